"""Summary statistics, scores, histograms and quantile trimming."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.numbering import dense_ranks
from fieldspark.operators.quantiles import exact_quantiles, quantile_name

MEASURES = ("size", "num_not_nan", "num_inf", "min", "mean", "max", "std", "skew", "kurtosis")
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Doubles are split at this part of one to be summed.
SPLIT = float(1 << 26)


def measure(col: str | Column, name: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    table = {
        "size": lambda: F.count(F.lit(1)),
        "num_not_nan": lambda: F.count(c),
        "num_inf": lambda: F.sum(F.when(F.abs(c) == float("inf"), 1).otherwise(0)),
        "min": lambda: F.min(c), "mean": lambda: F.avg(c), "max": lambda: F.max(c),
        "std": lambda: F.stddev_pop(c), "skew": lambda: F.skewness(c), "kurtosis": lambda: F.kurtosis(c),
    }
    if name not in table:
        raise ValueError(f"unknown measure {name!r}")
    return table[name]()


def steady_mean(c: Column) -> Column:
    """The mean of a double column, which the order of its rows does not change.

    A sum of doubles is off by what the order of its rows makes of it; a mean that ends in a 5 then goes up or down by chance
    when it is rounded.  Here the multiples of 1 / SPLIT and the rests are summed apart.  Both sums are exact for n values of 0 or
    between n / 2**27 and 2**27 / n, whatever their signs; beyond, they are as good as a sum of doubles.
    """
    split = F.abs(c) < SPLIT
    high = F.when(split, F.rint(c * SPLIT) / SPLIT).otherwise(c)
    return (F.sum(high) + F.sum(F.when(split, c - high).otherwise(0.0))) / F.count(c)


def statistics(df: DataFrame, val_col: str, by: Sequence[str] = (), measures: Sequence[str] = MEASURES, qs: Sequence[float] = QUANTILES, approximate: int | None = None) -> DataFrame:
    """One row per group: the measures in one aggregation, then the quantiles.

    Quantiles are exact, by counted brackets (a few passes, bounded memory); with ``approximate`` (an accuracy)
    they come from a sketch in the first aggregation.
    """
    out = [measure(val_col, m).alias(m) for m in measures]
    if not qs:
        return df.groupBy(*by).agg(*out)
    if approximate is not None:
        agg = df.groupBy(*by).agg(*out, F.percentile_approx(val_col, list(qs), approximate).alias("_q"))
        return agg.withColumns({quantile_name(q): F.col("_q")[i] for i, q in enumerate(qs)}).drop("_q")
    return _with_groups(df.groupBy(*by).agg(*out), exact_quantiles(df, val_col, qs, by), by)


def _with_groups(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with the row of its group; without groups there is one row for all."""
    side = per_group.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[F.col(f"`{c}`") for c in per_group.columns if c not in by])
    if not by:
        return df.crossJoin(F.broadcast(side))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)])
    return df.join(side, same).drop(*[f"_g{i}" for i in range(len(by))])


def block_statistics(df: DataFrame, block_col: str, block_size: int, val_col: str, **options) -> DataFrame:
    """Statistics over blocks of consecutive distinct values of ``block_col``.

    The distinct values are ranked on their own, in ranges; rows get the block by a join.
    """
    ranked = dense_ranks(df, [block_col], "_rank").select(block_col, F.floor((F.col("_rank") - 1) / block_size).alias("block"))
    return statistics(df.join(ranked, block_col), val_col, ["block"], **options)


def describe_blocks(blocks: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Of the statistics of blocks, how each is spread: one row a column."""
    rows = blocks.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("r")).select("r.*")
    return statistics(rows, "v", ["column"], ("num_not_nan", "mean", "std", "min", "max"), (0.25, 0.5, 0.75))


def histogram(df: DataFrame, col: str, n_bins: int, low: float | None = None, high: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts of ``n_bins`` equal bins between low and high (the data's range if not given)."""
    if low is None or high is None:
        r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        low, high = (r["lo"] if low is None else low), (r["hi"] if high is None else high)
    width = (high - low) / n_bins
    inside = df.where((F.col(col) >= low) & (F.col(col) <= high))
    index = F.least(F.floor((F.col(col) - low) / width), F.lit(n_bins - 1)).cast("int")
    counts = inside.groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumns({"bin_low": low + F.col("bin") * width, "bin_high": low + (F.col("bin") + 1) * width})


def quantile_clip(df: DataFrame, col: str, q_low: float, q_high: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows between two exact quantiles of their group, both included; groups are told apart null-safely."""
    limits = exact_quantiles(df, col, [q_low, q_high], by).toDF(*by, "_low", "_high")
    return _with_groups(df, limits, by).where(F.col(col).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def quantile_limits(df: DataFrame, by: Sequence[str], col: str, qs: Sequence[float] = (0.01, 0.99)) -> DataFrame:
    """Colour limits: exact quantiles of each group."""
    return exact_quantiles(df, col, qs, by)


def down_sample(df: DataFrame, max_rows: int, key_cols: Sequence[str], total: int | None = None) -> DataFrame:
    """About ``max_rows`` rows, the same ones each time and on any engine: by the MD5 of the key's text."""
    total = df.count() if total is None else total
    if total <= max_rows:
        return df
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.where(place < F.lit(int((1 << 32) * max_rows / total)))


def rmse(y: Column, mu: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - mu, 2)))


def nll_terms(y: Column, mu: Column, sig: Column) -> Column:
    """Negative log density of each row under a normal distribution."""
    return F.log(sig * math.sqrt(2 * math.pi)) + F.pow(y - mu, 2) / (2 * sig * sig)


def scores(df: DataFrame, y: str, mu: str, var: str, by: Sequence[str] = ()) -> DataFrame:
    """n, rmse, mse, total and mean negative log density and the mean normalised difference."""
    y_, m_, s_ = F.col(y), F.col(mu), F.sqrt(F.col(var))
    rows = df.where(y_.isNotNull() & m_.isNotNull() & F.col(var).isNotNull())
    nll = nll_terms(y_, m_, s_)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), rmse(y_, m_).alias("rmse"), F.avg(F.pow(y_ - m_, 2)).alias("mse"),
        F.sum(nll).alias("nll"), F.avg(nll).alias("mean_nll"), F.avg((y_ - m_) / s_).alias("mean_norm_diff"),
    )
