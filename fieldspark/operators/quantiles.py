"""Exact quantiles of all groups in bounded memory, by counted brackets.

A bracket is an interval of a group's values in which a wanted rank lies.  Each pass cuts every bracket into ``BINS``
equal bins, counts them in one aggregation, and keeps the bins that hold a wanted rank; the rows outside are not
read again.  A bin whose values are all equal is an answer, however many rows it has.  Of bins of at most
``SMALL`` rows the distinct values are counted, sorted and their ranks picked.  No task holds a group's values, and no map of
them is made.  Rows carry numbers and their bracket's path alone: wanted ranks, which are lists, meet bins and distinct values, so
that rows are counted by hashing and never sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.sources.scratch import written

BINS = 512
SMALL = 100_000
_LARGEST = 1.7976931348623157e308


def quantile_name(q: float) -> str:
    return f"q{q:.3f}"


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by and q0.000-like columns: the values that linear interpolation between order statistics gives.

    NULL and NaN take no part; a group without any other value has NULL quantiles.  Groups are told apart
    null-safely.  Infinite values are ordinary ends of the order; between one and a finite value the result is infinite.
    """
    g = [f"_g{i}" for i in range(len(by))]
    v = F.col(col).cast("double")
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(by, g, strict=True)], v.alias("_v"))
    rows = rows.select(*g, F.when(F.col("_v").isNotNull() & ~F.isnan("_v"), F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), F.col("_v")))).alias("_v"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in g], F.lit(True))
    group = written(rows.groupBy(*g).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "quantile-groups")
    # the ranks on both sides of each quantile
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.array(*[f(at(q)).cast("long") for q in qs for f in (F.floor, F.ceil)]))
    brackets = group.where("_n > 0").select(*g, F.lit("").alias("_path"), "_n", F.lit(0).cast("long").alias("_before"), "_lo", "_hi", ranks.alias("_ranks"))
    rows = rows.where(F.col("_v").isNotNull()).withColumn("_path", F.lit(""))
    found = []
    while True:
        brackets = written(brackets, "quantile-brackets")
        found.append(brackets.where("_lo = _hi").select(*g, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_value")))
        open_ = brackets.where("_lo < _hi")
        side = open_.select(*g, "_path", "_n", "_lo", "_hi")
        wanted = open_.select(*g, "_path", "_before", "_ranks")
        asked = lambda x: x.alias("x").join(wanted.alias("w"), same("x", "w") & (F.col("x._path") == F.col("w._path"))).select("x.*", "w._before", "w._ranks")
        met = rows.alias("r").join(side.alias("b"), same("r", "b") & (F.col("r._path") == F.col("b._path")))
        met = met.select(*[F.col(f"r.{c}").alias(c) for c in g], F.col("b._path").alias("_path"), F.col("r._v").alias("_v"), F.col("b._n").alias("_n"), F.col("b._lo").alias("_lo"), F.col("b._hi").alias("_hi"))
        met = written(met, "quantile-rows")
        # few rows: sort their values
        few = met.where(F.col("_n") <= SMALL).groupBy(*g, "_path", "_v").agg(F.count("*").alias("_m"))
        order = Window.partitionBy(*g, "_path").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        few = asked(few.withColumn("_below", F.sum("_m").over(order) - F.col("_m")))
        first = F.col("_before") + F.col("_below")
        found.append(few.select(*g, F.explode(F.filter("_ranks", lambda r: (r >= first) & (r < first + F.col("_m")))).alias("_rank"), F.col("_v").alias("_value")))
        large = met.where(F.col("_n") > SMALL)
        if large.isEmpty():
            break
        # halves, so that the width of the largest bracket is a finite number
        bin_ = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * (BINS - 1)).cast("int")
        cut = large.withColumn("_bin", bin_)
        bins = cut.groupBy(*g, "_path", "_bin").agg(F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        below = F.sum("_m").over(Window.partitionBy(*g, "_path").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
        bins = asked(bins.withColumn("_below", below)).withColumn("_from", F.col("_before") + F.col("_below"))
        bins = bins.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_m")))).where(F.size("_ranks") > 0)
        path = F.concat_ws("/", "_path", F.col("_bin").cast("string")).alias("_path")
        brackets = bins.select(*g, path, F.col("_m").alias("_n"), F.col("_from").alias("_before"), "_lo", "_hi", "_ranks")
        rows = cut.select(*g, path, "_v")
    every = reduce(lambda a, b: a.unionByName(b), found).groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    every = written(every, "quantile-values")
    out = group.alias("r").join(every.alias("b"), same("r", "b"), "left").select(*[F.col(f"r.{c}").alias(c) for c in g], "_n", "_at")

    def value(q: float):
        low, high = (F.col("_at")[f(at(q)).cast("long")] for f in (F.floor, F.ceil))
        infinite = lambda x: F.when(x == _LARGEST, float("inf")).when(x == -_LARGEST, float("-inf")).otherwise(x)
        low, high, part = infinite(low), infinite(high), at(q) - F.floor(at(q))
        return F.when(low == high, low).when(part == 0, low).otherwise(low * (1 - part) + high * part)

    if any(math.isnan(q) or not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    return out.select(*[F.col(a).alias(c) for a, c in zip(g, by, strict=True)], *[value(q).alias(quantile_name(q)) for q in qs])
