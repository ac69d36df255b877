"""Joins that compare tables: tolerance matches, differences, common locations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(x: DataFrame, y: DataFrame, x_col: str, y_col: str, tol: float | None = None, check: bool = False) -> DataFrame:
    """Rows of ``x`` with ``y_idx``: the least ``idx`` of ``y`` whose value equals, or is within ``tol``.

    A row's match depends on its value alone, so each distinct value is matched once.  Tolerance matches meet
    in buckets of width ``tol``, each x in three.  With ``check`` a value that has no match is an error; else
    its index is NULL, as it is for NULL.
    """
    right = y.select(F.col(y_col).alias("_y"), F.col("idx").alias("y_idx"))
    values = x.select(F.col(x_col).alias("_x")).distinct().where("_x is not null")
    if tol is None:
        pairs = values.join(right, F.col("_x") == F.col("_y"))
    else:
        b = lambda c: F.floor(F.col(c) / (tol or 1e-300)).cast("long")
        near = values.withColumn("_b", F.explode(F.sequence(b("_x") - 1, b("_x") + 1)))
        pairs = near.join(right.withColumn("_b", b("_y")), "_b").where(F.abs(F.col("_x") - F.col("_y")) < tol)
    first = pairs.groupBy("_x").agg(F.min("y_idx").alias("y_idx"))
    out = x.join(first, F.col(x_col) == F.col("_x"), "left").drop("_x")
    if check and out.where("y_idx is null").limit(1).count():
        raise ValueError("a value has no match")
    return out


def compare_tables(a: DataFrame, b: DataFrame, on: Sequence[str], columns: Sequence[str], how: str = "full", suffixes: tuple[str, str] = ("_1", "_2")) -> DataFrame:
    """Outer join with the absolute and the relative difference of each column next to its two values."""
    left = a.select(*on, *[F.col(c).alias(c + suffixes[0]) for c in columns])
    right = b.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in columns])
    out = [F.col(c) for c in on]
    for c in columns:
        x, y = F.col(c + suffixes[0]), F.col(c + suffixes[1])
        diff = F.abs(x - y)
        small = F.least(F.abs(x), F.abs(y))
        out += [x, y, diff.alias(f"{c}_abs_diff"), F.when(small != 0, diff / small).alias(f"{c}_rel_diff")]
    return left.join(right, list(on), how).select(*out)


def differences(a: DataFrame, b: DataFrame, on: Sequence[str], column: str, tol: float) -> DataFrame:
    """Rows of the comparison beyond the tolerance, largest first."""
    c = compare_tables(a, b, on, [column])
    return c.where(F.col(f"{column}_abs_diff") > tol).orderBy(F.desc(f"{column}_abs_diff"), *on)


def common_locations(parts: Sequence[DataFrame], coords: Sequence[str]) -> list[DataFrame]:
    """Each part restricted to the locations that all hold."""
    common = reduce(lambda p, q: p.intersect(q), [p.select(*coords) for p in parts])
    return [p.join(common, list(coords), "left_semi") for p in parts]


def join_rounded(a: DataFrame, b: DataFrame, coords: Sequence[str], decimals: int, how: str = "inner") -> DataFrame:
    """Equi-join on coordinates rounded on both sides."""
    keys = [f"_r{i}" for i in range(len(coords))]
    rounded = lambda df: df.withColumns({k: F.round(F.col(c).cast("double"), decimals) for k, c in zip(keys, coords, strict=True)})
    return rounded(a).join(rounded(b).drop(*coords), keys, how).drop(*keys)


def not_done(experts: DataFrame, done: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Experts that ``done`` does not hold, by null-safe coordinates."""
    cond = reduce(lambda p, q: p & q, [experts[c].eqNullSafe(done[c]) for c in coords])
    return experts.join(done, cond, "left_anti")


def of_experts(results: DataFrame, chosen: DataFrame, coords: Sequence[str]) -> DataFrame:
    return results.join(chosen, list(coords), "left_semi")
