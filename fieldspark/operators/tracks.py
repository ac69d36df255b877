"""Measurement tracks: gaps between consecutive observations, and numbers for the runs between gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.numbering import running_sum


def diff_distance(cols: Sequence[str], group: Sequence[str], order: Sequence[str], p: float = 2, k: int = 1, default: float | None = None) -> Column:
    """p-norm of the step from the row ``k`` back in the group; the first rows get ``default``."""
    w = Window.partitionBy(*group).orderBy(*order)
    steps = [F.pow(F.abs(F.col(c) - F.lag(c, k).over(w)), F.lit(float(p))) for c in cols]
    total = F.pow(reduce(lambda a, b: a + b, steps), F.lit(1.0 / p))
    return F.when(F.row_number().over(w) <= k, F.lit(default).cast("double")).otherwise(total)


def time_gap(col: str, group: Sequence[str], order: Sequence[str], unit_ms: float = 1.0) -> Column:
    """Absolute step in time from the row before, in milliseconds by default."""
    w = Window.partitionBy(*group).orderBy(*order)
    us = F.unix_micros(F.col(col).cast("timestamp"))
    return F.abs(us - F.lag(us).over(w)) / (1000.0 * unit_ms)


def number_tracks(df: DataFrame, gap_col: str, threshold: float, group: Sequence[str], order: Sequence[str], start: int = 0, out: str = "track") -> DataFrame:
    """Running count of gaps above the threshold (strictly; unknown gaps never count) per group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(F.when((F.col(gap_col) > threshold) & ~F.isnan(F.col(gap_col).cast("double")), 1).otherwise(0)).over(w) + start)


def continue_tracks(df: DataFrame, track_col: str, group: Sequence[str], first_by: str, start: int = 0) -> DataFrame:
    """Make numbers run on from one group to the next, in order of the groups' first ``first_by``.

    Groups are aggregated first; their sizes are summed up in ranges of the order, however many groups there are.
    """
    size = df.groupBy(*group).agg((F.max(track_col) + 1).alias("_n"), F.min(first_by).alias("_first"))
    offsets = running_sum(size, "_n", ["_first", *group], "_offset", include_own=False)
    offsets = offsets.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], (F.col("_offset") + start).alias("_offset"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
    return df.join(offsets, same).withColumn(track_col, F.col(track_col) + F.col("_offset")).drop("_offset", *[f"_g{i}" for i in range(len(group))])


def run_position(df: DataFrame, value_col: str, order: Sequence[str], group: Sequence[str] = (), out: str = "position") -> DataFrame:
    """0, 1, 2, ... restarting whenever the value differs from the row before."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.when(F.lag(value_col).over(w).eqNullSafe(F.col(value_col)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*group, "_run").orderBy(*order)
    return runs.withColumn(out, F.row_number().over(inside) - 1).drop("_new", "_run")


def track_starts(df: DataFrame, track_col: str, time_col: str, group: Sequence[str] = ()) -> DataFrame:
    """Per row the start of its track and the track's number within the date of that start."""
    with_start = df.withColumn("track_start", F.min(time_col).over(Window.partitionBy(*group, track_col)))
    day = F.to_date("track_start")
    w = Window.partitionBy(*group, day).orderBy("track_start", track_col)
    return with_start.withColumn("track_of_day", F.dense_rank().over(w) - 1)


def minimum_spacing(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Least gap between consecutive distinct values, per group."""
    values = df.select(*group, col).where(F.col(col).isNotNull()).distinct()
    if not group:  # ranges of values, each with the last value of the one before: no single-task window
        return minimum_spacing_all(values, col)
    gap = F.col(col) - F.lag(col).over(Window.partitionBy(*group).orderBy(col))
    return values.withColumn("_gap", gap).groupBy(*group).agg(F.min("_gap").alias("spacing"))


def minimum_spacing_all(values: DataFrame, col: str, buckets: int = 256) -> DataFrame:
    r = values.agg(F.min(col).alias("a"), F.max(col).alias("b")).first()
    span = (r["b"] - r["a"]) if r["a"] is not None else 0
    bucket = F.floor((F.col(col) - r["a"]) / (span or 1) * (buckets - 1)).cast("int") if r["a"] is not None else F.lit(0)
    marked = values.withColumn("_bucket", bucket)
    inner = marked.withColumn("_gap", F.col(col) - F.lag(col).over(Window.partitionBy("_bucket").orderBy(col)))
    ends = marked.groupBy("_bucket").agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    between = ends.withColumn("_gap", F.col("lo") - F.lag("hi").over(Window.orderBy("_bucket")))  # at most `buckets` rows
    return inner.select("_gap").unionByName(between.select("_gap")).agg(F.min("_gap").alias("spacing"))
