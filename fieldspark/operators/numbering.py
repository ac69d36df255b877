"""Running sums and ranks over a whole table, without a task that sees all rows.

Rows are sorted into ranges and written, so that a row's range is the same in every later pass.  Each range is
totalled, the totals (one row a range) are added up, and every range starts from the sum of those before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.sources.scratch import written

RANGES = 8


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``_range``, a number that grows with their place in the order; equal places share a range."""
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, value: str | Column, order: Sequence[str], out: str, include_own: bool = True) -> DataFrame:
    """Sum of ``value`` (NULL counts as 0) over all rows up to each one in the order; ``include_own`` counts the row itself.

    Rows that are equal in the order follow each other in no set order; add a column that tells them apart.
    A range holds rows of equal first places together, so such a column also spreads a frequent one.
    """
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    rows = in_ranges(df.withColumn("_v", v), order)
    before, total = {}, 0
    for r in rows.groupBy("_range").agg(F.sum("_v").alias("s")).orderBy("_range").collect():  # a row a range
        before[r["_range"]] = total
        total += r["s"]
    starts = F.array(*[F.lit(before.get(i)) for i in range(max(before, default=0) + 1)])
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("_v").over(w) - (0 if include_own else F.col("_v"))
    return rows.withColumn(out, own + F.get(starts, F.col("_range"))).drop("_v", "_range")


def dense_ranks(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """The distinct values of ``cols`` (NULL left out) with their place, from 1, in ascending order."""
    values = df.select(*cols).distinct()
    for c in cols:
        values = values.where(F.col(c).isNotNull())
    return running_sum(values, F.lit(1), cols, out)
