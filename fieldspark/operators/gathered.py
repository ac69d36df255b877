"""Many small groups at once: a group's rows travel as one array in the row of their owner.

Python workers then read batches of owners, which costs far less than one exchange for each group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A batch ends at about so many bytes, so owners of many rows come in small batches.
BATCH_BYTES = 16 << 20


def as_arrays(rows: DataFrame, by: Sequence[str], cols: Sequence[str], name: str) -> DataFrame:
    """One row for each ``by``, with ``cols`` of its rows as an array of structs of doubles."""
    return rows.groupBy(*by).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in cols])).alias(name))


def dealt(owners: DataFrame, by: Sequence[str]) -> DataFrame:
    """The owners in as many partitions as the session has for shuffles: few bytes may be much work."""
    spark = owners.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return owners.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)


def matrices(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The array of each owner as a matrix of doubles, one row an element; no rows where it is NULL."""
    lists = batch.column(name)
    items = lists.flatten()
    flat = np.column_stack([items.field(i).to_numpy(zero_copy_only=False) for i in range(items.type.num_fields)])
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    return (flat[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))


def in_order(m: np.ndarray) -> np.ndarray:
    """The rows sorted by their columns, the first one first."""
    return m[np.lexsort(m.T[::-1])] if len(m) > 1 else m
