"""Structured Streaming forms: incremental file ingest, tables of daily bins, tracks by time gap."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fieldspark.functions.columns import ColumnSpec, add_columns, nan_to_null, select_columns
from fieldspark.functions.predicates import select_rows
from fieldspark.operators.binning import Axis


def stream_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv", options: dict[str, Any] | None = None, col_funcs: Sequence[ColumnSpec] = (), row_select: Any = None, col_select: Sequence[str] | None = None) -> DataFrame:
    """New files as a stream, with the batch scan's derived columns, filters and projection."""
    df = spark.readStream.format(fmt).schema(schema).options(**({"header": True} if fmt == "csv" else {}) | dict(options or {})).load(path)
    return select_columns(select_rows(add_columns(nan_to_null(df), col_funcs), row_select), col_select)


def ingest_available(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append what is new since the last run and stop; the checkpoint takes the ledger's place."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append")
    return (writer.partitionBy(*partition_by) if partition_by else writer).start(path)


def daily_bins(df: DataFrame, time_col: str, val_col: str, x: tuple[str, Axis], y: tuple[str, Axis], by: Sequence[str] = (), delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Mean and count per window, group and bin; rows later than the watermark are dropped."""
    (x_col, x_axis), (y_col, y_axis) = x, y
    rows = df.withColumns({"ix": x_axis.index(F.col(x_col)), "iy": y_axis.index(F.col(y_col))}).where("ix is not null and iy is not null")
    watched = rows.withWatermark(time_col, delay) if df.isStreaming else rows
    out = watched.groupBy(F.window(time_col, window).alias("w"), *by, "ix", "iy").agg(F.avg(val_col).alias(val_col), F.count(val_col).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *by, x_axis.centre(F.col("ix")).alias(x_col), y_axis.centre(F.col("iy")).alias(y_col), val_col, "n")


def track_sessions(df: DataFrame, time_col: str, group: Sequence[str], gap: str, values: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """Tracks as session windows: rows at most ``gap`` apart belong together."""
    watched = df.withWatermark(time_col, delay) if df.isStreaming else df
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values]]
    out = watched.groupBy(*group, F.session_window(time_col, gap).alias("s")).agg(*aggs)
    return out.select(*group, F.col("s.start").alias("track_start"), F.col("s.end").alias("track_end"), "n", *values)


def replace_batch(batch: DataFrame, batch_id: int, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a micro-batch as partitions of its own, in place of what an earlier try of the same batch left."""
    rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by, "batch").parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run a stream over what is available into a table, batch by batch; a batch that is run again changes nothing.

    ``prepare`` is applied to each micro-batch as a plain DataFrame.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        replace_batch(prepare(batch) if prepare else batch, batch_id, path, partition_by)

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_bin_sums(df: DataFrame, time_col: str, val_col: str, x: tuple[str, Axis], y: tuple[str, Axis], by: Sequence[str] = ()) -> DataFrame:
    """day, by, ix, iy, s and n of each day and bin: what daily means are made of, and what batches can add up."""
    (x_col, x_axis), (y_col, y_axis) = x, y
    rows = df.withColumns({"day": F.to_date(time_col), "ix": x_axis.index(F.col(x_col)), "iy": y_axis.index(F.col(y_col))})
    return rows.where("day is not null and ix is not null and iy is not null").groupBy("day", *by, "ix", "iy").agg(F.sum(val_col).alias("s"), F.count(val_col).alias("n"))


def write_daily_bins(df: DataFrame, path: str, checkpoint: str, time_col: str, val_col: str, x: tuple[str, Axis], y: tuple[str, Axis], by: Sequence[str] = ()) -> StreamingQuery:
    """Keep a table of daily bins by a stream: each batch replaces its own share of the days that it touches.

    No watermark is needed: rows of any age add to their day.
    """
    return write_stream(df, path, checkpoint, ["day"], lambda batch: daily_bin_sums(batch, time_col, val_col, x, y, by))


def read_daily_bins(spark: SparkSession, path: str, val_col: str, x: tuple[str, Axis], y: tuple[str, Axis], by: Sequence[str] = ()) -> DataFrame:
    """Mean and count per day, group and bin, all batches together."""
    sums = spark.read.parquet(path).groupBy("day", *by, "ix", "iy").agg((F.sum("s") / F.sum("n")).alias(val_col), F.sum("n").alias("n"))
    return sums.select("day", *by, x[1].centre(F.col("ix")).alias(x[0]), y[1].centre(F.col("iy")).alias(y[0]), val_col, "n")


class TrackNumbers(StatefulProcessor):
    """The last time and track number of each group of a bucket, as keyed state: one value a bucket."""

    def __init__(self, time_col: str, group: Sequence[str], order: Sequence[str], threshold_us: float, start: int, names: Sequence[str]):
        self.time_col, self.group, self.order, self.threshold_us, self.start, self.names = time_col, list(group), list(order), threshold_us, start, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracks", "groups binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        part = pd.concat(list(rows), ignore_index=True).sort_values(self.order, na_position="first", kind="stable", ignore_index=True)
        code = part.groupby(self.group, dropna=False, sort=False).ngroup().to_numpy()
        place = np.argsort(code, kind="stable")
        part, code = part.take(place).reset_index(drop=True), code[place]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        # a bucket's rows have the same columns of the group missing
        keys = [tuple(None if pd.isna(x) else x for x in k) for k in part.loc[first, self.group].itertuples(index=False, name=None)]
        never = np.iinfo(np.int64).min
        last, track = (np.array(x, np.int64) for x in zip(*(held.get(k, (never, self.start)) for k in keys), strict=True))
        known = part[self.time_col].notna().to_numpy()
        us = pd.Series(part[self.time_col].to_numpy("datetime64[us]").astype("int64"))[known]
        own = code[known]
        # rows older than what was seen before open no track
        seen = np.maximum(us.groupby(own).cummax().to_numpy(), last[own])
        new = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
        before = np.where(new, np.where(last[own] == never, us, last[own]), np.concatenate([[never], seen])[: len(own)])
        opened = np.zeros(len(part), np.int64)
        opened[known] = us.to_numpy() - before > self.threshold_us
        tracks = track[code] + pd.Series(opened).groupby(code).cumsum().to_numpy()
        ends = np.append(first[1:], len(part)) - 1
        np.maximum.at(last, own, us.to_numpy())
        held |= {k: (int(t), int(n)) for k, t, n in zip(keys, last, tracks[ends], strict=True) if t != never}
        self.state.update((pickle.dumps(held),))
        yield part.assign(track=tracks)[self.names]

    def close(self) -> None:
        pass


def stream_tracks(df: DataFrame, time_col: str, group: Sequence[str], order: Sequence[str], threshold: timedelta, start: int = 0, buckets: int = 1024) -> DataFrame:
    """The rows of a stream with their ``track``, which runs on over micro-batches and restarts.

    A row more than ``threshold`` after the one before it in its group opens a track.  Batches that come in the order of
    time give what ``number_tracks`` gives on the whole table; a row that comes late takes the group's current
    track.  Rows without a time take it too.  Groups are dealt into ``buckets``, as a call of Python and an exchange of state cost
more than numbering a group; a checkpoint goes with their number.  A task holds the rows of a bucket in one micro-batch,
which ``maxFilesPerTrigger`` bounds.
    """
    bucket = F.pmod(F.xxhash64(*group), F.lit(buckets)).cast("int")
    nulls = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(group)), F.lit(0))
    schema = T.StructType([*df.schema.fields, T.StructField("track", T.LongType())])
    numbers = TrackNumbers(time_col, group, order, threshold / timedelta(microseconds=1), start, schema.names)
    return df.withColumns({"_bucket": bucket, "_nulls": nulls}).groupBy("_bucket", "_nulls").transformWithStateInPandas(numbers, schema, "append", "none")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which keyed state needs; the session is left as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_tracks(df: DataFrame, path: str, checkpoint: str, time_col: str, group: Sequence[str], order: Sequence[str], threshold: timedelta, start: int = 0) -> StreamingQuery:
    """Number the tracks of what is available and append it to a table, each batch once; the checkpoint keeps the groups' state."""
    with keyed_state(df.sparkSession):
        return write_stream(stream_tracks(df, time_col, group, order, threshold, start), path, checkpoint)
