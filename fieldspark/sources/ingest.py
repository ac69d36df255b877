"""Incremental ingest: batches of files that a ledger does not hold yet."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.sources.scan import listed_files, read_files
from fieldspark.sources.store import Store

#: The partition column of an ingested table.
BATCH = "batch_id"
_FILE = "_ingested_file"
#: The table of files and their batches is sent to every task up to this length.
MOST_FILES = 100_000
LEDGER_SCHEMA = "file_dir string, sub_dir string, config_id int, n_rows bigint"


def new_batches(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batches without a ledger row; keys are compared null-safe."""
    keys = ["file_dir", "sub_dir", "config_id"]
    cond = F.lit(True)
    for k in keys:
        cond &= batches[k].eqNullSafe(ledger[k])
    return batches.join(ledger, cond, "left_anti")


def batch_id(file_dir: str, sub_dir: str | None, config_id: int) -> str:
    """The partition of a batch; a letter in front keeps it text when partitions are listed."""
    return "b" + hashlib.sha256(json.dumps([file_dir, sub_dir, config_id]).encode()).hexdigest()[:32]


def ingest(spark: SparkSession, store: Store, table: str, file_dirs: Sequence[str], regex: str, sub_dirs: Sequence[str | None] = (None,), config: Any = None, overwrite: bool = False, **read_options: Any) -> int:
    """Append every new batch (directory x sub-directory x config) and note it; the rows appended.

    All new batches are read in one scan, each row finds its batch by its file, and all are written at once, as one
    partition (``batch_id``) a batch; the number of Spark jobs does not depend on that of batches.  If the scan fails, it is
    tried again with either half of the batches, so that one that cannot be read keeps no other back.

    A batch that cannot be read or is empty is logged and left for the next run.  A partition is replaced
    by the rows of its batch, so batches that were written but not noted when a run died are written again in their place.
    """
    ledger_name = f"_{table}_batches"
    config_id = store.config_id(config if config is not None else read_options)
    batches = spark.createDataFrame([(d, s, config_id) for d in file_dirs for s in sub_dirs], "file_dir string, sub_dir string, config_id int")
    if not overwrite and store.exists(ledger_name):
        batches = new_batches(batches, store.read(ledger_name))
    files: dict[tuple[str, str | None], list[tuple[str, str]]] = {}
    for b in batches.orderBy("file_dir", "sub_dir").collect():
        try:
            found = listed_files(b["file_dir"], regex, b["sub_dir"])
        except FileNotFoundError as e:
            logging.warning("batch %s skipped: no directory %s", b, e)
            continue
        if found:
            files[b["file_dir"], b["sub_dir"]] = found
        else:
            logging.warning("batch %s has no files", b)
    total, fresh = 0, overwrite

    def append(part: list[tuple[str, str | None]]) -> None:
        nonlocal total, fresh
        if not part:
            return
        try:
            ids = {batch_id(d, s, config_id): (d, s) for d, s in part}
            names = [(name, batch_id(d, s, config_id)) for d, s in part for _, name in files[d, s]]
            rows = read_files(spark, sorted({path for key in part for path, _ in files[key]}), file_col=_FILE, **read_options)
            side = spark.createDataFrame(names, f"{_FILE} string, {BATCH} string")
            rows = rows.join(F.broadcast(side) if len(names) <= MOST_FILES else side, _FILE).drop(_FILE)
            if rows.isEmpty():
                logging.warning("batches %s are empty", part)
                return
            if fresh:
                # an overwrite that dies on its way must not leave the old ledger beside new rows
                store.write(spark.createDataFrame([], LEDGER_SCHEMA), ledger_name)
            store.write(rows, table, append=not fresh, config=config, partition_by=[BATCH], replace_partitions=True)
        except (PySparkException, Py4JJavaError) as e:
            if len(part) == 1:
                logging.warning("batch %s skipped: %s", part[0], e)
            else:
                append(part[: len(part) // 2])
                append(part[len(part) // 2 :])
            return
        written = store.read(table).join(spark.createDataFrame([(i,) for i in ids], f"{BATCH} string"), BATCH, "left_semi")
        counts = written.groupBy(BATCH).agg(F.count("*").alias("n")).collect()  # a row a new batch
        store.write(spark.createDataFrame([(*ids[r[BATCH]], config_id, r["n"]) for r in counts], LEDGER_SCHEMA), ledger_name, append=True)
        for i in set(ids) - {r[BATCH] for r in counts}:
            logging.warning("batch %s is empty", ids[i])
        total, fresh = total + sum(r["n"] for r in counts), False

    append(list(files))
    return total
