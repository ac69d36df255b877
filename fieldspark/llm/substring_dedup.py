"""Substring dedup: drop words of windows that an earlier document also holds.

A window is ``width`` consecutive words of one text, taken byte for byte.  A word is removed if some
window over it also starts in a document with a smaller doc_id; windows are judged on the input.

A count-min prefilter spares most windows the exact grouping.  Each window is counted under its
anchor, the least fingerprint of its runs of ``ANCHOR`` words: equal windows have equal anchors, so
a sketch of anchor counts (each document counts an anchor once) overestimates the count of every
window.  Each partition makes its own sketch; the sketches are merged segment by segment, and of the
sum only the bits "estimated in two documents or more" are kept: ``2 * 2**bits`` bits, with ``bits``
at most ``MAX_BITS``, are broadcast.  The second pass takes only windows estimated repeated and
groups them exactly by a 96-bit fingerprint: first inside each task, where all but the smallest
document of a window are settled, then one row for each task and window across the cluster.  So a
window that a third of all documents hold costs one row a task.  A sketch too small for its input
lets more windows through and loses none.

Null texts have no words.  Rows without a doc_id and texts with fewer than ``width`` words keep all
words.  Rows that repeat a doc_id are one document with several texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import Words, binary_column, chunks, new_text, sliding_min, small_batches, table, window_hashes

WIDTH = 50
ANCHOR = 30
#: Windows that a task holds before it sends what it found.
HELD = 2_000_000
SEGMENT = 20
MAX_BITS = 28


def _windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows that stay in one text, their anchors, and word fingerprints."""
    h = w.hashes()
    anchors = sliding_min(window_hashes(h, ANCHOR), width - ANCHOR + 1)
    at = np.flatnonzero(w.doc[: len(anchors)] == w.doc[width - 1 :]) if len(anchors) else np.zeros(0, np.int64)
    return at, anchors[at], h


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each anchor in either row of the sketch."""
    return [(anchors >> np.uint64(64 - bits)).astype(np.int64), (anchors * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - bits)).astype(np.int64)]


def sketch_bits(docs: DataFrame) -> int:
    """About two counters for each anchor that the input can hold."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MAX_BITS, max(SEGMENT, math.ceil(math.log2(max(2, size / 6 / 10 * 4)))))


def repeated_bits(docs: DataFrame, bits: int, width: int = WIDTH) -> np.ndarray:
    """Merged sketch: for each row and counter whether two documents or more counted there."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, segments, cells, counts = [], [], [], []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            for row, at in enumerate(_cells(every, bits)):
                at, n = np.unique(at, return_counts=True)
                n = np.minimum(n, 2).astype(np.uint8)
                cuts = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << SEGMENT))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[s], cuts[s + 1])
                    rows.append(row)
                    segments.append(s)
                    cells.append((at[part] & ((1 << SEGMENT) - 1)).astype("<u4").tobytes())
                    counts.append(n[part].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(segments, pa.int32()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], names=["row", "segment", "cells", "counts"])
            for x in (rows, segments, cells, counts):
                x.clear()

        n = 0
        for b in batches:
            for _, texts in chunks(binary_column(b)):
                w = Words(texts)
                at, anchors, _ = _windows(w, width)
                if not len(at):
                    continue
                owner = w.doc[at]
                new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])])
                pairs = np.unique(np.stack([owner[new].astype(np.uint64), anchors[new]]), axis=1)
                held.append(pairs[1])
                n += pairs.shape[1]
                if n > 4_000_000:
                    yield from flush()
                    n = 0
        yield from flush()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << SEGMENT, np.uint8)
        for cells, counts in zip(part["cells"], part["counts"], strict=True):
            at = np.frombuffer(cells, "<u4")
            total[at] = np.minimum(2, total[at] + np.frombuffer(counts, np.uint8))
        at = np.flatnonzero(total)
        return pd.DataFrame({"row": part["row"].iloc[:1], "segment": part["segment"].iloc[:1], "cells": [at.astype("<u4").tobytes()], "counts": [total[at].tobytes()]})

    schema = "row int, segment int, cells binary, counts binary"
    sketches = docs.where("doc_id is not null").select("text").mapInArrow(partial, schema)
    # two rounds, so that no task meets the sketches of all partitions
    salted = sketches.withColumn("salt", F.spark_partition_id() % 32)
    some = salted.groupBy("row", "segment", "salt").applyInPandas(lambda part: merge(part), schema)
    bits_set = np.zeros((2, 1 << bits >> 3), np.uint8)
    for r in some.groupBy("row", "segment").applyInPandas(merge, schema).toLocalIterator():
        total = np.zeros(1 << SEGMENT, np.uint8)
        total[np.frombuffer(r["cells"], "<u4")] = np.frombuffer(r["counts"], np.uint8) >= 2
        lo = r["segment"] << SEGMENT >> 3
        bits_set[r["row"], lo : lo + (1 << SEGMENT >> 3)] = np.packbits(total, bitorder="little")
    return bits_set


def _estimated(anchors: np.ndarray, bits_set: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    for row, at in zip(bits_set, _cells(anchors, bits), strict=True):
        out &= (row[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def removed_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fingerprint (f1) of each window to remove; a document may hold it several times."""
    spark = docs.sparkSession
    bits = sketch_bits(docs)
    shared = spark.sparkContext.broadcast(repeated_bits(docs, bits, width))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            f1, f2, doc = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(3))
            held.clear()
            order = np.lexsort((doc, f2, f1))
            f1, f2, doc = f1[order], f2[order].astype(np.int32), doc[order]
            new = np.ones(len(f1), bool)
            new[1:] = (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
            other = new.copy()
            other[1:] |= doc[1:] != doc[:-1]
            f1, f2, doc, new = f1[other], f2[other], doc[other], new[other]
            return pa.RecordBatch.from_arrays([pa.array(f1), pa.array(f2), pa.array(doc), pa.array(~new)], names=["f1", "f2", "doc_id", "sure"])

        size = 0
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for first, texts in chunks(binary_column(b)):
                w = Words(texts)
                at, anchors, h = _windows(w, width)
                at = at[_estimated(anchors, shared.value, bits)]
                if not len(at):
                    continue
                f2 = window_hashes(w.hashes(1), width, 1)[at] >> np.uint64(33)
                held.append((window_hashes(h, width)[at].view(np.int64), f2.astype(np.int64), ids[first + w.doc[at]]))
                size += len(at)
                if size > HELD:
                    yield flush()
                    size = 0
        yield flush()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by window and document: those that are not their window's smallest."""
        last: tuple[int, int, int] | None = None  # window and smallest document so far
        for b in batches:
            f1, f2, doc, sure = (b.column(c).to_numpy(zero_copy_only=False) for c in ("f1", "f2", "doc_id", "sure"))
            open_at = np.flatnonzero(~sure)
            gone = sure.copy()
            if len(open_at):
                a, c, d = f1[open_at], f2[open_at], doc[open_at]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
                if last is not None and (a[0], c[0]) == last[:2]:
                    new[0] = False
                run = np.cumsum(new)
                least = np.concatenate([[last[2] if last is not None else 0], d[new]])
                gone[open_at] = d > least[run]
                last = (a[-1], c[-1], least[run[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(f1[gone])], names=["doc_id", "f1"])

    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(emit, "f1 bigint, f2 int, doc_id bigint, sure boolean")
    dealt = rows.repartition(F.when(F.col("sure"), F.xxhash64("doc_id", "f1")).otherwise(F.col("f1"))).sortWithinPartitions("f1", "f2", "doc_id")
    return dealt.mapInArrow(judge, "doc_id bigint, f1 bigint")


def covered(w: Words, i: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words of text ``i`` lie under a window that starts at one of ``starts``."""
    n = int(w.first[i + 1] - w.first[i])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(docs: DataFrame, extra: list[str], width: int, digest: bool) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, the kept words (or their digest) and ``extra``."""
    small_batches(docs.sparkSession)
    gone = removed_windows(docs, width).groupBy("doc_id").agg(F.collect_list("f1").alias("gone"))
    own = [F.col(c).alias(f"c{i}_") for i, c in enumerate(extra)]
    joined = docs.select("doc_id", "text", *own).join(gone.select(F.col("doc_id").alias("g_id"), "gone"), F.col("doc_id") == F.col("g_id"), "left").drop("g_id")
    kept_type = "string" if digest else "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("gone")
            n_words, n_removed, kept = [], [], []
            for first, texts in chunks(binary_column(b)):
                w = Words(texts)
                h = None
                for i, t in enumerate(texts):
                    n = int(w.first[i + 1] - w.first[i])
                    n_words.append(n)
                    gone_here = lists[first + i]
                    words = t.split() if digest or gone_here.is_valid else []
                    removed = 0
                    if gone_here.is_valid:
                        if h is None:
                            h = window_hashes(w.hashes(), width).view(np.int64)
                        own = h[w.first[i] : max(w.first[i], w.first[i + 1] - width + 1)]
                        at = np.flatnonzero(np.isin(own, gone_here.values.to_numpy()))
                        out = covered(w, i, at, width)
                        removed = int(out.sum())
                        words = [x for x, o in zip(words, out.tolist(), strict=True) if not o]
                    n_removed.append(removed)
                    if digest:
                        kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    else:
                        kept.append(b" ".join(words) if removed else t)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()) if digest else pa.array(kept, pa.binary(), mask=np.asarray(b.column("text").is_null())), *[b.column(f"c{i}_") for i in range(len(extra))]],
                names=["doc_id", "n_words", "n_removed", "kept", *[f"c{i}_" for i in range(len(extra))]],
            )

    fields = "".join(f", c{i}_ {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    return joined.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, kept {kept_type}{fields}")


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, each without the removed words: those kept, joined by one space.

    A text that loses nothing stays as it is.  ``n_chars``, where there is one, follows the text.
    """
    rest = [c for c in docs.columns if c != "text"]
    out = _apply(docs, rest, width, digest=False)
    text = F.col("kept").cast("string")
    return out.select(*[new_text(docs, c, text, rest) for c in docs.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _apply(table(spark, sf_dir, "documents"), [], WIDTH, digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m WHERE doc_id > first),
r AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
