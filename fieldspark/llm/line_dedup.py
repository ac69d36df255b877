"""Line dedup by winnowing over line hashes: of equal runs of lines the first stays.

Lines are cut at ``\\n`` and compared without white space at their ends; lines without a word are
never compared and stay.  A run is ``min_run`` consecutive lines that have a word, by default one.  A line is deleted
if a run that covers it also starts at a lesser place, in the order of (doc_id, text, position).

1. *Winnow.*  Of every ``WINDOW`` consecutive lines the one with the least hash is selected (a shorter text is one window).
   Two texts that share a run of that length select the same line of it: its fingerprint is guaranteed.
2. *Join positions.*  A selected line travels with the hashes of the lines around it.  Tasks settle equal fingerprints
   among the lines that they hold, and send one place for each distinct one; the least place of all tasks is its first.
   So a hot line costs one row a block of lines, never all its copies.
3. *Extend.*  From a later place and its first, lines are compared both ways.  A run's next fingerprint is less than a window
   away, so what travels with a fingerprint reaches it, and the matches of a run join up.  Lines of a
   match of two lines or more are a later copy and go.
4. *Shortest runs.*  What no match covers, repeated lines that stand alone among others above all, is compared as
   runs of ``min_run`` lines by the hash of the whole run, settled in the same way.  Runs within a match take no part:
   they have been seen at a lesser place.

Lines are told apart by 128 bits: of two hashes of 64, or of two lines or more.  Null and empty texts lose nothing;
rows without a doc_id pass unchanged; rows that repeat doc_id and text count as one document and get the same
result.  All input columns come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import binary_column, chunks, new_text, sliding_min, small_batches, table, window_hashes, written

WINDOW = 4
#: Lines that are settled among themselves before their places are sent.
BLOCK_LINES = 500_000


def line_hashes(text: bytes) -> np.ndarray:
    """Two hashes of each line with a word, as rows."""
    found = b"".join(xxhash.xxh3_128_digest(x) for x in map(bytes.strip, text.split(b"\n")) if x)
    return np.frombuffer(found, ">u8").reshape(-1, 2).astype(np.uint64)


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def selected(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of every window of lines; the last of equal ones."""
    if not len(h):
        return np.zeros(0, np.int64)
    window = min(window, len(h))
    least = sliding_min(h, window)
    # of equal minima the last: looked for from the right
    at = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(least)) + window - 1 - (at[:, ::-1] == least[:, None]).argmax(axis=1))


def surroundings(h: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The hashes from window - 1 lines before to as many after each place; 0 beyond the text."""
    edge = np.zeros(window - 1, np.uint64)
    return np.concatenate([edge, h, edge])[at[:, None] + np.arange(2 * window - 1)]


def extension(mine: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """How many lines before and after each selected line are equal in both surroundings, without a gap."""
    same = (mine == first) & (mine != 0)
    before = np.logical_and.accumulate(same[:, : window - 1][:, ::-1], axis=1).sum(axis=1)
    return before, np.logical_and.accumulate(same[:, window:], axis=1).sum(axis=1)


def first_of(place: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """For each row the index of the row with the least place among those of equal keys."""
    order = np.lexsort((*reversed(place), *reversed(keys)))
    if not len(order):
        return order
    new = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def is_later(place: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Whether a row's place differs from that of its first."""
    return np.logical_or.reduce([p != p[first] for p in place])


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, t (key of the text) and the hashes of its lines; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for _, texts in chunks(binary_column(b)):
                keys += [text_key(x) for x in texts]
                found += [line_hashes(x).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "t", "h"])

    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return written(some.mapInArrow(run, "doc_id bigint, t bigint, h binary").where(F.length("h") > 0), "line-hashes")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of hashed_lines (and what was joined to them) in blocks of about BLOCK_LINES lines."""
    held, lines = [], 0
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            held.append(part)
            lines += sum(len(x) for x in part.column("h").to_pylist()) // 16
            if lines >= BLOCK_LINES:
                yield pa.Table.from_batches(held)
                held, lines = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _texts(block: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    for i, x in enumerate(block["h"].to_pylist()):
        yield i, np.frombuffer(x, np.uint64).reshape(-1, 2)


_NONE = [np.zeros(0, np.int64)]


def matched_runs(lines: DataFrame, min_run: int) -> DataFrame:
    """doc_id, t, lo, hi: runs of lines that a selected line shows to be a later copy."""
    least = max(2, min_run)
    width = 2 * WINDOW - 1

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, keys = block["doc_id"].to_numpy(), block["t"].to_numpy()
            owner, at, around = [*_NONE], [*_NONE], [np.zeros((0, width), np.uint64)]
            for i, h in _texts(block):
                places = selected(h[:, 0])
                owner.append(np.full(len(places), i))
                at.append(places)
                around.append(surroundings(h[:, 0], places))
            owner, at, around = np.concatenate(owner), np.concatenate(at), np.concatenate(around)
            place = [ids[owner], keys[owner], at]
            first = first_of(place, [around[:, WINDOW - 1]])
            later = is_later(place, first)
            before, after = extension(around, around[first])
            run = later & (before + after + 1 >= least)
            alone = np.flatnonzero(first == np.arange(len(first)))
            yield _match_rows(place, around, alone, np.flatnonzero(run), before, after)

    names = ["fingerprint", "doc_id", "t", "pos", "around", "lo", "hi"]

    def _match_rows(place, around, alone, run, before, after) -> pa.RecordBatch:
        rows = np.concatenate([alone, run])
        none = np.arange(len(rows)) >= len(alone)
        lo, hi = place[2] - before, place[2] + after
        return pa.RecordBatch.from_arrays(
            [
                pa.array(around[rows, WINDOW - 1].view(np.int64), mask=none), pa.array(place[0][rows]), pa.array(place[1][rows]), pa.array(place[2][rows].astype(np.int32)),
                pa.array([around[k].tobytes() for k in alone] + [None] * len(run), pa.binary()), pa.array(lo[rows].astype(np.int32), mask=~none), pa.array(hi[rows].astype(np.int32), mask=~none),
            ],
            names=names,
        )

    rows = written(lines.mapInArrow(settle, "fingerprint bigint, doc_id bigint, t bigint, pos int, around binary, lo int, hi int"), "line-places")
    first = F.min(F.struct("doc_id", "t", "pos", "around")).over(Window.partitionBy("fingerprint")).alias("first")
    across = rows.where("fingerprint is not null").select("doc_id", "t", "pos", "around", first)
    across = across.where(F.struct("doc_id", "t", "pos") > F.struct("first.doc_id", "first.t", "first.pos")).select("doc_id", "t", "pos", "around", F.col("first.around").alias("first"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine, first = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, width) for c in ("around", "first"))
            before, after = extension(mine, first)
            at = b.column("pos").to_numpy()
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array((at - before).astype(np.int32)), pa.array((at + after).astype(np.int32))], names=["doc_id", "t", "lo", "hi"])
            yield out.filter(pa.array(before + after + 1 >= least))

    found = across.mapInArrow(extend, "doc_id bigint, t bigint, lo int, hi int")
    return written(rows.where("fingerprint is null").select("doc_id", "t", "lo", "hi").unionByName(found).distinct(), "line-matches")


def shortest_runs(lines: DataFrame, matches: DataFrame, min_run: int) -> DataFrame:
    """doc_id, t, lo, hi: later copies among the runs of ``min_run`` lines that lie in no match."""
    known = matches.groupBy("doc_id", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("known"))
    left = lines.join(known, ["doc_id", "t"], "left")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, keys, known = block["doc_id"].to_numpy(), block["t"].to_numpy(), block["known"].to_pylist()
            owner, at, runs = [*_NONE], [*_NONE], [np.zeros((0, 2), np.uint64)]
            for i, h in _texts(block):
                h = h if min_run == 1 else np.stack([window_hashes(np.ascontiguousarray(h[:, k]), min_run, k) for k in (0, 1)], axis=1)
                free = np.ones(len(h), bool)
                for r in known[i] or ():
                    free[r["lo"] : max(r["lo"], r["hi"] - min_run + 2)] = False
                places = np.flatnonzero(free)
                owner.append(np.full(len(places), i))
                at.append(places)
                runs.append(h[places])
            owner, at, runs = np.concatenate(owner), np.concatenate(at), np.concatenate(runs).view(np.int64)
            place = [ids[owner], keys[owner], at]
            first = first_of(place, [runs[:, 0], runs[:, 1]])
            later = is_later(place, first)
            keep = np.flatnonzero(later | (first == np.arange(len(first))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[0][keep]), pa.array(place[1][keep]), pa.array(at[keep].astype(np.int32)), *[pa.array(runs[keep, k], mask=later[keep]) for k in (0, 1)]],
                names=["doc_id", "t", "pos", "line", "line2"],
            )

    rows = written(left.mapInArrow(settle, "doc_id bigint, t bigint, pos int, line bigint, line2 bigint"), "run-places")  # no line: a lesser place of it was in the same block
    place = F.struct("doc_id", "t", "pos")
    first = F.min(place).over(Window.partitionBy("line", "line2"))
    across = rows.where("line is not null").select("doc_id", "t", "pos", (place > first).alias("gone")).where("gone").drop("gone")
    every = rows.where("line is null").select("doc_id", "t", "pos").unionByName(across)
    return every.select("doc_id", "t", F.col("pos").alias("lo"), (F.col("pos") + (min_run - 1)).alias("hi"))


def repeated_runs(docs: DataFrame, min_run: int) -> DataFrame:
    """doc_id, t (key of the text), lo and hi (first and last line) of the runs to delete."""
    lines = hashed_lines(docs)
    matches = matched_runs(lines, min_run)
    return matches.unionByName(shortest_runs(lines, matches, min_run))


def _apply(docs: DataFrame, extra: list[str], digest: bool, min_run: int = 1) -> DataFrame:
    small_batches(docs.sparkSession)
    gone = repeated_runs(docs, min_run).groupBy(F.col("doc_id").alias("g_id"), "t").agg(F.collect_list(F.struct("lo", "hi")).alias("places"))
    gone = gone.groupBy("g_id").agg(F.collect_list(F.struct("t", "places")).alias("gone"))
    own = [F.col(c).alias(f"c{i}_") for i, c in enumerate(extra)]
    joined = docs.select("doc_id", "text", *own).join(gone, F.col("doc_id") == F.col("g_id"), "left").drop("g_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_removed, kept = [], [], []
            gone_col = b.column("gone")
            for first, texts in chunks(binary_column(b)):
                for place, text in enumerate(texts):
                    cell = gone_col[first + place]
                    found = {g["t"]: g["places"] for g in cell.as_py()} if cell.is_valid else {}
                    lines = text.split(b"\n")
                    at = [k for k, x in enumerate(lines) if x.strip()]
                    drop: set[int] = set()
                    if found:
                        drop.update(at[k] for r in found.get(text_key(text), []) for k in range(r["lo"], r["hi"] + 1))
                    if drop:
                        text = b"\n".join([x for k, x in enumerate(lines) if k not in drop])
                    n_lines.append(len(at))
                    n_removed.append(len(drop))
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()) if digest else pa.array(kept, pa.binary(), mask=np.asarray(b.column("text").is_null())), *[b.column(f"c{i}_") for i in range(len(extra))]],
                names=["doc_id", "n_lines", "n_removed", "kept", *[f"c{i}_" for i in range(len(extra))]],
            )

    fields = "".join(f", c{i}_ {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    return joined.mapInArrow(run, f"doc_id bigint, n_lines bigint, n_removed bigint, kept {'string' if digest else 'binary'}{fields}")


def line_dedup(docs: DataFrame, min_run: int = 1) -> DataFrame:
    """The documents without the deleted lines; ``n_chars``, where there is one, follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    out = _apply(docs, rest, False, min_run)
    text = F.col("kept").cast("string")
    return out.select(*[new_text(docs, c, text, rest) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and the digest of the text that is left."""
    out = _apply(table(spark, sf_dir, "documents"), [], digest=True)
    return out.select("doc_id", "n_lines", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
           FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT *, trim(line, E' \t\n\r\x0b\x0c') <> '' AS has_word, row_number() OVER (PARTITION BY trim(line, E' \t\n\r\x0b\x0c') ORDER BY doc_id, pos) AS k FROM l)
SELECT doc_id, count(*) FILTER (WHERE has_word) AS n_lines, count(*) FILTER (WHERE has_word AND k > 1) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT has_word OR k = 1), '')) AS kept_sha256
FROM b GROUP BY doc_id
"""
