"""N-gram Jaccard join: size-banded tiles with bitmap signatures, then exact intersection.

A document is the set of its ``SHINGLE``-word shingles (64-bit fingerprints of lower-cased words).
Two documents link when 100 * |A & B| >= 75 * |A | B|.

1. Documents with equal sets form a class; the smallest doc_id stands for it from here on.
2. All shingles are put in one global order, common ones last.  Two linked sets share a shingle
   within the first ``n - ceil(0.75 n) + 1`` of each; these prefixes are the tiles' keys.  Frequency
   comes from a fixed number of counters; it moves work, never a result.
3. A tile is a prefix shingle and a size band; sizes in a band differ by less than 4/3, so a linked
   partner is in the same band or the next.  In rounds every row first meets one leader of its tiles
   only.  In the first round a tile's leader is its most central member, that whose prefix shingles
   the most others share for its size: among near copies the one that links with the most.  In later rounds it is
   drawn by a hash of the id that is the same in all tiles.  A row takes the leader of most of its
   tiles, so a round of m rows has at most m pairs.  Tiles of one component take no further part.
   Rounds go on, with new draws, while one pair in ``PAYS`` links and more than ``FEW`` are met.
4. What is left are pairs in one tile but in different components.  The rows outside a tile's largest component
   meet the rest of the tile, so a tile of one large component and a few others costs only what the others ask.
   The asked rows are dealt out in blocks of about ``TILE_ROWS``; sizes and the places of the shared shingle
   bound the overlap.
5. Candidates of each round meet the bitmaps of their hashed shingles: a bit set in A and not in B
   proves an element of A outside B, so bit counts bound the overlap from above.
6. Those that pass are verified by intersecting the sorted fingerprint arrays.

A pair inside one component is never needed for the result and is left out once that is known; no
other pair is skipped.  Tables of a round are deleted when the next one has been written.

Empty texts have the empty set and link with nothing.  Rows without a doc_id get no component.  Rows
that repeat a doc_id are one node.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import Words, binary_column, bit_filter, chunks, dropped, may_hold, mix, small_batches, table, window_hashes, written
from fieldspark.llm.components import components

SHINGLE = 5
PERCENT = 75
COUNTERS, SEGMENT = 23, 19
TILE_ROWS = 4096
SMALL_SETS = 4 << 20
PAYS, FEW = 8, 16


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text; a shorter text is one shingle."""
    w = Words([t.lower() for t in texts])
    h = w.hashes()
    all_windows = window_hashes(h, SHINGLE)
    for i in range(w.n_docs):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        if hi - lo >= SHINGLE:
            yield np.unique(all_windows[lo : hi - SHINGLE + 1])
        elif hi > lo:
            yield window_hashes(h[lo:hi], hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares at least with any that it links with."""
    return -(-PERCENT * n // 100)


def bitmap(s: np.ndarray) -> bytes:
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(s) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the width of the smallest."""
    width = min(map(len, signatures))
    out = np.zeros((len(signatures), width // 8), np.uint64)
    for i, s in enumerate(signatures):
        out[i] = np.bitwise_or.reduce(np.frombuffer(s, "<u8").reshape(-1, width // 8), axis=0)
    return out


def links_possible(a_bits: np.ndarray, a_n: np.ndarray, b_bits: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    """For all pairs of two blocks, whether the bit counts allow a link."""
    out = np.zeros((len(a_n), len(b_n)), bool)
    for i in range(len(a_n)):
        only_a = np.bitwise_count(a_bits[i] & ~b_bits).sum(axis=1, dtype=np.int64)
        only_b = np.bitwise_count(b_bits & ~a_bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(a_n[i] - only_a, b_n - only_b)
        out[i] = (100 + PERCENT) * most >= PERCENT * (a_n[i] + b_n)
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both) and both > 0


def common_counters(docs: DataFrame) -> np.ndarray:
    """Frequency class of each counter: 0 for the usual load, more for every doubling above it.

    Each task counts into all counters, capped at 255, and sends them segment by segment; segments
    are summed in two rounds, so no task meets those of all others.
    """
    size = 1 << SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.uint8)
        for b in batches:
            for _, texts in chunks(binary_column(b)):
                every = np.concatenate(list(shingle_sets(texts)))
                at, n = np.unique((every >> np.uint64(64 - COUNTERS)).astype(np.int64), return_counts=True)
                total[at] = np.minimum(total[at] + n, 255)
        parts = [zlib.compress(total[i : i + size].tobytes(), 1) for i in range(0, len(total), size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["segment", "counts"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.uint32)
        for c in part["counts"]:
            raw = zlib.decompress(c)
            total += np.frombuffer(raw, np.uint8 if len(raw) == size else "<u4")
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "counts": [zlib.compress(total.astype("<u4").tobytes(), 1)]})

    schema = "segment int, counts binary"
    sketches = docs.select("text").mapInArrow(run, schema).withColumn("salt", F.spark_partition_id() % 32)
    some = sketches.groupBy("segment", "salt").applyInPandas(merge, schema)
    merged = written(some.groupBy("segment").applyInPandas(merge, schema), "counters")

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for c in x["counts"]:
                n = np.frombuffer(zlib.decompress(c), "<u4").astype(float)
                usual = max(8.0, 2 * n.mean())  # shingles spread evenly, so one segment's mean will do
                out.append(zlib.compress(np.where(n > usual, np.maximum(1, np.log2(np.maximum(n, 1) / usual) + 1), 0).astype(np.uint8).tobytes()))
            yield pd.DataFrame({"segment": x["segment"], "counts": out})

    out = np.zeros(1 << COUNTERS, np.uint8)
    for r in merged.mapInPandas(classes, schema).collect():
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    dropped(merged)
    return out


def prefix(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order (frequency class, fingerprint)."""
    size = len(s) - least_overlap(len(s)) + 1
    if not len(s):
        return s
    own = classes[(s >> np.uint64(64 - COUNTERS)).astype(np.int64)]
    return s[:size] if not own.any() else s[np.argsort(own, kind="stable")[:size]]


def set_key(s: np.ndarray) -> np.uint64:
    """A fingerprint of a set; with its size and ``second_key`` it stands for the set."""
    return mix(s).sum(dtype=np.uint64)


def second_key(s: np.ndarray) -> np.uint64:
    return np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15))


def longs(keys: list[np.uint64]) -> pa.Array:
    return pa.array(np.array(keys, np.uint64).view(np.int64))


def set_keys(docs: DataFrame) -> DataFrame:
    """doc_id, n and the key of the set (two longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2 = [], [], []
            for _, texts in chunks(binary_column(b)):
                for s in shingle_sets(texts):
                    n.append(len(s))
                    k1.append(second_key(s))
                    k2.append(set_key(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), longs(k1), longs(k2)], names=["doc_id", "n", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n int, k1 bigint, k2 bigint")


def set_heads(docs: DataFrame, classes: np.ndarray, copies: DataFrame) -> DataFrame:
    """doc_id, n, bitmap and prefix of each set that is not empty, without the sets of ``copies``.

    A filter tells most documents from the copies; only those that it may hold meet the exact list.
    """
    copied = bit_filter(copies.select(F.xxhash64("b").alias("key")), "key")
    shared = docs.sparkSession.sparkContext.broadcast((classes, copied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, copied = shared.value
        for b in batches:
            n, bits, first, k2 = [], [], [], []
            for _, texts in chunks(binary_column(b)):
                for s in shingle_sets(texts):
                    n.append(len(s))
                    k2.append(set_key(s))
                    bits.append(bitmap(s) if len(s) else b"")
                    first.append(prefix(s, classes).view(np.int64))
            maybe = may_hold(copied, b.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), longs(k2), pa.array(maybe), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "n", "k2", "maybe", "bits", "prefix"])

    every = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    heads = written(every.mapInArrow(run, "doc_id bigint, n int, k2 bigint, maybe boolean, bits binary, prefix array<bigint>").where("n > 0"), "set-heads")
    unsure = heads.where("maybe").join(copies.select(F.col("b").alias("doc_id"), "k2"), ["doc_id", "k2"], "left_anti")
    names = ["doc_id", "n", "bits", "prefix"]
    return heads.where("not maybe").select(names).unionByName(written(unsure.select(names), "heads-of-copies"))


def band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(100 / PERCENT)).cast("int")


def sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def fingerprint_arrays(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, k2 and sorted fingerprints of the documents in ``ids`` (and a few by chance)."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64("doc_id").alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(may_hold(wanted.value, b.column("key").to_numpy())))
            sets, keys = [], []
            for _, texts in chunks(binary_column(b)):
                for s in shingle_sets(texts):
                    sets.append(s.tobytes())
                    keys.append(set_key(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), longs(keys), pa.array(sets, pa.binary())], names=["doc_id", "k2", "s"])

    some = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    return some.mapInArrow(run, "doc_id bigint, k2 bigint, s binary")


def verified(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection; a written table.

    Sets that take up to ``SMALL_SETS`` bytes in all are sent to every task, once for all their pairs; more are shuffled.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    arrays = written(fingerprint_arrays(docs, ids), "fingerprints")
    once = arrays.dropDuplicates(["doc_id", "k2"])
    small = (arrays.agg(F.sum(F.length("s") + 64)).first()[0] or 0) <= SMALL_SETS
    sent = F.broadcast if small else lambda df: df
    left = sent(once.select(F.col("doc_id").alias("a"), F.col("s").alias("a_s")))
    right = sent(once.select(F.col("doc_id").alias("b"), F.col("s").alias("b_s")))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_s", "b_s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("a_s").to_pylist(), batch.column("b_s").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = written(both.mapInArrow(run, "a bigint, b bigint"), name)
    dropped(arrays)
    return out


def bitmaps_allow(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Drop the pairs whose bitmaps rule a link out."""
    left = heads.select(F.col("doc_id").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"))
    right = heads.select(F.col("doc_id").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_n", "b_n", "a_bits", "b_bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("a_bits", "b_bits", "a_n", "b_n")), strict=True):
                f = folded([x, y])
                ok.append(bool(links_possible(f[:1], np.array([n]), f[1:], np.array([m]))[0, 0]))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def overlap_possible(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of n and m shingles, whose first common one is at places pos and at, may link."""
    return F.least(n - pos, m - at) * (100 + PERCENT) >= (n + m) * PERCENT


def places(heads: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, n, pos, h of the prefix shingles that may be in ``shared``; a filter spares the join most others."""
    filter_bits = heads.sparkSession.sparkContext.broadcast(bit_filter(shared, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("prefix")
            h = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ok = np.flatnonzero(may_hold(filter_bits.value, h))
            own = pa.array(owner[ok])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), b.column("n").take(own), pa.array(pos[ok].astype(np.int32)), pa.array(h[ok])], names=["doc_id", "n", "pos", "h"])

    return heads.select("doc_id", "n", "prefix").mapInArrow(run, "doc_id bigint, n int, pos int, h bigint")


class Alike(NamedTuple):
    """Further columns of tile rows, and conditions on those of two rows, which are given as functions of a name."""

    columns: Sequence[str] = ()
    #: whether they may link
    fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] = lambda a, b: F.lit(True)
    #: whether of all tiles that hold both this one, h, is the one to meet in
    here: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] = lambda a, b: F.lit(True)


ANY = Alike()


def leader_pairs(tiles: DataFrame, number: int, alike: Alike = ANY) -> DataFrame:
    """At most one pair for each row of the tiles: with the leader, in another component, of most of its tiles."""
    draw = F.struct(F.lit(0.0) if number else -F.col("central"), F.xxhash64("doc_id", F.lit(number)))
    pick = F.struct(draw.alias("draw"), "n", "doc_id", "pos", "comp", *alike.columns)
    # written first: both sides of the join are then plain exchanges, and a hot tile can be split
    leaders = written(tiles.groupBy("h", "band").agg(F.min(pick).alias("leader")), "leaders")
    below = tiles.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).join(leaders, ["h", "band"])
    fit = sizes_fit(F.col("n"), F.col("leader.n")) & overlap_possible(F.col("n"), F.col("pos"), F.col("leader.n"), F.col("leader.pos"))
    fit &= alike.fits(F.col, lambda c: F.col(f"leader.{c}"))
    stars = below.where((F.col("comp") != F.col("leader.comp")) & fit).groupBy("doc_id", F.col("leader.doc_id").alias("other")).agg(F.count("*").alias("tiles"))
    best = stars.groupBy("doc_id").agg(F.max_by("other", F.struct("tiles", F.xxhash64("other"))).alias("other"))
    out = written(best.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct(), "leader-pairs")
    dropped(leaders)
    return out


def still_mixed(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of tiles that hold more than one component."""
    names = [c for c in tiles.columns if c != "comp"]
    named = tiles.select(names).join(labels, F.col("doc_id") == F.col("node"), "left").select(*names, F.coalesce("root", "doc_id").alias("comp"))
    mixed = written(named.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h"), "mixed-tiles")
    out = written(named.join(mixed, "h"), "tile-rows")
    dropped(tiles, mixed)
    return out


def tile_candidates(tiles: DataFrame, alike: Alike = ANY) -> DataFrame:
    """Pairs of one tile in different components that sizes and places allow."""
    parts = tiles.groupBy("h", "comp").agg(F.count("*").alias("m")).groupBy("h").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.sum("m").alias("m"))
    rows = written(tiles.join(written(parts, "tile-parts"), "h"), "tile-rows")
    blocks = F.ceil(F.col("m") / TILE_ROWS).cast("int")
    outside = (F.col("comp") != F.col("largest")).alias("outside")
    asked = rows.select("h", "band", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), F.col("doc_id").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"), F.col("comp").alias("b_comp"), outside, *[F.col(c).alias(f"b_{c}") for c in alike.columns])
    asking = rows.where("comp <> largest").select("h", F.explode(F.array([F.col("band") + i for i in (-1, 0, 1)])).alias("band"), F.sequence(F.lit(0), blocks - 1).alias("blocks"), F.col("doc_id").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("comp").alias("a_comp"), *[F.col(c).alias(f"a_{c}") for c in alike.columns])
    asking = asking.withColumn("block", F.explode("blocks")).drop("blocks")
    # two rows that both ask meet once
    fit = (F.col("a_comp") != F.col("b_comp")) & (~F.col("outside") | (F.col("a") < F.col("b"))) & sizes_fit(F.col("a_n"), F.col("b_n"))
    fit &= overlap_possible(F.col("a_n"), F.col("a_pos"), F.col("b_n"), F.col("b_pos"))
    for holds in (alike.fits, alike.here):
        fit &= holds(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    pairs = asking.join(asked, ["h", "band", "block"]).where(fit)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labels_of(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def jaccard_join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, n and class; links as pairs (a, b) that connect each component)."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    rows = written(set_keys(docs), "set-keys")
    usable = rows.where("doc_id is not null and n > 0")
    key = ["k1", "k2", "n"]
    classes = written(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last"), "classes")
    copies = written(usable.join(classes, key).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), "k2").distinct(), "copies")
    dropped(classes)
    heads = set_heads(docs, common_counters(docs), copies)
    shared = written(heads.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "shared-shingles")
    central = (F.sum("m").over(Window.partitionBy("doc_id")) / F.col("n")).alias("central")
    tiles = places(heads, shared).join(shared, "h").select("h", band(F.col("n")).alias("band"), "doc_id", "n", "pos", central, F.col("doc_id").alias("comp"))
    tiles = written(tiles, "tile-rows")
    dropped(shared)
    links = tile_links(tiles, lambda pairs, name: step(pairs, heads, docs, name))
    return rows.select("doc_id", "n"), links.unionByName(copies.select("a", "b"))


def tile_links(tiles: DataFrame, test: Callable[[DataFrame, str], DataFrame], alike: Alike = ANY) -> DataFrame:
    """Links (a, b) that join all rows of tiles which links of one tile can join; ``test`` keeps the pairs that link.

    ``tiles`` is a written table of h, band, doc_id, n, pos, central and comp (the doc_id at first), and what ``alike``
    asks for; it is deleted.
    """
    links, more, number = None, True, 0
    while more:
        pairs = leader_pairs(tiles, number, alike)
        new = test(pairs, "leader-links")
        tested, found = pairs.count(), new.count()
        dropped(pairs)
        links = new if links is None else links.unionByName(new)
        labels = labels_of(links)
        tiles = still_mixed(tiles, labels)
        dropped(labels)
        # a handful of rows may as well meet whole tiles
        more, number = found * PAYS > tested and tested > FEW, number + 1
    links = links.unionByName(test(tile_candidates(tiles, alike), "tile-links"))
    dropped(tiles)
    return links


def step(pairs: DataFrame, heads: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The links among some pairs: by bitmaps, then exactly."""
    passed = written(bitmaps_allow(pairs, heads), f"{name}-maybe")
    out = verified(passed, docs, name)
    dropped(passed)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, links = jaccard_join(docs)
    labels = labels_of(links)
    out = rows.join(labels, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; all columns come back.

    Rows without a doc_id stay.  Of rows that repeat a doc_id all stay or all go.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""
