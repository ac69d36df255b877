"""Document fingerprints: MinHash signatures, what they say about likeness, and near copies by signature bands.

A text's shingles are its runs of ``SHINGLE`` words (a shorter text is one shingle), as 64-bit fingerprints of
words with A-Z lower-cased.  Each of ``PERMUTATIONS`` universal hashes a * x + b modulo 2**64, with odd a, permutes
these; the shingle that comes first under it is one position of the signature.  A position is stored as one byte
of that shingle's mixed hash, so a fingerprint is 128 bytes whatever the text.  Two fingerprints agree in the share
J + (1 - J) / 256 of their positions, J being the Jaccard similarity of the sets; ``likeness`` solves that for J.

``near_copies`` joins bands of ``BAND`` positions: documents with an equal band form a tile, whose rows meet as in
the n-gram join, by leaders in rounds and then across components.  Exact copies are one class before that.
Every pair that is met is verified by the exact Jaccard similarity (75 % or more links).  With 16 bands
of 5 positions a pair at 75 % shares a band with probability 0.99, one at 85 % with 0.9999.

Pairs whose fingerprints differ in more than ``DIFFERENT`` of 128 positions are not met.  Four bits of each position are
compared for that, as bit planes in the join; at 75 % 30 differ on average, and 95 % of such pairs pass, all but
a few in ten thousand at 80 %.  So near copies just at the bound may be missed, as by the bands; links that are found are exact.

``fingerprints`` reads texts in the order of doc_id, each with the next one.  Ids are cut into ranges by their
quantiles, so a task has neighbours next to each other, and the first document of a range also
goes to the range before.  Texts are shuffled once; the classes of ``near_copies`` travel with them.

Null and empty texts have no shingle: equal to each other, unlike any other, linked with nothing.  Rows without a
doc_id take no part.  Rows that repeat a doc_id are ordered by text; as near copies they are one node.  After the last
document the first follows; a single document follows itself.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import Words, binary_column, chunks, dropped, mix, small_batches, table, window_hashes, written
from fieldspark.llm.components import components
from fieldspark.llm.ngram_jaccard import SHINGLE, Alike, tile_links, verified

PERMUTATIONS = 128
BANDS, BAND = 16, 5
#: Ranges of ids for each shuffle partition: so many that partitions get about the same number of rows.
RANGES = 8
_RANDOM = np.random.default_rng(20240131)
_A = _RANDOM.integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 64, PERMUTATIONS, np.uint64)
PLANES, DIFFERENT = 4, 38
#: What a byte of unrelated sets agrees by chance.
CHANCE = 1 / 256


_WORDS = PERMUTATIONS // 64
_PLANES = [f"p{i}_{w}" for i in range(PLANES) for w in range(_WORDS)]


def _alike(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether the planes of two rows differ in at most DIFFERENT positions."""
    differ = [reduce(lambda x, y: x.bitwiseOR(y), [a(f"p{i}_{w}").bitwiseXOR(b(f"p{i}_{w}")) for i in range(PLANES)]) for w in range(_WORDS)]
    return reduce(lambda x, y: x + y, [F.bit_count(d) for d in differ]) <= DIFFERENT


def _least_shared(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether h is the least of the bands that two rows share: a pair then comes once, however many it shares."""
    return F.array_min(F.array_intersect(a("bands"), b("bands"))) == F.col("h")


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(one row of PERMUTATIONS bytes a text, number of shingles with repeats)."""
    w = Words([t.lower() for t in texts])
    h = w.hashes()
    n_words = np.diff(w.first)
    windows = window_hashes(h, SHINGLE)
    whole = np.flatnonzero(n_words >= SHINGLE)
    size = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    start = np.cumsum(size) - size
    x = np.zeros(int(size.sum()), np.uint64)
    if len(whole):
        # windows that start in a text's last words run into the next text and are left out
        k = np.repeat(w.first[whole] - (np.cumsum(size[whole]) - size[whole]), size[whole]) + np.arange(int(size[whole].sum()))
        x[np.repeat(n_words >= SHINGLE, size)] = windows[k]
    for i in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)):
        x[start[i]] = window_hashes(h[w.first[i] : w.first[i + 1]], int(n_words[i]))[0]
    out = np.zeros((len(texts), PERMUTATIONS), np.uint8)
    some = np.flatnonzero(size)
    if len(some):
        for p in range(PERMUTATIONS):
            least = np.minimum.reduceat(x * _A[p] + _B[p], start[some])
            out[some, p] = (mix(least) & np.uint64(255)).astype(np.uint8)
    return out, size


def likeness(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the sets behind some pairs of fingerprints, 0 to 1."""
    share = (a == b).mean(axis=-1)
    out = np.clip((share - CHANCE) / (1 - CHANCE), 0, 1)
    empty, other = a_size == 0, b_size == 0
    return np.where(empty | other, (empty & other).astype(float), out)


def signature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), two longs that stand for the text, the fingerprint, and its low bits as planes of 64 positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, prints, planes = [], [], [], []
            for _, texts in chunks(binary_column(b)):
                rows, size = signatures(texts)
                prints += [r.tobytes() for r in rows]
                bits = np.stack([np.packbits(rows >> p & 1, axis=1, bitorder="little").view("<i8") for p in range(PLANES)], axis=1)
                planes.append(bits.reshape(len(rows), -1))
                n += size.tolist()
                keys += [xxhash.xxh3_128_digest(t.lower()) for t in texts]
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(prints, pa.binary()), *[pa.array(x) for x in np.concatenate(planes or [np.zeros((0, len(_PLANES)), np.int64)]).T]], names=["doc_id", "n", "k1", "k2", "print", *_PLANES])

    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return some.mapInArrow(run, "doc_id bigint, n int, k1 bigint, k2 bigint, print binary, " + ", ".join(f"{c} bigint" for c in _PLANES))


def band_tiles(heads: DataFrame) -> DataFrame:
    """Rows that share a band with another, as tiles of the n-gram join."""
    bands = F.array([F.xxhash64(F.lit(i), F.substring("print", 1 + i * BAND, BAND)) for i in range(BANDS)])
    rows = heads.select("doc_id", F.explode(bands).alias("h"))
    shared = rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("h", "m")
    # distinct shingles are fewer than shingles, by a factor that is not known here: one size band for all
    zero = F.lit(0)
    # the row that shares most bands with others leads its tiles first
    own = Window.partitionBy("doc_id")
    central, own_bands = F.sum("m").over(own).cast("double").alias("central"), F.collect_set("h").over(own).alias("bands")
    tiles = rows.join(written(shared, "shared-bands"), "h").select("h", "doc_id", central, own_bands).join(heads.select("doc_id", *_PLANES).dropDuplicates(["doc_id"]), "doc_id")
    tiles = tiles.select("h", zero.alias("band"), "doc_id", F.lit(1).alias("n"), zero.alias("pos"), "central", F.col("doc_id").alias("comp"), "bands", *_PLANES)
    return written(tiles, "band-rows")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id linked with it, over any number of links) of the documents that have a near copy."""
    small_batches(docs.sparkSession)
    rows = written(signature_rows(docs).where("n > 0"), "signatures")
    key = ["k1", "k2"]
    classes = written(rows.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last"), "copies")
    copied = rows.join(classes, key).where("doc_id <> rep").select("doc_id", "rep", *key).distinct()
    copied = written(copied, "copy-links")
    heads = rows.join(copied.select("doc_id", *key), ["doc_id", *key], "left_anti")
    tiles = band_tiles(heads)
    links = tile_links(tiles, lambda pairs, name: verified(pairs, docs, name), Alike([*_PLANES, "bands"], _alike, _least_shared))
    every = links.unionByName(copied.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    out = components(every.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))
    dropped(rows, classes, copied)
    return out


def _range_of(bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are not above doc_id, by halving."""
    steps = [1 << i for i in range(max(1, len(bounds)).bit_length() - 1, -1, -1)]
    every = F.array([F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    ahead = lambda lo, step: (lo + step <= len(bounds)) & (F.coalesce(F.get(every, lo + step - 1), F.lit(0)) <= F.col("doc_id"))
    return F.aggregate(F.array([F.lit(s) for s in steps]), F.lit(0), lambda lo, step: F.when(ahead(lo, step), lo + step).otherwise(lo))


def neighbours(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents, dealt by ranges of doc_id and sorted; a range ends with the first document of the next, marked ``copy``.

    A row that has a class_id holds no document but the class of those that follow with its doc_id.
    """
    spark = docs.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))
    place = _range_of(bounds)
    first = {r["range"]: r["first"] for r in ids.groupBy(place.alias("range")).agg(F.min("doc_id").alias("first")).collect()}  # at most n rows
    order = sorted(first)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    lowest = F.array([F.lit(first.get(r)).cast("long") for r in range(len(bounds) + 1)])
    prior = F.array([F.lit(before.get(r, 0)) for r in range(len(bounds) + 1)])
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("range", place)
    own, other = F.struct(F.col("range"), F.lit(False).alias("copy")), F.struct(F.get(prior, F.col("range")).alias("range"), F.lit(True).alias("copy"))
    both = F.when(F.col("doc_id") == F.get(lowest, F.col("range")), F.array(own, other)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", F.explode(both).alias("to")).select("to.range", "to.copy", "doc_id", "text")
    dealt = dealt.withColumn("class_id", F.lit(None).cast("long"))
    marks = classes.select(place.alias("range"), F.lit(False).alias("copy"), "doc_id", F.lit(None).cast("string").alias("text"), "class_id")
    return dealt.unionByName(marks).repartition("range").sortWithinPartitions("range", "copy", "doc_id", F.col("class_id").desc_nulls_last(), "text")


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """(code points, the text with its last quarter replaced by the beginning of the following one)."""
    x = text.decode()
    k = len(x) // 4
    return len(x), (x[: len(x) - k] + following.decode()[:k]).encode() if k else text


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and class_id of every document.

    class_id is the smallest doc_id among its near copies, its own without any.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"]
        held: tuple[tuple[int, bool, int, int], bytes] | None = None  # the last row so far waits for its next one
        known = (None, None)  # the last doc_id with a class, and the class
        for b in batches:
            marks = []
            for r, copy, i, c in zip(*(b.column(c).to_pylist() for c in ("range", "copy", "doc_id", "class_id")), strict=True):
                known = (i, c) if c is not None else known
                marks.append((r, copy, i, known[1] if known[0] == i else i))
            no_document = b.column("class_id").is_valid().to_pylist()
            for at, texts in chunks(binary_column(b)):
                rows = [(marks[at + k], t) for k, t in enumerate(texts) if not no_document[at + k]]
                rows = [held, *rows] if held else rows
                if not rows:
                    continue
                held = rows[-1]
                # a copy only follows; of several first documents with one id, the first copy counts
                pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][0][1] and rows[i][0][0] == rows[i + 1][0][0]]
                if not pairs:
                    continue
                made = [edited(rows[i][1], rows[j][1]) for i, j in pairs]
                own, size = signatures([t for _, t in rows])
                new, new_size = signatures([t for _, t in made])
                i, j = np.array(pairs).T
                columns = [
                    pa.array([rows[k][0][2] for k in i], pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for _, t in made]),
                    pa.array([own[k].tobytes().hex() for k in i]), pa.array([x.tobytes().hex() for x in new]),
                    pa.array(likeness(own[i], size[i], new, new_size)), pa.array(likeness(own[i], size[i], own[j], size[j])), pa.array([rows[k][0][3] for k in i], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id bigint"
    return neighbours(docs, near_copies(docs)).mapInArrow(run, schema)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
