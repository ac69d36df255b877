"""Language-model scoring by deleted interpolation of word n-grams.

Tokens are the words of a text (ASCII lower case) and one end; all words that training has not seen
are one more type.  With N training tokens of V types, a word w after a word v has probability

    P(w | v) = L2 * c(v, w) / c(v) + (1 - L2) * P1(w)
    P1(w)    = L1 * c(w) / N + (1 - L1) / (V + 1)

with exact counts of all words and all word pairs; a text's first word follows the end token.  L2
depends on the bucket (binary logarithm) of the context's frequency, and is 0 after unseen words.
L1 and L2 are learned by expectation-maximisation: estimates from one part of the training
documents, held-out counts from the other.  The final estimates use all training counts.  For a
given context the probabilities of all types sum to one.

The counts of words and pairs grow with the corpus, so no task and no broadcast holds them all.  The
documents are written in units of about ``UNIT_BYTES`` of text.  A unit asks for the totals of its
distinct words and pairs: it sends them with its own counts, in order and cut into shards by ranges of
fingerprints.  A shard sums what all units sent and answers each with totals in the order in which it
asked, so that no fingerprint is sent back.  A cogroup brings the answers to the unit's texts, which
give the same fingerprints in the same order.  There are as many shards as units, so neither a unit
nor a shard grows with the corpus.  What L2 needs of the held-out pairs is their mass by bucket and by
the logarithm of c(v, w) / c(v) / P1(w), in steps of 1 / STEPS octave; only those sums reach the driver.

Documents with remainder 1 are held out and teach nothing; neither do rows without a doc_id.  Null and
empty texts are the end token alone.  Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import Words, binary_column, chunks, crc_mod, mix, small_batches, table, written

BUCKETS = 48
ROUNDS = 30
#: Bytes of text of a unit, whose distinct pairs need a worker's memory, and of a part cut into tokens at once.
UNIT_BYTES = 8 << 20
CHUNK = 1 << 19
#: Histogram steps to an octave, and the step of held-out pairs that estimation has not seen.
STEPS = 64
NEVER = -(1 << 20)
#: Stands for the end token among the fingerprints of words.
END_WORD = -1
#: Parts of the documents: estimation, deleted (for the weights), neither.
ESTIMATION, DELETED, OUT = 0, 1, 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens in order, the end of each text included, and each text's first."""
    w = Words([t.lower() for t in texts])
    first = w.first + np.arange(len(texts) + 1)
    out = np.full(int(first[-1]), END_WORD, np.int64)
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = w.hashes().view(np.int64)
    return out, first


def pairs_of(keys: np.ndarray) -> np.ndarray:
    """Fingerprint of each token with the one before it; a text's first follows an end."""
    prior = np.concatenate([[END_WORD], keys[:-1]]).astype(np.int64)
    return mix(mix(prior.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + keys.view(np.uint64)).view(np.int64)


def folded(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each further column."""
    keys = np.concatenate([h[0] for h in held])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[cut], *(np.add.reduceat(np.concatenate([h[i] for h in held])[order], cut, dtype=held[0][i].dtype) for i in range(1, len(held[0])))


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed with all first bytes first, which suits numbers in order and small ones."""
    planes = np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(x: bytes) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    planes = pa.decompress(x[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def in_units(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, held_out and unit of all documents; a written table.

    A unit is a stretch of what one task reads: about ``UNIT_BYTES`` of text, and whole documents.
    """
    remainder = crc_mod("doc_id", 5)
    part = F.when(remainder.isNull() | (remainder == 1), OUT).when(remainder == 0, DELETED).otherwise(ESTIMATION).cast("int")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    read = docs.select(F.col("doc_id").cast("long"), body, part.alias("part"), F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), F.spark_partition_id().alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            sizes = pc.binary_length(b.column("text")).to_numpy().astype(np.int64)
            start = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            unit = (b.column("task").to_numpy().astype(np.int64) << 32) + start // UNIT_BYTES
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text", "part", "held_out")), pa.array(unit)], names=["doc_id", "text", "part", "held_out", "unit"])

    return written(read.mapInArrow(run, "doc_id bigint, text binary, part int, held_out boolean, unit bigint"), "lm-units")


class Tally:
    """The distinct words and pairs of a unit and their counts by part."""

    def __init__(self):
        self.held: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}

    def add(self, texts: list[bytes], part: np.ndarray) -> None:
        for at, some in chunks(texts, CHUNK):
            words, first = tokens(some)
            owner = np.repeat(part[at : at + len(some)], np.diff(first))
            for pair, keys in ((False, words), (True, pairs_of(words))):
                for p in (ESTIMATION, DELETED, OUT):
                    k, n = np.unique(keys[owner == p], return_counts=True)
                    n, zero = n.astype(np.int32), np.zeros(len(k), np.int32)
                    self.held[pair].append((k, n if p == ESTIMATION else zero, n if p == DELETED else zero))

    def blobs(self, unit: int, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The sums, packed shard by shard."""
        for pair, held in self.held.items():
            if not sum(len(h[0]) for h in held):
                continue
            keys, est, deleted = folded(held)
            cut = np.append(np.searchsorted(keys, edges), len(keys))
            spans = [(i, slice(cut[i], cut[i + 1])) for i in np.flatnonzero(np.diff(cut)).tolist()]
            for lo in range(0, len(spans), 64):
                some = spans[lo : lo + 64]
                columns = [[packed(x[at]) for _, at in some] for x in (keys, est, deleted)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pair] * len(some), pa.bool_()), pa.array([i for i, _ in some], pa.int32()), pa.array([unit] * len(some), pa.int64()), *[pa.array(c, pa.binary()) for c in columns]],
                    names=["pair", "shard", "unit", "keys", "n_est", "n_del"],
                )


def tallies(units: DataFrame, shards: int) -> DataFrame:
    """pair, shard, unit and the packed keys, n_est and n_del."""
    edges = np.array([-(1 << 63) + i * (1 << 64) // shards for i in range(shards)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, own = Tally(), None
        for b in batches:
            unit, part, texts = b.column("unit").to_numpy(), b.column("part").to_numpy(), binary_column(b)
            cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]])) if len(unit) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if own is not None and unit[lo] != own:
                    yield from tally.blobs(own, edges)
                    tally = Tally()
                own = int(unit[lo])
                tally.add(texts[lo:hi], part[lo:hi])
        if own is not None:
            yield from tally.blobs(own, edges)

    return units.select("text", "part", "unit").mapInArrow(run, "pair boolean, shard int, unit bigint, keys binary, n_est binary, n_del binary")


def totals(asked: DataFrame) -> DataFrame:
    """The answers of each shard: pair, shard, unit, value and est (packed).

    ``value`` has the training count of each key of the unit, in order, and ``est`` the estimation count
    of each that its deleted part holds.  For words, a row of unit -1 has tokens and types (all, then
    estimation) as ``value``, and as ``est`` pairs of a count in estimation and the held-out mass of the
    words with that count.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = {}
        for unit, *x in zip(rows["unit"], *(rows[c] for c in ("keys", "n_est", "n_del")), strict=True):
            parts.setdefault(unit, []).append(tuple(map(unpacked, x)))
        # a unit that two tasks have read has sent two parts; its texts ask once
        parts = {u: x[0] if len(x) == 1 else folded(x) for u, x in parts.items()}
        sent = [np.concatenate([x[i] for x in parts.values()]) for i in range(3)]
        every, at = np.unique(sent[0], return_inverse=True)
        est = np.bincount(at, sent[1], len(every)).astype(np.int64)
        value = est + np.bincount(at, sent[2], len(every)).astype(np.int64)
        out, lo = [], 0
        for unit, (keys, _, deleted) in parts.items():
            own = at[lo : lo + len(keys)]
            lo += len(keys)
            out.append((unit, packed(value[own]), packed(est[own[deleted > 0]])))
        if not rows["pair"].iloc[0]:
            count, inverse = np.unique(est, return_inverse=True)
            mass = np.bincount(inverse, value - est).astype(np.int64)
            out.append((-1, packed(np.array([value.sum(), est.sum(), (value > 0).sum(), (est > 0).sum()])), packed(np.stack([count, mass]).ravel())))
        frame = pd.DataFrame(out, columns=["unit", "value", "est"])
        return frame.assign(pair=rows["pair"].iloc[0], shard=rows["shard"].iloc[0])

    return asked.groupBy("pair", "shard").applyInPandas(run, "pair boolean, shard int, unit bigint, value binary, est binary")


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1).astype(int), BUCKETS - 1)


def unigram_weight(histogram: pd.DataFrame, n_est: float, types: int) -> float:
    """Weight of the word estimates against the uniform, from (count in estimation, held-out mass)."""
    l1 = 0.9
    p, mass = histogram["est"].to_numpy(float) / max(n_est, 1), histogram["mass"].to_numpy(float)
    if not mass.sum() or not n_est:
        return 0.5
    for _ in range(ROUNDS):
        own = l1 * p
        l1 = min(max(float((mass * own / (own + (1 - l1) / (types + 1))).sum() / mass.sum()), 1e-6), 1 - 1e-6)
    return l1


def bigram_weights(histogram: pd.DataFrame) -> np.ndarray:
    """Weight of the bigram estimates by bucket of the context's frequency, from (bucket, step, mass)."""
    b, step, mass = (histogram[c].to_numpy() for c in ("bucket", "step", "mass"))
    odds = np.where(step == NEVER, 0.0, 2.0 ** (np.maximum(step, -1000 * STEPS) / STEPS))
    seen = np.bincount(b, mass, BUCKETS)
    weights = np.full(BUCKETS, 0.5)
    weights[0] = 0
    for _ in range(ROUNDS):
        own = weights[b] * odds
        new = np.bincount(b, mass * own / (own + 1 - weights[b]), BUCKETS) / np.maximum(seen, 1e-300)
        weights = np.where(seen > 0, np.clip(new, 1e-6, 1 - 1e-6), weights)
        weights[0] = 0
    return weights


def lookup(keys: np.ndarray):
    """A function from keys to their places: one table probe, and a search for the few that collide."""
    bits = max(10, int(len(keys) * 2 - 1).bit_length())
    place = lambda k: (mix(k.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    at = np.zeros(1 << bits, np.int32)
    at[place(keys)] = np.arange(len(keys))

    def find(asked: np.ndarray) -> np.ndarray:
        out = at[place(asked)]
        off = np.flatnonzero(keys[out] != asked)
        if len(off):
            out[off] = np.searchsorted(keys, asked[off])
        return out

    return find


def answered(texts: pd.Series, got: pd.DataFrame):
    """Two functions from fingerprints to counts, of words and of pairs, from a unit's texts and its answers."""
    out = []
    for pair, of in ((False, lambda keys: keys), (True, pairs_of)):
        rows = got[got["pair"] == pair].sort_values("shard")
        keys = [np.zeros(0, np.int64)]
        for _, some in chunks(texts, CHUNK):
            keys.append(np.unique(of(tokens(some)[0])))
            if sum(map(len, keys[1:])) > len(keys[0]) // 4 + 500_000:
                keys = [np.unique(np.concatenate(keys))]
        keys = np.unique(np.concatenate(keys))
        n = np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in rows["n"])])
        n = n if len(n) and n.max() >= 1 << 31 else n.astype(np.int32)
        if len(n) != len(keys):
            raise RuntimeError("a unit's texts differ from those that it was counted with")
        out.append(lambda asked, find=lookup(keys), n=n: n[find(asked)])
    return out


def before_counts(counts: np.ndarray, end: int) -> np.ndarray:
    """Frequency of the context of each token, from the frequencies of the tokens."""
    return np.concatenate([[end], counts[:-1]])


END_ONLY = np.full(1, END_WORD, np.int64)


def held_out_histogram(bodies: DataFrame, got: DataFrame, l1: float, n_est: int, types_est: int) -> pd.DataFrame:
    """bucket, step and mass of the pairs of the deleted part; ``got`` has counts of the estimation part."""

    def run(texts: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"bucket": [], "step": [], "mass": []})
        words, pairs = answered(texts["text"], got)
        held = []
        for _, some in chunks(texts["text"], CHUNK):
            keys, _ = tokens(some)
            c = words(keys)
            context = before_counts(c, words(END_ONLY)[0])
            p1 = l1 * c / max(n_est, 1) + (1 - l1) / (types_est + 1)
            both = pairs(pairs_of(keys))
            step = np.where(both > 0, np.round(np.log2(np.maximum(both, 1) / np.maximum(context, 1) / p1) * STEPS), NEVER).astype(np.int64)
            held.append(np.unique(step * BUCKETS + bucket(context), return_counts=True))
        code, n = folded(held)
        return pd.DataFrame({"bucket": code % BUCKETS, "step": code // BUCKETS, "mass": n})

    each = bodies.groupBy("unit").cogroup(got.groupBy("unit")).applyInPandas(run, "bucket long, step long, mass long")
    return each.groupBy("bucket", "step").agg(F.sum("mass").alias("mass")).toPandas()  # bounded by the steps of a double


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    small_batches(docs.sparkSession)
    units = in_units(docs)
    shards = max(16, units.select("unit").distinct().count())
    sums = written(totals(tallies(units, shards)), "lm-totals")
    counts, histogram = np.zeros(4, np.int64), [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    for r in sums.where("unit = -1").select("value", "est").toLocalIterator():  # one row a shard
        counts += unpacked(r["value"])
        histogram = [folded([*histogram, tuple(unpacked(r["est"]).reshape(2, -1))])]
    n, n_est, types, types_est = map(int, counts)
    l1 = unigram_weight(pd.DataFrame({"est": histogram[0][0], "mass": histogram[0][1]}), n_est, types_est)
    sums = sums.where("unit >= 0")
    est = sums.where("length(est) > 8").select("unit", "pair", "shard", F.col("est").alias("n"))
    l2 = bigram_weights(held_out_histogram(units.where(F.col("part") == DELETED).select("unit", "text"), est, l1, n_est, types_est))
    value = sums.select("unit", "pair", "shard", F.col("value").alias("n"))
    floor = n + 0.5 * (types + 1)

    def run(texts: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        words, pairs = answered(texts["text"], got)
        out: dict[str, list[np.ndarray]] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for _, some in chunks(texts["text"], CHUNK):
            keys, first = tokens(some)
            c = words(keys)
            context = before_counts(c, words(END_ONLY)[0])
            w = l2[bucket(context)]
            logs = np.log10(w * pairs(pairs_of(keys)) / np.maximum(context, 1) + (1 - w) * (l1 * c / max(n, 1) + (1 - l1) / (types + 1)))
            out["n_tokens"].append(np.diff(first))
            out["n_known"].append(np.add.reduceat((c > 0).astype(np.int64), first[:-1]))
            out["base_score"].append(np.add.reduceat(np.log10((c + 0.5) / floor), first[:-1]))
            out["score"].append(np.add.reduceat(logs, first[:-1]))
        columns = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
        return pd.DataFrame({"doc_id": texts["doc_id"], "held_out": texts["held_out"], "train_tokens": n, **columns})

    bodies = units.select("unit", "doc_id", "held_out", "text")
    schema = "doc_id long, held_out boolean, train_tokens long, n_tokens long, n_known long, base_score double, score double"
    scored = bodies.groupBy("unit").cogroup(value.groupBy("unit")).applyInPandas(run, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
