"""Quality classifier: interpolated modified Kneser-Ney over words, trained on trusted text.

Tokens are the words of a text (ASCII lower case) and one end; starts stand before the first.  With
the discount D of a count, a word w after a context c of ``order - 1`` words has probability

    P(w | c) = (n(c, w) - D) / n(c) + (sum of D over c) / n(c) * P(w | c without its first word)

where lower orders count the distinct words seen before (c, w), and below single words every type and
one unknown word are equally likely.  Counts come from all documents that ``labels`` marks as good but
every ``HELD_OUT``-th by a hash of the id, which is never counted.

The model is counts alone: how often an n-gram occurs (for shorter ones, after how many words), and for a
context the sum of these and how many of its words have 1, 2, and 3 or more.  Tasks send their distinct n-grams,
packed and sharded by context, so that a context and the number of its words are sent once for all of them;
no fingerprint of an n-gram is stored, as context and word give it.  Documents meet the model by joins of counts.  A unit of about
``UNIT_BYTES`` of text sends, shard by shard, those of its distinct n-grams that a bit filter of fixed size
lets through.  Each shard of the model answers all units with counts; there are as many shards as units (``SHARDS`` at
least), so neither a unit nor a shard grows with the corpus, and the model is sent once for each of ``ROUNDS`` parts of
the documents.  Answers are written; they and the texts (compressed) meet by unit, which gives every document's perplexity.  A step's shuffle
files go when what it wrote is there.

A document is kept if its perplexity is at most the threshold of its language: ``slack`` times a
quantile over all good documents of that language that were not counted; over those of all languages
where the language has fewer than ``least``.

Null and empty texts hold one token, the end; repeated rows and rows without a doc_id are scored like
any other, and the latter are never trusted.  Without good documents all are kept; without any left
out of the counts all good ones give the thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import FILTER_BITS, FILTER_SEGMENT, binary_column, chunks, dropped, may_hold, mix, rows_of, small_batches, table, written
from fieldspark.llm.lm_scoring import lookup, packed, tokens, unpacked

ORDER = 2
HELD_OUT = 5
UNIT_BYTES = 16 << 20
SHARDS = 64
#: A key with more than this share of a join's rows is dealt over SALTS tasks; there are at most 1 / HOT such keys.
HOT, SALTS = 1 / 200, 16
START_WORD = -2
#: Of the texts' compression on their way to their unit.
LEVEL = 6
#: A task sends the n-grams that it has counted, and packs rows of the model, when there are this many.
HELD_ROWS = 2_000_000
#: Documents ask for counts in so many rounds, one after another, by the task that reads them.
ROUNDS = 2
#: What Spark calls the deletion of a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + word.view(np.uint64)).view(np.int64)


def grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per length 1 to ``order``: fingerprints of the n-gram that ends at each token and of its context; each text's first token."""
    keys, first = tokens(texts)
    back = [keys]
    for _ in range(order - 1):
        b = np.concatenate([[START_WORD], back[-1][:-1]]).astype(np.int64)
        b[first[:-1]] = START_WORD
        back.append(b)
    ends, contexts = [keys], [np.zeros(len(keys), np.int64)]
    for k in range(2, order + 1):
        context = back[k - 1]
        for j in range(k - 2, 0, -1):
            context = joined(context, back[j])
        contexts.append(context)
        ends.append(joined(context, keys))
    return ends, contexts, first


def spans_of(keys: np.ndarray, shards: int) -> list[slice]:
    """Where the shards of ``keys``, which are in unsigned order, lie."""
    cut = np.searchsorted(keys.view(np.uint64), np.arange(shards, dtype=np.uint64) << np.uint64(64 - shards.bit_length() + 1))
    return [slice(lo, hi) for lo, hi in zip(cut, np.append(cut[1:], len(keys)), strict=True)]


def distinct(keys: np.ndarray) -> np.ndarray:
    """In order; a sort, as np.unique is many times slower on millions of numbers."""
    keys = np.sort(keys)
    return keys[starts_of(keys)]


def starts_of(keys: np.ndarray) -> np.ndarray:
    """The first place of each run of equal keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def summed(rows: list[np.ndarray], order: int) -> list[np.ndarray]:
    """The columns cN, g1, c2 ... of distinct n-grams and their n added up, in unsigned order of cN and g1."""
    at = np.lexsort((rows[1].view(np.uint64), rows[0].view(np.uint64)))
    top, word = rows[0][at], rows[1][at]
    first = np.flatnonzero(np.concatenate([[True], (top[1:] != top[:-1]) | (word[1:] != word[:-1])])) if len(at) else at
    return [*(x[at][first] for x in rows[:-1]), np.add.reduceat(rows[-1][at], first) if len(at) else rows[-1]]


def count_grams(docs: DataFrame, order: int = ORDER, shards: int = SHARDS) -> DataFrame:
    """Distinct n-grams: g1 and c2 ... cN (fingerprints of the last word and of its contexts) and n."""
    inner = [f"c{k}" for k in range(2, order)]
    names = [f"c{order}", "g1", *inner, "n"] if order > 1 else ["g1", "n"]

    def blobs(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows = summed([np.concatenate(x) for x in zip(*held, strict=True)], order)
        out = []
        for at in spans_of(rows[0], shards):
            top, word, *rest, n = (x[at] for x in rows)
            first = starts_of(top)
            # what belongs to the context is sent once for all its words
            out.append([packed(x) for x in (top[first], np.diff(np.append(first, len(top))), *(x[first] for x in rest), word, n)])
        return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array(out, pa.list_(pa.binary()))], names=["shard", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for _, texts in chunks(binary_column(b), 4 << 20):
                ends, contexts, _ = grams(texts, order)
                held.append(summed([contexts[-1], ends[0], *contexts[1:-1], np.ones(len(ends[0]), np.int64)], order))
                size += len(held[-1][0])
                if size > HELD_ROWS:
                    yield blobs(held)
                    held, size = [], 0
        if held:
            yield blobs(held)

    def total(part: pd.DataFrame) -> pd.DataFrame:
        held = []
        for columns in part["columns"]:
            top, words, *rest, word, n = map(unpacked, columns)
            held.append([np.repeat(top, words), word, *(np.repeat(x, words) for x in rest), n])
        rows = summed([np.concatenate(x) for x in zip(*held, strict=True)], order)
        return pd.DataFrame({k: x for k, x in zip([f"c{order}", "g1", *inner, "n"], rows, strict=True) if k in names})

    small_batches(docs.sparkSession)
    sent = docs.select("text").mapInArrow(run, "shard int, columns array<binary>")
    return sent.groupBy("shard").applyInPandas(total, ", ".join(f"{x} bigint" for x in names))


def discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    have = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n = [have.get(i, 0) for i in range(1, 5)]
    if not all(n[:3]):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]


def spread_join(big: DataFrame, small: DataFrame, key: str, rows: str) -> DataFrame:
    """Join on ``key``, with the few keys that hold a large share of ``big`` dealt over several tasks.

    ``small`` has one row a key, and in ``rows`` how many rows of ``big`` it will meet.  The model's own counts are no longer joined.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    hot = [r[0] for r in small.where(F.col(rows) > max(total * HOT, 10_000)).select(key).collect()]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    left = big.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(*[c for c in big.columns if c.startswith("g")]), F.lit(SALTS)).cast("int")).otherwise(0))
    right = small.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.drop(rows), [key, "salt"]).drop("salt")


def context_counts(seen: DataFrame, *by: str) -> DataFrame:
    """The n-grams' sum, and how many have a count of 1, of 2, and of more."""
    sums = [F.sum("n").alias("total"), *(F.count(F.when(x, 1)).alias(k) for k, x in (("ones", F.col("n") == 1), ("twos", F.col("n") == 2), ("more", F.col("n") > 2)))]
    return seen.groupBy(*by).agg(*sums)


def model_of(counts: DataFrame, order: int = ORDER) -> tuple[list[tuple[DataFrame, DataFrame | None]], list[dict]]:
    """Written tables, and facts that are as many for any corpus, by length of n-gram from 1 on.

    Tables: the n-grams (c2 ..., g1, n) and their contexts (key, total, ones, twos, more).  Facts: the discounts, and of
    single words the counts of their empty context.
    """
    seen = [counts]
    for k in range(order - 1, 0, -1):
        # the count of a shorter n-gram is the number of words seen before it
        by = [f"c{k}", "g1"] if k > 1 else ["g1"]
        rest = [f"c{j}" for j in range(2, k)]
        seen.insert(0, written(seen[0].groupBy(*by).agg(*[F.first(x).alias(x) for x in rest], F.count("*").alias("n")), "gram-counts"))
    tables, facts = [], []
    for k, rows in enumerate(seen, 1):
        facts.append({"discounts": discounts(rows)} | (context_counts(rows).first().asDict() if k == 1 else {}))
        tables.append((rows, written(context_counts(rows, f"c{k}").withColumnRenamed(f"c{k}", "key"), "gram-contexts") if k > 1 else None))
    return tables, facts


def keyed(tables: list[tuple[DataFrame, DataFrame | None]]) -> list[tuple[DataFrame, list[str]]]:
    """Each table of a model with ``key`` and the columns of its counts; an n-gram's key comes from its context and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, word, n = b.columns
            yield pa.RecordBatch.from_arrays([pa.array(joined(context.to_numpy(), word.to_numpy())), n], names=["key", "n"])

    out = []
    for k, (rows, contexts) in enumerate(tables, 1):
        of = rows.select(F.col("g1").alias("key"), "n") if k == 1 else rows.select(f"c{k}", "g1", "n").mapInArrow(run, "key bigint, n bigint")
        out.append((of, ["n"]))
        if contexts is not None:
            out.append((contexts, ["total", "ones", "twos", "more"]))
    return out


def dealt(tables: list[tuple[DataFrame, DataFrame | None]], shards: int) -> DataFrame:
    """shard, whether its rows are contexts, and runs of their packed keys and counts."""

    def run_of(contexts: bool):
        def blobs(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            at = np.argsort(rows[0].view(np.uint64))
            rows = [x[at] for x in rows]
            spans = [(i, x) for i, x in enumerate(spans_of(rows[0], shards)) if x.start < x.stop]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in spans], pa.int32()), pa.array([contexts] * len(spans), pa.bool_()), pa.array([packed(rows[0][x]) for _, x in spans], pa.binary()), pa.array([packed(np.concatenate([c[x] for c in rows[1:]])) for _, x in spans], pa.binary())],
                names=["shard", "contexts", "keys", "counts"],
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                held.append([c.to_numpy() for c in b.columns])
                size += b.num_rows
                if size > HELD_ROWS:
                    yield blobs(held)
                    held, size = [], 0
            if size:
                yield blobs(held)

        return run

    parts = [of.select("key", *names).mapInArrow(run_of(len(names) > 1), "shard int, contexts boolean, keys binary, counts binary") for of, names in keyed(tables)]
    every = parts[0]
    for x in parts[1:]:
        every = every.union(x)
    return every


def filter_of(model: DataFrame) -> np.ndarray:
    """Like ``bit_filter``, of all keys of a dealt model; a task sends its bits compressed, and no rows."""
    size = 1 << FILTER_SEGMENT >> 3

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            for x in b.column("keys").to_pylist():
                slots[unpacked(x).view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
        bits = np.packbits(slots, bitorder="little").tobytes()
        sent = [(i, bits[i * size : (i + 1) * size]) for i in range(len(bits) // size)]
        sent = [(i, x) for i, x in sent if any(x)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sent], pa.int64()), pa.array([pa.compress(x, codec="zstd", asbytes=True) for _, x in sent], pa.binary())], names=["segment", "bits"])

    def either(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size, np.uint8)
        for x in part["bits"]:
            out |= np.frombuffer(pa.decompress(x, decompressed_size=size, codec="zstd"), np.uint8)
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "bits": [out.tobytes()]})

    bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for r in model.select("keys").mapInArrow(mark, "segment bigint, bits binary").groupBy("segment").applyInPandas(either, "segment bigint, bits binary").collect():
        bits[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return bits


def marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "lang", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.spark_partition_id().alias("task"))


def unit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(unit, rows) of what a task reads, in order; a unit is a stretch of about UNIT_BYTES."""
    before = 0
    for b in batches:
        sizes = pc.binary_length(b.column("text")).to_numpy().astype(np.int64)
        unit = (b.column("task").to_numpy().astype(np.int64) << 20) + (before + np.cumsum(sizes) - sizes) // UNIT_BYTES
        before += int(sizes.sum())
        cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]])) if len(unit) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(unit[lo]), b.slice(lo, hi - lo)


def asked(docs: DataFrame, bits, order: int, shards: int, turn: int) -> DataFrame:
    """shard, unit and the unit's distinct n-grams there that the model may hold, in order; of the tasks whose turn it is."""

    def blobs(unit: int, held: list[np.ndarray]) -> pa.RecordBatch:
        # unsigned order puts the shards, which are leading bits, one after another
        keys = distinct(np.concatenate(held).view(np.uint64))
        out = [packed(keys[x].view(np.int64)) for x in spans_of(keys, shards)]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(shards), pa.int32()), pa.array([unit] * shards, pa.int64()), pa.array(out, pa.binary())], names=["shard", "unit", "keys"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for unit, b in unit_runs(batches):
            if own is not None and unit != own:
                yield blobs(own, held)
                held = []
            own = unit
            held += [keys_of(*wanted(texts, bits.value, order)) for _, texts in chunks(binary_column(b))]
        if own is not None:
            yield blobs(own, held)

    of = marked(docs).select("text", "task").where(F.col("task") % ROUNDS == turn)
    return of.mapInArrow(run, "shard int, unit bigint, keys binary")


def wanted(texts: list[bytes], bits: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Per length the n-grams that the model may hold, and at which tokens they end; each text's first token; contexts of starts.

    The model has no n-gram whose context or shorter n-gram it lacks.  A context that is not a text's start is the shorter
    n-gram of the token before.
    """
    ends, contexts, first = grams(texts, order)
    held = [may_hold(bits, ends[0])]
    starts = np.array([context[0] for context in contexts[1:]], np.int64)
    for end in ends[1:]:
        known = np.concatenate([[True], held[-1][:-1]])
        known[first[:-1]] = True
        at = np.flatnonzero(held[-1] & known)
        found = np.zeros(len(end), bool)
        found[at[may_hold(bits, end[at])]] = True
        held.append(found)
    return [end[x] for end, x in zip(ends, held, strict=True)], held, first, starts


def keys_of(ends: list[np.ndarray], held: list[np.ndarray], first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What is asked for; single words, which repeat most, once each."""
    return np.concatenate([distinct(ends[0]), *ends[1:], starts])


def answers(asks: DataFrame, model: DataFrame) -> DataFrame:
    """unit, shard, and for each key it asked for n, total, ones, twos and more; 0 where there is none."""

    def table_of(part: pd.DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, and their counts with a column of zeros at the end."""
        keys = [unpacked(x) for x in part["keys"]]
        counts = [unpacked(x).reshape(columns, -1) for x in part["counts"]]
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        at = np.argsort(key)
        return key[at], np.concatenate([np.zeros((columns, 0), np.int64), *counts], axis=1)[:, at]

    def run(asks: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        kinds = [table_of(part[part["contexts"] == contexts], columns) for contexts, columns in ((False, 1), (True, 4))]
        out = []
        for unit, shard, blob in zip(asks["unit"], asks["shard"], asks["keys"], strict=True):
            own, found = unpacked(blob), []
            for keys, counts in kinds:
                got = np.zeros((len(counts), len(own)), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    same = keys[at] == own
                    got[:, same] = counts[:, at[same]]
                found.append(got)
            out.append((unit, shard, packed(np.concatenate(found).ravel())))
        return pd.DataFrame(out, columns=["unit", "shard", "counts"])

    return asks.groupBy("shard").cogroup(model.groupBy("shard")).applyInPandas(run, "unit bigint, shard int, counts binary")


def squeezed(docs: DataFrame) -> DataFrame:
    """unit and runs of its documents: ids, languages, sizes and compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", compression_level=LEVEL)
        for unit, b in unit_runs(batches):
            ids, langs = b.column("doc_id"), b.column("lang").to_pylist()
            for at, texts in chunks(binary_column(b)):
                some = ids.slice(at, len(texts))
                body = b"".join(texts)
                row = [
                    [unit], [some.fill_null(0).to_numpy().astype(np.int64).tobytes()], [some.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()],
                    [langs[at : at + len(texts)]], [np.array([len(t) for t in texts], np.int64).tobytes()], [zstd.compress(body, asbytes=True) if body else b""],
                ]
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["unit", "ids", "known", "langs", "sizes", "body"])

    return marked(docs).mapInArrow(run, "unit bigint, ids binary, known binary, langs array<string>, sizes binary, body binary")


def unsqueezed(row) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(row.sizes, np.int64))
    body = pa.decompress(row.body, decompressed_size=int(ends[-1]), codec="zstd", asbytes=True) if row.body else b""
    return [body[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Answer:
    """What the model holds of a unit's keys: n, and the counts of those that are contexts."""

    def __init__(self, keys: np.ndarray, sent: list[bytes]):
        """``keys`` in unsigned order, ``sent`` shard by shard."""
        self.keys, self.none, n, counts, self.context, seen = keys, len(keys), [], [np.zeros((4, 1), np.int64)], [], 1
        for x in sent:
            got = unpacked(x).reshape(5, -1)
            at = np.flatnonzero(got[1])
            context = np.zeros(got.shape[1], np.int32)
            context[at] = np.arange(seen, seen + len(at))
            n.append(got[0].copy())
            counts.append(got[1:, at])
            self.context.append(context)
            seen += len(at)
        # the last place is that of keys that the model lacks, the first column that of what is no context
        self.n = np.concatenate([*n, [0]])
        self.context = np.concatenate([*self.context, [0]]).astype(np.int32)
        self.counts = np.concatenate(counts, axis=1)
        if len(self.n) != len(keys) + 1:
            raise RuntimeError("a unit's texts differ from those that it asked for")
        self.find = lookup(keys) if len(keys) else None

    def places(self, keys: np.ndarray) -> np.ndarray:
        if self.find is None:
            return np.full(len(keys), self.none)
        keys = keys.view(np.uint64)
        at = np.minimum(self.find(keys), self.none - 1)
        return np.where(self.keys[at] == keys, at, self.none)


def log_probabilities(ends: list[np.ndarray], held: list[np.ndarray], first: np.ndarray, starts: np.ndarray, answer: Answer, facts: list[dict]) -> np.ndarray:
    """log10 of the probability of each token, from what ``wanted`` gives."""

    def spare(of, k: int):
        return sum(d * x for d, x in zip(facts[k]["discounts"], of, strict=True))

    def places(k: int) -> np.ndarray:
        at = np.full(len(held[k]), answer.none)
        at[held[k]] = answer.places(ends[k])
        return at

    def above(at: np.ndarray, k: int) -> np.ndarray:
        n = answer.n[at]
        return n - np.array([0.0, *facts[k]["discounts"]])[np.minimum(n, 3)]

    empty = [facts[0][x] for x in ("ones", "twos", "more")]
    at = places(0)
    p = (above(at, 0) + spare(empty, 0) / (sum(empty) + 1)) / facts[0]["total"]
    for k in range(1, len(ends)):
        before = np.concatenate([[answer.none], at[:-1]])
        before[first[:-1]] = answer.places(starts[k - 1 : k])
        context = answer.context[before]
        total, left = answer.counts[0], spare(answer.counts[1:], k)
        at = places(k)
        p = np.where(total[context] > 0, (above(at, k) + left[context] * p) / np.maximum(total, 1)[context], p)
    return np.log10(p)


def perplexities(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame | None]], facts: list[dict], order: int = ORDER, size: int | None = None, spend: bool = False) -> DataFrame:
    """doc_id, lang, n_tokens and perplexity of every row of ``docs`` (``size`` bytes of text), whose tasks must read the same rows twice.

    With ``spend`` the model's tables are deleted as soon as they have been dealt.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards_of(bytes_of(docs) if size is None else size)
    model = written(dealt(tables, shards), "gram-model")
    if spend:
        dropped(*(x for of in tables for x in of if x is not None))
    bits = spark.sparkContext.broadcast(filter_of(model))
    got = None
    for turn in range(ROUNDS):
        some = written(answers(asked(docs, bits, order, shards, turn), model), "gram-answers")
        got = some if got is None else got.union(some)
    dropped(model)

    def run(texts: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = {"doc_id": [], "lang": [], "n_tokens": [], "perplexity": []}
        runs = list(texts.itertuples(index=False))
        held = [wanted(unsqueezed(row), bits.value, order) for row in runs]
        keys = distinct(np.concatenate([np.zeros(0, np.int64), *(keys_of(*x) for x in held)]).view(np.uint64))
        answer = Answer(keys, list(got.sort_values("shard")["counts"]))
        for row, own in zip(runs, held, strict=True):
            first = own[2]
            total = np.add.reduceat(log_probabilities(*own, answer, facts), first[:-1])
            known = np.frombuffer(row.known, np.uint8).astype(bool)
            out["doc_id"].append(pd.Series(pd.array(np.frombuffer(row.ids, np.int64), dtype="Int64")).where(known))
            out["lang"].append(pd.Series(list(row.langs), dtype=object))
            out["n_tokens"].append(pd.Series(np.diff(first)))
            out["perplexity"].append(pd.Series(10 ** np.minimum(-total / np.diff(first), 300)))
        return pd.DataFrame({k: pd.concat(v, ignore_index=True) if v else pd.Series([], dtype=object) for k, v in out.items()})

    return squeezed(docs).groupBy("unit").cogroup(got.groupBy("unit")).applyInPandas(run, "doc_id bigint, lang string, n_tokens bigint, perplexity double")


def bytes_of(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards_of(size: int) -> int:
    """A power of two."""
    return max(SHARDS, 1 << (size // UNIT_BYTES).bit_length())


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, slack: float = 1.05, least: int = 30, order: int = ORDER, stable: bool = False) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold and kept.

    ``stable`` says that ``docs`` is a plain scan of files, whose tasks read the same rows each time; any
    other table is written first.
    """
    with shuffles_freed(docs.sparkSession):
        docs = docs.select("doc_id", "text", "lang")
        docs = docs if stable else written(docs, "quality-texts")
        good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
        part = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT << 20))
        left_out = F.pmod(part, F.lit(HELD_OUT)) == 0
        counted = good.where(~left_out)
        trusted = rows_of(docs.select(F.col("doc_id").cast("long"), "text"), counted, "doc_id")
        size = bytes_of(docs)
        counts = written(count_grams(trusted, order, shards_of(size)), "gram-counts")
        if counts.isEmpty():
            return docs.select(F.col("doc_id").cast("long"), "lang", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
        tables, facts = model_of(counts, order)
        scored = written(perplexities(docs, tables, facts, order, size, spend=True), "perplexities")
        of_good = scored.join(good.select("doc_id", left_out.alias("left_out")), "doc_id")
        of_good = of_good.where("left_out") if not of_good.where("left_out").isEmpty() else of_good
        limit = (F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("threshold")
        overall = of_good.agg(limit).first()["threshold"]
        own = of_good.groupBy(F.col("lang").alias("own_lang")).agg(limit, F.count("*").alias("n_good")).where(F.col("n_good") >= least).drop("n_good")
        joined_ = scored.join(F.broadcast(own) if own.count() < 10_000 else own, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
        out = joined_.select("doc_id", "lang", "n_tokens", "perplexity", F.coalesce("threshold", F.lit(overall)).alias("threshold"))
        return out.withColumn("kept", F.col("perplexity") <= F.col("threshold"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), stable=True)
