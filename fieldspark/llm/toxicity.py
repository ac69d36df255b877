"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in NumPy.

A token is a run of ASCII letters, digits and bytes above 127, lower-cased in ASCII.  It is embedded
as the sum of three hashed vectors: of the whole token, of its first four and its first five bytes.
Filters over one, two and three tokens, a maximum over the whole text and a logistic layer give the
score; a text of any length is scored whole.  The model sees texts only, never language or source.

Training uses all labelled rows that may be learned from.  One fifth, by hash of the id, is set aside; the
rest is dealt into replicas of about ``replica_rows``, each one row of a table.  The embedding starts from the counts of all
replicas.  In each of ``rounds`` rounds every replica is trained from the same model in a task, and the
changes are averaged, those of a hashed vector over the replicas that changed it.  On all rows set aside
the scores are calibrated (two-parameter logistic, reweighted to the class shares of all labelled rows)
and a threshold per language is chosen, which decides ``flagged``; languages with few set-aside rows
get ``base``.  The driver holds one model and sums over the rows.

Null and empty texts get the score of a text without tokens.  Without a label of each class every
score is 0.  Repeated rows are scored each, and teach each; of several labels of a document the largest
counts.  Input columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import _BYTES, binary_column, bit_filter, chunks, crc_mod, dropped, may_hold, mix, small_batches, table, written

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a token that each hashed feature reads.
PREFIXES = (None, 4, 5)
WIDTHS = (1, 2, 3)
#: Ranges of hashed vectors, each of which one group puts together; the range after the last has all other parameters.
RANGES = 64
#: Sums over rows are taken in whole numbers of this step, so that they do not depend on their order.
STEP = 2.0**-24
TRIES = np.linspace(0.1, 0.6, 26)


@dataclass
class Config:
    bits: int = 15
    dim: int = 12
    filters: int = 8
    epochs: int = 8
    batch: int = 32
    rate: float = 0.02
    rounds: int = 2
    replica_rows: int = 4000
    base: float = 0.3
    min_rows: int = 40
    seed: int = 5


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all tokens, and the first token of each text (one more at the end)."""
    data = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    inside = _TOKEN[data]
    at = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = at[0::2], at[1::2]
    up, down = _BYTES[0].get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    out = np.empty((len(starts), len(PREFIXES)), np.int32)
    for k, size in enumerate(PREFIXES):
        stop = ends if size is None else np.minimum(ends, starts + size)
        h = mix((total[stop] - total[starts]) * down[starts] + np.uint64(k * 7919))
        out[:, k] = (h >> np.uint64(64 - bits)).astype(np.int32) + (k << bits)
    bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    return out, np.searchsorted(starts - 1, bounds)


@dataclass
class Model:
    config: Config
    embedding: np.ndarray
    kernels: list[np.ndarray]  # (width, dim, filters)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the largest response of each filter, its position, and the token vectors.

        A window that runs past the end of its text sees zeros there.
        """
        n_docs, c = len(first) - 1, self.config
        x = self.embedding[tokens].sum(axis=1) if len(tokens) else np.zeros((0, c.dim), np.float32)
        best = np.zeros((n_docs, len(WIDTHS) * c.filters), np.float32)
        where = np.full(best.shape, -1, np.int64)
        full = np.flatnonzero(np.diff(first) > 0)
        if not len(full):
            return best, where, x
        last = np.repeat(first[1:], np.diff(first))
        left = last - np.arange(len(tokens))  # tokens from here to the end of the text
        for k, width in enumerate(WIDTHS):
            y = np.tile(self.biases[k], (len(x), 1))
            for j in range(width):
                part = x[j:] @ self.kernels[k][j]
                part[left[: len(part)] <= j] = 0
                y[: len(part)] += part
            cols = slice(k * c.filters, (k + 1) * c.filters)
            top = np.maximum.reduceat(y, first[full])
            best[full, cols] = np.maximum(top, 0)
            if self.keep:
                hit = y == np.repeat(top, np.diff(first)[full], axis=0)
                for f in range(c.filters):
                    rows = np.flatnonzero(hit[:, f])
                    owner = np.searchsorted(first, rows, side="right") - 1
                    where[owner[::-1], k * c.filters + f] = rows[::-1]
        return best, where, x

    keep: bool = False

    def logits(self, texts: list[bytes]) -> np.ndarray:
        tokens, first = features(texts, self.config.bits)
        return self.pooled(tokens, first)[0] @ self.weights + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -30, 30)))


def bucket_counts(c: Config, tokens: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Documents of each class (toxic, clean) that hold a bucket."""
    size = len(PREFIXES) << c.bits
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    out = np.zeros((size, 2), np.float64)
    for k in range(len(PREFIXES)):
        seen = np.unique(owner * size + tokens[:, k])
        bucket, toxic = seen % size, y[seen // size] == 1
        out[:, 0] += np.bincount(bucket[toxic], minlength=size)
        out[:, 1] += np.bincount(bucket[~toxic], minlength=size)
    return out


def new_model(c: Config, counts: np.ndarray, n_toxic: int, n_clean: int) -> Model:
    """Small random values; the first dimension starts at each bucket's class log odds."""
    rng = np.random.default_rng(c.seed)
    e = rng.normal(0, 0.05, (len(counts), c.dim)).astype(np.float32)
    pos, neg = counts.T
    odds = np.log((pos + 1) / (n_toxic + 2)) - np.log((neg + 1) / (n_clean + 2))
    e[:, 0] = np.where(pos + neg >= 3, np.clip(odds, -1, 5) / 3, 0)
    kernels = [rng.normal(0, 0.2, (w, c.dim, c.filters)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[:, 0] = np.abs(k[:, 0]) + 0.3
    return Model(c, e, kernels, [np.zeros(c.filters, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * c.filters, 0.2, np.float32), -1.0)


@dataclass
class Training:
    """A model and the sums of squared gradients that its steps are scaled by."""

    model: Model
    past_e: np.ndarray
    past: list[np.ndarray]
    past_b: float = 1e-3

    @classmethod
    def of(cls, m: Model) -> Training:
        return cls(m, np.full(m.embedding.shape, 1e-2, np.float32), [np.full(p.shape, 1e-3, np.float32) for p in (*m.kernels, *m.biases, m.weights)])

    def vectors(self) -> np.ndarray:
        return np.concatenate([self.model.embedding, self.past_e], axis=1)

    def rest(self) -> np.ndarray:
        m = self.model
        return np.concatenate([x.ravel() for x in (*m.kernels, *m.biases, m.weights, *self.past, np.array([m.bias, self.past_b]))]).astype(np.float64)

    def put(self, vectors: np.ndarray, rest: np.ndarray) -> None:
        m, at = self.model, 0
        m.embedding, self.past_e = (np.ascontiguousarray(x, np.float32) for x in np.split(vectors, 2, axis=1))
        for x in (*m.kernels, *m.biases, m.weights, *self.past):
            x[...] = rest[at : at + x.size].reshape(x.shape)
            at += x.size
        m.bias, self.past_b = float(rest[-2]), float(rest[-1])


def train(t: Training, tokens: np.ndarray, first: np.ndarray, y: np.ndarray, share: np.ndarray, epochs: int, seed: int) -> None:
    """Minimise log loss by mini-batches; only the windows that win a maximum pass gradients.

    ``share`` is each row's weight.
    """
    m, c = t.model, t.model.config
    m.keep = True
    rng = np.random.default_rng(seed)
    dense, past, past_e, past_b = [*m.kernels, *m.biases, m.weights], t.past, t.past_e, t.past_b
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), c.batch):
            docs = order[lo : lo + c.batch]
            spans = [np.arange(first[d], first[d + 1]) for d in docs]
            own = tokens[np.concatenate(spans)]
            begin = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            best, where, x = m.pooled(own, begin)
            p = 1 / (1 + np.exp(-np.clip(best @ m.weights + m.bias, -30, 30)))
            g = ((p - y[docs]) * share[docs] / len(docs)).astype(np.float32)
            grads = [np.zeros_like(q) for q in dense]
            grads[-1][:] = best.T @ g
            down = np.outer(g, m.weights) * (best > 0) * (where >= 0)
            gx = np.zeros_like(x)
            for k, width in enumerate(WIDTHS):
                for f in range(c.filters):
                    col = k * c.filters + f
                    hit = np.flatnonzero(down[:, col])
                    for j in range(width):
                        at = where[hit, col] + j
                        ok = at < begin[hit + 1]
                        at, own_g = at[ok], down[hit[ok], col]
                        grads[k][j, :, f] += x[at].T @ own_g
                        np.add.at(gx, at, own_g[:, None] * m.kernels[k][j, :, f])
                    grads[len(WIDTHS) + k][f] += down[hit, col].sum()
            for q, dq, h in zip(dense, grads, past, strict=True):
                h += dq * dq
                q -= c.rate * dq / np.sqrt(h)
            past_b += float(g.sum()) ** 2
            m.bias -= c.rate * float(g.sum()) / past_b**0.5
            touched = np.flatnonzero(np.abs(gx).sum(axis=1))
            rows, inverse = np.unique(own[touched].ravel(), return_inverse=True)
            ge = np.zeros((len(rows), c.dim), np.float32)
            np.add.at(ge, inverse, np.repeat(gx[touched], len(PREFIXES), axis=0))
            past_e[rows] += ge * ge
            m.embedding[rows] -= c.rate * ge / np.sqrt(past_e[rows])
    m.keep = False
    t.past_b = past_b


def replicas(docs: DataFrame, known: DataFrame, c: Config) -> DataFrame:
    """aside, replica, n, n_toxic and the packed y, langs, sizes and texts of the labelled documents; a written table."""
    n_known = known.count()
    n = [max(1, -(-n_known * share // (5 * c.replica_rows))) for share in (4, 1)]
    place, aside = F.xxhash64("doc_id"), F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 4
    replica = F.when(aside, n[0] + F.pmod("place", F.lit(n[1]))).otherwise(F.pmod("place", F.lit(n[0]))).cast("int")
    known = known.select(F.col("doc_id").cast("long"), "y", place.alias("place")).withColumn("replica", replica)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(known, "place"))  # of fixed size; the texts of other documents stay where they are
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).where("doc_id is not null")
    texts = texts.withColumn("place", place).withColumn("replica", replica)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(shared.value, b.column("place").to_numpy())))

    def pack(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        part = part.merge(known[["doc_id", "y"]], on="doc_id").sort_values(["place", "doc_id", "text"])
        y, texts = part["y"].to_numpy(np.int8), part["text"].tolist()
        if not len(y):
            return pd.DataFrame({"aside": [], "replica": [], "n": [], "n_toxic": [], "y": [], "langs": [], "sizes": [], "body": []})
        number = int(part["replica"].iloc[0])
        return pd.DataFrame({
            "aside": [number >= n[0]], "replica": [number], "n": [len(y)], "n_toxic": [int(y.sum())], "y": [y.tobytes()],
            "langs": [part["lang"].tolist()], "sizes": [np.array([len(x) for x in texts], np.int64).tobytes()], "body": [pa.compress(b"".join(texts) or b" ", codec="zstd", asbytes=True)],
        })

    kept = texts.mapInArrow(keep, "doc_id long, lang string, text binary, place long, replica int")
    both = [x.repartition(sum(n), "replica").groupBy("replica") for x in (kept, known)]
    schema = "aside boolean, replica int, n long, n_toxic long, y binary, langs array<string>, sizes binary, body binary"
    return written(both[0].cogroup(both[1]).applyInPandas(pack, schema), "toxicity-rows")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray, list[str]]]:
    """replica, texts, y and languages of each row of ``replicas``."""
    for r in batch.to_pylist():
        ends = np.cumsum(np.frombuffer(r["sizes"], np.int64)).tolist()
        body = pa.decompress(r["body"], decompressed_size=max(ends[-1], 1), codec="zstd", asbytes=True)
        yield r["replica"], [body[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)], np.frombuffer(r["y"], np.int8), r["langs"]


def all_features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [features(run, bits) for _, run in chunks(texts)]
    return np.concatenate([t for t, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])


def put_together(rows: DataFrame, work: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]], mean: bool, size: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By range, the slots and the sums (or means) of what ``work`` gives for each replica: vectors by slot, and one more vector.

    A mean is over the replicas that have the slot.
    """
    step, kind = -(-size // RANGES), np.float32 if mean else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for replica, texts, y, _ in unpacked(b):
                vectors, rest = work(texts, y)
                slots = np.flatnonzero(vectors.any(axis=1))
                cut = np.searchsorted(slots, np.arange(RANGES + 1) * step)
                spans = [slots[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
                blobs = [(s.astype(np.int32).tobytes(), vectors[s].astype(np.float32).tobytes()) for s in spans]
                blobs.append((np.zeros(1, np.int32).tobytes(), rest.astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(RANGES + 1), pa.int32()), pa.array([replica] * (RANGES + 1), pa.int32()), *[pa.array(list(x), pa.binary()) for x in zip(*blobs, strict=True)]],
                    names=["range", "replica", "slots", "vectors"],
                )

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("replica")
        low = int(part["range"].iloc[0]) * step if part["range"].iloc[0] < RANGES else 0
        total, n = None, np.zeros(step)
        for s, v in zip(part["slots"], part["vectors"], strict=True):
            at = np.frombuffer(s, np.int32) - low
            if len(at):
                own = np.frombuffer(v, np.float32).reshape(len(at), -1)
                total = np.zeros((step, own.shape[1])) if total is None else total
                total[at] += own
                n[at] += 1
        at = np.flatnonzero(n)
        values = b"" if total is None else (total[at] / n[at, None] if mean else total[at]).astype(kind).tobytes()
        return pd.DataFrame({"range": part["range"].iloc[:1].tolist(), "slots": [(at + low).astype(np.int32).tobytes()], "vectors": [values]})

    sent = rows.mapInArrow(run, "range int, replica int, slots binary, vectors binary")
    out = {}
    for r in sent.groupBy("range").applyInPandas(merge, "range int, slots binary, vectors binary").collect():  # one row a range
        slots = np.frombuffer(r["slots"], np.int32)
        out[r["range"]] = slots, np.frombuffer(r["vectors"], kind).reshape(len(slots), -1) if len(slots) else np.zeros((0, 0))
    return out


def trained(rows: DataFrame, c: Config, n: int, n_toxic: int) -> Model:
    """A model of all rows: replicas are trained side by side, round after round."""
    size = len(PREFIXES) << c.bits
    spark = rows.sparkSession
    counts = np.zeros((size, 2))
    for at, values in put_together(rows, lambda texts, y: (bucket_counts(c, *all_features(texts, c.bits), y), np.zeros(1)), False, size).values():
        if values.shape[1] == 2:
            counts[at] = values
    t = Training.of(new_model(c, counts, n_toxic, n - n_toxic))
    weight = {1: 0.5 * n / max(n_toxic, 1), 0: 0.5 * n / max(n - n_toxic, 1)}
    rounds = min(c.rounds if n > c.replica_rows else 1, c.epochs)
    for i in range(rounds):
        shared = spark.sparkContext.broadcast(t)
        epochs = c.epochs * (i + 1) // rounds - c.epochs * i // rounds

        def work(texts: list[bytes], y: np.ndarray, shared=shared, epochs=epochs, seed=c.seed + 1 + i) -> tuple[np.ndarray, np.ndarray]:
            own = deepcopy(shared.value)  # a worker's broadcast value serves many tasks
            vectors, rest = own.vectors(), own.rest()
            train(own, *all_features(texts, c.bits), y.astype(np.float32), np.where(y == 1, weight[1], weight[0]), epochs, seed)
            return own.vectors() - vectors, own.rest() - rest

        moved = put_together(rows, work, True, size)
        vectors, rest = t.vectors(), t.rest()
        for k, (at, values) in moved.items():
            if k == RANGES:
                rest += values[0]
            elif len(at):
                vectors[at] += values
        t.put(vectors, rest)
        shared.unpersist()
    return t.model


def logits(rows: DataFrame, m: Model) -> DataFrame:
    """lang, y and z of the rows set aside; a written table."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts, y, langs in unpacked(b):
                z = np.concatenate([shared.value.logits(part) for _, part in chunks(texts)]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(y.astype(np.int32)), pa.array(z)], names=["lang", "y", "z"])

    return written(rows.mapInArrow(run, "lang string, y int, z double"), "toxicity-logits")


def calibrate(m: Model, z: DataFrame, positive_share: float) -> None:
    """Fit slope and shift of the logits, then the best threshold of each language, over all rows of ``z`` (lang, y, z)."""
    n = {r["y"]: r["n"] for r in z.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = {1: positive_share * total / max(n.get(1, 0), 1), 0: (1 - positive_share) * total / max(n.get(0, 0), 1)}

    def likely(a: float, b: float) -> Column:
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("z") + b))))

    a, b = 1.0, 0.0
    w, x = F.when(F.col("y") == 1, weight[1]).otherwise(weight[0]), F.col("z")
    for _ in range(50):  # Newton steps with a small ridge on the slope
        p = likely(a, b)
        v = w * p * (1 - p)
        terms = [w * (p - F.col("y")) * x, w * (p - F.col("y")), v * x * x, v * x, v]
        ga, gb, haa, hab, hbb = ((s or 0) * STEP for s in z.agg(*[F.sum(F.round(q / STEP).cast("long")) for q in terms]).first())
        ga += 0.5 * (a - 1)
        da, db = np.linalg.solve(np.array([[haa + 0.5, hab], [hab, hbb + 1e-6]]), [ga, gb]).tolist()
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    m.slope, m.shift = max(a, 0.05), b
    p = likely(m.slope, m.shift)
    hits = [F.sum((p >= float(t)).cast("long")).alias(f"h{i}") for i, t in enumerate(TRIES)]
    by = z.groupBy("lang").pivot("y", [0, 1]).agg(F.count("z").alias("n"), *hits)
    for r in by.where(f"`0_n` > 0 and `1_n` > 0 and `0_n` + `1_n` >= {m.config.min_rows}").collect():  # a row a language
        own, hit, wrong = r["1_n"] * weight[1], *(np.array([r[f"{y}_h{i}"] for i in range(len(TRIES))]) * weight[y] for y in (1, 0))
        f1 = 2 * hit / np.maximum(own + hit + wrong, 1e-9)
        best = np.flatnonzero(f1 >= f1.max() - 1e-9)
        m.thresholds[r["lang"]] = float(TRIES[best[np.argmin(np.abs(TRIES[best] - m.config.base))]])


def fit(docs: DataFrame, labels: DataFrame, config: Config | None = None) -> Model | None:
    """Train on all labelled rows; None if a class has no row."""
    c = config or Config()
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_mod("doc_id", 4) != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return None
    rows = replicas(docs, known, c)
    n = {r["aside"]: (r["n"], r["n_toxic"]) for r in rows.groupBy("aside").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).collect()}
    every = tuple(map(sum, zip(*n.values(), strict=True))) or (0, 0)
    if not 0 < every[1] < every[0]:
        return None
    split = all(0 < n.get(x, (0, 0))[1] < n.get(x, (0, 0))[0] for x in (True, False))
    m = trained(rows.where("not aside") if split else rows, c, *(n[False] if split else every))
    z = logits(rows.where("aside") if split else rows, m)
    calibrate(m, z, share[1] / sum(share.values()))
    dropped(rows, z)
    return m


def score(docs: DataFrame, model: Model | None, extra: list[str] | None = None, text: str = "text") -> DataFrame:
    """doc_id, score, predicted, flagged (by the language's threshold) and the ``extra`` columns.

    ``text`` names the column of texts; it goes to the workers once, though it be among ``extra``.
    """
    extra = extra or []
    base = model.config.base if model else Config().base
    kept = [docs.schema[c] for c in extra]
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.col("lang").alias("_lang"), F.col(text).alias("_text"), *[c for c in extra if c != text])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by Config

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = binary_column(b, "_text")
            s = np.zeros(len(texts))
            if m is not None:
                for at, part in chunks(texts):
                    s[at : at + len(part)] = m.scores(part)
            limits = np.array([m.thresholds.get(x, base) if m else base for x in b.column("_lang").to_pylist()])
            own = [b.column("_text" if c == text else c) for c in extra]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s), pa.array((s >= base).astype(np.int32)), pa.array(s >= limits), *own],
                names=["doc_id", "score", "predicted", "flagged", *extra],
            )

    fields = ["doc_id bigint", "score double", "predicted int", "flagged boolean"]
    schema = ", ".join(fields + [f"`{f.name}` {f.dataType.simpleString()}" for f in kept])
    return source.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "flagged")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the language's threshold does not flag, with their columns."""
    names = docs.columns
    inside = docs.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(names)], "doc_id", "lang")
    scored = score(inside, fit(docs, labels), [f"c{i}_" for i in range(len(names))], f"c{names.index('text')}_")
    return scored.where(~F.col("flagged")).select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)])
