"""Spelling variant grouping by pivotal grams: every word meets the words one edit away.

1. *Count.*  Runs of letters are counted with NumPy over chunks of whole texts; counts are summed in Spark.
   Words are named by 64-bit fingerprints inside one chunk only.  ``planted`` is the contract's own damage:
   where 97 divides the crc32 of ``<doc_id>:<run>``, one code point of the run is left out.
2. *Order.*  Bigrams are counted over the distinct words.  Letters are few, so the table of counts has a fixed size.
   A word's bigrams are put in one global order, rare ones first; its first ``PREFIX`` are its gram prefix.
   Of these, dynamic programming picks two that are disjoint and together rarest: the pivots.  One edit
   cannot touch both, so of two near words, the one whose prefix ends earlier has a pivot in the other's prefix.
3. *Position limits.*  An untouched pivot leaves the edit on one side of it.  All of the other side is equal then,
   and so is the half of this side that the edit is not in.  Side, places, lengths and these equal parts
   make the join key, so a frequent bigram at a frequent place does not bring all its words together.
4. *Verify.*  Pairs with equal keys are kept if their edit distance in code points is one.
5. *Forms.*  A word's form is its most frequent near word (ties: smallest in code-point order), if that is at
   least ``ratio`` times as frequent.  Roots follow forms; each round doubles the reach, so rounds are few.

Null and empty texts have no words.  A missing doc_id counts as empty text in ``<doc_id>:<run>``.  Rows that repeat
a doc_id are texts of their own, whose words all count.  Words of any length take part.  Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import Words, binary_column, chunks, dropped, mix, small_batches, table, written

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
PLANT_EVERY = 97
PREFIX = 3
TEXT_BYTES = 2 << 20
#: Runs longer than this get their crc32 one by one.
SHORT = 64

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LEAD = 0xC3  # the first UTF-8 byte of U+00C0 to U+00FF; any byte may follow it there
#: Letters are numbered: a to z, then U+00C0 to U+00FF.
LETTERS = 26 + 64


def _letters(data: np.ndarray) -> np.ndarray:
    lead = data == _LEAD
    out = _LETTER[data] | lead
    out[1:] |= lead[:-1]
    return out


class Runs(Words):
    """The runs of letters of some lower-cased texts, in the form of ``Words``."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        inside = _letters(self.data)
        at = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = at[0::2], at[1::2]
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        self.doc = np.searchsorted(ends, self.starts - 1, side="right")
        self.n_docs = len(texts)

    def lengths(self) -> np.ndarray:
        """Code points of each run."""
        total = np.concatenate([[0], np.cumsum(self.data == _LEAD)])
        return (self.ends - self.starts) - (total[self.ends] - total[self.starts])


def pieces(text: bytes, most: int = TEXT_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that cut no run."""
    if len(text) <= most:
        yield text
        return
    gaps = np.flatnonzero(~_letters(np.frombuffer(text, np.uint8)))
    lo = 0
    while len(text) - lo > most:
        k = int(np.searchsorted(gaps, lo + most))
        hi = int(gaps[k - 1]) + 1 if k and gaps[k - 1] >= lo else int(gaps[k]) + 1 if k < len(gaps) else len(text)
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def crcs(heads: np.ndarray, head: np.ndarray, words: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of heads[head] followed by words[word], all given as crc32; ``size`` is the bytes of each word.

    A crc32 is linear: that of a head, carried over as many zero bytes as the word has, XOR that of the word.
    """
    out = np.empty(len(head), np.uint32)
    order = np.argsort(size[word], kind="stable")
    sizes = size[word][order]
    carried, done = heads.copy(), 0
    for n in np.unique(sizes):
        for _ in range(int(n) - done):
            carried = (carried >> np.uint32(8)) ^ _CRC[carried & np.uint32(255)]
        done = int(n)
        at = order[np.searchsorted(sizes, n) : np.searchsorted(sizes, n, side="right")]
        out[at] = carried[head[at]] ^ words[word[at]]
    return out


def count_chunk(texts: list[bytes], ids: list[bytes], planted: bool, least: int) -> tuple[list[bytes], list[int]]:
    """Distinct results of at least ``least`` code points of some texts, and how often they occur."""
    runs = Runs(texts)
    if not len(runs.starts):
        return [], []
    _, first, which = np.unique(runs.hashes(), return_index=True, return_inverse=True)
    start, end, length = runs.starts[first], runs.ends[first], runs.lengths()[first]
    n = np.bincount(which, minlength=len(first))
    data = runs.data.tobytes()
    extra: Counter[bytes] = Counter()
    if planted:
        fit = np.flatnonzero(length >= least)
        place = np.full(len(first), -1)
        place[fit] = np.arange(len(fit))
        words = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(start[fit].tolist(), end[fit].tolist(), strict=True)), np.uint32, len(fit))
        own = np.flatnonzero(place[which] >= 0)
        pair, times = np.unique(runs.doc[own] * len(fit) + place[which[own]], return_counts=True)
        head, word = np.divmod(pair, max(1, len(fit)))
        heads = np.array([zlib.crc32(i + b":") for i in ids], np.uint32)
        size = (end - start)[fit]
        short = np.flatnonzero(size[word] <= SHORT)
        h = np.empty(len(pair), np.uint32)
        h[short] = crcs(heads, head[short], words, word[short], size)
        for k in np.flatnonzero(size[word] > SHORT):
            h[k] = zlib.crc32(data[start[fit[word[k]]] : end[fit[word[k]]]], int(heads[head[k]]))
        for k in np.flatnonzero(h % PLANT_EVERY == 0):
            at = fit[word[k]]
            n[at] -= times[k]
            text = data[start[at] : end[at]].decode()
            gone = int(h[k]) % len(text)
            if len(text) > least:
                extra[(text[:gone] + text[gone + 1 :]).encode()] += int(times[k])
    keep = np.flatnonzero((length >= least) & (n > 0))
    out = [data[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)]
    return out + list(extra), n[keep].tolist() + list(extra.values())


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, planted: bool = False) -> DataFrame:
    """word and n of all words that are long and frequent enough."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = binary_column(b, "id")
            parts = [(i, p) for i, x in enumerate(binary_column(b)) if x for p in pieces(x.lower())]
            for first, texts in chunks((p for _, p in parts), TEXT_BYTES):
                ids = [names[i] or b"" for i, _ in parts[first : first + len(texts)]]
                words, n = count_chunk(texts, ids, planted, min_length)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def numbered(words: np.ndarray) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    return np.where(points < 128, points - ord("a"), points - 0xC0 + 26).astype(np.int64)


def by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions) of the words of each length, in groups of bounded size."""
    length = words.str.len().to_numpy()
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        step = max(1, (1 << 19) // int(n))
        for lo in range(0, len(at), step):
            yield int(n), at[lo : lo + step]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many times each of the LETTERS ** 2 bigrams occurs in the distinct words: a table of fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for b in batches:
            for _, at in by_length(b["word"]):
                x = numbered(b["word"].to_numpy()[at])
                total += np.bincount((x[:, :-1] * LETTERS + x[:, 1:]).ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": some, "n": total[some]})

    out = np.zeros(LETTERS * LETTERS, np.int64)
    for r in words.select("word").mapInPandas(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def prefix_of(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the first PREFIX bigrams of each row, in the global order (count, bigram, place)."""
    order = np.lexsort((np.arange(len(counts)), counts))
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    return np.argsort(rank[grams], axis=1, kind="stable")[:, :PREFIX]


def pivots_of(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Two disjoint bigrams of each row of ``places`` with the least total weight.

    Places are gone through from left to right; ``one`` is the best single bigram that ends before the
    present one begins, ``two`` the best pair so far.
    """
    rows = np.arange(len(places))
    order = np.argsort(places, axis=1)
    places, weights = np.take_along_axis(places, order, 1), np.take_along_axis(weights, order, 1)
    far = np.iinfo(np.int64).max // 4
    two, pick = np.full(len(rows), far), np.zeros((len(rows), 2), np.int64)
    for i in range(places.shape[1]):
        before = np.where(places[:, :i] + 2 <= places[:, i : i + 1], weights[:, :i], far)
        if i == 0:
            continue
        j = before.argmin(axis=1)
        one = before[rows, j]
        better = one + weights[:, i] < two
        two = np.where(better, one + weights[:, i], two)
        pick[better] = np.stack([places[rows, j], places[:, i]], axis=1)[better]
    return pick


class _Parts:
    """Fingerprints of parts of equally long words."""

    def __init__(self, x: np.ndarray):
        base = np.uint64(0x9E3779B97F4A7C15)
        n = x.shape[1]
        self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        down = np.uint64(pow(int(base), -1, 1 << 64))
        self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, down, np.uint64)]))
        self.total = np.zeros((len(x), n + 1), np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[:n], axis=1, out=self.total[:, 1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        rows = np.arange(len(self.total))
        return mix((self.total[rows, hi] - self.total[rows, lo]) * self.down[lo])


def _key(kind: int, n: int, place: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    out = mix(a ^ mix(place.astype(np.uint64) * np.uint64(8) + np.uint64(kind) ^ np.uint64(n) << np.uint64(32)))
    return out if b is None else mix(out ^ b * np.uint64(3))


def keys(parts: _Parts, own: int, n: int, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) under which words of length ``own`` may meet a word of length ``n`` at a shared bigram.

    ``place`` is where the bigram begins in the word at hand.  With own == n these are also the keys of the
    word that asks; a word that is asked makes them for the lengths n - 1, n and n + 1.
    """
    # the edit is to the right: places count from the left
    rest = n - place - 2
    half = rest // 2
    ok = np.flatnonzero((rest >= 0) & (place + 2 + half <= own))
    yield ok, _key(0, n, place, parts.of(np.zeros_like(place), np.minimum(place + 2 + half, own)))[ok]
    tail = rest - half
    ok = np.flatnonzero((rest >= 0) & (place + 2 + tail <= own) & (tail >= 0))
    yield ok, _key(1, n, place, parts.of(np.zeros_like(place), place + 2), parts.of(np.clip(own - tail, 0, own), np.full_like(place, own)))[ok]
    # the edit is to the left: places count from the right
    there = place + n - own
    half = np.maximum(there, 0) // 2
    lo = half + own - n
    ok = np.flatnonzero((there >= 0) & (lo >= 0) & (lo <= place))
    yield ok, _key(2, n, there, parts.of(np.clip(lo, 0, own), np.full_like(place, own)))[ok]
    ok = np.flatnonzero((there >= 0) & (half <= place))
    yield ok, _key(3, n, there, parts.of(np.zeros_like(place), np.minimum(half, own)), parts.of(place, np.full_like(place, own)))[ok]


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n of every pair of words that one edit separates, in both directions.

    ``words`` is a written table of (word, n); words need three code points for two disjoint bigrams, so
    the least length is four.
    """
    counts = words.sparkSession.sparkContext.broadcast(gram_counts(words))

    def rows_of(asks: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                names, times = b["word"].to_numpy(), b["n"].to_numpy()
                for n, at in by_length(b["word"]):
                    x = numbered(names[at])
                    grams = x[:, :-1] * LETTERS + x[:, 1:]
                    places = prefix_of(grams, counts.value)
                    if asks:
                        places = pivots_of(places, counts.value[np.take_along_axis(grams, places, 1)])
                    parts, made = _Parts(x), []
                    for k in range(places.shape[1]):
                        for other in (n,) if asks else (n - 1, n, n + 1):
                            made += keys(parts, n, other, places[:, k])
                    rows = at[np.concatenate([r for r, _ in made])]
                    yield pd.DataFrame({"key": np.concatenate([k for _, k in made]).view(np.int64), "w": names[rows], "w_n": times[rows]})

        return run

    schema = "key bigint, w string, w_n bigint"
    asking = words.mapInPandas(rows_of(True), schema).select("key", F.col("w").alias("a"), F.col("w_n").alias("a_n"))
    asked = words.mapInPandas(rows_of(False), schema).select("key", F.col("w").alias("b"), F.col("w_n").alias("b_n"))
    # Spark takes both sides to be about as large as ``words``, but a word makes up to 8 and 36 keys: never broadcast
    pairs = asking.join(asked.hint("merge"), "key").where("a <> b and levenshtein(a, b, 1) = 1")
    names = ("word", "n", "other", "other_n")
    pairs = written(pairs.select("a", "a_n", "b", "b_n"), "spelling-pairs")
    both = pairs.select("a", "a_n", "b", "b_n").toDF(*names).unionByName(pairs.select("b", "b_n", "a", "a_n").toDF(*names))
    return both.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: forms are followed until a word without one."""
    reach = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(reach.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        dropped(reach)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        kept = new.select("word", "root")
        kept.scratch_path = new.scratch_path
        reach = kept


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, planted: bool = False) -> DataFrame:
    """word, n, form, form_n, root and n_near of every word; ``min_length`` is at least four."""
    if min_length < 4:
        raise ValueError("two disjoint bigrams need words of four code points")
    words = written(word_counts(docs, min_length, min_count, planted), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = near.select(F.col("word").alias("near_word"), "n_near", F.col("best.other").alias("form"), (-F.col("best.minus")).alias("form_n"))
    joined = words.join(near.hint("merge"), F.col("word") == F.col("near_word"), "left")
    ok = F.col("form_n") >= ratio * F.col("n")
    rows = written(joined.select("word", "n", F.when(ok, F.col("form")).alias("form"), F.when(ok, F.col("form_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "spelling-forms")
    dropped(words)
    ends = roots(rows.where("form is not null")).withColumnRenamed("word", "from_word")
    return rows.join(ends.hint("merge"), F.col("word") == F.col("from_word"), "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), planted=True).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (SELECT id, run, count(*) AS n
      FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY id, run),
b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM d GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
one AS (SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM cut a JOIN v b ON a.rest = b.word
        UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
near AS (SELECT DISTINCT * FROM (SELECT * FROM one UNION ALL SELECT b, b_n, a, a_n FROM one)),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b_n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b_n >= 2 * v.n THEN b END AS form, CASE WHEN b_n >= 2 * v.n THEN b_n END AS form_n
      FROM v LEFT JOIN best ON best.a = v.word AND k = 1),
walk AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word) w ON w.word = f.word
"""
