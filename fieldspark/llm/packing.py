"""Packing of documents into sequences of bounded length by multiway differencing.

Each document is tokenised once, in the task that reads it, and cut: as many full windows as fit,
then the rest in pieces of at most ``REST`` ids, small enough to balance windows with little padding.
Full windows are sequences by themselves and take no further part.  The rests are dealt by their
place in the table of pieces, whatever they hold, into groups of about ``group_rows``; each group is
partitioned into near-equal windows by the Karmarkar-Karp method: the two partial partitions with the
largest spread are merged so that the fullest windows of one meet the emptiest of the other.  The
number of windows starts at the least that can hold the group and rises whenever a window exceeds the
capacity.

Null and empty texts have the end id alone.  Repeated rows are packed each.  A special token that
stands in a text is one id, as the tokenizers library has it.  Rows without a doc_id are packed too.

Any tokenizer file will do.  One that normalises and splits as ``word_bpe_49k.json`` does, into parts that no white
space is in, is applied word by word, and words are remembered; any other encodes whole texts.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from fieldspark.llm.common import binary_column, small_batches, table, written

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
REST = 512
END_ID = 1


#: Words of printable ASCII (no apostrophe) and Latin-1 letters: their normal form is their lower case.
PLAIN = re.compile("[\x21-\x26\x28-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: What this vocabulary cuts such words into: runs of letters, single digits, runs of anything else.
PART = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


#: Fixed values of the file format: the steps before the merges for which PLAIN, PART and encoding by words hold.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def splits_words(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer's steps are those that encoding by words is made for."""
    file = json.loads(tokenizer.to_str())
    before = (file["normalizer"] or {}).get("normalizers"), (file["pre_tokenizer"] or {}).get("pretokenizers")
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in file["added_tokens"])
    return before == (NORMALIZERS, SPLITTERS) and plain and file["model"]["type"] == "BPE" and file["model"]["dropout"] is None and file["truncation"] is None


class WordEncoder:
    """Ids of texts, word by word where the file allows it: no token then crosses ASCII white space.

    Plain words go straight to the library's merge model, part by part; all others, and words that hold
    one of the vocabulary's added tokens, through its whole chain of normaliser, splitter and model.
    Words and parts are remembered, up to ``max_words``.
    """

    def __init__(self, path: str, max_words: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = splits_words(self.tokenizer)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.model = self.tokenizer.model
        by_byte = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: by_byte.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.max_words = max_words

    def encode_word(self, word: str) -> bytes:
        if not PLAIN.fullmatch(word) or self.added.search(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in PART.findall(word.lower()):
            ids = self.parts.get(part)
            if ids is None:
                ids = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(part.translate(self.letters))])
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        cut = [t.split() for t in texts]
        new: set[bytes] = set()
        for words in cut:
            new.update(words)
        if len(self.known) + len(new) > self.max_words:
            self.known, self.parts = {}, {}
        self.known.update([(w, self.encode_word(w.decode())) for w in new if w not in self.known])
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in cut]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of a worker process: what one task learns serves the next ones."""
    return WordEncoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, rest: int = REST) -> DataFrame:
    """Tokenise and cut: doc_id, start, length, ids_crc32, doc_tokens."""
    where = path or public_tokenizers.path(TOKENIZER)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(where)
        for b in batches:
            texts = binary_column(b)
            for lo in range(0, len(texts), 1024):
                owner, start, length, crc, total = [], [], [], [], []
                coded = encoder.encode([t or b"" for t in texts[lo : lo + 1024]])
                for i, ids in enumerate(coded):
                    ids += end
                    n = len(ids) // 4
                    full = n - n % capacity
                    for at, size in [*((a, capacity) for a in range(0, full, capacity)), *((a, rest) for a in range(full, n, rest))]:
                        part = ids[4 * at : 4 * (at + size)]
                        owner.append(lo + i)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: the window, out of ``k``, of each item."""
    if k <= 1:
        return np.zeros(len(sizes), np.int64)
    # a partial partition: sums in ascending order and, for each sum, the items that make it
    heap: list[tuple[int, int, np.ndarray, list[list[int]]]] = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, np.array([s], np.int64), [[i]]))
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a, own_a = heapq.heappop(heap)
        _, _, b, own_b = heapq.heappop(heap)
        # absent windows are empty; the fullest of one meets the emptiest of the other
        p, q = len(a), len(b)
        if p + q <= k:
            sums, own = np.concatenate([a, b]), own_a + own_b
        else:
            overlap = p + q - k
            joined = a[:overlap] + b[:overlap][::-1]
            sums = np.concatenate([joined, a[overlap:], b[overlap:]])
            own = [x + y for x, y in zip(own_a[:overlap], own_b[:overlap][::-1], strict=True)] + own_a[overlap:] + own_b[overlap:]
        order = np.argsort(sums, kind="stable")
        sums, own = sums[order], [own[i] for i in order.tolist()]
        low = int(sums[0]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[-1]), tick, sums, own))
        tick += 1
    out = np.zeros(len(sizes), np.int64)
    for window, items in enumerate(heap[0][3]):
        out[items] = window
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; the count rises until every window holds its items."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        out = difference(sizes, k)
        if np.bincount(out, weights=sizes).max() <= capacity:
            return out
        k += max(1, k // 200)


def pack(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = 768) -> DataFrame:
    """Give each piece of ``cut``, a written table, its sequence_id and offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = cut.where(F.col("length") >= capacity).select(*names, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group_rows))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        part["sequence_id"] = windows(part["length"].to_numpy(), capacity) + (part["group"].to_numpy() << 32)
        part = part.sort_values("sequence_id", kind="stable")
        part["offset"] = part.groupby("sequence_id")["length"].cumsum() - part["length"]
        return part.drop(columns="group")

    grouped = rests.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("group"))
    packed = grouped.groupBy("group").applyInPandas(run, ", ".join(f"{n} bigint" for n in [*names, "sequence_id", "offset"]))
    return full.unionByName(packed)


def packing(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    small_batches(docs.sparkSession)
    return pack(written(pieces(docs, capacity, path), "pieces"), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"))
