"""Byte-level BPE encoding and decoding by merge replay over a corpus slice.

Encoding a piece depends on the piece alone, so the distinct pieces of a slice of the corpus are
encoded together and every text is then a lookup.  ``MergeReplay`` holds all distinct pieces in one
token array with links to the neighbours, and an inverted index from a merge (the token that a pair
makes) to the positions of that pair.  It applies the merges in rank order; each application touches
only the neighbours of the merged positions and adds the pairs they form to the index.

A slice is what one task reads; the index is emptied whenever it holds ``max_pieces`` pieces, so the
memory does not grow with the input.  No shuffle takes place and nothing is broadcast.

Null texts count as empty: no ids.  Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.common import chunks, table

VOCABULARY = "byte_bpe_50k.tiktoken"


class Vocabulary:
    """Ranks of a vocabulary file, and every pair of tokens that joins to a third."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.lengths, self.offsets = lengths, np.cumsum(lengths) - lengths
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, -1 for none (negative ids stand for an edge)."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == key), self.pair_made[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that a sequence of ids stands for."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        within = np.arange(ends[-1]) - np.repeat(ends - n, n)
        return self.blob[np.repeat(self.offsets[ids], n) + within].tobytes()

    def encode_one(self, piece: bytes) -> list[int]:
        """Merge the lowest rank first, leftmost among equals, until no pair joins."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


class MergeReplay:
    """Encodes many distinct pieces at once by replaying the merges over all of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        v = self.v
        # one edge mark (-1) before each piece and at the end keeps pieces apart
        lengths = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(lengths + 1) - lengths
        token = np.full(int(lengths.sum()) + len(pieces) + 1, -1, np.int32)
        inside = np.ones(len(token), bool)
        inside[starts - 1] = inside[-1] = False
        token[inside] = v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
        alive = inside.copy()
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        odd: set[int] = set()

        def add(positions: np.ndarray, made: np.ndarray) -> None:
            ok = made >= 0
            positions, made = positions[ok], made[ok]
            if not len(made):
                return
            order = np.argsort(made, kind="stable")
            positions, made = positions[order], made[order]
            cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
            for group, at in zip(np.split(positions, cuts), made[np.concatenate([[0], cuts])].tolist(), strict=True):
                if at in index:
                    index[at].append(group)
                else:
                    index[at] = [group]
                    heapq.heappush(queue, at)

        every = np.flatnonzero(inside)
        add(every, v.joined(token[every], token[every + 1]))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(index.pop(rank)))
            at = at[alive[at]]
            at = at[v.joined(token[at], token[after[at]]) == rank]
            if not len(at):
                continue
            # of pairs that share a token, take every other one from the left
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():
                run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            alive[gone] = False
            token[at] = rank
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            lefts, rights = v.joined(token[left], token[at]), v.joined(token[at], token[after[at]])
            # a merge that opens a lower rank must be followed up before its piece goes on
            low = at[((lefts >= 0) & (lefts < rank)) | ((rights >= 0) & (rights < rank))]
            if len(low):
                odd.update((np.searchsorted(starts, low, side="right") - 1).tolist())
            add(left, lefts)
            add(at, rights)
        flat = token[alive].astype("<u4")
        counts = np.add.reduceat(alive, starts - 1) if len(pieces) else np.zeros(0, int)
        ends = np.cumsum(counts) * 4
        raw = flat.tobytes()
        out = [raw[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)]
        for i in odd:
            out[i] = np.array(v.encode_one(pieces[i]), "<u4").tobytes()
        return out


class Encoder:
    """Texts to ids, remembering the pieces of this slice."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, max_pieces: int = 400_000):
        self.vocabulary = Vocabulary(path)
        self.replay = MergeReplay(self.vocabulary)
        self.pattern = regex.compile(pattern)
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        if len(self.known) + len(new) > self.max_pieces:
            self.known = {}
        missing = [p for p in new if p not in self.known]
        self.known.update(zip(missing, self.replay.encode([p.encode() for p in missing]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(ids, "<u4"))


def encode_documents(docs: DataFrame, path: str | None = None, bytes_at_once: int = 8 << 20) -> DataFrame:
    """doc_id and the ids of its text as little-endian unsigned 32-bit integers (``ids``)."""
    return _coded(docs, path, bytes_at_once, digests=False)


def encode_decode_digests(docs: DataFrame, path: str | None = None, bytes_at_once: int = 8 << 20) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them."""
    return _coded(docs, path, bytes_at_once, digests=True)


def _coded(docs: DataFrame, path: str | None, bytes_at_once: int, digests: bool) -> DataFrame:
    where = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(where)
        for b in batches:
            texts = b.column("text").to_pylist()
            lo, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size < bytes_at_once and i + 1 < len(texts):
                    continue
                coded = encoder.encode([t or "" for t in texts[lo : i + 1]])
                ids = b.column("doc_id").slice(lo, i + 1 - lo)
                if digests:
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array([len(c) // 4 for c in coded], pa.int64()),
                            pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                            pa.array([hashlib.sha256(encoder.decode(c)).hexdigest() for c in coded]),
                        ],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(coded, pa.binary())], names=["doc_id", "ids"])
                lo, size = i + 1, 0

    schema = "doc_id bigint, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes (``bytes``) of each row's ``ids``; null ids decode to nothing."""
    where = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(where)
        for b in batches:
            out = []
            for _, part in chunks(b.column("ids").to_pylist()):
                out += [v.decode(np.frombuffer(x, "<u4")) for x in part]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(table(spark, sf_dir, "documents"))
