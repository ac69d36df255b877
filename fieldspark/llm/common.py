"""Shared pieces of the training-data operators: scratch tables, word spans and fingerprints.

Words are ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes of a text, which is what ``bytes.split()``
cuts.  Fingerprints are 64-bit polynomial sums, taken with NumPy over a whole batch of texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are fingerprinted in chunks of about this many bytes, to bound a worker's memory.
CHUNK_BYTES = 1 << 19
#: A chunk's bytes (or words) meet 64-bit arithmetic in blocks of this many, however long a text is.
BLOCK = 1 << 18
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Bits of a filter of keys, and of the segments in which it is put together.
FILTER_BITS, FILTER_SEGMENT = 26, 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a local session may fall back on a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _give_memory_back() -> None:
    """Let the C library return large freed arrays to the system: Python workers live for many tasks."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD


_give_memory_back()


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of bounded bytes, not only of bounded rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, to free the shared folder."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """2**FILTER_BITS bits (packed), set at the leading bits of each 64-bit key of ``column``.

    Segments are put together in tasks; the array has the same size whatever the input.
    """
    size = 1 << FILTER_SEGMENT
    at = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS)
    slots = keys.select(at.alias("slot")).distinct().select(F.shiftright("slot", FILTER_SEGMENT).alias("segment"), (F.col("slot") % size).alias("slot"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size, np.uint8)
        out[part["slot"].to_numpy()] = 1
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for r in slots.groupBy("segment").applyInPandas(pack, "segment bigint, bits binary").collect():
        bits[r["segment"] * size >> 3 : (r["segment"] + 1) * size >> 3] = np.frombuffer(r["bits"], np.uint8)
    return bits


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a filter of ``bit_filter`` may hold; false is certain."""
    slot = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def rows_of(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key is in ``ids``; a filter of fixed size keeps most others out of the join's shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64(key).alias("place")), "place"))
    rows = docs.withColumn("_place", F.xxhash64(key))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(shared.value, b.column("_place").to_numpy())))

    return rows.mapInArrow(keep, rows.schema).drop("_place").join(ids.hint("merge"), key, "left_semi")


def chunks(texts: Iterable[bytes | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) in runs of about ``most`` bytes; null counts as empty."""
    first, run, size = 0, [], 0
    for i, x in enumerate(texts):
        x = x or b""
        if run and size + len(x) > most:
            yield first, run
            first, run, size = i, [], 0
        run.append(x)
        size += len(x)
    if run:
        yield first, run


def binary_column(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column of a batch as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, extended on demand.

    Those of a long run (one huge word) are made for it alone and not kept.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024) - 1, base, np.uint64)])) for base in (self.base, self.inverse)]
            if n > 4 * BLOCK:
                return made[0][:n], made[1][:n]
            self.up, self.down = made
        return self.up[:n], self.down[:n]


#: Two independent families give 128 bits where one is too few.
_BYTES = (_Powers(0x9E6C63D0676A9A99), _Powers(0xD6E8FEB86659FD93))
_WORDS = (_Powers(0xA3B195354A39B70D), _Powers(0x1B03738712FAD5C9))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a run of texts: byte spans, the text each is in, and fingerprints."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[self.data]
        edge = space[1:] != space[:-1]
        at = np.flatnonzero(edge) + 1
        self.starts, self.ends = at[0::2], at[1::2]
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        self.doc = np.searchsorted(ends, self.starts - 1, side="right")
        self.n_docs = len(texts)
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit fingerprint of each word; it depends on the word alone, not on the blocks."""
        out = np.empty(len(self.starts), np.uint64)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + BLOCK, side="right")))
            at, stop = int(self.starts[lo]), int(self.ends[hi - 1])
            up, down = _BYTES[family].get(stop - at)
            total = np.zeros(stop - at + 1, np.uint64)
            np.cumsum((self.data[at:stop].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
            start, end = self.starts[lo:hi] - at, self.ends[lo:hi] - at
            h = (total[end] - total[start]) * down[start]
            out[lo:hi] = mix(h ^ (end - start).astype(np.uint64) << np.uint64(56))
            lo = hi
        return out


def window_hashes(words: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Fingerprints of all runs of ``width`` consecutive word fingerprints."""
    out = np.empty(max(0, len(words) - width + 1), np.uint64)
    for lo in range(0, len(out), BLOCK):
        part = words[lo : min(lo + BLOCK, len(out)) + width - 1]
        up, down = _WORDS[family].get(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=total[1:])
        out[lo : lo + BLOCK] = mix((total[width:] - total[:-width]) * down[: len(part) - width + 1])
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, in linear time."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def new_text(docs: DataFrame, column: str, text: F.Column, rest: list[str]) -> F.Column:
    """A column of ``docs`` after its texts became ``text``; the columns in ``rest`` came back as c0_, c1_ ..."""
    if column == "text":
        out = text
    elif column == "n_chars":
        out = F.when(text.isNull(), F.col(f"c{rest.index(column)}_")).otherwise(F.length(text).cast("long"))
    else:
        out = F.col(f"c{rest.index(column)}_")
    return out.cast(docs.schema[column].dataType).alias(column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of an id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
