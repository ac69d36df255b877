"""Exact top-k inner products through vector-approximation files.

Every component becomes the integer floor(scale * x).  Each chunk of vectors is stored twice: as one
byte per component, the cell of a uniform grid over the chunk's own range, and exactly.  A query
scans the cells first: with cell centre c and half width h, its product lies within
``q . c +- h * sum |q|``.  Candidates are then read exactly in the order of their upper bound, and
reading stops once the k-th exact product beats every bound that is left; so nothing is missed.

The stated queries meet all rows in blocks: both sides are packed into bounded blocks, each query
block is sent to every chunk by an equi-join on the chunk's number, and only k rows per query and
chunk leave a task.  Chunk winners are merged by keeping k per query in two rounds.

Vectors that are null, empty, or hold a null, NaN or infinity take no part, as candidates or as queries;
neither do vectors of another length than the query's.  Ties go to the smaller vec_id.  A candidate
with the query's own vec_id is skipped.  Rows that repeat a vec_id are rows of their own: as candidates
each may be found, and as queries each gets its own k results.  Products must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import table, written

K = 10
CHUNK_ROWS = 8192
QUERY_ROWS = 512
CELLS = 255
#: Beyond this magnitude sums of products could leave what a double holds exactly.
EXACT = float(1 << 53)


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id, dim and the integer components of the vectors that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.size(v).alias("dim"),
        F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("v"),
    )


def blocks(rows: DataFrame, size: int, cells: bool) -> DataFrame:
    """Pack vectors of one dimension into blocks: ids and exact matrix, and the cells if asked."""

    def pack(part: pd.DataFrame, dim: int) -> dict:
        exact = np.stack(part["v"].to_numpy()).astype("<i8")
        out = {"dim": dim, "n": len(part), "ids": part["vec_id"].to_numpy("<i8").tobytes(), "exact": exact.tobytes()}
        if cells:
            low, high = exact.min(axis=0).astype(float), exact.max(axis=0).astype(float)
            width = np.maximum((high - low) / CELLS, 1e-9)
            grid = np.minimum(np.floor((exact - low) / width), CELLS).astype(np.uint8)
            out |= {"low": low.astype("<f8").tobytes(), "width": width.astype("<f8").tobytes(), "cells": grid.tobytes()}
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                held.setdefault(dim, []).append(part)
                if sum(map(len, held[dim])) >= size:
                    whole = pd.concat(held.pop(dim), ignore_index=True)
                    yield pd.DataFrame([pack(whole[i : i + size], dim) for i in range(0, len(whole), size)])
        for dim, parts in held.items():
            whole = pd.concat(parts, ignore_index=True)
            yield pd.DataFrame([pack(whole[i : i + size], dim) for i in range(0, len(whole), size)])

    schema = "dim int, n int, ids binary, exact binary" + ", low binary, width binary, cells binary" * cells
    return rows.mapInPandas(run, schema)


def exact_products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products; through doubles where those are certain to be exact."""
    if np.abs(m).max(initial=0).astype(float) * np.abs(q).astype(float).sum() < EXACT:
        return (m.astype(float) @ q.astype(float)).astype(np.int64)
    return m @ q


def search(ids: np.ndarray, exact: np.ndarray, low: np.ndarray, width: np.ndarray, grid: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's position, vec_ids, products) of the k best of one chunk; the count read is minimal."""
    centre = (low + (grid + 0.5) * width).T
    q = queries.astype(float)
    middle = q @ centre
    # the grid's rounding and that of doubles is covered by a relative margin
    half = (np.abs(q) @ width) * 0.5
    half = half * (1 + 1e-9) + 1e-6 * (1 + np.abs(q) @ np.maximum(np.abs(low), np.abs(low + width * (CELLS + 1))) * 1e-6)
    step = max(4 * k, 64)
    for i in range(len(queries)):
        other = ids != own[i]
        upper = np.where(other, middle[i] + half[i], -np.inf)
        left = int(other.sum())
        got = np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        take = step
        while left and len(got) < left:
            # the next candidates in order of their upper bound
            take = min(max(take, len(got) + step), left)
            best = np.argpartition(-upper, take - 1)[:take] if take < len(upper) else np.flatnonzero(other)
            fresh = np.setdiff1d(best, got, assume_unique=True)
            got = np.concatenate([got, fresh])
            scores = np.concatenate([scores, exact_products(exact[fresh], queries[i])])
            if len(got) >= left:
                break
            rest = upper.copy()
            rest[got] = -np.inf
            kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
            if kth > rest.max():
                break
            take = max(2 * take, int((upper >= kth).sum()) if np.isfinite(kth) else 0)
        order = np.lexsort((ids[got], -scores))[:k]
        yield i, ids[got][order], scores[order]


def top_k(vectors: DataFrame, k: int = K, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vec_col, scale)
    chunks = written(blocks(rows, CHUNK_ROWS, cells=True).withColumn("chunk", F.monotonically_increasing_id()), "va-file")
    asked = blocks(rows.where(F.col("vec_id") % every == 0).repartitionByRange(max(1, spark.sparkContext.defaultParallelism), "vec_id"), QUERY_ROWS, cells=False)
    # a query is a row, not an id: its block and its place there
    asked = asked.select("dim", F.monotonically_increasing_id().alias("q_block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("exact").alias("q"))
    asked = written(asked, "va-queries")
    # every query block goes to every chunk of its dimension: the chunk list is a few bytes a chunk
    pairs = asked.join(chunks.select("dim", "chunk"), "dim").join(chunks.drop("dim"), "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                shape = (r.n, r.dim)
                ids, exact = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.exact, "<i8").reshape(shape)
                grid = np.frombuffer(r.cells, np.uint8).reshape(shape)
                own, q = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q, "<i8").reshape(r.q_n, r.dim)
                found = list(search(ids, exact, np.frombuffer(r.low, "<f8"), np.frombuffer(r.width, "<f8"), grid, q, own, k))
                yield pd.DataFrame({
                    "q_block": r.q_block,
                    "q_at": np.repeat(np.arange(len(own)), [len(x) for _, x, _ in found]),
                    "query_id": np.repeat(own, [len(x) for _, x, _ in found]),
                    "vec_id": np.concatenate([x for _, x, _ in found]),
                    "score": np.concatenate([s for _, _, s in found]),
                    "chunk": r.chunk,
                })

    found = pairs.select("dim", "n", "ids", "exact", "low", "width", "cells", "q_block", "q_n", "q_ids", "q", "chunk")
    found = found.mapInPandas(run, "q_block bigint, q_at bigint, query_id bigint, vec_id bigint, score bigint, chunk bigint")
    best = [F.col("score").desc(), F.col("vec_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("q_block", "q_at", "salt").orderBy(*best))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("q_block", "q_at").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
