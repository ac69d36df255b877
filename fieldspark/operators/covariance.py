"""Joint predictions of an expert: the covariance of its locations as a table, and draws from it.

The locations of an expert are numbered 0, 1, 2 ... in the order of their coordinates and cut into blocks.
Each pair of blocks is one task of a grouped job, so an expert with many locations is worked on in many
places; a task holds the expert's observations and two blocks, never the whole matrix.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.gathered import as_arrays, dealt, in_order, matrices
from fieldspark.operators.gp import PARAMS

if TYPE_CHECKING:
    from fieldspark.operators.experts import ExpertConfig

BLOCK = 256


def numbered_locations(locations: DataFrame, coords: Sequence[str]) -> DataFrame:
    """expert_id, i and pred_loc_<c>: an expert's distinct locations, numbered in the order of their coordinates."""
    where = [f"pred_loc_{c}" for c in coords]
    order = Window.partitionBy("expert_id").orderBy(*where)
    return locations.select("expert_id", *where).distinct().select("expert_id", (F.row_number().over(order) - 1).alias("i"), *where)


def _block_pairs(size: Column, block: Column, rows: int) -> Column:
    """For a row of ``block``, the (first, second) blocks, first <= second, in which it takes part, and on which side."""
    every = F.sequence(F.lit(0), F.floor((size - 1) / rows).cast("int"))
    pair = lambda b, side, first, second: F.struct(first.alias("a"), second.alias("b"), F.lit(side).alias("side"))
    as_first = F.transform(F.filter(every, lambda b: b >= block), lambda b: pair(b, 0, block, b))
    as_second = F.transform(F.filter(every, lambda b: b <= block), lambda b: pair(b, 1, b, block))
    return F.concat(as_first, as_second)


def predict_covariance(fitted: DataFrame, selected: DataFrame, locations: DataFrame, c: ExpertConfig, block_rows: int = BLOCK) -> DataFrame:
    """expert_id, i, j, value with i <= j: the posterior covariance of the expert's locations, noise left out.

    ``i`` and ``j`` are the numbers of ``numbered_locations``.  Units are those of ``f_var``, which is the diagonal.
    Experts without a fit or without observations have no rows.
    """
    coords, where = list(c.coords), [f"pred_loc_{x}" for x in c.coords]
    ready = fitted.where(F.col(PARAMS[0]).isNotNull()).select("expert_id", *PARAMS)
    numbered = numbered_locations(locations, coords)
    sizes = numbered.groupBy("expert_id").agg(F.count("*").cast("int").alias("_n"))
    block = F.floor(F.col("i") / block_rows).cast("int")
    sides = numbered.join(sizes, "expert_id").withColumn("_to", F.explode(_block_pairs(F.col("_n"), block, block_rows)))
    sides = sides.select("expert_id", "_to.a", "_to.b", "_to.side", "i", *where)
    last = F.floor((F.col("_n") - 1) / block_rows).cast("int")
    pairs = sizes.select("expert_id", F.explode(F.sequence(F.lit(0), last)).alias("a"), last.alias("_last"))
    pairs = pairs.select("expert_id", "a", F.explode(F.sequence("a", "_last")).alias("b"))
    key = ["expert_id", "a", "b"]
    owners = dealt(pairs.select(*key).join(ready, "expert_id"), key)
    rows = as_arrays(selected, ["expert_id"], [*coords, "_obs"], "_rows")
    met = owners.join(as_arrays(sides, key, ["side", "i", *where], "_at"), key).join(rows, "expert_id")

    def covariances(e: int, obs: np.ndarray, at: np.ndarray, p: dict) -> list[np.ndarray]:
        obs = in_order(obs)
        first, second = (m[np.argsort(m[:, 1])] for m in (at[at[:, 0] == s] for s in (0, 1)))
        params = {n: np.asarray(p[n], float) for n in PARAMS}
        value = c.model_for(len(obs)).covariance(obs[:, :-1], c.gp, params, first[:, 2:], second[:, 2:])
        i, j = (x.ravel().astype(np.int32) for x in np.meshgrid(first[:, 1], second[:, 1], indexing="ij"))
        keep = i <= j
        return [np.full(keep.sum(), e, np.int64), i[keep], j[keep], value.ravel()[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owned = zip(b.column("expert_id").to_pylist(), matrices(b, "_rows"), matrices(b, "_at"), b.select(list(PARAMS)).to_pylist(), strict=True)
            # some pairs of blocks at a time: a full one gives block_rows ** 2 rows
            while some := list(itertools.islice(owned, 16)):
                parts = [covariances(*x) for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*parts, strict=True)], names=["expert_id", "i", "j", "value"])

    met = met.select(F.col("expert_id").cast("long"), *PARAMS, "_rows", "_at")
    return met.mapInArrow(run, "expert_id bigint, i int, j int, value double")


def joint_draws(preds: DataFrame, covariance: DataFrame, c: ExpertConfig, n: int, seed: int = 0, max_locations: int = 4096) -> DataFrame:
    """expert_id, pred_loc_<c>, draw and f_star: ``n`` joint draws of each expert's field at its locations.

    ``preds`` are the expert's predictions, ``covariance`` the table of ``predict_covariance`` at the same locations.
    A draw needs the whole factor, so an expert with more than ``max_locations`` is an error.  The random numbers
    depend on ``seed`` and expert_id alone.
    """
    where = [f"pred_loc_{x}" for x in c.coords]
    places = numbered_locations(preds, c.coords).join(preds.select("expert_id", *where, "f_star").distinct(), ["expert_id", *where])

    def run(key: tuple, at: pd.DataFrame, cov: pd.DataFrame) -> pd.DataFrame:
        m = len(at)
        if m > max_locations:
            raise ValueError(f"expert {key[0]} has {m} locations, more than max_locations")
        at = at.sort_values("i", ignore_index=True)
        k = np.zeros((m, m))
        k[cov["i"], cov["j"]] = cov["value"]
        k[cov["j"], cov["i"]] = cov["value"]
        # rounding may leave eigenvalues a little below zero
        w, v = np.linalg.eigh(k)
        z = np.random.default_rng([seed, int(key[0]) & (1 << 64) - 1]).standard_normal((m, n))
        f = at["f_star"].to_numpy()[:, None] + (v * np.sqrt(np.maximum(w, 0))) @ z
        out = at.loc[np.repeat(np.arange(m), n), ["expert_id", *where]].reset_index(drop=True)
        return out.assign(draw=np.tile(np.arange(n), m), f_star=f.ravel())

    schema = "expert_id bigint, " + ", ".join(f"`{x}` double" for x in where) + ", draw int, f_star double"
    return places.groupBy("expert_id").cogroup(covariance.groupBy("expert_id")).applyInPandas(run, schema)
