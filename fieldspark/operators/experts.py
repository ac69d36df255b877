"""Local experts: each selects nearby observations, fits a model and predicts nearby locations.

Two grouped jobs do the work: fit joins the observations to the experts' side, so an expert without any
observation still gets its details row; predict joins observations and locations.  What belongs to an expert is an array in
its row, and a worker reads many experts at a time.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.predicates import run_bounds, select_rows
from fieldspark.operators.compare import not_done
from fieldspark.operators.covariance import predict_covariance
from fieldspark.operators.gathered import as_arrays, dealt, in_order, matrices
from fieldspark.operators.gp import PARAMS, GPConfig, Model, model_by_name
from fieldspark.operators.nearby import Near, _windows, expert_as_location, local_select, prediction_locations, shifted_locations
from fieldspark.sources.scratch import written

DETAILS = "num_obs bigint, run_time double, objective_value double, parameters_optimised boolean, optimise_success boolean, model string, device string"


@dataclass
class ExpertConfig:
    """One run: what each expert selects, its model, where it predicts."""

    coords: Sequence[str]
    obs_col: str
    local_select: Sequence[Near]
    gp: GPConfig = field(default_factory=GPConfig)
    model: str | Model = "exact"
    min_obs: int = 3
    max_exact_obs: int | None = None  # groups above it use the sparse bound, if one is set
    replacement_model: str | Model | None = None
    replacement_threshold: int = 0
    optimise: bool = True
    pred_method: str = "from_table"  # or 'expert_loc', 'shift'
    max_dist: float | None = None
    dist_cols: Sequence[str] = ("x", "y")
    offsets: dict[str, Sequence[float]] = field(default_factory=dict)
    table_suffix: str = ""
    params_to_store: Sequence[str] = PARAMS
    full_cov: bool = False  # also the covariance of each expert's locations

    def model_for(self, n: int) -> Model:
        """The model of a group of ``n`` rows: the replacement below its threshold, sparse above a limit that is set."""
        if self.replacement_model and n < self.replacement_threshold:
            return model_by_name(self.replacement_model)
        return model_by_name("sparse" if self.model == "exact" and self.max_exact_obs and n > self.max_exact_obs else self.model)


def with_expert_id(df: DataFrame, coords: Sequence[str]) -> DataFrame:
    return df if "expert_id" in df.columns else df.withColumn("expert_id", F.xxhash64(*coords))


def locations_of(experts: DataFrame, c: ExpertConfig, locations: DataFrame | None) -> DataFrame:
    if c.pred_method == "expert_loc":
        return expert_as_location(experts, c.coords)
    if c.pred_method == "shift":
        return shifted_locations(experts, c.offsets, c.coords)
    if locations is None or c.max_dist is None:
        raise ValueError("prediction locations and max_dist are needed")
    return prediction_locations(experts, locations, c.max_dist, c.dist_cols, c.coords)


def select_for_experts(experts: DataFrame, obs: DataFrame, c: ExpertConfig) -> DataFrame:
    """expert_id and coordinates and value of its observations; bounds of the whole run prune the scan."""
    bounds = run_bounds(experts, _windows(c.local_select))
    rows = select_rows(obs.select(*c.coords, c.obs_col).where(F.col(c.obs_col).isNotNull()), bounds)
    return local_select(experts, rows, c.local_select, [*c.coords, c.obs_col], c.coords).select("expert_id", *c.coords, F.col(c.obs_col).alias("_obs"))


def fit_experts(experts: DataFrame, selected: DataFrame, c: ExpertConfig, start: DataFrame | None = None) -> DataFrame:
    """One details row per expert, with its parameters as arrays (NULL where nothing was fitted).

    ``start`` (expert_id and parameter arrays) sets initial, or with ``optimise=False`` final, values.
    """
    coords, names = list(c.coords), list(PARAMS)
    left = dealt(experts.select("expert_id", *[F.col(x).cast("double") for x in coords]), ["expert_id"]).dropDuplicates(["expert_id"])
    given = start is not None
    if given:
        left = left.join(start.select("expert_id", *names), "expert_id", "left")
    left = left.join(as_arrays(selected, ["expert_id"], [*coords, "_obs"], "_rows"), "expert_id", "left")

    def fitted(obs: np.ndarray, first: dict[str, np.ndarray]) -> tuple:
        began = time.perf_counter()
        model = c.model_for(len(obs))
        params, value, optimised, ok = {}, None, False, False
        if len(obs) >= c.min_obs and not (given and not first):
            obs = in_order(obs)
            params, value, ok = model.fit(obs[:, :-1], obs[:, -1], c.gp, first, c.optimise)
            optimised = c.optimise
        own = [np.asarray(params[n], float).tolist() if params else None for n in names]
        return len(obs), time.perf_counter() - began, None if value is None else float(value), bool(optimised), bool(ok), model.name, socket.gethostname(), *own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            firsts = [{n: np.asarray(v, float) for n in names if (v := r[n]) is not None} for r in b.select(names).to_pylist()] if given else [{} for _ in range(b.num_rows)]
            rows = [fitted(*x) for x in zip(matrices(b, "_rows"), firsts, strict=True)]
            done = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("expert_id", *coords)], *done], names=out_names)

    schema = "expert_id bigint, " + ", ".join(f"`{x}` double" for x in coords) + f", {DETAILS}, " + ", ".join(f"{n} array<double>" for n in names)
    out_names = ["expert_id", *coords, *[d.split()[0] for d in DETAILS.split(", ")], *names]
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), *[pa.list_(pa.float64()) for _ in names]]
    return left.select(F.col("expert_id").cast("long"), *coords, *(names if given else []), "_rows").mapInArrow(run, schema)


def predict_experts(fitted: DataFrame, selected: DataFrame, locations: DataFrame, c: ExpertConfig) -> DataFrame:
    """f_star, f_var, y_var, f_bar and f_star_obs (data units) of each expert at each of its locations."""
    coords, names = list(c.coords), list(PARAMS)
    where = [f"pred_loc_{x}" for x in coords]
    ready = dealt(fitted.where(F.col(names[0]).isNotNull()).select("expert_id", *coords, *names), ["expert_id"])
    asked = ready.join(as_arrays(locations, ["expert_id"], where, "_at"), "expert_id").join(as_arrays(selected, ["expert_id"], [*coords, "_obs"], "_rows"), "expert_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            params = b.select(names).to_pylist()
            sizes, parts = [], []
            for obs, at, p in zip(matrices(b, "_rows"), matrices(b, "_at"), params, strict=True):
                obs = in_order(obs)
                got = c.model_for(len(obs)).predict(obs[:, :-1], obs[:, -1], c.gp, {n: np.asarray(p[n], float) for n in names}, at)
                sizes.append(len(at))
                parts.append(np.column_stack([at, *[np.broadcast_to(np.asarray(got[n], float), (len(at),)) for n in ("f_star", "f_var", "y_var", "f_bar")]]))
            if not parts:
                continue
            own = b.select(["expert_id", *coords]).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            values = np.concatenate(parts)
            f_star, f_bar = values[:, len(where)], values[:, -1]
            out = [*own.columns, *[pa.array(v) for v in values.T], pa.array(f_star * c.gp.obs_scale + f_bar)]
            yield pa.RecordBatch.from_arrays(out, names=out_names)

    out_names = ["expert_id", *coords, *where, "f_star", "f_var", "y_var", "f_bar", "f_star_obs"]
    schema = "expert_id bigint, " + ", ".join(f"`{n}` double" for n in out_names[1:])
    return asked.select(F.col("expert_id").cast("long"), *[F.col(x).cast("double") for x in coords], *names, "_at", "_rows").mapInArrow(run, schema)


def long_parameters(fitted: DataFrame, coords: Sequence[str], params: Sequence[str] = PARAMS) -> DataFrame:
    """coords, param, dim, value: one row per element of each stored parameter."""
    items = F.array(*[F.struct(F.lit(n).alias("param"), F.col(n).alias("v")) for n in params])
    rows = fitted.select("expert_id", *coords, F.explode(items).alias("p"))
    return rows.select("expert_id", *coords, F.col("p.param").alias("param"), F.posexplode("p.v").alias("dim", "value"))


def wide_parameters(params: DataFrame, experts: DataFrame, coords: Sequence[str], adjust: dict[str, Any] | None = None) -> DataFrame:
    """expert_id and one array per parameter, joined by coordinates (each first adjusted if asked).

    A vector with a NULL counts as missing.
    """
    item = F.array_sort(F.collect_list(F.struct("dim", "value")))
    vectors = params.groupBy(*coords, "param").agg(F.transform(item, lambda s: s["value"]).alias("v"), F.min(F.col("value").isNotNull()).alias("ok"))
    own = F.when(F.col("ok"), F.col("v"))
    wide = vectors.groupBy(*coords).agg(*[F.first(F.when(F.col("param") == n, own), ignorenulls=True).alias(n) for n in PARAMS])
    keys = experts.select("expert_id", *[(adjust[c](F.col(c)) if adjust and c in adjust else F.col(c)).alias(c) for c in coords])
    return keys.join(wide, list(coords), "left").drop(*coords)


@dataclass
class ExpertRun:
    run_details: DataFrame
    params: DataFrame
    preds: DataFrame
    covariance: DataFrame | None = None


def run_experts(experts: DataFrame, obs: DataFrame, c: ExpertConfig, locations: DataFrame | None = None, done: DataFrame | None = None, load_params: DataFrame | None = None, materialise: Callable[[DataFrame, str], DataFrame] = written) -> ExpertRun:
    """Fit and predict all experts that ``done`` lacks and that have a location to predict.

    ``materialise`` (a function from DataFrame and name to DataFrame) writes the selections and the fit and reads
    them back, as both have several users; by default to the scratch folder.
    """
    experts = with_expert_id(experts, c.coords)
    if done is not None:
        experts = not_done(experts, done, c.coords)
    places = locations_of(experts, c, locations)
    experts = experts.join(places.select("expert_id").distinct(), "expert_id", "left_semi")
    selected = materialise(select_for_experts(experts, obs, c), "selected")
    start = None if load_params is None else wide_parameters(load_params, experts, c.coords)
    fitted = materialise(fit_experts(experts, selected, c, start), "fit")
    details = fitted.drop(*PARAMS)
    covariance = predict_covariance(fitted, selected, places, c) if c.full_cov else None
    return ExpertRun(details, long_parameters(fitted, c.coords, c.params_to_store), predict_experts(fitted, selected, places, c), covariance)


def run_and_store(store, experts: DataFrame, obs: DataFrame, c: ExpertConfig, locations: DataFrame | None = None, load_params: DataFrame | None = None, config: Any = None) -> int:
    """Run, append the result tables to a store and return the configuration's id.

    Experts with a details row are skipped; loaded parameters that were not optimised are not stored.
    """
    config_id = store.config_id(config if config is not None else c)
    name = lambda t: f"{t}{c.table_suffix}"
    done = store.read(name("run_details")) if store.exists(name("run_details")) else None
    known = store.read(name("expert_locs")) if store.exists(name("expert_locs")) else None
    experts = with_expert_id(experts, c.coords)
    fresh = experts if known is None else not_done(experts, known, c.coords)
    store.write(fresh, name("expert_locs"), append=known is not None)

    def keep(df: DataFrame, what: str) -> DataFrame:
        store.write(df, f"_{what}{c.table_suffix}")
        return store.read(f"_{what}{c.table_suffix}")

    run = run_experts(experts, obs, c, locations, done, load_params, keep)
    store.write(run.preds, name("preds"), append=done is not None)
    if run.covariance is not None:
        store.write(run.covariance, name("covariance"), append=store.exists(name("covariance")))
    if load_params is None or c.optimise:
        store.write(run.params, name("params"), append=done is not None)
    store.write(run.run_details.withColumn("config_id", F.lit(config_id)), name("run_details"), append=done is not None, config=config)
    return config_id
