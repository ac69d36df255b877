"""Hold-out cross-validation: folds, training selections, predictions at held-out rows, scores."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.predicates import combined, run_bounds, select_rows
from fieldspark.operators.experts import ExpertConfig, fit_experts, long_parameters, predict_experts, select_for_experts, wide_parameters, with_expert_id
from fieldspark.operators.glue import SmoothingConfig, glue
from fieldspark.operators.gp import PARAMS
from fieldspark.operators.nearby import Near, _windows, local_select, near_join, prediction_locations
from fieldspark.operators.stats import scores
from fieldspark.sources.scratch import written
from fieldspark.sources.store import json_text


def where_products(wheres: Sequence[Sequence[dict[str, Any]]]) -> list[list[dict[str, Any]]]:
    """Every combination of one predicate from each list."""
    return [list(p) for p in itertools.product(*wheres)]


def folds(df: DataFrame, cols: Sequence[str], wheres: Sequence[Sequence[dict[str, Any]]] = ()) -> DataFrame:
    """Distinct values of the fold columns under each combination of predicates: fold_id and values."""
    parts = [select_rows(df, w).select(*cols).distinct() for w in (where_products(wheres) or [[]])]
    every = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    return every.select(F.xxhash64(*cols).alias("fold_id"), *cols)


def where_folds(df: DataFrame, cols: Sequence[str], wheres: Sequence[Sequence[dict[str, Any]]] = ()) -> DataFrame:
    """fold_id, where_id and values: the folds of each combination of predicates, kept apart.

    ``where_id`` is the place of the combination among all.  Equal values under two combinations are two folds, as
    their training rows differ.
    """
    rows = with_wheres(df, wheres).select(*cols, F.explode("_wheres").alias("where_id")).distinct()
    texts = F.array(*[F.lit(json_text(w)) for w in _combinations(wheres)])
    return rows.select(F.xxhash64(F.get(texts, F.col("where_id")), *cols).alias("fold_id"), "where_id", *cols)


def _combinations(wheres: Sequence[Sequence[dict[str, Any]]]) -> list[list[dict[str, Any]]]:
    return where_products(wheres) or [[]]


def with_wheres(df: DataFrame, wheres: Sequence[Sequence[dict[str, Any]]], known_only: bool = False) -> DataFrame:
    """The rows with ``_wheres``: which combinations of predicates they satisfy.

    With ``known_only`` predicates on columns that ``df`` lacks are left out.
    """
    holds = []
    for k, rules in enumerate(_combinations(wheres)):
        cond = combined(df, [r for r in rules if not known_only or r.get("col") in df.columns])
        holds.append(F.lit(k) if cond is None else F.when(cond, F.lit(k)))
    return df.withColumn("_wheres", F.array_compact(F.array(*holds)))


def in_fold(fold_cols: Sequence[str], prefix: str = "fold_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in fold_cols])


def _side(fold_table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Folds with their values as fold_<c>, and where_id if they have one."""
    return fold_table.select("fold_id", *[c for c in ("where_id",) if c in fold_table.columns], *[F.col(c).alias(f"fold_{c}") for c in cols])


def _satisfied(rows: DataFrame, side: DataFrame) -> Column:
    """Whether a row satisfies the predicates of a fold; always, where the one or the other has none."""
    return F.array_contains("_wheres", F.col("where_id")) if "_wheres" in rows.columns and "where_id" in side.columns else F.lit(True)


def training_rows(selected: DataFrame, fold_table: DataFrame, cols: Sequence[str], pairs: DataFrame | None = None) -> DataFrame:
    """Every fold's training rows: the local selections that satisfy its predicates and are not in the fold.

    The raw observations are never multiplied by folds; their local selections are, by those folds that
    ``pairs`` (expert_id, fold_id) names for the expert.  Without it every fold gets its rows of all that is selected; the rows
    are dealt in shares and each share meets the folds.
    """
    side = _side(fold_table, cols)
    if pairs is not None:
        met = selected.join(pairs.select("expert_id", "fold_id").join(side, "fold_id"), "expert_id")
    else:
        shares = 4 * int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = selected.withColumn("_share", F.pmod(F.xxhash64(*[c for c in selected.columns if c != "_wheres"]), F.lit(shares)).cast("int"))
        met = dealt.join(side.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), "_share").drop("_share")
    return met.where(~in_fold(cols) & _satisfied(selected, side)).drop("where_id", "_wheres", *[f"fold_{c}" for c in cols])


def held_out_locations(df: DataFrame, fold_table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows of each fold, with its fold_id."""
    side = _side(fold_table, cols)
    return df.join(side, in_fold(cols) & _satisfied(df, side)).drop("where_id", "_wheres", *[f"fold_{c}" for c in cols])


def cross_validate(
    experts: DataFrame,
    obs: DataFrame,
    c: ExpertConfig,
    fold_cols: Sequence[str],
    wheres: Sequence[Sequence[dict[str, Any]]] = (),
    smooth: dict[str, SmoothingConfig] | None = None,
    materialise: Callable[[DataFrame, str], DataFrame] = written,
) -> dict[str, DataFrame]:
    """Fit without each fold, optionally smooth per fold, predict its rows, blend and score.

    ``fold_id`` is one more key of the same two grouped jobs.  ``obs`` needs the fold columns.  An expert
    is fitted without a fold only if the fold has a row that it predicts, so many folds in many places
    cost no more than their neighbourhoods.

    Each combination of ``wheres`` has folds of its own: their training rows and held-out rows satisfy it, and
    so do the experts, as far as they have its columns.

    With ``smooth`` all experts' parameters count in each fold.  They are fitted and summed up once; a fold then adds the
    differences of those experts alone that select a row of it, to the sums of those alone that predict a row of it.
    """
    fold_table = materialise(where_folds(obs, fold_cols, wheres), "xval-folds")
    experts = with_wheres(with_expert_id(experts, c.coords), wheres, known_only=True)
    rows = with_wheres(obs, wheres)
    # fold columns ride along in the selection and are dropped after the fold test
    chosen = materialise(select_for_experts_with(experts.drop("_wheres"), rows, c, [*fold_cols, "_wheres"]), "xval-selected")
    truth = held_out_locations(rows, fold_table, fold_cols)
    places = prediction_locations(experts.drop("_wheres"), truth.select(*c.coords).distinct(), c.max_dist, c.dist_cols, c.coords)
    held = truth.select("fold_id", *[F.col(x).alias(f"pred_loc_{x}") for x in c.coords]).distinct()
    located = places.join(held, [f"pred_loc_{x}" for x in c.coords])
    if wheres:
        ids = fold_table.select("fold_id", "where_id")
        located = located.join(ids, "fold_id").join(experts.select("expert_id", "_wheres"), "expert_id").where("array_contains(_wheres, where_id)").drop("where_id", "_wheres")
    near = materialise(located.select("expert_id", "fold_id").distinct(), "xval-pairs")
    every = experts.select("expert_id", *c.coords)
    keyed = lambda df: df.withColumn("run_id", F.xxhash64("expert_id", "fold_id"))
    by_run = lambda df: keyed(df).drop("expert_id", "fold_id").withColumnRenamed("run_id", "expert_id")
    runs_of = lambda pairs: by_run(pairs.join(every, "expert_id"))
    training_of = lambda pairs: by_run(training_rows(chosen, fold_table, fold_cols, pairs).drop(*fold_cols))
    training = training_of(near)
    if smooth:
        start = smoothed_per_fold(experts, chosen, fold_table, fold_cols, near, c, smooth, runs_of, training_of, materialise)
        fitted = materialise(fit_experts(runs_of(near), training, replace(c, optimise=False), start), "xval-smooth")
    else:
        fitted = materialise(fit_experts(runs_of(near), training, c), "xval-fit")
    names = keyed(near).withColumnRenamed("expert_id", "own_id").withColumnRenamed("run_id", "expert_id")
    preds = predict_experts(fitted, training, by_run(located), c)
    preds = preds.join(names, "expert_id").drop("expert_id").withColumnRenamed("own_id", "expert_id")
    return {"folds": fold_table, "fit": fitted, "preds": preds, "scores": score_folds(preds, truth, c)}


def smoothed_per_fold(experts: DataFrame, chosen: DataFrame, fold_table: DataFrame, fold_cols: Sequence[str], near: DataFrame, c: ExpertConfig, smooth: dict[str, SmoothingConfig], runs_of, training_of, materialise) -> DataFrame:
    """expert_id (a run's) and one array per parameter for the pairs ``near``: smoothed over all experts without the fold.

    Base fits use all rows of a combination of predicates.  A fold changes the fits of the experts that select
    one of its rows; the kernel sums of a pair are the base's plus the differences of these.  Rows so far away that their weights are
    below rounding are not met (``REACH``); where nothing near is left, all rows are.
    """
    coords, xy = list(c.coords), ("x", "y")
    others = [x for x in coords if x not in xy]
    ids = fold_table.select("fold_id", "where_id")
    # base: one run for each expert and combination
    base_pairs = experts.select("expert_id", F.explode("_wheres").alias("where_id"))
    base_id = F.xxhash64(F.lit("base"), "expert_id", "where_id")
    base_runs = base_pairs.join(experts.select("expert_id", *coords), "expert_id").withColumn("run_id", base_id)
    base_rows = chosen.withColumn("where_id", F.explode("_wheres")).withColumn("run_id", base_id).select(F.col("run_id").alias("expert_id"), *coords, "_obs")
    base_fit = fit_experts(base_runs.select(F.col("run_id").alias("expert_id"), *coords), base_rows, c)
    base = long_parameters(base_fit, coords).withColumnRenamed("expert_id", "run_id").join(base_runs.select("run_id", "expert_id", "where_id"), "run_id").drop("run_id")
    base = materialise(base, "xval-base")
    # changed: the folds that an expert selects a row of
    side = _side(fold_table, fold_cols)
    changed = materialise(chosen.join(side, in_fold(fold_cols) & _satisfied(chosen, side)).select("expert_id", "fold_id").distinct(), "xval-changed")
    changed_fit = fit_experts(runs_of(changed), training_of(changed), c)
    named = changed.withColumn("run_id", F.xxhash64("expert_id", "fold_id"))
    new = materialise(long_parameters(changed_fit, coords).withColumnRenamed("expert_id", "run_id").join(named, "run_id").drop("run_id"), "xval-new")
    # an expert that lost its fit has no rows in ``new``: its base values go
    old = changed.join(ids, "fold_id").join(base, ["expert_id", "where_id"]).drop("where_id")
    sign = lambda df, k: df.withColumn("_sign", F.lit(float(k)))
    differences = materialise(sign(new, 1).unionByName(sign(old, -1)), "xval-differences")
    wanted = near.join(ids, "fold_id").join(experts.select("expert_id", *[F.col(x).alias(f"e_{x}") for x in coords]), "expert_id")
    out = None
    for name in PARAMS:
        if name not in smooth:
            own = near.join(ids, "fold_id").join(base.where(F.col("param") == name), ["expert_id", "where_id"]).join(changed, ["expert_id", "fold_id"], "left_anti")
            mine = own.select("expert_id", "fold_id", "param", "dim", "value").unionByName(new.where(F.col("param") == name).join(near, ["expert_id", "fold_id"]).select("expert_id", "fold_id", "param", "dim", "value"))
        else:
            k = smooth[name]
            v = F.col("value")
            v = v if k.max is None else F.least(v, F.lit(float(k.max)))
            v = v if k.min is None else F.greatest(v, F.lit(float(k.min)))
            clean = lambda df: df.where((F.col("param") == name) & F.col("value").isNotNull() & ~F.isnan("value")).withColumn("value", v)  # noqa: B023, E731
            dims = range(len(coords) if name == "lengthscales" else 1)
            targets = wanted.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims])))
            value = materialise(_means(targets, clean(base), clean(differences), k, others, kernel_sums), f"xval-means-{name}")
            # few: experts without a value of their own and far from all others
            lone = materialise(value.where((F.col("w") < LEAST) | F.col("w").isNull()).select(*targets.columns), f"xval-lone-{name}")
            far = _means(lone, clean(base), clean(differences), k, others, all_sums)
            value = value.where(F.col("w") >= LEAST).unionByName(far)
            mine = value.select("expert_id", "fold_id", F.lit(name).alias("param"), "dim", "value").where(F.col("value").isNotNull())
        out = mine if out is None else out.unionByName(mine)
    runs = near.select(F.xxhash64("expert_id", "fold_id").alias("expert_id"), F.xxhash64("expert_id", "fold_id").alias("run_id"))
    return wide_parameters(out.select(F.xxhash64("expert_id", "fold_id").alias("run_id"), "param", "dim", "value"), runs, ["run_id"])


#: Scaled lengths within which a row counts; one outside weighs less than 1e-31, so even 1e12 of them are less than the
#: rounding of a sum of at least LEAST.  Points with smaller sums meet all rows.
REACH, LEAST = 12.0, 1e-3


def _weight(k: SmoothingConfig) -> Column:
    return F.exp(-0.5 * (F.pow((F.col("x") - F.col("e_x")) / k.l_x, 2) + F.pow((F.col("y") - F.col("e_y")) / k.l_y, 2)))


def _summed(pairs: DataFrame, keys: Sequence[str], k: SmoothingConfig, others: Sequence[str]) -> DataFrame:
    for x in others:
        pairs = pairs.where(F.col(x).eqNullSafe(F.col(f"e_{x}")))
    w = F.col("_sign") * _weight(k)
    return pairs.groupBy(*keys).agg(F.sum(w * F.col("value")).alias("_s"), F.sum(w).alias("_w"))


def kernel_sums(points: DataFrame, rows: DataFrame, keys: Sequence[str], same: Sequence[str], k: SmoothingConfig, others: Sequence[str]) -> DataFrame:
    """By ``keys`` of the points: sums of weighted values and weights over the rows within REACH, of equal ``same`` columns."""
    where = [c for c in points.columns if c not in same]
    left = points.withColumns({"_u": F.col("e_x") / k.l_x, "_v": F.col("e_y") / k.l_y})
    right = rows.withColumns({"_u": F.col("x") / k.l_x, "_v": F.col("y") / k.l_y})
    pairs = near_join(left, right, [Near(["_u", "_v"], "<=", REACH)], "l_", ["x", "y", *others, "value", "_sign"], where, same)
    return _summed(pairs.withColumnsRenamed({f"l_{c}": c for c in where}), keys, k, others)


def all_sums(points: DataFrame, rows: DataFrame, keys: Sequence[str], same: Sequence[str], k: SmoothingConfig, others: Sequence[str]) -> DataFrame:
    """The same over all rows, which are dealt in shares that each point meets."""
    shares = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("x", "y", *others, "value", "_sign", *same, F.pmod(F.xxhash64("x", "y", "value"), F.lit(shares)).cast("int").alias("_share"))
    every = points.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return _summed(every.join(dealt, [*same, "_share"]), keys, k, others)


def _means(targets: DataFrame, base: DataFrame, differences: DataFrame, k: SmoothingConfig, others: Sequence[str], sums: Callable) -> DataFrame:
    """``targets`` with ``w`` and ``value``: the kernel mean of the base and the fold's differences at each."""
    place = ["where_id", "dim", "e_x", "e_y", *[f"e_{x}" for x in others]]
    at_base = sums(targets.select(*place).distinct(), base.withColumn("_sign", F.lit(1.0)), place, ["where_id", "dim"], k, others)
    at_base = at_base.select(*[F.col(c).alias(f"_b_{c}") for c in place], F.col("_s").alias("_bs"), F.col("_w").alias("_bw"))
    moved = sums(targets, differences, ["expert_id", "fold_id", "dim"], ["fold_id", "dim"], k, others)
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in place])
    both = targets.join(at_base, same, "left").join(moved, ["expert_id", "fold_id", "dim"], "left")
    s, w = (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)) for a, b in (("_bs", "_s"), ("_bw", "_w")))
    # what is left of a sum whose every term went is rounding
    value = F.when(w > 1e-12 * F.coalesce("_bw", F.lit(0.0)), s / w)
    return both.select(*targets.columns, w.alias("w"), value.alias("value"))


def select_for_experts_with(experts: DataFrame, obs: DataFrame, c: ExpertConfig, extra: Sequence[str]) -> DataFrame:
    """The experts' selections with further columns of the observations."""
    if not extra:
        return select_for_experts(experts, obs, c)
    rows = obs.where(F.col(c.obs_col).isNotNull()).select(*c.coords, c.obs_col, *[x for x in extra if x not in c.coords])
    rows = select_rows(rows, run_bounds(experts, _windows(c.local_select)))
    got = local_select(experts, rows, c.local_select, rows.columns, c.coords)
    return got.select("expert_id", *c.coords, F.col(c.obs_col).alias("_obs"), *[x for x in extra if x not in c.coords])


def score_folds(preds: DataFrame, truth: DataFrame, c: ExpertConfig, r: float = 3.0) -> DataFrame:
    """Blend overlapping predictions of each fold, join the truth and score per fold."""
    pairs = [(f"pred_loc_{x}", x) for x in c.dist_cols]
    scaled = preds.withColumns({"f_star": F.col("f_star_obs"), "y_var": F.col("y_var") * c.gp.obs_scale**2})
    others = [f"pred_loc_{x}" for x in c.coords if x not in c.dist_cols]
    glued = glue(scaled, pairs, c.max_dist / r, by=["fold_id", *others])
    obs = truth.select("fold_id", *[F.col(x).cast("double").alias(f"pred_loc_{x}") for x in c.coords], F.col(c.obs_col).alias("_y"))
    return scores(glued.join(obs, ["fold_id", *[f"pred_loc_{x}" for x in c.coords]]), "_y", "f_star", "y_var", ["fold_id"])


def mean_over_folds(fold_scores: DataFrame) -> DataFrame:
    return fold_scores.agg(F.count("*").alias("n_folds"), *[F.avg(c).alias(c) for c in ("rmse", "mse", "mean_nll", "mean_norm_diff")])

