"""Queries over local experts: fit, predict, blend, smooth, cross-validate."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators.binning import bin_by
from fieldspark.operators.experts import ExpertConfig, fit_experts, long_parameters, run_experts, select_for_experts, wide_parameters
from fieldspark.operators.glue import SmoothingConfig, glue_1d, glue_by_spacing, glue_local_predictions, kernel_smooth, mean_by_location, smooth_parameters, weighted_values
from fieldspark.operators.kerneltree import tree_smooth
from fieldspark.operators.gp import GPConfig
from fieldspark.operators.lattice import smooth_lattice
from fieldspark.operators.nearby import Near
from fieldspark.operators.stats import scores
from fieldspark.operators.xval import cross_validate, folds, held_out_locations, training_rows, where_folds, with_wheres
from fieldspark.plans.tables import PER_UNIT, experts, in_units, read, scaled_observations, supplier_x

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


GP = GPConfig(kernel="matern32", lengthscales=[8.0, 8.0], kernel_variance=0.001, likelihood_variance=0.0005, obs_mean="local")
FIELD = ExpertConfig(["x", "y"], "obs", [Near(["x", "y"], "<=", 5.0)], GP, optimise=False, max_dist=8.0)


def field(spark, sf_dir):
    """Mean of the observations on cells of 1.05 x 1.05: the field that experts learn."""
    return bin_by(scaled_observations(spark, sf_dir), "obs", grid_res=1.05, x_range=(0.0, 52.5), y_range=(0.0, 52.5))


def flagship(spark, sf_dir):
    """Bins, local experts with fixed parameters, predictions at all cells near them, blended."""
    cells = field(spark, sf_dir)
    run = run_experts(experts(spark), cells, FIELD, cells.select("x", "y"))
    preds = run.preds.withColumn("f_star", F.col("f_star_obs"))
    out = glue_local_predictions(preds, 8.0, 3.0)
    return out.select(F.round("pred_loc_x", 6).alias("x"), F.round("pred_loc_y", 6).alias("y"), F.round("f_star", 9).alias("f_star"), F.round("f_var", 9).alias("f_var"), F.round("y_var", 9).alias("y_var"))


QUERIES["flagship_field"] = flagship


@query("e3_fit_experts")
def e3_fit_experts(spark, sf_dir):
    """Optimised hyperparameters of every expert."""
    c = ExpertConfig(["x", "y"], "obs", [Near(["x", "y"], "<=", 4.0)], GPConfig(lengthscales=[8.0, 8.0], kernel_variance=0.001, likelihood_variance=0.0005, obs_mean="local", bounds={"lengthscales": ([1.0, 1.0], [60.0, 60.0]), "likelihood_variance": (1e-6, 0.1)}, max_iter=30))
    e = experts(spark)
    return long_parameters(fit_experts(e, select_for_experts(e, field(spark, sf_dir), c), c), c.coords)


SINGLE = ExpertConfig(["x"], "obs", [Near("x", "<=", 5.0 * PER_UNIT), Near("x", ">=", -5.0 * PER_UNIT)], GPConfig(coords_scale=[PER_UNIT], lengthscales=2.0, kernel_variance=1.5, likelihood_variance=0.1), min_obs=1, optimise=False, pred_method="expert_loc")


@query("e4_predict_one_observation", """
WITH k AS (SELECT s_suppkey, s_acctbal / 1000 AS y, 1.5 * (1 + sqrt(3) * d) * exp(-sqrt(3) * d) AS k FROM (SELECT *, s_nationkey / 10.0 / 2 AS d FROM supplier))
SELECT s_suppkey * 100.0 AS x, round(k / 1.6 * y, 9) AS f_star, round(1.5 - k * k / 1.6, 9) AS f_var, round(1.6 - k * k / 1.6, 9) AS y_var FROM k""")
def e4_predict_one_observation(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    obs = s.select(supplier_x(F.col("s_nationkey") / 10.0).alias("x"), (F.col("s_acctbal") / 1000).alias("obs"))
    places = s.select(F.col("s_suppkey").alias("expert_id"), supplier_x().alias("x"))
    preds = run_experts(places, obs, SINGLE).preds
    return preds.select(in_units("x"), *[F.round(c, 9).alias(c) for c in ("f_star", "f_var", "y_var")])


@query("e9_run_details", """
SELECT s_suppkey * 100.0 AS x, CASE WHEN s_nationkey < 12 THEN 1 ELSE 0 END AS num_obs, s_nationkey < 12 AS fitted FROM supplier""")
def e9_run_details(spark, sf_dir):
    """Experts without any observation still get their details row."""
    s = read(spark, sf_dir, "supplier")
    obs = s.where("s_nationkey < 12").select(supplier_x(F.col("s_nationkey") / 10.0).alias("x"), (F.col("s_acctbal") / 1000).alias("obs"))
    places = s.select(F.col("s_suppkey").alias("expert_id"), supplier_x().alias("x"))
    d = run_experts(places, obs, SINGLE).run_details
    return d.select(in_units("x"), F.col("num_obs").cast("int").alias("num_obs"), F.col("objective_value").isNotNull().alias("fitted"))


def predictions(spark, sf_dir):
    """lineitem rows in the role of predictions of experts (suppliers) at locations (quantities)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 10 * 5.0).alias("x"), (F.col("l_partkey") % 10 * 5.0).alias("y"), F.col("l_quantity").alias("pred_loc_x"), (F.col("l_orderkey") % 50 * 1.0).alias("pred_loc_y"),
        F.when(F.col("l_linenumber") < 6, F.col("l_discount")).alias("f_star"), F.col("l_tax").alias("f_var"), (F.col("l_tax") + 0.01).alias("y_var"),
    )


PREDS_SQL = """p AS (SELECT l_suppkey % 10 * 5.0 AS x, l_partkey % 10 * 5.0 AS y, l_quantity AS pred_loc_x, l_orderkey % 50 * 1.0 AS pred_loc_y,
 CASE WHEN l_linenumber < 6 THEN l_discount END AS f_star, l_tax AS f_var, l_tax + 0.01 AS y_var FROM lineitem)"""


def mean_sql(v: str) -> str:
    return f"round(sum(CASE WHEN {v} IS NOT NULL THEN w * {v} END) / nullif(sum(CASE WHEN {v} IS NOT NULL THEN w END), 0), 7) AS {v}"


def rounded(df, *names, digits=7):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("a10_glue", f"""WITH {PREDS_SQL}, q AS (SELECT *, exp(-0.5 * pow((pred_loc_x - x) / 10.0, 2)) * exp(-0.5 * pow((pred_loc_y - y) / 10.0, 2)) AS w FROM p)
SELECT pred_loc_x, pred_loc_y, {mean_sql('f_star')}, {mean_sql('f_var')}, {mean_sql('y_var')} FROM q GROUP BY 1, 2""")
def a10_glue(spark, sf_dir):
    return rounded(glue_local_predictions(predictions(spark, sf_dir), 30.0, 3.0), "f_star", "f_var", "y_var")


@query("a11_glue_1d", f"""WITH {PREDS_SQL}, q AS (SELECT *, exp(-0.5 * pow((pred_loc_x - x) / ((10.0 + x) / 3), 2)) AS w FROM p)
SELECT pred_loc_x, {mean_sql('f_star')}, {mean_sql('f_var')}, {mean_sql('y_var')} FROM q GROUP BY 1""")
def a11_glue_1d(spark, sf_dir):
    p = predictions(spark, sf_dir)
    radius = p.select("x").distinct().withColumn("radius", 10.0 + F.col("x"))
    return rounded(glue_1d(p, radius), "f_star", "f_var", "y_var")


@query("a13_glue_by_spacing", f"""WITH {PREDS_SQL}, q AS (SELECT *, exp(-0.5 * pow((pred_loc_x - x) / 2.5, 2)) * exp(-0.5 * pow((pred_loc_y - y) / 2.5, 2)) AS w FROM p)
SELECT pred_loc_x, pred_loc_y, {mean_sql('f_star')} FROM q GROUP BY 1, 2""")
def a13_glue_by_spacing(spark, sf_dir):
    return rounded(glue_by_spacing(predictions(spark, sf_dir), 2.0), "f_star")


@query("a14_weighted_values", f"""WITH {PREDS_SQL}, q AS (SELECT *, exp(-0.5 * pow((pred_loc_x - x) / 4.0, 2)) AS w FROM p)
SELECT pred_loc_x, round(sum(w), 5) AS weight, {mean_sql('f_star')} FROM q GROUP BY 1""")
def a14_weighted_values(spark, sf_dir):
    out = weighted_values(predictions(spark, sf_dir), "pred_loc_x", "x", ["f_star"], 4.0)
    return rounded(rounded(out, "weight", digits=5), "f_star")


@query("a20_mean_by_location", f"WITH {PREDS_SQL} SELECT pred_loc_x, round(avg(f_star), 9) AS f_star, round(avg(y_var), 9) AS y_var FROM p GROUP BY 1")
def a20_mean_by_location(spark, sf_dir):
    return rounded(mean_by_location(predictions(spark, sf_dir), ["pred_loc_x"], ["f_star", "y_var"]), "f_star", "y_var", digits=9)


def parameter_points(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    keys = [(F.col("p_size") * 1.0).alias("x"), (F.col("p_partkey") % 40 * 1.0).alias("y"), (F.col("p_partkey") % 2).cast("int").alias("dim")]
    return p.groupBy(*keys).agg(F.max("p_retailprice").alias("v"))


POINTS_SQL = "q AS (SELECT p_size * 1.0 AS x, p_partkey % 40 * 1.0 AS y, (p_partkey % 2)::INTEGER AS dim, max(p_retailprice) AS v FROM part GROUP BY 1, 2, 3)"


@query("a15_kernel_smooth", f"""WITH {POINTS_SQL}
SELECT a.dim, a.x, a.y, round(sum(b.v * exp(-0.5 * (pow((b.x - a.x) / 3, 2) + pow((b.y - a.y) / 2, 2)))) / sum(exp(-0.5 * (pow((b.x - a.x) / 3, 2) + pow((b.y - a.y) / 2, 2)))), 6) AS v
FROM q a JOIN q b ON a.dim = b.dim AND sqrt(pow(b.x / 3.0 - a.x / 3.0, 2) + pow(b.y / 2.0 - a.y / 2.0, 2)) <= 3.9 GROUP BY 1, 2, 3""")
def a15_kernel_smooth(spark, sf_dir):
    return rounded(kernel_smooth(parameter_points(spark, sf_dir), "v", 3.0, 2.0, by=["dim"], cutoff=3.9), "v", digits=6)


@query("a15_kernel_smooth_full", f"""WITH {POINTS_SQL}
SELECT a.dim, a.x, a.y, round(sum(b.v * exp(-0.5 * (pow((b.x - a.x) / 3, 2) + pow((b.y - a.y) / 2, 2)))) / sum(exp(-0.5 * (pow((b.x - a.x) / 3, 2) + pow((b.y - a.y) / 2, 2)))), 6) AS v
FROM q a JOIN q b ON a.dim = b.dim GROUP BY 1, 2, 3""")
def a15_kernel_smooth_full(spark, sf_dir):
    return rounded(kernel_smooth(parameter_points(spark, sf_dir), "v", 3.0, 2.0, by=["dim"], cutoff=None), "v", digits=6)


NULLS_SQL = """q AS (SELECT p_size * 1.0 AS x, p_partkey % 40 * 1.0 AS y, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 2)::INTEGER END AS dim, max(CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END) AS v FROM part GROUP BY 1, 2, 3)"""


def points_with_nulls(spark, sf_dir):
    """Parameter points of which a fifth have no group and some no value."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    keys = [(F.col("p_size") * 1.0).alias("x"), (k % 40 * 1.0).alias("y"), F.when(k % 5 > 0, (k % 2).cast("int")).alias("dim")]
    return p.groupBy(*keys).agg(F.max(F.when(k % 7 > 0, F.col("p_retailprice"))).alias("v"))


NULLS_SMOOTH_SQL = f"""WITH {NULLS_SQL}, w AS (SELECT a.dim, a.x, a.y, b.v, exp(-0.5 * (pow((b.x - a.x) / 3, 2) + pow((b.y - a.y) / 2, 2))) AS w FROM q a JOIN q b ON a.dim IS NOT DISTINCT FROM b.dim AND b.v IS NOT NULL)
SELECT dim, x, y, round(sum(v * w) / sum(w), 6) AS v FROM w GROUP BY 1, 2, 3"""


@query("a15_kernel_smooth_nulls", NULLS_SMOOTH_SQL)
def a15_kernel_smooth_nulls(spark, sf_dir):
    return rounded(kernel_smooth(points_with_nulls(spark, sf_dir), "v", 3.0, 2.0, by=["dim"]), "v", digits=6)


@query("a15_kernel_smooth_error", NULLS_SMOOTH_SQL)
def a15_kernel_smooth_error(spark, sf_dir):
    """The same without most far pairs: at most 2e-11 of the values' range is lost."""
    return rounded(kernel_smooth(points_with_nulls(spark, sf_dir), "v", 3.0, 2.0, by=["dim"], error=1e-11), "v", digits=6)


@query("a15_kernel_smooth_tree", f"WITH {NULLS_SQL} SELECT dim, x, y, true AS within FROM q WHERE EXISTS (SELECT 1 FROM q b WHERE b.dim IS NOT DISTINCT FROM q.dim AND b.v IS NOT NULL)")
def a15_kernel_smooth_tree(spark, sf_dir):
    """Through the tree of cells; whether each mean is as near to the full sum's as the tree promises."""
    points, error = points_with_nulls(spark, sf_dir), 0.05
    tree = tree_smooth(points, "v", 12.0, 10.0, by=["dim"], error=error)
    full = kernel_smooth(points, "v", 12.0, 10.0, by=["dim"]).select(F.col("dim").alias("d"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("v").alias("fv"))
    spread = points.groupBy(F.col("dim").alias("sd")).agg((F.max("v") - F.min("v")).cast("double").alias("spread"))
    both = tree.join(full, F.col("dim").eqNullSafe(F.col("d")) & (F.col("x") == F.col("fx")) & (F.col("y") == F.col("fy"))).join(spread, F.col("dim").eqNullSafe(F.col("sd")))
    return both.select("dim", "x", "y", (F.abs(F.col("v") - F.col("fv")) <= error * F.col("spread") + 1e-9).alias("within"))


LATTICE_SQL = """q AS (SELECT l_returnflag AS source, floor(l_quantity)::BIGINT AS ix, floor(l_extendedprice / 3000)::BIGINT AS iy, avg(l_discount) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
 d AS (SELECT source, ix, iy, CASE WHEN n % 4 <> 0 THEN v END AS v FROM q)"""


@query("a18_smooth_lattice", f"""WITH {LATTICE_SQL}
SELECT a.source, a.ix, a.iy, round(sum(b.v * exp(-0.5 * (pow(b.ix - a.ix, 2) + pow(b.iy - a.iy, 2)) / 2.25)) / sum(exp(-0.5 * (pow(b.ix - a.ix, 2) + pow(b.iy - a.iy, 2)) / 2.25)), 7) AS v
FROM d a JOIN d b ON a.source = b.source AND abs(a.ix - b.ix) <= 6 AND abs(a.iy - b.iy) <= 6 AND b.v IS NOT NULL WHERE a.v IS NOT NULL GROUP BY 1, 2, 3""")
def a18_smooth_lattice(spark, sf_dir):
    """Mean discounts on a lattice with holes, smoothed for each source."""
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("source"), F.floor("l_quantity").alias("ix"), F.floor(F.col("l_extendedprice") / 3000).alias("iy")).agg(F.avg("l_discount").alias("v"), F.count("*").alias("n"))
    holed = cells.select("source", "ix", "iy", F.when(F.col("n") % 4 != 0, F.col("v")).alias("v"))
    return rounded(smooth_lattice(holed, "v", 1.5, ["source"]).where("v is not null"), "v")


@query("a16_smooth_parameters", f"""WITH {POINTS_SQL}, c AS (SELECT x, y, dim, greatest(least(v, 990), 905) AS v FROM q)
SELECT a.x, a.y, 'lengthscales' AS param, a.dim, round(sum(b.v * exp(-0.5 * (pow((b.x - a.x) / 2, 2) + pow((b.y - a.y) / 2, 2)))) / sum(exp(-0.5 * (pow((b.x - a.x) / 2, 2) + pow((b.y - a.y) / 2, 2)))), 6) AS value
FROM c a JOIN c b ON a.dim = b.dim GROUP BY 1, 2, 4
UNION ALL SELECT x, y, 'kernel_variance', dim, round(v, 6) FROM q""")
def a16_smooth_parameters(spark, sf_dir):
    p = parameter_points(spark, sf_dir).withColumnRenamed("v", "value")
    params = p.withColumn("param", F.explode(F.array(F.lit("lengthscales"), F.lit("kernel_variance"))))
    out = smooth_parameters(params, {"lengthscales": SmoothingConfig(2.0, 2.0, max=990, min=905)}, ["x", "y"], cutoff=None)
    return rounded(out, "value", digits=6)


@query("e12_parameters_of_experts", f"""WITH {POINTS_SQL}
SELECT x, y, count(*)::INTEGER AS n, round(max(CASE WHEN dim = 0 THEN v END), 6) AS first FROM q WHERE dim = 0 GROUP BY 1, 2""")
def e12_parameters_of_experts(spark, sf_dir):
    p = parameter_points(spark, sf_dir).where("dim = 0").select("x", "y", F.lit("lengthscales").alias("param"), "dim", F.col("v").alias("value"))
    places = p.select("x", "y").distinct().withColumn("expert_id", F.xxhash64("x", "y"))
    wide = wide_parameters(p, places, ["x", "y"]).join(places, "expert_id")
    return wide.select("x", "y", F.size("lengthscales").alias("n"), F.round(F.col("lengthscales")[0], 6).alias("first"))


@query("a19_scores", """
SELECT l_returnflag, count(*) AS n, round(sqrt(avg(pow(l_discount - l_tax, 2))), 9) AS rmse, round(avg(pow(l_discount - l_tax, 2)), 9) AS mse,
 round(sum(ln(sqrt(v) * sqrt(2 * pi())) + pow(l_discount - l_tax, 2) / (2 * v)), 4) AS nll, round(avg(ln(sqrt(v) * sqrt(2 * pi())) + pow(l_discount - l_tax, 2) / (2 * v)), 7) AS mean_nll,
 round(avg((l_discount - l_tax) / sqrt(v)), 7) AS mean_norm_diff FROM (SELECT *, 0.001 + l_quantity / 10000 AS v FROM lineitem) GROUP BY 1""")
def a19_scores(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("v", 0.001 + F.col("l_quantity") / 10000)
    out = scores(li, "l_discount", "l_tax", "v", ["l_returnflag"])
    return rounded(rounded(rounded(out, "nll", digits=4), "mean_nll", "mean_norm_diff"), "rmse", "mse", digits=9)


@query("x1_folds", "SELECT DISTINCT l_returnflag, year(l_shipdate) AS year FROM lineitem WHERE l_quantity < 10 UNION SELECT DISTINCT l_returnflag, year(l_shipdate) FROM lineitem WHERE l_quantity > 45")
def x1_folds(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate").cast("long"))
    wheres = [[{"col": "l_quantity", "comp": "<", "val": 10}, {"col": "l_quantity", "comp": ">", "val": 45}]]
    return folds(li, ["l_returnflag", "year"], wheres).drop("fold_id")


WHERES = [[{"col": "l_quantity", "comp": "<", "val": 30}, {"col": "l_quantity", "comp": ">", "val": 15}], [{"col": "l_tax", "comp": "<=", "val": 0.04}]]
WHERES_SQL = "w AS (SELECT *, year(l_shipdate) AS year, i AS where_id FROM lineitem, range(2) r(i) WHERE (CASE WHEN i = 0 THEN l_quantity < 30 ELSE l_quantity > 15 END) AND l_tax <= 0.04)"


@query("x1_folds_of_wheres", f"WITH {WHERES_SQL} SELECT DISTINCT where_id, l_returnflag, year FROM w")
def x1_folds_of_wheres(spark, sf_dir):
    """Two overlapping predicates, each joined to a third: their folds stay apart."""
    li = read(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate").cast("long"))
    return where_folds(li, ["l_returnflag", "year"], WHERES).drop("fold_id")


@query("x2_training_rows_of_wheres", f"""WITH {WHERES_SQL}, f AS (SELECT DISTINCT where_id, l_returnflag AS held FROM w)
SELECT f.where_id, held, count(*) FILTER (WHERE l_returnflag <> held) AS n_training, count(*) FILTER (WHERE l_returnflag = held) AS n_held_out, round(sum(l_discount) FILTER (WHERE l_returnflag <> held), 4) AS total FROM f JOIN w USING (where_id) GROUP BY 1, 2""")
def x2_training_rows_of_wheres(spark, sf_dir):
    """Training and held-out rows both satisfy the predicates of their fold."""
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_tax", "l_discount")
    f, rows = where_folds(li, ["l_returnflag"], WHERES), with_wheres(li, WHERES)
    training = training_rows(rows, f, ["l_returnflag"]).groupBy("fold_id").agg(F.count("*").alias("n_training"), F.round(F.sum("l_discount"), 4).alias("total"))
    held = held_out_locations(rows, f, ["l_returnflag"]).groupBy("fold_id").agg(F.count("*").alias("n_held_out"))
    return f.join(training, "fold_id").join(held, "fold_id").select("where_id", F.col("l_returnflag").alias("held"), "n_training", "n_held_out", "total")


@query("x2_training_rows", """
WITH f AS (SELECT DISTINCT o_orderpriority AS p FROM orders) SELECT p AS fold, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, f WHERE o_orderpriority <> p GROUP BY 1""")
def x2_training_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    f = folds(o, ["o_orderpriority"])
    rows = training_rows(o, f, ["o_orderpriority"]).join(f.withColumnRenamed("o_orderpriority", "fold"), "fold_id")
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("x2_held_out", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def x2_held_out(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return held_out_locations(o, folds(o, ["o_orderpriority"]), ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("x4_cross_validation")
def x4_cross_validation(spark, sf_dir):
    """Scores per held-out source: predictions with fixed parameters, blended, against the truth."""
    cells = bin_by(scaled_observations(spark, sf_dir), "obs", ["source"], grid_res=3.5, x_range=(0.0, 52.5), y_range=(0.0, 52.5))
    out = cross_validate(experts(spark, 3), cells, ExpertConfig(["x", "y"], "obs", [Near(["x", "y"], "<=", 8.0)], GP, optimise=False, max_dist=9.0), ["source"])
    return out["scores"].drop("fold_id").select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "mean_nll")])
