"""Queries over experts with two observations each, where every result has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators.covariance import numbered_locations, predict_covariance
from fieldspark.operators.experts import ExpertConfig, fit_experts, run_experts, select_for_experts
from fieldspark.operators.gp import GPConfig
from fieldspark.operators.nearby import Near, shifted_locations
from fieldspark.plans.tables import PER_UNIT, in_units, read, supplier_x

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


PLAIN = GPConfig(coords_scale=[PER_UNIT], lengthscales=2.0, kernel_variance=1.5, likelihood_variance=0.1)
OFFSETS = tuple(v * PER_UNIT for v in (-1.0, 0.25, 1.5))


def two_each(spark, sf_dir):
    """Suppliers as experts a hundred apart, each with an observation on either side."""
    s = read(spark, sf_dir, "supplier")
    right = s.select(supplier_x(F.col("s_nationkey") / 10.0).alias("x"), (F.col("s_acctbal") / 1000).alias("obs"))
    left = s.select(supplier_x(-1 - F.col("s_nationkey") / 20.0).alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("obs"))
    return s.select(F.col("s_suppkey").alias("expert_id"), supplier_x().alias("x")), right.unionByName(left)


def config(**more) -> ExpertConfig:
    near = [Near("x", "<=", 5.0 * PER_UNIT), Near("x", ">=", -5.0 * PER_UNIT)]
    return ExpertConfig(["x"], "obs", near, **{"gp": PLAIN, "min_obs": 2, "optimise": False, "pred_method": "shift", "offsets": {"x": OFFSETS}, **more})


def matern(d: str) -> str:
    """Matern-3/2 with variance 1.5 and length 2 over a distance."""
    return f"(1.5 * (1 + sqrt(3) * abs({d}) / 2) * exp(-sqrt(3) * abs({d}) / 2))"


PAIR_SQL = f"""o AS (SELECT s_suppkey AS id, s_nationkey / 10.0 AS x1, -1 - s_nationkey / 20.0 AS x2, s_acctbal / 1000 AS y1, (s_suppkey % 7)::DOUBLE AS y2 FROM supplier),
 k AS (SELECT *, {matern('x1 - x2')} AS c, 1.6 * 1.6 - pow({matern('x1 - x2')}, 2) AS det FROM o),
 p AS (SELECT k.*, i, e, {matern('e - x1')} AS k1, {matern('e - x2')} AS k2 FROM k, (VALUES (0, -1.0), (1, 0.25), (2, 1.5)) v(i, e))"""


@query("e4_predict_two_observations", f"""WITH {PAIR_SQL}
SELECT id * 100.0 + e AS pred_loc_x, round((k1 * (1.6 * y1 - c * y2) + k2 * (1.6 * y2 - c * y1)) / det, 8) AS f_star,
 round(1.5 - (1.6 * k1 * k1 - 2 * c * k1 * k2 + 1.6 * k2 * k2) / det, 8) AS f_var FROM p""")
def e4_predict_two_observations(spark, sf_dir):
    preds = run_experts(*two_each(spark, sf_dir), config()).preds
    return preds.select(in_units("pred_loc_x"), F.round("f_star", 8).alias("f_star"), F.round("f_var", 8).alias("f_var"))


@query("e3_objective_two_observations", f"""WITH {PAIR_SQL}
SELECT id * 100.0 AS x, 2 AS num_obs, round(0.5 * (1.6 * y1 * y1 - 2 * c * y1 * y2 + 1.6 * y2 * y2) / det + 0.5 * ln(det) + ln(2 * pi()), 7) AS objective_value FROM k""")
def e3_objective_two_observations(spark, sf_dir):
    """The negative log likelihood of fixed parameters."""
    details = run_experts(*two_each(spark, sf_dir), config()).run_details
    return details.select(in_units("x"), F.col("num_obs").cast("int").alias("num_obs"), F.round("objective_value", 7).alias("objective_value"))


@query("e5_covariance", f"""WITH {PAIR_SQL}
SELECT a.id AS expert_id, a.i, b.i AS j, round({matern('a.e - b.e')} - (1.6 * a.k1 * b.k1 - a.c * (a.k1 * b.k2 + a.k2 * b.k1) + 1.6 * a.k2 * b.k2) / a.det, 8) AS value
FROM p a JOIN p b ON a.id = b.id AND a.i <= b.i""")
def e5_covariance(spark, sf_dir):
    """Covariances of each expert's three locations, in blocks of two."""
    c = config()
    places, obs = two_each(spark, sf_dir)
    selected = select_for_experts(places, obs, c)
    at = shifted_locations(places, c.offsets, c.coords)
    cov = predict_covariance(fit_experts(places, selected, c), selected, at, c, block_rows=2)
    return cov.select("expert_id", "i", "j", F.round("value", 8).alias("value"))


@query("e5_joint_variance", f"""WITH {PAIR_SQL}
SELECT a.id * 100.0 AS x, count(*)::INTEGER AS n, round(sum({matern('a.e - b.e')} - (1.6 * a.k1 * b.k1 - a.c * (a.k1 * b.k2 + a.k2 * b.k1) + 1.6 * a.k2 * b.k2) / a.det) / 9, 8) AS mean_variance
FROM p a JOIN p b ON a.id = b.id GROUP BY 1""")
def e5_joint_variance(spark, sf_dir):
    """The variance of an expert's mean over its locations, which needs the covariances of all pairs."""
    run = run_experts(*two_each(spark, sf_dir), config(full_cov=True))
    locations = numbered_locations(run.preds, ["x"]).groupBy("expert_id").agg(F.count("*").alias("m"))
    both = run.covariance.join(locations, "expert_id").groupBy("expert_id", "m")
    total = both.agg(F.sum(F.col("value") * F.when(F.col("i") == F.col("j"), 1).otherwise(2)).alias("v"), F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(2)).alias("n"))
    return total.select((F.col("expert_id") * 100.0).alias("x"), F.col("n").cast("int").alias("n"), F.round(F.col("v") / (F.col("m") * F.col("m")), 8).alias("mean_variance"))


@query("e7_bounded_variance", """
WITH b AS (SELECT s_suppkey * 100.0 AS x, pow(s_acctbal / 1000, 2) - 0.01 AS best FROM supplier)
SELECT x, CASE WHEN best < 0.5 THEN 'low' WHEN best > 30 THEN 'high' ELSE 'inside' END AS side, true AS at_optimum FROM b""")
def e7_bounded_variance(spark, sf_dir):
    """One observation y, kernel variance s fixed: the best likelihood variance is y * y - s, kept within its bounds."""
    s = read(spark, sf_dir, "supplier")
    places = s.select(F.col("s_suppkey").alias("expert_id"), supplier_x().alias("x"))
    obs = s.select(supplier_x(F.col("s_nationkey") / 10.0).alias("x"), (F.col("s_acctbal") / 1000).alias("obs"))
    gp = GPConfig(coords_scale=[PER_UNIT], lengthscales=2.0, kernel_variance=0.01, likelihood_variance=1.0, fixed=("lengthscales", "kernel_variance"), bounds={"likelihood_variance": (0.5, 30.0)})
    c = config(gp=gp, min_obs=1, optimise=True)
    selected = select_for_experts(places, obs, c)
    best = selected.select("expert_id", (F.col("_obs") * F.col("_obs") - 0.01).alias("best"))
    fitted = fit_experts(places, selected, c).join(best, "expert_id")
    side = F.when(F.col("best") < 0.5, "low").when(F.col("best") > 30, "high").otherwise("inside")
    bounded = F.greatest(F.lit(0.5), F.least(F.lit(30.0), F.col("best")))
    return fitted.select(in_units("x"), side.alias("side"), (F.abs(F.col("likelihood_variance")[0] - bounded) < 0.01 * bounded).alias("at_optimum"))


@query("e10_experts_without_locations", "SELECT s_suppkey AS expert_id FROM supplier WHERE s_suppkey % 3 = 0")
def e10_experts_without_locations(spark, sf_dir):
    """Experts that have nothing to predict are not run."""
    places, obs = two_each(spark, sf_dir)
    c = config(pred_method="from_table", max_dist=5.0 * PER_UNIT, dist_cols=("x",))
    at = places.where("expert_id % 3 = 0").select((F.col("x") + 1.0 * PER_UNIT).alias("x"))
    return run_experts(places, obs, c, at).run_details.select("expert_id")


@query("k3_model_by_path", f"""WITH {PAIR_SQL}
SELECT id * 100.0 + e AS pred_loc_x, 'exact' AS model, round((k1 * (1.6 * y1 - c * y2) + k2 * (1.6 * y2 - c * y1)) / det, 8) AS f_star FROM p""")
def k3_model_by_path(spark, sf_dir):
    """The model is named by where it is defined."""
    run = run_experts(*two_each(spark, sf_dir), config(model="fieldspark.operators.gp:ExactGP"))
    return run.preds.join(run.run_details.select("expert_id", "model"), "expert_id").select(in_units("pred_loc_x"), "model", F.round("f_star", 8).alias("f_star"))


@query("e17_sparse_two_observations", f"""WITH {PAIR_SQL},
 m AS (SELECT *, 1.5 * 1.000001 AS b, (1.5 * 1.000001 * 1.5 - c * c) / (pow(1.5 * 1.000001, 2) - c * c) AS m1, 1.5 * 0.000001 * c / (pow(1.5 * 1.000001, 2) - c * c) AS m2 FROM p),
 q AS (SELECT *, 1.5 * m1 + c * m2 + 0.1 AS s1, 1.5 * m2 + c * m1 AS s2, k1 * m1 + k2 * m2 AS q1, k1 * m2 + k2 * m1 AS q2, b + 10 * (2.25 + c * c) AS p1, c + 30 * c AS p2 FROM m)
SELECT id * 100.0 + e AS pred_loc_x, round((q1 * (s1 * y1 - s2 * y2) + q2 * (s1 * y2 - s2 * y1)) / (s1 * s1 - s2 * s2), 7) AS f_star,
 round(1.5 - (b * k1 * k1 - 2 * c * k1 * k2 + b * k2 * k2) / (b * b - c * c) + (p1 * k1 * k1 - 2 * p2 * k1 * k2 + p1 * k2 * k2) / (p1 * p1 - p2 * p2), 7) AS f_var FROM q""")
def e17_sparse_two_observations(spark, sf_dir):
    """The sparse model with both observations as inducing points, its jitter included."""
    preds = run_experts(*two_each(spark, sf_dir), config(model="sparse")).preds
    return preds.select(in_units("pred_loc_x"), F.round("f_star", 7).alias("f_star"), F.round("f_var", 7).alias("f_var"))


@query("e19_details_of_a_run", "SELECT s_suppkey * 100.0 AS x, true AS has_device, true AS timed, 'exact' AS model FROM supplier")
def e19_details_of_a_run(spark, sf_dir):
    d = run_experts(*two_each(spark, sf_dir), config()).run_details
    return d.select(in_units("x"), (F.length("device") > 0).alias("has_device"), F.col("run_time").between(0, 3600).alias("timed"), "model")
