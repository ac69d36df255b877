"""Queries over joins: range joins, nearest rows, comparisons, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators.compare import common_locations, compare_tables, differences, join_rounded, match, not_done, of_experts
from fieldspark.operators.grid import value_at_nearest_cell
from fieldspark.operators.lattice import bilinear_value
from fieldspark.operators.nearby import Near, band_terms, distance, expert_as_location, local_select, near_join, nearest, prediction_locations, shifted_locations
from fieldspark.plans.tables import SCALED_SQL, experts, experts_sql, observations, read, scaled_observations
from fieldspark.sources.store import attach_locations

QUERIES: dict = {}
ORACLE_SQL: dict = {}
RADIUS = 6.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("j1_local_select", f"WITH {SCALED_SQL}, {experts_sql()} SELECT expert_id, id FROM experts e JOIN obs o ON sqrt(pow(o.x - e.x, 2) + pow(o.y - e.y, 2)) <= {RADIUS}")
def j1_local_select(spark, sf_dir):
    return local_select(experts(spark), scaled_observations(spark, sf_dir), [Near(["x", "y"], "<=", RADIUS)], ["id"], ["x", "y"]).select("expert_id", "id")


@query("j2_band_and_ball", f"""WITH {SCALED_SQL}, {experts_sql()}, d AS (SELECT *, 9500.0 + expert_id * 20 AS t FROM experts)
SELECT expert_id, count(*) AS n, round(sum(o.obs), 6) AS total FROM d e JOIN obs o ON sqrt(pow(o.x - e.x, 2) + pow(o.y - e.y, 2)) <= 8 AND o.t <= e.t + 60 AND o.t >= e.t - 60 GROUP BY 1""")
def j2_band_and_ball(spark, sf_dir):
    e = experts(spark).withColumn("t", 9500.0 + F.col("expert_id") * 20)
    got = local_select(e, scaled_observations(spark, sf_dir), [Near(["x", "y"], "<=", 8.0), *band_terms("t", 60.0)], ["obs"], ["x", "y", "t"])
    return got.groupBy("expert_id").agg(F.count("*").alias("n"), F.round(F.sum("obs"), 6).alias("total"))


def price_points(spark, sf_dir):
    return read(spark, sf_dir, "part").select((F.col("p_size") * 1.0).alias("x"), ((F.col("p_retailprice") - 900) / 2).alias("y")).distinct()


POINTS_SQL = "p AS (SELECT DISTINCT p_size * 1.0 AS x, (p_retailprice - 900) / 2 AS y FROM part)"


@query("j3_prediction_locations", f"""WITH {experts_sql()}, {POINTS_SQL}
SELECT expert_id, p.x AS pred_loc_x, round(p.y, 6) AS pred_loc_y, expert_id * 1.5 AS pred_loc_t FROM experts e JOIN p ON sqrt(pow(p.x - e.x, 2) + pow(p.y - e.y, 2)) < 5""")
def j3_prediction_locations(spark, sf_dir):
    e = experts(spark).withColumn("t", F.col("expert_id") * 1.5)
    out = prediction_locations(e, price_points(spark, sf_dir), 5.0, ["x", "y"], ["x", "y", "t"])
    return out.withColumn("pred_loc_y", F.round("pred_loc_y", 6))


@query("j4_locations_with_select", f"""WITH {experts_sql()}, {POINTS_SQL}
SELECT expert_id, p.x AS pred_loc_x, round(p.y, 6) AS pred_loc_y FROM experts e JOIN p ON sqrt(pow(p.x - e.x, 2) + pow(p.y - e.y, 2)) < 5 AND p.x >= e.x - 1""")
def j4_locations_with_select(spark, sf_dir):
    out = prediction_locations(experts(spark), price_points(spark, sf_dir), 5.0, ["x", "y"], ["x", "y"], [Near("x", ">=", -1.0)])
    return out.withColumn("pred_loc_y", F.round("pred_loc_y", 6))


@query("j6_shifted_locations", """SELECT s_suppkey AS expert_id, round(s_acctbal + a, 6) AS pred_loc_x, s_nationkey + b AS pred_loc_y FROM supplier, (VALUES (-1.5), (0.0), (1.5)) u(a), (VALUES (-2.0), (2.0)) v(b)""")
def j6_shifted_locations(spark, sf_dir):
    e = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("expert_id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return shifted_locations(e, {"x": [-1.5, 0, 1.5], "y": [-2, 2]}, ["x", "y"]).withColumn("pred_loc_x", F.round("pred_loc_x", 6))


@query("j7_expert_locations", "SELECT s_suppkey AS expert_id, s_acctbal AS pred_loc_x FROM supplier")
def j7_expert_locations(spark, sf_dir):
    e = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("expert_id"), F.col("s_acctbal").alias("x"))
    return expert_as_location(e, ["x"])


@query("j9_not_done", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j9_not_done(spark, sf_dir):
    done = read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return not_done(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), done, ["c_custkey"])


@query("j10_attach_locations", "SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, n.n_name, n.n_regionkey::DOUBLE AS c_acctbal_expert_location FROM customer c LEFT JOIN nation n ON c_nationkey = n_nationkey")
def j10_attach_locations(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").cast("double").alias("c_acctbal"))
    return attach_locations(c, n, ["c_nationkey"])


@query("j11_chosen_experts", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def j11_chosen_experts(spark, sf_dir):
    chosen = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return of_experts(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), chosen, ["o_custkey"])


@query("j13_nearest_truth", """
WITH a AS (SELECT s_suppkey AS id, s_nationkey * 2.0 AS x, s_acctbal / 100 AS y FROM supplier),
 d AS (SELECT id, p_partkey, round(sqrt(pow(p_size - x, 2) + pow(p_retailprice - 900 - y, 2)), 6) AS distance,
  row_number() OVER (PARTITION BY id ORDER BY sqrt(pow(p_size - x, 2) + pow(p_retailprice - 900 - y, 2)), p_partkey) AS k FROM a, part)
SELECT id, p_partkey, distance FROM d WHERE k = 1""")
def j13_nearest_truth(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 2.0).alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    truth = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") - 900).alias("y"))
    return nearest(a, truth, ["x", "y"], "id", "p_partkey", [], 2.0).select("id", "p_partkey", F.round("distance", 6).alias("distance"))


@query("j14_rounded_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON round(s_acctbal, 0) = round(c_acctbal, 0)")
def j14_rounded_join(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("b"))
    return join_rounded(s, read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("b")), ["b"], 0).select("s_suppkey", "c_custkey")


@query("j15_common_locations", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def j15_common_locations(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    parts = [o.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FOP"]
    return common_locations(parts, ["o_custkey"])[0]


def nation_balances(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("bal"))
    s = read(spark, sf_dir, "supplier").where("s_nationkey <> 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("bal"))
    return c, s


BALANCES_SQL = """c AS (SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer WHERE c_nationkey <> 3 GROUP BY 1), s AS (SELECT s_nationkey AS k, avg(s_acctbal) AS b FROM supplier WHERE s_nationkey <> 5 GROUP BY 1)"""


@query("j16_compare_tables", f"""WITH {BALANCES_SQL} SELECT k, round(a, 6) AS bal_1, round(b, 6) AS bal_2, round(abs(a - b), 6) AS bal_abs_diff, round(abs(a - b) / least(abs(a), abs(b)), 6) AS bal_rel_diff FROM c FULL JOIN s USING (k)""")
def j16_compare_tables(spark, sf_dir):
    out = compare_tables(*nation_balances(spark, sf_dir), ["k"], ["bal"])
    both = F.col("bal_1").isNotNull() & F.col("bal_2").isNotNull()
    out = out.withColumn("bal_rel_diff", F.when(both, F.col("bal_rel_diff")))
    return out.select("k", *[F.round(x, 6).alias(x) for x in ("bal_1", "bal_2", "bal_abs_diff", "bal_rel_diff")])


@query("a25_differences", f"WITH {BALANCES_SQL} SELECT k, round(abs(a - b), 6) AS bal_abs_diff FROM c JOIN s USING (k) WHERE abs(a - b) > 500 ORDER BY 2 DESC")
def a25_differences(spark, sf_dir):
    return differences(*nation_balances(spark, sf_dir), ["k"], "bal", 500.0).select("k", F.round("bal_abs_diff", 6).alias("bal_abs_diff"))


@query("j17_match", """
WITH y AS (SELECT p_partkey AS idx, p_retailprice AS v FROM part) SELECT s_suppkey AS idx, coalesce((SELECT min(y.idx) FROM y WHERE abs(y.v - (900 + s_acctbal / 100)) < 0.05), -1) AS y_idx FROM supplier""")
def j17_match(spark, sf_dir):
    x = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), (900 + F.col("s_acctbal") / 100).alias("v"))
    y = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("v"))
    return match(x, y, "v", "v", tol=0.05).select("idx", F.coalesce("y_idx", F.lit(-1)).alias("y_idx"))


@query("u4_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def u4_intersect(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    return c.intersect(read(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("g8_raster_value", """
WITH r AS (SELECT p_size AS cx, avg(p_retailprice) AS v FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(v - l_discount, 6) AS height FROM lineitem LEFT JOIN r ON l_quantity = cx""")
def g8_raster_value(spark, sf_dir):
    raster = read(spark, sf_dir, "part").groupBy((F.col("p_size") * 1.0).alias("x")).agg(F.avg("p_retailprice").alias("v")).withColumn("y", F.lit(0.0))
    pts = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.col("l_quantity").alias("x"), F.lit(0.0).alias("y"))
    return value_at_nearest_cell(pts, raster, "x", "y", "v", 1.0, "geoid").select("l_orderkey", "l_linenumber", F.round(F.col("geoid") - F.col("l_discount"), 6).alias("height"))


RASTER_SQL = "r AS (SELECT p_size AS cx, p_partkey % 40 AS cy, avg(p_retailprice) AS v FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1, 2)"


@query("g8_bilinear_value", f"""WITH {RASTER_SQL},
 p AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_quantity + l_discount * 7 AS x, l_extendedprice / 2700 AS y FROM lineitem),
 c AS (SELECT id, l_orderkey, l_linenumber, floor(x) + i AS cx, floor(y) + j AS cy, (CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM p, range(2) a(i), range(2) b(j))
SELECT c.l_orderkey, c.l_linenumber, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS height FROM c LEFT JOIN r ON c.cx = r.cx AND c.cy = r.cy AND w > 0 GROUP BY c.id, 1, 2""")
def g8_bilinear_value(spark, sf_dir):
    """A raster with holes, read between its cells; points outside have no value."""
    raster = read(spark, sf_dir, "part").where("p_partkey % 9 <> 0").groupBy((F.col("p_size") * 1.0).alias("x"), (F.col("p_partkey") % 40 * 1.0).alias("y")).agg(F.avg("p_retailprice").alias("v"))
    pts = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.col("l_discount") * 7).alias("x"), (F.col("l_extendedprice") / 2700).alias("y"))
    return bilinear_value(pts, raster, "x", "y", "v", 1.0, "height").select("l_orderkey", "l_linenumber", F.round("height", 6).alias("height"))


@query("j1_distances", f"WITH {SCALED_SQL}, {experts_sql()} SELECT expert_id, round(min(sqrt(pow(o.x - e.x, 2) + pow(o.y - e.y, 2))), 6) AS nearest FROM experts e JOIN obs o ON sqrt(pow(o.x - e.x, 2) + pow(o.y - e.y, 2)) <= {RADIUS} GROUP BY 1")
def j1_distances(spark, sf_dir):
    pairs = near_join(experts(spark), observations(spark, sf_dir).withColumn("x", F.col("x") / 2000.0), [Near(["x", "y"], "<=", RADIUS)], keep=["id"])
    return pairs.groupBy(F.col("e_expert_id").alias("expert_id")).agg(F.round(F.min(distance(["x", "y"])), 6).alias("nearest"))
