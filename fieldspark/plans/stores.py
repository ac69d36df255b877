"""Queries over stored tables, many files, streams of files, and small helpers on rows and arrays."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from fieldspark.functions.arrays import arrays_to_tables, expand_by_values, one_row, with_coordinates
from fieldspark.functions.columns import ColumnSpec, add_columns, rename_all
from fieldspark.functions.mathfun import known
from fieldspark.functions.predicates import select_rows
from fieldspark.operators.experts import ExpertConfig, fit_experts, run_and_store, run_experts, select_for_experts
from fieldspark.operators.glue import SmoothingConfig, glue
from fieldspark.operators.gp import GPConfig
from fieldspark.operators.nearby import Near, latest_per, sample_truth
from fieldspark.operators.xval import cross_validate
from fieldspark.plans.regression import PREDS_SQL, mean_sql, predictions, rounded
from fieldspark.plans.tables import PER_UNIT, in_units, read, supplier_x
from fieldspark.sources.ingest import ingest
from fieldspark.sources.scan import load, read_from_directories, union_all
from fieldspark.sources.scratch import scratch_root
from fieldspark.sources.store import Store, collect_results
from fieldspark.streaming.streams import ingest_available, stream_files

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def fresh(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("s9_store_append", "SELECT c_custkey, c_acctbal, c_nationkey % 2 AS part, 2 AS writes FROM customer WHERE c_acctbal > 0")
def s9_store_append(spark, sf_dir):
    """Write, append, read with a filter and columns; the attributes of both writes come back."""
    store, c = Store(spark, fresh(spark, "store")), read(spark, sf_dir, "customer").withColumn("part", F.col("c_nationkey") % 2)
    for p in (0, 1):
        store.write(c.where(F.col("part") == p), "customers", append=p > 0, config={"part": p}, run_info=True)
    kept = [x["part"] for x in store.attribute("customers", "config")]
    out = store.read("customers", [{"col": "c_acctbal", "comp": ">", "val": 0}], ["c_custkey", "c_acctbal", "part"])
    return out.withColumn("writes", F.lit(len(kept)))


@query("s14_export_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey >= 3")
def s14_export_csv(spark, sf_dir):
    """A stored table to CSV, and read again by the flat-file reader with a declared schema."""
    store = Store(spark, fresh(spark, "store"))
    store.write(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), "suppliers")
    path = fresh(spark, "export")
    store.export_csv("suppliers", f"{path}/suppliers.csv")
    return load(spark, f"{path}/suppliers.csv", where=[{"col": "s_nationkey", "comp": ">=", "val": 3}], schema="s_suppkey bigint, s_name string, s_acctbal double, s_nationkey int", col_select=["s_suppkey", "s_name", "s_acctbal"])


def order_files(spark, sf_dir) -> str:
    """orders as CSV files, one directory a status."""
    path = fresh(spark, "orders")
    read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").repartition(3, "o_orderkey").write.partitionBy("o_orderstatus").option("header", True).csv(path)
    return path


ORDER_SCHEMA = "o_orderkey bigint, o_totalprice double"


@query("s1_files_by_regex", "SELECT o_orderkey, o_totalprice, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 1000")
def s1_files_by_regex(spark, sf_dir):
    spec = ColumnSpec("status", lambda c: F.regexp_extract(c, "o_orderstatus=(.)", 1), ["_path"])
    path = order_files(spark, sf_dir)
    files = read_from_directories(spark, path, r"^part-.*\.csv$", ["o_orderstatus=F", "o_orderstatus=O"], schema=ORDER_SCHEMA, row_select=[{"col": "o_totalprice", "comp": ">", "val": 1000}])
    return add_columns(files.select("*", F.col("_metadata.file_path").alias("_path")), [spec]).drop("_path")


@query("s3_recursive_files", "SELECT o_orderkey, o_totalprice FROM orders")
def s3_recursive_files(spark, sf_dir):
    return read_from_directories(spark, order_files(spark, sf_dir), r"\.csv$", walk=True, schema=ORDER_SCHEMA)


@query("s12_ingest_ledger", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS first_run, 0 AS again FROM orders WHERE o_orderstatus <> 'P'")
def s12_ingest_ledger(spark, sf_dir):
    """Batches that the ledger holds are not read again; a directory that is missing is left for later."""
    path, store = order_files(spark, sf_dir), Store(spark, fresh(spark, "store"))
    run = lambda: ingest(spark, store, "orders", [path], r"\.csv$", ["o_orderstatus=F", "o_orderstatus=O", "none"], schema=ORDER_SCHEMA)
    first, again = run(), run()
    return store.read("orders", columns=["o_orderkey", "o_totalprice"]).withColumns({"first_run": F.lit(first).cast("long"), "again": F.lit(again)})


@query("st1_stream_files", "SELECT o_orderkey, round(o_totalprice * 2, 4) AS twice FROM orders WHERE o_totalprice > 5000")
def st1_stream_files(spark, sf_dir):
    """New files as a stream into a table; a second run finds nothing new."""
    source, out, checkpoint = order_files(spark, sf_dir), fresh(spark, "streamed"), fresh(spark, "checkpoint")
    for _ in range(2):
        s = stream_files(spark, f"{source}/*", ORDER_SCHEMA, col_funcs=[ColumnSpec("twice", lambda p: F.round(p * 2, 4), ["o_totalprice"])], row_select=[{"col": "o_totalprice", "comp": ">", "val": 5000}], col_select=["o_orderkey", "twice"])
        ingest_available(s, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("s16_table_as_source", "SELECT p_partkey, p_size FROM part WHERE p_size >= 25")
def s16_table_as_source(spark, sf_dir):
    return load(spark, read(spark, sf_dir, "part"), where=[{"col": "p_size", "comp": ">=", "val": 25}], col_select=["p_partkey", "p_size"])


@query("p4_column_by_position", "SELECT k, bal + 1 AS more FROM (SELECT c_custkey AS k, c_acctbal AS bal FROM customer)")
def p4_column_by_position(spark, sf_dir):
    c = rename_all(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["k", "bal"])  # P6
    return add_columns(c, [ColumnSpec("more", lambda x: x + 1, [1])]).select("k", "more")


@query("p8_allowed_constant", "SELECT s_suppkey, 'north' AS pole FROM supplier")
def p8_allowed_constant(spark, sf_dir):
    return add_columns(read(spark, sf_dir, "supplier").select("s_suppkey"), [ColumnSpec("pole", "north", allowed=["north", "south"])])


@query("j18_lattice_to_cells", "WITH c AS (SELECT p_size AS x, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1) SELECT g.x, n FROM (SELECT DISTINCT l_quantity::INTEGER AS x FROM lineitem) g LEFT JOIN c USING (x)")
def j18_lattice_to_cells(spark, sf_dir):
    cells = read(spark, sf_dir, "part").where("p_size % 2 = 0").groupBy(F.col("p_size").cast("int").alias("x")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("x")).distinct().join(cells, "x", "left")


@query("j19_groups_to_rows", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS off FROM orders")
def j19_groups_to_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.join(o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m")), "o_orderpriority").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 4).alias("off"))


@query("w9_latest_per", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def w9_latest_per(spark, sf_dir):
    return latest_per(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("u3_except", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity < 10 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 48")
def u3_except(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.where("l_quantity < 10").select(F.col("l_suppkey").alias("k")).subtract(li.where("l_discount > 0.09 AND l_quantity > 48").select("l_suppkey"))


@query("u5_arrays_side_by_side", """
SELECT vec_id, i - 1 AS _dim_0, round(embedding[i]::DOUBLE, 6) AS a, CASE WHEN i <= 32 THEN round(2 * embedding[i]::DOUBLE, 6) END AS b FROM embeddings, range(1, 65) r(i)""")
def u5_arrays_side_by_side(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    e = e.withColumn("b", F.transform(F.slice("a", 1, 32), lambda x: 2 * x))
    return arrays_to_tables(e, ["a", "b"], ["vec_id"], concat=True)[1].select("vec_id", F.col("_dim_0").cast("long"), F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("y4_with_coordinates", "SELECT 1.5 AS x, 'n' AS pole, p_partkey FROM part")
def y4_with_coordinates(spark, sf_dir):
    return with_coordinates(read(spark, sf_dir, "part").select("p_partkey"), {"x": 1.5, "pole": "n"})


@query("m4_known_values", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey > 2")
def m4_known_values(spark, sf_dir):
    v = F.when(F.col("c_nationkey") > 2, F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(float("nan")))
    return read(spark, sf_dir, "customer").withColumn("v", v).where(known(F.col("v"))).select("c_custkey")


@query("n3_expand_values", "SELECT o_orderstatus AS status, p AS least, count(*) AS n FROM orders, (VALUES (1000), (100000)) v(p) WHERE o_totalprice >= p AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2")
def n3_expand_values(spark, sf_dir):
    """One selection for each combination of the list-valued entries of a configuration."""
    o = read(spark, sf_dir, "orders")
    parts = [
        select_rows(o, [{"col": "o_orderstatus", "comp": "==", "val": c["status"]}, {"col": "o_totalprice", "comp": ">=", "val": c["least"]}]).select(F.lit(c["status"]).alias("status"), F.lit(c["least"]).alias("least"))
        for c in expand_by_values({"status": ["F", "O"], "least": [1000, 100000]}, ["status", "least"])
    ]
    return union_all(parts).groupBy("status", "least").agg(F.count("*").alias("n"))


@query("n4_one_row", "SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT avg(c_acctbal) FROM customer)")
def n4_one_row(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.where(F.col("c_acctbal") >= one_row(c.agg(F.avg("c_acctbal").alias("mean")))["mean"]).select("c_custkey")


@query("a12_glue_pairs", f"""WITH {PREDS_SQL}, q AS (SELECT *, exp(-0.5 * (pow((pred_loc_x - x) / 12.0, 2) + pow((pred_loc_y - y) / 12.0, 2) + pow((x - y) / 12.0, 2))) AS w FROM p)
SELECT pred_loc_x, pred_loc_y, x AS pred_loc_z, {mean_sql('f_star')} FROM q GROUP BY 1, 2, 3""")
def a12_glue_pairs(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("pred_loc_z", F.col("x"))
    return rounded(glue(p, [("pred_loc_x", "x"), ("pred_loc_y", "y"), ("pred_loc_z", "y")], 12.0, ["f_star"]), "f_star")


@query("g9_sample_truth", """
WITH a AS (SELECT s_suppkey AS id, s_nationkey * 2.0 AS x, s_acctbal / 100 AS y FROM supplier),
 d AS (SELECT id, p_retailprice + p_size AS v, row_number() OVER (PARTITION BY id ORDER BY sqrt(pow(p_size - x, 2) + pow(p_retailprice - 900 - y, 2)), p_partkey) AS k FROM a, part)
SELECT id, round(v - avg(v) OVER (), 6) AS obs FROM d WHERE k = 1""")
def g9_sample_truth(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 2.0).alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    truth = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") - 900).alias("y"), (F.col("p_retailprice") + F.col("p_size")).alias("v"))
    return sample_truth(a, truth, ["x", "y"], "id", "p_partkey", "v", 4.0).select("id", F.round("obs", 6).alias("obs"))


def one_each(spark, sf_dir):
    """Suppliers as experts a hundred apart, each with one observation close by."""
    s = read(spark, sf_dir, "supplier")
    obs = s.select(supplier_x(F.col("s_nationkey") / 10.0).alias("x"), (F.col("s_acctbal") / 1000).alias("obs"))
    return s.select(F.col("s_suppkey").alias("expert_id"), supplier_x().alias("x")), obs


def alone(gp: GPConfig, **more) -> ExpertConfig:
    return ExpertConfig(["x"], "obs", [Near("x", "<=", 5.0 * PER_UNIT), Near("x", ">=", -5.0 * PER_UNIT)], gp, **{"min_obs": 1, "optimise": False, "pred_method": "expert_loc", **more})


PLAIN = GPConfig(coords_scale=[PER_UNIT], lengthscales=2.0, kernel_variance=1.5, likelihood_variance=0.1)


@query("e13_stored_results", """
WITH k AS (SELECT s_suppkey, s_acctbal / 1000 AS y, 1.5 * (1 + sqrt(3) * d) * exp(-sqrt(3) * d) AS k FROM (SELECT *, s_nationkey / 10.0 / 2 AS d FROM supplier))
SELECT s_suppkey * 100.0 AS x, round(k / 1.6 * y, 9) AS f_star, round(2 * (k / 1.6 * y), 9) AS twice, 1 AS num_obs, 1 AS config_id FROM k""")
def e13_stored_results(spark, sf_dir):
    """Half of the experts, then all: the second run skips those that are stored; tables are collected."""
    places, obs = one_each(spark, sf_dir)
    store, c = Store(spark, fresh(spark, "run")), alone(PLAIN, table_suffix="_A")
    run_and_store(store, places.where("expert_id % 2 = 0"), obs, c)
    run_and_store(store, places, obs, c)
    out = collect_results(store, "_A", coords=["x"], col_funcs={"preds": [ColumnSpec("twice", "*", ["f_star"], [2])]})
    details = out["run_details_A"].select("x", F.col("num_obs").cast("int"), "config_id")
    return out["preds_A"].join(details, "x").select(in_units("x"), F.round("f_star", 9).alias("f_star"), F.round("twice", 9).alias("twice"), "num_obs", "config_id")


@query("e2_scaled_data", """
WITH k AS (SELECT s_suppkey, (s_acctbal / 1000 - 3) / 2 AS y, 1.5 * exp(-0.5 * d * d) AS k FROM (SELECT *, s_nationkey / 10.0 / 4 / 2 AS d FROM supplier))
SELECT s_suppkey * 100.0 AS x, round(k / 1.6 * y, 9) AS f_star, round(1.5 - k * k / 1.6, 9) AS f_var, round(k / 1.6 * y * 2 + 3, 9) AS f_star_obs FROM k""")
def e2_scaled_data(spark, sf_dir):
    """Scaled coordinates and values, a given mean, another kernel; all parameters fixed while optimising."""
    gp = GPConfig(kernel="rbf", coords_scale=[4.0 * PER_UNIT], obs_scale=2.0, obs_mean=3.0, lengthscales=2.0, kernel_variance=1.5, likelihood_variance=0.1, fixed=("lengthscales", "kernel_variance", "likelihood_variance"))
    preds = run_experts(*one_each(spark, sf_dir), alone(gp, optimise=True)).preds
    return preds.select(in_units("x"), *[F.round(c, 9).alias(c) for c in ("f_star", "f_var", "f_star_obs")])


@query("e3_fitted_variance", "SELECT s_suppkey * 100.0 AS x, true AS at_optimum, true AS success FROM supplier WHERE abs(s_acctbal) >= 500")
def e3_fitted_variance(spark, sf_dir):
    """With one observation y and a fixed kernel variance s the best likelihood variance is y * y - s."""
    places, obs = one_each(spark, sf_dir)
    c = alone(GPConfig(coords_scale=[PER_UNIT], lengthscales=2.0, kernel_variance=0.01, likelihood_variance=1.0, fixed=("lengthscales", "kernel_variance")), optimise=True)
    obs = obs.where("abs(obs) >= 0.5")
    fitted = fit_experts(places, select_for_experts(places, obs, c), c).where("num_obs = 1")
    best = select_for_experts(places, obs, c).select("expert_id", (F.col("_obs") * F.col("_obs") - 0.01).alias("best"))
    close = F.abs(F.col("likelihood_variance")[0] - F.col("best")) < 0.001 * F.col("best")
    return fitted.join(best, "expert_id").select(in_units("x"), close.alias("at_optimum"), F.col("optimise_success").alias("success"))


@query("e11_replacement_model", "SELECT s_suppkey * 100.0 AS x, 'sparse' AS model FROM supplier")
def e11_replacement_model(spark, sf_dir):
    run = run_experts(*one_each(spark, sf_dir), alone(PLAIN, replacement_model="sparse", replacement_threshold=2))
    return run.run_details.select(in_units("x"), "model")


@query("x4_scores_by_fold", """
WITH o AS (SELECT s_suppkey AS k, 0 AS fold, s_nationkey / 10.0 AS x, s_acctbal / 1000 AS y FROM supplier UNION ALL SELECT s_suppkey, 1, 1 + s_nationkey / 20.0, s_suppkey % 7 FROM supplier),
 p AS (SELECT a.fold, a.y, b.y AS other, abs(a.x - b.x) / 2 * sqrt(3) AS d FROM o a JOIN o b ON a.k = b.k AND a.fold <> b.fold),
 q AS (SELECT fold, y - 1.5 * (1 + d) * exp(-d) / 1.6 * other AS e, 1.6 - pow(1.5 * (1 + d) * exp(-d), 2) / 1.6 AS v FROM p)
SELECT fold, count(*) AS n, round(sqrt(avg(e * e)), 7) AS rmse, round(avg(ln(sqrt(v) * sqrt(2 * pi())) + e * e / (2 * v)), 7) AS mean_nll FROM q GROUP BY 1""")
def x4_scores_by_fold(spark, sf_dir):
    """Two folds, each with one observation near every expert: the one predicts the other."""
    places, first = one_each(spark, sf_dir)
    second = read(spark, sf_dir, "supplier").select(supplier_x(1 + F.col("s_nationkey") / 20.0).alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("obs"))
    obs = first.withColumn("fold", F.lit(0)).unionByName(second.withColumn("fold", F.lit(1)))
    out = cross_validate(places, obs, alone(PLAIN, max_dist=5.0 * PER_UNIT, dist_cols=("x",)), ["fold"])
    return out["scores"].join(out["folds"], "fold_id").select("fold", "n", F.round("rmse", 7).alias("rmse"), F.round("mean_nll", 7).alias("mean_nll"))


@query("x5_smoothed_scores_by_fold", """
WITH o AS (SELECT s_suppkey AS k, 0 AS fold, s_nationkey / 10.0 AS x, s_acctbal / 1000 AS y FROM supplier UNION ALL SELECT s_suppkey, 1, 1 + s_nationkey / 20.0, s_suppkey % 7 FROM supplier),
 p AS (SELECT a.fold, a.y, b.y AS other, abs(a.x - b.x) / 2 * sqrt(3) AS d FROM o a JOIN o b ON a.k = b.k AND a.fold <> b.fold),
 q AS (SELECT fold, y - 1.5 * (1 + d) * exp(-d) / 1.55 * other AS e, 1.55 - pow(1.5 * (1 + d) * exp(-d), 2) / 1.55 AS v FROM p)
SELECT fold, count(*) AS n, round(sqrt(avg(e * e)), 7) AS rmse, round(avg(ln(sqrt(v) * sqrt(2 * pi())) + e * e / (2 * v)), 7) AS mean_nll FROM q GROUP BY 1""")
def x5_smoothed_scores_by_fold(spark, sf_dir):
    """The same two folds; each predicts with a noise variance of at most 0.05, smoothed over all experts."""
    places, first = one_each(spark, sf_dir)
    second = read(spark, sf_dir, "supplier").select(supplier_x(1 + F.col("s_nationkey") / 20.0).alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("obs"))
    obs = first.withColumn("fold", F.lit(0)).unionByName(second.withColumn("fold", F.lit(1))).withColumn("y", F.lit(0.0))
    c = replace(alone(PLAIN, max_dist=5.0 * PER_UNIT, dist_cols=("x",)), coords=["x", "y"])
    out = cross_validate(places.withColumn("y", F.lit(0.0)), obs, c, ["fold"], smooth={"likelihood_variance": SmoothingConfig(500.0 * PER_UNIT, 1.0, max=0.05)})
    return out["scores"].join(out["folds"], "fold_id").select("fold", "n", F.round("rmse", 7).alias("rmse"), F.round("mean_nll", 7).alias("mean_nll"))
