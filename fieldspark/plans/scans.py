"""Queries over scans: loading, derived columns, predicates, sampling, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions.arrays import array_to_rows, rows_to_array, sorted_array
from fieldspark.functions.columns import ColumnSpec, add_columns, repeat_for_values
from fieldspark.functions.predicates import global_select, interval_rules, run_bounds, select_rows
from fieldspark.operators.stats import down_sample, quantile_clip
from fieldspark.plans.tables import OBS_SQL, observations, read
from fieldspark.sources.scan import load, long_from_arrays, union_all

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("s4_load_select", """
SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 6) AS revenue, 'box' AS area
FROM lineitem WHERE l_quantity >= 10 AND l_shipdate < TIMESTAMP '1997-01-01' AND l_extendedprice * (1 - l_discount) > 20000""")
def s4_load_select(spark, sf_dir):
    return load(
        spark, f"{sf_dir}/lineitem.parquet",
        where=[{"col": "l_quantity", "comp": ">=", "val": 10}, {"col": "l_shipdate", "comp": "<", "val": "1997-01-01"}],
        col_funcs=[ColumnSpec("revenue", lambda p, d: F.round(p * (1 - d), 6), ["l_extendedprice", "l_discount"])],
        row_select=[{"col": "revenue", "comp": ">", "val": 20000}],
        add_data_to_col={"area": "box"},
        col_select=["l_orderkey", "l_linenumber", "l_quantity", "revenue", "area"],
    )


@query("s8_pushed_parquet_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def s8_pushed_parquet_filter(spark, sf_dir):
    return select_rows(read(spark, sf_dir, "orders"), [{"col": "o_orderstatus", "comp": "==", "val": "F"}, {"col": "o_totalprice", "comp": ">", "val": 100000}], columns=["o_orderkey", "o_totalprice"])


@query("s13_long_from_arrays", """
SELECT label, vec_id, i // 8 AS _dim_0, i % 8 AS _dim_1, round(embedding[i + 1]::DOUBLE, 6) AS obs
FROM embeddings, range(64) r(i) WHERE embedding[i + 1] IS NOT NULL""")
def s13_long_from_arrays(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    rows = long_from_arrays(e.select("label", "vec_id", grid.alias("g")), ["label", "vec_id"], "g")
    return rows.select("label", "vec_id", F.col("_dim_0").cast("long"), F.col("_dim_1").cast("long"), F.round(F.col("obs").cast("double"), 6).alias("obs"))


@query("p1_columns_in_order", "SELECT p_partkey, p_size + 1 AS a, (p_size + 1) * 2 AS b, (p_size + 1) * 2 >= 40 AS big FROM part")
def p1_columns_in_order(spark, sf_dir):
    specs = [ColumnSpec("a", "p_size + 1"), ColumnSpec("b", "*", ["a"], [2]), ColumnSpec("big", ">=", ["b"], [40])]
    return add_columns(read(spark, sf_dir, "part"), specs).select("p_partkey", "a", "b", "big")


@query("p2_struct_columns", "SELECT p_partkey, p_size % 7 AS rest, p_size // 7 AS weeks FROM part")
def p2_struct_columns(spark, sf_dir):
    spec = ColumnSpec(["rest", "weeks"], lambda s: F.struct((s % 7).alias("r"), F.floor(s / 7).cast("int").alias("w")), ["p_size"])
    return add_columns(read(spark, sf_dir, "part"), [spec]).select("p_partkey", "rest", "weeks")


@query("p3_file_name_column", "SELECT 'orders' AS source, count(*) AS n FROM orders")
def p3_file_name_column(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    spec = ColumnSpec("source", lambda c: F.regexp_extract(c, r"(\w+)\.parquet", 1), ["_path"])
    with_path = o.select("o_orderkey", F.col("_metadata.file_path").alias("_path"))
    return add_columns(with_path, [spec]).groupBy("source").agg(F.count("*").alias("n"))


@query("p7_repeat_for_values", "SELECT n_nationkey, k AS kind, s AS season FROM nation, (VALUES (1), (2), (3)) a(k), (VALUES ('w'), ('s')) b(s)")
def p7_repeat_for_values(spark, sf_dir):
    return repeat_for_values(read(spark, sf_dir, "nation").select("n_nationkey"), {"kind": [1, 2, 3], "season": ["w", "s"]})


@query("p11_conditional_value", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive FROM customer")
def p11_conditional_value(spark, sf_dir):
    return add_columns(read(spark, sf_dir, "customer"), [ColumnSpec("positive", lambda b: F.when(b > 0, b), ["c_acctbal"])]).select("c_custkey", "positive")


@query("f2_function_predicate", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3")
def f2_function_predicate(spark, sf_dir):
    return select_rows(read(spark, sf_dir, "orders"), {"func": lambda k: k % 10 == 3, "cols": ["o_custkey"]}, columns=["o_orderkey"])


@query("f3_negated_predicate", "SELECT c_custkey, positive FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive FROM customer) WHERE NOT coalesce(positive >= 5000, false)")
def f3_negated_predicate(spark, sf_dir):
    return select_rows(p11_conditional_value(spark, sf_dir), {"col": "positive", "comp": ">=", "val": 5000, "negate": True})


@query("f4_any_of", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.09 OR l_quantity = 1 OR l_returnflag = 'R'")
def f4_any_of(spark, sf_dir):
    rules = [{"col": "l_discount", "comp": ">=", "val": 0.09}, {"col": "l_quantity", "comp": "==", "val": 1}, {"col": "l_returnflag", "comp": "==", "val": "R"}]
    return select_rows(read(spark, sf_dir, "lineitem"), rules, "OR", ["l_orderkey", "l_linenumber"])


@query("f9_dynamic_bounds", f"WITH {OBS_SQL} SELECT id, t FROM obs WHERE t >= 9500 - 30 AND t <= 9500 + 30 AND source = 'A'")
def f9_dynamic_bounds(spark, sf_dir):
    local = [{"col": "t", "comp": ">=", "val": -30}, {"col": "t", "comp": "<=", "val": 30}]
    rules = global_select([{"col": "source", "comp": "==", "val": "A"}, {"loc_col": "t", "src_col": "t", "func": lambda a, b: a + b}], local, {"t": 9500})
    return select_rows(observations(spark, sf_dir), rules, columns=["id", "t"])


@query("f9_run_bounds", f"""
WITH {OBS_SQL}, b AS (SELECT min(s_acctbal) * 10 - 500 AS lo, max(s_acctbal) * 10 + 500 AS hi FROM supplier WHERE s_nationkey < 20)
SELECT id, x FROM obs, b WHERE x >= lo AND x <= hi""")
def f9_run_bounds(spark, sf_dir):
    places = read(spark, sf_dir, "supplier").where("s_nationkey < 20").select((F.col("s_acctbal") * 10).alias("x"))
    return select_rows(observations(spark, sf_dir), run_bounds(places, {"x": (500, 500)}), columns=["id", "x"])


@query("f10_intervals", """
SELECT CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 ELSE 2 END AS part, count(*) AS n
FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 500000 GROUP BY 1""")
def f10_intervals(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    parts = [select_rows(o, rules).select(F.lit(i).alias("part")) for i, rules in enumerate(interval_rules("o_totalprice", [0, 50000, 150000, 500000]))]
    return union_all(parts).groupBy("part").agg(F.count("*").alias("n"))


@query("f14_drop_incomplete", "SELECT c_custkey, c_acctbal AS positive FROM customer WHERE c_acctbal > 0")
def f14_drop_incomplete(spark, sf_dir):
    return p11_conditional_value(spark, sf_dir).na.drop("any")


@query("f15_quantile_clip", """
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders GROUP BY 1)
SELECT o_orderkey, o.o_orderpriority, o_totalprice FROM orders o JOIN q USING (o_orderpriority) WHERE o_totalprice BETWEEN lo AND hi""")
def f15_quantile_clip(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return quantile_clip(o, "o_totalprice", 0.05, 0.95, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("f16_down_sample", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT < (SELECT CASE WHEN count(*) <= 1000 THEN 4294967296 ELSE floor(4294967296::DOUBLE * 1000 / count(*)) END FROM orders)""")
def f16_down_sample(spark, sf_dir):
    return down_sample(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1000, ["o_orderkey"])


@query("f17_membership", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def f17_membership(spark, sf_dir):
    return select_rows(read(spark, sf_dir, "orders"), {"col": "o_orderpriority", "comp": "==", "val": ["1-URGENT", "2-HIGH"]}, columns=["o_orderkey", "o_orderpriority"])


@query("u1_union_by_name", "SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def u1_union_by_name(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return union_all([c, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))])


@query("o1_sorted_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o1_sorted_preview(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("y1_array_to_rows", "SELECT vec_id, i - 1 AS _dim_0, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) r(i)")
def y1_array_to_rows(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "value")
    return array_to_rows(e, "value", ["vec_id"]).select("vec_id", F.col("_dim_0").cast("long"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("y2_rows_to_array", """
WITH v AS (SELECT p_size - 1 AS _dim_0, CASE WHEN count(*) > 38 THEN count(*) END AS n FROM part GROUP BY 1)
SELECT array_to_string(list(coalesce(n, -1) ORDER BY _dim_0), ',') AS counts FROM v""")
def y2_rows_to_array(spark, sf_dir):
    v = read(spark, sf_dir, "part").groupBy((F.col("p_size") - 1).alias("_dim_0")).agg(F.count("*").alias("n"))
    v = v.withColumn("n", F.when(F.col("n") > 38, F.col("n")))
    return rows_to_array(v, "n", ["_dim_0"], fill=-1).select(F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("counts"))


@query("y5_sorted_array", "SELECT o_custkey, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY 1")
def y5_sorted_array(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("_dim_0"), F.col("o_orderkey").cast("string").alias("keys"))
    return sorted_array(o, ["o_custkey"], "_dim_0", "keys").select("o_custkey", F.array_join("keys", ",").alias("keys"))


@query("n1_json_fields", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def n1_json_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
