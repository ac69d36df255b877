"""Queries over grids: binning, statistics, projection, lattices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldspark.functions.columns import ColumnSpec
from fieldspark.functions.geo import degrees_from_text, project, unproject
from fieldspark.functions.mathfun import inverse_sigmoid, inverse_softplus, matern32, sigmoid, softplus
from fieldspark.operators.binning import BinConfig, bin_by, bin_days, run_binning, store_binning
from fieldspark.operators.grid import expert_locations, given_locations, grid_2d, had_observation, lattice_rows, lattice_values, masked, thin_lattice
from fieldspark.operators.stats import block_statistics, histogram, quantile_limits, statistics
from fieldspark.plans.tables import LONLAT_SQL, OBS_SQL, X_RANGE, lon_lat, observations, read
from fieldspark.sources.scan import union_all
from fieldspark.sources.scratch import scratch_root
from fieldspark.sources.store import Store, from_dict

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: 105 bins of 1000 along x, 50 of 1 along y.
BINS_SQL = f"""{OBS_SQL}, b AS (SELECT *, least(floor(x / 1000.0), 104)::INTEGER AS ix, least(floor(y / 1.0), 49)::INTEGER AS iy
  FROM obs WHERE x BETWEEN 0 AND 105000 AND y BETWEEN 0 AND 50)"""
BOX = {"grid_res": 1000.0, "x_range": X_RANGE, "y_range": (0.0, 50_000.0)}


def boxed(spark, sf_dir):
    """Observations with y stretched so that one resolution serves both axes."""
    return observations(spark, sf_dir).withColumn("y", F.col("y") * 1000)


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


CENTRES = "0.0 + (ix + 0.5) * 1000.0 AS x, 0.0 + (iy + 0.5) * 1000.0 AS y"


@query("a1_bin_mean", f"WITH {BINS_SQL} SELECT {CENTRES}, round(avg(obs), 9) AS obs FROM b GROUP BY ix, iy")
def a1_bin_mean(spark, sf_dir):
    return rounded(bin_by(boxed(spark, sf_dir), "obs", **BOX), "obs")


@query("a2_bin_1d", f"WITH {BINS_SQL} SELECT source, 0.0 + (ix + 0.5) * 1000.0 AS x, round(avg(obs), 9) AS obs FROM b GROUP BY source, ix")
def a2_bin_1d(spark, sf_dir):
    return rounded(bin_by(boxed(spark, sf_dir), "obs", ["source"], y_col=None, grid_res=1000.0, x_range=X_RANGE), "obs")


@query("a3_bin_by_source_year", f"WITH {BINS_SQL} SELECT source, year(date) AS year, {CENTRES}, round(sum(obs), 6) AS obs FROM b GROUP BY source, year(date), ix, iy")
def a3_bin_by_source_year(spark, sf_dir):
    return rounded(bin_by(boxed(spark, sf_dir).withColumn("year", F.year("date").cast("long")), "obs", ["source", "year"], statistic="sum", **BOX), "obs", digits=6)


@query("a4_bin_statistics", f"""WITH {BINS_SQL} SELECT source, {CENTRES}, round(avg(obs), 9) AS obs_mean, round(median(obs), 9) AS obs_median,
 count(obs) AS obs_count, round(sum(obs), 6) AS obs_sum, min(obs) AS obs_min, max(obs) AS obs_max, round(stddev_pop(obs), 9) AS obs_std,
 round(max(obs) - min(obs), 9) AS obs_spread FROM b GROUP BY source, ix, iy""")
def a4_bin_statistics(spark, sf_dir):
    def spread(v):
        return F.max(v) - F.min(v)

    stats = ["mean", "median", "count", "sum", "min", "max", "std", spread]
    out = bin_by(boxed(spark, sf_dir), "obs", ["source"], statistic=stats, **BOX)
    return rounded(rounded(out, "obs_sum", digits=6), "obs_mean", "obs_median", "obs_std", "obs_spread")


@query("a5_dense_counts", f"""WITH {BINS_SQL}, c AS (SELECT source, ix, iy, count(obs) AS n FROM b GROUP BY 1, 2, 3),
 l AS (SELECT source, i AS ix, j AS iy FROM (SELECT DISTINCT source FROM obs), range(105) r(i), range(50) s(j))
 SELECT source, {CENTRES}, coalesce(n, 0) AS obs FROM l LEFT JOIN c USING (source, ix, iy)""")
def a5_dense_counts(spark, sf_dir):
    return bin_by(boxed(spark, sf_dir), "obs", ["source"], statistic="count", dense=True, **BOX)


def binning_run(spark, sf_dir):
    return run_binning(boxed(spark, sf_dir), BinConfig(
        "obs", 1000.0, ["source"], x_range=X_RANGE, y_range=(0.0, 50_000.0), load_by=["year"],
        col_funcs=[ColumnSpec("year", lambda d: F.year(d).cast("long"), ["date"])],
        row_select=[{"col": "obs", "comp": ">", "val": 0.01}], add_output_cols=[ColumnSpec("t", "year - 1995")],
    ))


@query("a6_binning_run", f"""WITH {BINS_SQL} SELECT year(date) AS year, source, {CENTRES}, round(avg(obs), 9) AS obs, year(date) - 1995 AS t
 FROM b WHERE obs > 0.01 GROUP BY year(date), source, ix, iy""")
def a6_binning_run(spark, sf_dir):
    return rounded(binning_run(spark, sf_dir)[0], "obs")


def whole_run():
    return BinConfig("obs", 1000.0, ["source"], x_range=X_RANGE, y_range=(0.0, 50_000.0), row_select=[{"col": "obs", "comp": ">", "val": 0.01}])


@query("a7_bins_at_once", f"WITH {BINS_SQL} SELECT source, {CENTRES}, round(avg(obs), 9) AS obs FROM b WHERE obs > 0.01 GROUP BY source, ix, iy")
def a7_bins_at_once(spark, sf_dir):
    return rounded(run_binning(boxed(spark, sf_dir), whole_run())[0], "obs")


@query("s10_stored_bins", f"WITH {BINS_SQL} SELECT source, {CENTRES}, round(avg(obs), 9) AS obs, 1000.0 AS grid_res, 'lineitem' AS raw FROM b WHERE obs > 0.01 GROUP BY source, ix, iy")
def s10_stored_bins(spark, sf_dir):
    """Bins are kept with their own configuration and that of what was binned, and both are read back."""
    store = Store(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}")
    store_binning(store, boxed(spark, sf_dir), whole_run(), "bins", {"table": "lineitem"})
    config = from_dict(BinConfig, store.attribute("bins", "config")[-1])
    raw = store.attribute("bins", "raw_data_config")[-1]["table"]
    return rounded(store.read("bins"), "obs").withColumns({"grid_res": F.lit(config.grid_res), "raw": F.lit(raw)})


@query("s15_run_provenance", """SELECT o_orderpriority, count(*) AS n, sha256('{"col": "' || o_orderpriority || '"}') AS config_hash FROM orders GROUP BY 1""")
def s15_run_provenance(spark, sf_dir):
    """A table a priority, each with its run noted."""
    store = Store(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}")
    o = read(spark, sf_dir, "orders")
    out = []
    for r in o.select("o_orderpriority").distinct().collect():  # five priorities
        p = r["o_orderpriority"]
        name = "t" + p[0]
        store.write(o.where(F.col("o_orderpriority") == p), name, config={"col": p}, run_info=True)
        out.append(store.read(name).groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("config_hash", F.lit(store.attribute(name, "run_info")[-1]["config_hash"])))
    return union_all(out)


@query("g5_given_locations", "SELECT DISTINCT s_nationkey::DOUBLE AS x, floor(s_acctbal / 1000) AS y, s_nationkey * 2.0 AS t FROM supplier WHERE s_nationkey IN (SELECT p_size FROM part)")
def g5_given_locations(spark, sf_dir):
    """Locations out of a table in one call: derived columns, distinct coordinates, a mask."""
    part = read(spark, sf_dir, "part").select((F.col("p_size") * 1.0).alias("x"))
    out = given_locations(spark, read(spark, sf_dir, "supplier"), ["x", "y"], [(part, ["x"])], col_funcs=[ColumnSpec("x", lambda n: n.cast("double"), ["s_nationkey"]), ColumnSpec("y", lambda b: F.floor(b / 1000).cast("double"), ["s_acctbal"]), ColumnSpec("t", "x * 2")])
    return out.select("x", "y", "t")


STATS_SQL = """count(*) AS size, count({v}) AS num_not_nan, sum(CASE WHEN isinf({v}) THEN 1 ELSE 0 END)::BIGINT AS num_inf, min({v}) AS min,
 round(avg({v}), 6) AS mean, max({v}) AS max, round(stddev_pop({v}), 6) AS std,
 round((avg({v}*{v}*{v}) - 3*avg({v})*avg({v}*{v}) + 2*pow(avg({v}), 3)) / pow(stddev_pop({v}), 3), 4) AS skew,
 round(kurtosis_pop({v}), 4) AS kurtosis, """ + ", ".join(f'round(quantile_cont({{v}}, {q}), 6) AS "q{q:.3f}"' for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))


def rounded_stats(df):
    names = ["mean", "std", *[c for c in df.columns if c.startswith("q0.")]]
    out = df.withColumns({n: F.round(F.col(f"`{n}`"), 6) for n in names})
    return out.withColumns({n: F.round(n, 4) for n in ("skew", "kurtosis")})


@query("a6_batch_statistics", f"WITH {OBS_SQL} SELECT year(date) AS year, {STATS_SQL.format(v='obs')} FROM obs WHERE obs > 0.01 GROUP BY 1")
def a6_batch_statistics(spark, sf_dir):
    return rounded_stats(binning_run(spark, sf_dir)[1])


@query("a8_statistics", f"SELECT c_mktsegment, {STATS_SQL.format(v='c_acctbal')} FROM customer GROUP BY 1")
def a8_statistics(spark, sf_dir):
    return rounded_stats(statistics(read(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]))


@query("a9_bin_days", """
WITH o AS (SELECT o_orderdate::DATE AS d, o_custkey % 100 * 1000.0 AS x, o_orderkey % 100 * 1000.0 AS y, o_totalprice AS v FROM orders),
b AS (SELECT d, least(floor(x / 50000), 1) AS ix, least(floor(y / 50000), 1) AS iy, avg(v) AS v FROM o GROUP BY 1, 2, 3),
l AS (SELECT day::DATE AS d, i AS ix, j AS iy FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS day FROM o), range(2) r(i), range(2) s(j))
SELECT strftime(l.d, '%Y-%m-%d') AS d, (l.ix + 0.5) * 50000.0 AS x, (l.iy + 0.5) * 50000.0 AS y, round(v, 6) AS v FROM l LEFT JOIN b USING (d, ix, iy)""")
def a9_bin_days(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 100 * 1000.0).alias("x"), (F.col("o_orderkey") % 100 * 1000.0).alias("y"), F.col("o_totalprice").alias("v"))
    return rounded(bin_days(o, "v", "d", 50.0, x_range=(0.0, 100_000.0), y_range=(0.0, 100_000.0)), "v", digits=6).withColumn("d", F.col("d").cast("string"))


@query("a21_block_statistics", f"""
WITH {OBS_SQL}, r AS (SELECT date, floor((dense_rank() OVER (ORDER BY date) - 1) / 30)::BIGINT AS block FROM (SELECT DISTINCT date FROM obs))
SELECT block, {STATS_SQL.format(v='obs')} FROM obs JOIN r USING (date) GROUP BY block""")
def a21_block_statistics(spark, sf_dir):
    return rounded_stats(block_statistics(observations(spark, sf_dir), "date", 30, "obs"))


@query("a22_histogram", """
SELECT c_mktsegment, bin, count(*) AS n, (-1000 + bin * 550.0)::DOUBLE AS bin_low, (-1000 + (bin + 1) * 550.0)::DOUBLE AS bin_high
FROM (SELECT c_mktsegment, least(floor((c_acctbal + 1000) / 550.0), 19)::INTEGER AS bin FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000) GROUP BY 1, 2""")
def a22_histogram(spark, sf_dir):
    return histogram(read(spark, sf_dir, "customer"), "c_acctbal", 20, -1000.0, 10000.0, ["c_mktsegment"])


@query("a23_quantile_limits", """SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.01), 6) AS lo, round(quantile_cont(c_acctbal, 0.99), 6) AS hi FROM customer GROUP BY 1""")
def a23_quantile_limits(spark, sf_dir):
    q = quantile_limits(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal").toDF("c_nationkey", "lo", "hi")
    return rounded(q, "lo", "hi", digits=6)


E2 = 0.0066943799901413165
QP_SQL = f"(1 - {E2}) * (s / (1 - {E2} * s * s) + atanh(sqrt({E2}) * s) / sqrt({E2}))"


@query("g1_project_polar", f"""
WITH {LONLAT_SQL}, q AS (SELECT *, sin(radians(lat)) AS s FROM pts), r AS (SELECT *, {QP_SQL} AS q, {QP_SQL.replace("s * s", "1").replace("* s)", "* 1)").replace("(s /", "(1 /")} AS qp FROM q)
SELECT o_orderkey, round(6378137.0 * sqrt(greatest(qp - q, 0)) * sin(radians(lon)), 4) + 0.0 AS x, round(-6378137.0 * sqrt(greatest(qp - q, 0)) * cos(radians(lon)), 4) + 0.0 AS y FROM r""")
def g1_project_polar(spark, sf_dir):
    x, y = project(F.col("lon"), F.col("lat"))
    return lon_lat(spark, sf_dir).select("o_orderkey", (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


@query("g2_round_trip", f"WITH {LONLAT_SQL} SELECT o_orderkey, round(lon, 6) + 0.0 AS lon, round(lat, 6) AS lat FROM pts WHERE lat < 89.9")
def g2_round_trip(spark, sf_dir):
    x, y = project(F.col("lon"), F.col("lat"), 30.0, 60.0)
    pts = lon_lat(spark, sf_dir).where("lat < 89.9").withColumns({"px": x, "py": y})
    lon, lat = unproject(F.col("px"), F.col("py"), 30.0, 60.0)
    lon = F.pmod(F.round(lon, 6) + 180.0, F.lit(360.0)) - 180.0
    return pts.select("o_orderkey", (F.round(lon, 6) + 0.0).alias("lon"), F.round(lat, 6).alias("lat"))


@query("g4_expert_locations", """
SELECT DISTINCT p_size::BIGINT AS x, s_nationkey::BIGINT AS y, p_size * 2 AS t FROM part, supplier WHERE p_size % 2 = 0
 AND p_size IN (SELECT p_size FROM part WHERE p_retailprice > 990)""")
def g4_expert_locations(spark, sf_dir):
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    mask = part.where("p_retailprice > 990").select(F.col("p_size").alias("x"))
    out = expert_locations(spark, {"x": (part, "p_size"), "y": (supplier, "s_nationkey")}, [(mask, ["x"])], [ColumnSpec("t", "x * 2")], [{"func": lambda x: x % 2 == 0, "cols": ["x"]}])
    return out.select(F.col("x").cast("long"), F.col("y").cast("long"), "t")


@query("g3_grid_cells_with_data", f"WITH {BINS_SQL} SELECT DISTINCT (iy // 5) * 11 + ix // 10 AS id FROM b")
def g3_grid_cells_with_data(spark, sf_dir):
    cells = boxed(spark, sf_dir).where("x >= 0 and x < 110000 and y between 0 and 50000")
    key = cells.select((F.floor(F.col("x") / 10_000) * 10_000.0 + 5000).alias("x"), (F.least(F.floor(F.col("y") / 1000), F.lit(49)).cast("long").alias("iy")))
    key = key.select("x", ((F.floor(F.col("iy") / 5)) * 5000.0 + 2500).alias("y")).distinct()
    # rows of the lattice are five bins high
    grid = grid_2d(spark, (0.0, 110_000.0), (0.0, 100_000.0), step_size=10_000.0).withColumn("y", F.col("y") / 2)
    return masked(grid, [key], ["x", "y"]).select("id")


@query("g6_lattice", """
WITH c AS (SELECT o_custkey % 20 AS ix, o_orderkey % 10 AS iy, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT iy::INTEGER AS iy, array_to_string(list(coalesce(n, 0)::VARCHAR ORDER BY ix), ',') AS n FROM (SELECT i AS ix, j AS iy, n FROM range(20) r(i) CROSS JOIN range(10) s(j) LEFT JOIN c ON c.ix = i AND c.iy = j) GROUP BY 1""")
def g6_lattice(spark, sf_dir):
    c = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20 * 2.5).alias("x"), (F.col("o_orderkey") % 10 * 4.0).alias("y")).agg(F.count("*").alias("n"))
    cells = lattice_values(c, "x", "y", "n", fill=0)
    return lattice_rows(cells, "n").select("iy", F.array_join(F.transform("n", lambda v: v.cast("string")), ",").alias("n"))


@query("g7_degrees_from_text", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * round(o_orderkey % 90 + (o_custkey % 600) / 10.0 / 60, 9) AS lat FROM orders""")
def g7_degrees_from_text(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    text = F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(" "), (F.col("o_custkey") % 600 / 10).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " N").otherwise(" S"))
    return o.select("o_orderkey", F.round(degrees_from_text(text), 9).alias("lat"))


@query("f11_had_observation", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE CASE WHEN l_discount > 0.05 THEN l_discount END IS NOT NULL")
def f11_had_observation(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_discount") > 0.05, F.col("l_discount")))
    return had_observation(li, ["l_returnflag", "l_linestatus"], "v")


@query("f12_thin_lattice", f"WITH {BINS_SQL} SELECT ix, iy, count(*) AS n FROM b WHERE ix % 3 = 1 AND iy % 3 = 1 GROUP BY 1, 2")
def f12_thin_lattice(spark, sf_dir):
    cells = bin_by(boxed(spark, sf_dir), "obs", statistic="count", keep_index=True, **BOX)
    return thin_lattice(cells, ["ix", "iy"], 3, 1).select("ix", "iy", F.col("obs").alias("n"))


@query("m1_transforms", """
SELECT c_custkey, round(ln(1 + exp(-abs(z))) + greatest(z, 0) + 0.5, 9) AS sp, round(z, 6) AS inv_sp, round(2 + 3 / (1 + exp(-z)), 9) AS sg, round(z, 6) AS inv_sg,
 round((1 + sqrt(3) * abs(z)) * exp(-sqrt(3) * abs(z)), 9) AS kernel FROM (SELECT c_custkey, c_acctbal / 1000 AS z FROM customer)""")
def m1_transforms(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("z"))
    z = F.col("z")
    sp, sg = softplus(z, 0.5), sigmoid(z, 2.0, 5.0)
    return c.select("c_custkey", F.round(sp, 9).alias("sp"), F.round(inverse_softplus(sp, 0.5), 6).alias("inv_sp"), F.round(sg, 9).alias("sg"), F.round(inverse_sigmoid(sg, 2.0, 5.0), 6).alias("inv_sg"), F.round(matern32(F.abs(z)), 9).alias("kernel"))
