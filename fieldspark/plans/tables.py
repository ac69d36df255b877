"""The provided tables in the roles of this engine: observations, tracks, truth, experts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators.grid import grid_2d

#: Box of the observations, in the units of each axis.
X_RANGE, Y_RANGE = (0.0, 105000.0), (0.0, 50.0)
#: Prices are divided by this, to bring both axes to the same order.
X_SCALE = 2000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as observations: x, y, t (days), obs, source, date, and a row id."""
    li = read(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"),
        F.unix_date(day).cast("double").alias("t"), F.col("l_discount").alias("obs"), F.col("l_returnflag").alias("source"), day.alias("date"),
    )


#: The same in DuckDB.
OBS_SQL = """obs AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice AS x, l_quantity AS y,
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS t, l_discount AS obs, l_returnflag AS source, l_shipdate::DATE AS date FROM lineitem)"""


def scaled_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumn("x", F.col("x") / X_SCALE)


SCALED_SQL = OBS_SQL.replace("l_extendedprice AS x", f"l_extendedprice / {X_SCALE} AS x")


def experts(spark: SparkSession, n: int = 5) -> DataFrame:
    """n x n expert locations over the scaled box: expert_id, x, y."""
    grid = grid_2d(spark, (0.0, X_RANGE[1] / X_SCALE), Y_RANGE, num_step=n + 1)
    return grid.select(F.col("id").alias("expert_id"), "x", "y")


def experts_sql(n: int = 5) -> str:
    dx, dy = X_RANGE[1] / X_SCALE / n, Y_RANGE[1] / n
    return f"experts AS (SELECT i AS expert_id, {dx / 2} + (i % {n}) * {dx} AS x, {dy / 2} + (i // {n}) * {dy} AS y FROM range({n * n}) r(i))"


#: Suppliers as experts stand a hundred apart, at 2000 of these units: whole numbers, which no number of suppliers rounds.
PER_UNIT = 20


def supplier_x(right: Column | float = 0.0) -> Column:
    """Where a supplier's expert stands, or a place ``right`` of it; in twentieths, where all places are whole numbers."""
    return F.col("s_suppkey") * (100.0 * PER_UNIT) + F.round(F.lit(right) * PER_UNIT)


def in_units(name: str) -> Column:
    """A coordinate of ``supplier_x`` in the units of its table."""
    return (F.col(name) / PER_UNIT).alias(name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def lon_lat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as points: o_orderkey, lon in [-180, 180), lat in [60, 90)."""
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", (((F.col("o_custkey") * 7) % 360) - 180).cast("double").alias("lon"), (60 + (F.col("o_orderkey") % 3000) / 100).cast("double").alias("lat"))


LONLAT_SQL = "pts AS (SELECT o_orderkey, ((o_custkey * 7) % 360 - 180)::DOUBLE AS lon, (60 + (o_orderkey % 3000) / 100.0)::DOUBLE AS lat FROM orders)"
