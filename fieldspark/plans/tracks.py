"""Queries over ordered data: gaps, tracks, runs, times, and the streaming forms."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from fieldspark.functions import timecols as tc
from fieldspark.operators.binning import Axis
from fieldspark.operators.tracks import continue_tracks, diff_distance, minimum_spacing, number_tracks, run_position, time_gap, track_starts
from fieldspark.plans.tables import events, read
from fieldspark.sources.scratch import scratch_root
from fieldspark.streaming.streams import daily_bin_sums, daily_bins, read_daily_bins, replace_batch, track_sessions, write_daily_bins, write_tracks

QUERIES: dict = {}
ORACLE_SQL: dict = {}
GAP_MS = 86_400_000.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


ORDER = ["ts", "event_id"]
GAPS_SQL = """g AS (SELECT *, abs(epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000.0 AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 t AS (SELECT *, (sum(CASE WHEN dt > 86400000.0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS track FROM g)"""


def tracked(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("dt", time_gap("ts", ["user_id"], ORDER))
    return number_tracks(e, "dt", GAP_MS, ["user_id"], ORDER)


@query("w1_diff_distance", """
SELECT event_id, round(CASE WHEN row_number() OVER w <= 2 THEN 0.0 ELSE sqrt(pow(value - lag(value, 2) OVER w, 2) + pow(epoch_us(ts) / 1e9 - lag(epoch_us(ts) / 1e9, 2) OVER w, 2)) END, 6) AS d
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w1_diff_distance(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e9)
    return e.select("event_id", F.round(diff_distance(["value", "s"], ["user_id"], ORDER, k=2, default=0.0), 6).alias("d"))


@query("w2_track_numbers", f"WITH {GAPS_SQL} SELECT event_id, track FROM t")
def w2_track_numbers(spark, sf_dir):
    return tracked(spark, sf_dir).select("event_id", "track")


@query("w3_continued_tracks", f"""WITH {GAPS_SQL}, n AS (SELECT user_id, max(track) + 1 AS n, min(ts) AS first FROM t GROUP BY 1),
 o AS (SELECT user_id, coalesce(sum(n) OVER (ORDER BY first, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM n)
 SELECT event_id, (track + off)::BIGINT AS track FROM t JOIN o USING (user_id)""")
def w3_continued_tracks(spark, sf_dir):
    return continue_tracks(tracked(spark, sf_dir), "track", ["user_id"], "ts").select("event_id", "track")


@query("w4_time_gaps", f"WITH {GAPS_SQL} SELECT event_id, round(dt, 3) AS dt FROM g")
def w4_time_gaps(spark, sf_dir):
    return tracked(spark, sf_dir).select("event_id", F.round("dt", 3).alias("dt"))


@query("w5_run_position", """
WITH n AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT event_id, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1)::INTEGER AS position FROM r""")
def w5_run_position(spark, sf_dir):
    return run_position(events(spark, sf_dir), "event_type", ORDER, ["user_id"]).select("event_id", "position")


@query("w6_track_starts", f"""WITH {GAPS_SQL}, s AS (SELECT *, min(ts) OVER (PARTITION BY user_id, track) AS track_start FROM t)
 SELECT event_id, track_start, (dense_rank() OVER (PARTITION BY user_id, track_start::DATE ORDER BY track_start, track) - 1)::INTEGER AS track_of_day FROM s""")
def w6_track_starts(spark, sf_dir):
    return track_starts(tracked(spark, sf_dir), "track", "ts", ["user_id"]).select("event_id", "track_start", "track_of_day")


@query("w7_spread_times", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, epoch_us(TIMESTAMP '2019-10-31 23:33:55') + CASE WHEN n > 1 THEN 3029000000 * i // (n - 1) ELSE 0 END AS us FROM f""")
def w7_spread_times(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("name", F.concat(F.lit("x_20191031T233355_20191101T002424_a_b_"), F.col("user_id").cast("string"), F.lit(".txt")))
    start, end = tc.name_times(F.col("name"))
    out = tc.spread_between(e, "user_id", "event_id", start, end)
    return out.select("event_id", F.unix_micros("datetime").alias("us"))


@query("w8_minimum_spacing", "SELECT round(min(d), 6) AS spacing FROM (SELECT p_retailprice - lag(p_retailprice) OVER (ORDER BY p_retailprice) AS d FROM (SELECT DISTINCT p_retailprice FROM part))")
def w8_minimum_spacing(spark, sf_dir):
    return minimum_spacing(read(spark, sf_dir, "part"), "p_retailprice").select(F.round("spacing", 6).alias("spacing"))


@query("t1_number_to_time", "SELECT o_orderkey, epoch(TIMESTAMP '1950-01-01')::BIGINT + (o_orderkey % 30000) * 86400 + 43200 AS s FROM orders")
def t1_number_to_time(spark, sf_dir):
    ts = tc.timestamp_from_number(F.col("o_orderkey") % 30000 + 0.5)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(ts).alias("s"))


@query("t2_date_digits", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders")
def t2_date_digits(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", tc.date_digits(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("d"))


@query("t3_time_from_parts", """SELECT o_orderkey, CASE WHEN o_custkey % 13 BETWEEN 1 AND 12 THEN make_timestamp(2000 + o_orderkey % 20, o_custkey % 13, 1 + o_orderkey % 28, o_orderkey % 24, o_custkey % 60, 7.0) END AS ts FROM orders""")
def t3_time_from_parts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    hms = (k % 24) * 10000 + (c % 60) * 100 + 7
    ts = tc.timestamp_from_parts((2000 + k % 20).cast("int"), (c % 13).cast("int"), (1 + k % 28).cast("int"), hms, strict=False)
    return o.select("o_orderkey", ts.alias("ts"))


@query("t5_days", "SELECT event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE AS day, round(epoch_us(ts) / 86400e6, 9) AS t, strftime(ts, '%Y-%m-%d') AS d FROM events")
def t5_days(spark, sf_dir):
    e = events(spark, sf_dir)
    t = tc.fractional_days(F.col("ts"))
    return e.select("event_id", tc.days_since_epoch(F.col("ts")).alias("day"), F.round(t, 9).alias("t"), tc.date_from_days(t).cast("string").alias("d"))


DAILY_SQL = """SELECT epoch(date_trunc('day', ts))::BIGINT AS day, event_type, (least(floor(value / 20.0), 9) + 0.5) * 20.0 AS value_bin,
 (user_id % 150 // 50 + 0.5) * 50.0 AS user_bin, round(avg(value), 6) AS mean, count(*) AS n
 FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1, 2, 3, 4"""


def daily(df):
    rows = df.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("x"), (F.col("user_id") % 150).cast("double").alias("y"), F.col("value").alias("mean"))
    out = daily_bins(rows, "ts", "mean", ("x", Axis(0.0, 200.0, 20.0)), ("y", Axis(0.0, 150.0, 50.0)), ["event_type"])
    return out.select(F.unix_seconds("window_start").alias("day"), "event_type", F.col("x").alias("value_bin"), F.col("y").alias("user_bin"), F.round("mean", 6).alias("mean"), "n")


@query("st2_daily_bins", DAILY_SQL)
def st2_daily_bins(spark, sf_dir):
    return daily(events(spark, sf_dir))


@query("st2_daily_bins_streamed", DAILY_SQL)
def st2_daily_bins_streamed(spark, sf_dir):
    """The same as a table that a stream keeps; its last batch is run a second time, which changes nothing."""
    stream = spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parquet*")
    rows = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("x"), (F.col("user_id") % 150).cast("double").alias("y"), F.col("value").alias("mean"))
    root = f"{scratch_root(spark)}/streams/{uuid.uuid4().hex}"
    axes = [("x", Axis(0.0, 200.0, 20.0)), ("y", Axis(0.0, 150.0, 50.0))]
    done = write_daily_bins(rows(stream), f"{root}/bins", f"{root}/checkpoint", "ts", "mean", *axes, ["event_type"])
    done.awaitTermination()
    replace_batch(daily_bin_sums(rows(events(spark, sf_dir)), "ts", "mean", *axes, ["event_type"]), 0, f"{root}/bins", ["day"])
    out = read_daily_bins(spark, f"{root}/bins", "mean", *axes, ["event_type"])
    return out.select(F.unix_seconds(F.col("day").cast("timestamp")).alias("day"), "event_type", F.col("x").alias("value_bin"), F.col("y").alias("user_bin"), F.round("mean", 6).alias("mean"), "n")


@query("st3_tracks_streamed", f"WITH {GAPS_SQL} SELECT event_id, track FROM t")
def st3_tracks_streamed(spark, sf_dir):
    """Tracks numbered by a stream that is started again for each third of the events, which is one micro-batch."""
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    root = f"{scratch_root(spark)}/streams/{uuid.uuid4().hex}"
    cuts = e.agg(F.percentile_approx(F.unix_micros("ts"), [1 / 3, 2 / 3])).first()[0]
    third = lambda k: F.when(F.unix_micros("ts") < cuts[0], 0).when(F.unix_micros("ts") < cuts[1], 1).otherwise(2) == k
    for part in range(3):
        e.where(third(part)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        write_tracks(stream, f"{root}/tracks", f"{root}/checkpoint", "ts", ["user_id"], ORDER, timedelta(days=1)).awaitTermination()
    return spark.read.parquet(f"{root}/tracks").select("event_id", "track")


@query("st3_track_sessions", f"""WITH {GAPS_SQL} SELECT user_id, epoch_us(min(ts)) AS track_start, count(*) AS n, round(avg(value), 6) AS value FROM t GROUP BY user_id, track""")
def st3_track_sessions(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = track_sessions(e, "ts", ["user_id"], "86400 seconds", ["value"])
    return out.select("user_id", F.unix_micros("track_start").alias("track_start"), "n", F.round("value", 6).alias("value"))
