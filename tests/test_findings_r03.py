"""What the findings of round 3 named, on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspark.llm import quality_lm, toxicity
from fieldspark.operators import lattice, nearby, quantiles, xval
from fieldspark.operators.experts import ExpertConfig, fit_experts, predict_experts
from fieldspark.operators.glue import SmoothingConfig
from fieldspark.operators.gp import ExactGP, GPConfig, SparseGP
from fieldspark.streaming import streams
from tests.llm import cases
from tests.llm.test_operators import plain_kneser_ney


def test_experts_of_few_bytes_are_dealt_over_tasks(spark):
    places = spark.range(64).select(F.col("id").alias("expert_id"), (F.col("id") * 10.0).alias("x"))
    rows = places.where("expert_id % 4 > 0").select("expert_id", "x", F.col("expert_id").cast("double").alias("_obs"))
    c = ExpertConfig(["x"], "obs", [], GPConfig(), min_obs=1, optimise=False, pred_method="expert_loc")
    fitted = fit_experts(places, rows, c)
    assert fitted.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    details = {r["expert_id"]: (r["num_obs"], r["lengthscales"]) for r in fitted.collect()}
    assert details == {i: (1, [1.0]) if i % 4 else (0, None) for i in range(64)}
    preds = predict_experts(fitted, rows, places.select("expert_id", F.col("x").alias("pred_loc_x")), c)
    assert preds.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    assert {r["expert_id"]: round(r["f_star"], 9) for r in preds.collect()} == {i: round(i / 2, 9) for i in range(64) if i % 4}


@pytest.mark.parametrize("model", [ExactGP(), SparseGP()])
def test_far_from_the_origin_predictions_are_the_same(model):
    x, y = np.array([[0.0], [14.0], [33.0]]), np.array([1.0, -2.0, 9.5])
    new, far = np.array([[5.0], [-20.0]]), 120_000_000.0
    c = GPConfig(coords_scale=[20.0], lengthscales=2.0, kernel_variance=1.5, likelihood_variance=0.1)
    p = model.fit(x, y, c, None, False)[0]
    near, moved = model.predict(x, y, c, p, new), model.predict(x + far, y, c, p, new + far)
    assert all(np.array_equal(near[k], moved[k]) for k in near)
    assert np.array_equal(model.covariance(x, c, p, new, new), model.covariance(x + far, c, p, new + far, new + far))
    assert model.fit(x, y, c, None, False)[1] == model.fit(x + far, y, c, None, False)[1]


def test_kernel_sums_meet_near_rows_alone_and_lone_points_all(spark):
    k = SmoothingConfig(1.0, 1.0)
    rows = spark.createDataFrame([(float(x), 0.0, float(x % 5), 0, 0, 1.0) for x in range(0, 400, 4)], "x double, y double, value double, where_id int, dim int, _sign double")
    points = spark.createDataFrame([(0, 0, e, 0, e, 0.0) for e in (0.0, 202.0, 500.0)], "where_id int, dim int, e_x double, fold_id int, expert_id double, e_y double")
    keys, same = ["e_x"], ["where_id", "dim"]
    near, full = ({r["e_x"]: (r["_s"], r["_w"]) for r in f(points, rows, keys, same, k, []).collect()} for f in (xval.kernel_sums, xval.all_sums))
    assert set(near) == {0.0, 202.0} and set(full) == {0.0, 202.0, 500.0}
    assert all(near[e] == pytest.approx(full[e], rel=1e-14) for e in near)
    moved = rows.limit(0).drop("where_id").withColumn("fold_id", F.lit(0))
    got = {r["e_x"]: r["w"] for r in xval._means(points, rows, moved, k, [], xval.kernel_sums).collect()}
    assert got[0.0] > xval.LEAST and not got[500.0]


def test_nearest_meets_few_rows_where_places_repeat_or_crowd(spark):
    r = np.random.default_rng(7)
    # a crowd near 0, places that repeat, and far points
    spots = np.concatenate([r.uniform(0, 0.01, (3000, 2)), r.uniform(0, 100, (40, 2)).repeat(20, axis=0)])
    truth = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "t long, x double, y double")
    at = np.concatenate([r.uniform(0, 0.02, (200, 2)), r.uniform(-300, 300, (20, 2)), spots[3005:3006].repeat(30, axis=0)])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    assert nearby._fitting(points, truth, ["x", "y"], 5.0) < 0.01
    got = {row["id"]: row["t"] for row in nearby.nearest(points, truth, ["x", "y"], "id", "t", [], 5.0).collect()}
    away = np.sqrt(((at[:, None] - spots[None]) ** 2).sum(axis=2))
    assert got == {i: int(d.argmin()) for i, d in enumerate(away)}


def test_toxicity_learns_from_all_labelled_rows(spark):
    ids = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    learned = ids.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2").withColumn("n", F.row_number().over(order))
    # the word of the rows after the first 2 500 of their class
    docs = ids.join(learned.select("doc_id", "n"), "doc_id", "left").select("doc_id", F.lit("en").alias("lang"), F.when(F.col("toxic") == 0, "calm plain").when(F.col("n") > 2500, "rareone").otherwise("vile").alias("text"))
    model = toxicity.fit(docs, ids, toxicity.Config(epochs=2))
    calm, vile, rare = model.scores([b"calm plain", b"vile", b"rareone"])
    assert calm < 0.3 < min(vile, rare)


def test_quality_counts_all_trusted_texts(spark, monkeypatch):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("one two w"), F.col("id")).alias("text"))
    held = {r["doc_id"] for r in docs.where(F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(quality_lm.HELD_OUT << 20)), F.lit(quality_lm.HELD_OUT)) == 0).select("doc_id").collect()}
    found = []
    monkeypatch.setattr(quality_lm, "model_of", lambda counts, order, of=quality_lm.model_of: found.append(counts.count()) or of(counts, order))
    out = quality_lm.classify(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    # the pairs (start, one) and (one, two), and two of every counted text
    assert out.count() == 8000 and found == [2 + 2 * (8000 - len(held))]


def test_quality_model_takes_few_bytes_and_frees_them(spark, monkeypatch):
    # 40 000 distinct pairs of 2 000 words
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.expr("concat_ws(' ', transform(sequence(1, 20), i -> concat('w', pmod(xxhash64(id, i), 2000))))").alias("text"))
    sizes, left = {}, []

    def size(path):
        return sum(x.stat().st_size for x in Path(path.removeprefix("file:")).rglob("*.parquet"))

    def shuffles():
        folder = Path(spark.conf.get("spark.local.dir"))
        return {x for x in folder.rglob("shuffle_*") if x.suffix == ".data"}

    def noted(df, name, of=quality_lm.written):
        out = of(df, name)
        sizes.setdefault(name, size(out.scratch_path) / max(out.count(), 1))
        left.append(len(shuffles() - before))
        return out

    before = shuffles()
    monkeypatch.setattr(quality_lm, "written", noted)
    cleaned = spark.conf.get(quality_lm.CLEANUP)
    out = quality_lm.classify(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert out.count() == 2000 and out.where("perplexity > 0").count() == 2000
    # those of the query that has just ended may still be on their way out
    assert sizes["gram-counts"] < 8 and max(left) <= 2
    assert spark.conf.get(quality_lm.CLEANUP) == cleaned


@pytest.mark.parametrize("order", [2, 3])
def test_quality_of_texts_keeps_its_digits(spark, order):
    texts = [" ".join(f"w{(i * j) % 23}" for j in range(1, 4 + i % 30)) for i in range(60)]
    docs = quality_lm.written(cases.table(spark, [*texts, "", "never seen w1 w2"], extra=True), "test-docs")
    logs, _ = plain_kneser_ney(texts, order)
    counts = quality_lm.written(quality_lm.count_grams(docs.where("doc_id < 60"), order), "test-counts")
    got = {r["doc_id"]: r["perplexity"] for r in quality_lm.perplexities(docs, *quality_lm.model_of(counts, order), order).collect()}
    for r in docs.collect():
        assert np.log10(got[r["doc_id"]]) == pytest.approx(-np.mean(logs(r["text"] or "")), rel=1e-9)


def test_quantiles_count_rows_without_sorting_them(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(quantiles, "SMALL", 20)
    monkeypatch.setattr(quantiles, "written", lambda df, name, of=quantiles.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or of(df, name))
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.pow((F.col("id") * 37) % 4000 / 1000.0, 4.0).alias("v"))
    got = {r["g"]: r["q0.250"] for r in quantiles.exact_quantiles(df, "v", [0.25], ["g"]).collect()}
    want = {g: np.quantile([(((i * 37) % 4000) / 1000.0) ** 4 for i in range(4000) if i % 2 == g], 0.25) for g in (0, 1)}
    assert got == pytest.approx(want) and len(plans) > 3 and not any("SortAggregate" in p for p in plans)


def test_points_meet_a_small_raster_where_they_are(spark):
    raster = spark.range(100).select((F.col("id") % 10 * 1.0).alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"), F.col("id").cast("double").alias("v"))
    points = spark.range(1000).select("id", (F.col("id") % 90 / 10).alias("x"), (F.col("id") % 7 * 1.0).alias("y"))
    out = lattice.bilinear_value(points, raster, "x", "y", "v", 1.0, "h")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert all(r["h"] == pytest.approx(r["x"] + 10 * r["y"]) for r in out.collect())


def test_groups_of_a_bucket_keep_their_own_tracks(spark, tmp_path):
    big = 1 << 60
    for k, hours in enumerate([(0, 1, 9), (10, 20)]):
        rows = [(None if g == 3 else big + g, datetime(2024, 1, 1) + timedelta(hours=h), g, k) for g in range(4) for h in hours if g != 2 or k]
        spark.createDataFrame(rows, "g long, ts timestamp, i int, k int").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("g long, ts timestamp, i int, k int").parquet(f"{tmp_path}/in")
        with streams.keyed_state(spark):
            numbered = streams.stream_tracks(stream, "ts", ["g"], ["ts"], timedelta(hours=3), buckets=1)
            streams.write_stream(numbered, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("i", "ts").collect()
    assert [[r["track"] for r in out if r["i"] == i] for i in range(4)] == [[0, 0, 1, 1, 2], [0, 0, 1, 1, 2], [0, 1], [0, 0, 1, 1, 2]]
    assert all(r["g"] == (None if r["i"] == 3 else big + r["i"]) for r in out)
