"""Joint predictions, lattices, numbering, quantiles, streams and folds against plain versions."""

from __future__ import annotations

import subprocess
import sys
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.conftest import ROOT

from fieldspark.operators import covariance, lattice, numbering, quantiles, stats, xval
from fieldspark.operators.experts import ExpertConfig, run_experts
from fieldspark.operators.glue import kernel_smooth
from fieldspark.operators.gp import ExactGP, GPConfig, SparseGP
from fieldspark.operators.kerneltree import tree_smooth
from fieldspark.operators.nearby import Near
from fieldspark.streaming import streams


def a_run(spark, model="exact", **more):
    r = np.random.default_rng(4)
    rows = [(float(x), float(np.sin(x / 2) + r.normal() / 20)) for x in np.linspace(0, 10, 25)]
    obs = spark.createDataFrame(rows, "x double, obs double")
    places = spark.createDataFrame([(1, 3.0), (2, 7.0)], "expert_id long, x double")
    gp = GPConfig(lengthscales=1.5, kernel_variance=1.0, likelihood_variance=0.01)
    c = ExpertConfig(["x"], "obs", [Near("x", "<=", 3.0), Near("x", ">=", -3.0)], gp, model, optimise=False, pred_method="shift", offsets={"x": [-1.0, -0.3, 0.0, 0.4, 1.1]}, full_cov=True, **more)
    return run_experts(places, obs, c), c


@pytest.mark.parametrize("model", ["exact", "sparse"])
def test_covariance_in_blocks_equals_one_matrix(spark, model):
    run, c = a_run(spark, model)
    got = {(r["expert_id"], r["i"], r["j"]): r["value"] for r in run.covariance.collect()}
    assert len(got) == 2 * 15
    var = run.preds.orderBy("expert_id", "pred_loc_x").select("expert_id", "f_var").collect()
    for e in (1, 2):
        own = [r["f_var"] for r in var if r["expert_id"] == e]
        assert own == pytest.approx([got[e, i, i] for i in range(5)], abs=1e-9)
        k = np.array([[got[e, min(i, j), max(i, j)] for j in range(5)] for i in range(5)])
        assert np.linalg.eigvalsh(k).min() > -1e-9
    x = np.linspace(0, 10, 25)[:, None]
    p = {"lengthscales": np.array([1.5]), "kernel_variance": np.array([1.0]), "likelihood_variance": np.array([0.01])}
    a = np.array([[1.0], [2.0], [4.5]])
    whole = (ExactGP if model == "exact" else SparseGP)().covariance(x, c.gp, p, a, a)
    parts = np.block([[ExactGP().covariance(x, c.gp, p, a[s], a[t]) for t in (slice(0, 2), slice(2, 3))] for s in (slice(0, 2), slice(2, 3))])
    assert whole == pytest.approx(parts, abs=1e-4)  # all observations are inducing points here


def test_blocks_of_any_size_and_draws(spark):
    run, c = a_run(spark)
    want = {(r["expert_id"], r["i"], r["j"]): r["value"] for r in run.covariance.collect()}
    from fieldspark.operators.experts import fit_experts, select_for_experts
    from fieldspark.operators.nearby import shifted_locations

    places = run.run_details.select("expert_id", "x")
    obs = spark.createDataFrame([(float(x), 1.0) for x in np.linspace(0, 10, 25)], "x double, obs double")
    selected = select_for_experts(places, obs, c)
    for size in (1, 2, 4):
        cov = covariance.predict_covariance(fit_experts(places, selected, c), selected, shifted_locations(places, c.offsets, c.coords), c, size)
        assert {(r["expert_id"], r["i"], r["j"]): r["value"] for r in cov.collect()} == pytest.approx(want, abs=1e-9)
    draws = covariance.joint_draws(run.preds, run.covariance, c, 4000, seed=7).where("expert_id = 1").toPandas().pivot(index="draw", columns="pred_loc_x", values="f_star")
    k = np.array([[want[1, min(i, j), max(i, j)] for j in range(5)] for i in range(5)])
    mean = [r["f_star"] for r in run.preds.where("expert_id = 1").orderBy("pred_loc_x").collect()]
    assert draws.mean().to_numpy() == pytest.approx(mean, abs=0.01)
    assert np.cov(draws.to_numpy().T) == pytest.approx(k, abs=0.1 * k.max())
    with pytest.raises(Exception, match="max_locations"):
        covariance.joint_draws(run.preds, run.covariance, c, 1, max_locations=4).collect()


def test_exact_quantiles_by_brackets(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 20)
    monkeypatch.setattr(quantiles, "BINS", 8)
    r = np.random.default_rng(2)
    groups = {"normal": r.normal(size=300), "ties": np.repeat([1.0, 2.0, 2.5], [500, 3, 90]), "wide": np.exp(r.normal(size=200) * 20), "one": np.array([4.0]), "large": np.array([-1.7e308, 1.7e308, 0.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(None, float(v)) for v in range(50)] + [("normal", None), ("normal", float("nan")), ("none", None)]
    rows += [("infinite", v) for v in (float("-inf"), 1.0, float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {x["g"]: [x[quantiles.quantile_name(q)] for q in qs] for x in quantiles.exact_quantiles(df, "v", qs, ["g"]).collect()}
    assert got["none"] == [None] * 5 and got[None] == pytest.approx(np.quantile(range(50), qs))
    for g, vs in groups.items():
        if g != "large":
            assert got[g] == pytest.approx(np.quantile(vs, qs), rel=1e-12)
    assert got["large"][0] == -1.7e308 and got["large"][2] == 0.0 and got["infinite"] == [float("-inf"), float("-inf"), 1.0, float("inf"), float("inf")]
    assert quantiles.exact_quantiles(df.where("g = 'ties'"), "v", [0.5]).first()[0] == 1.0
    assert quantiles.exact_quantiles(df.where("false"), "v", [0.5], ["g"]).count() == 0
    clipped = stats.quantile_clip(df.where("g is null"), "v", 0.1, 0.9, ["g"])
    assert sorted(x["v"] for x in clipped.collect()) == [float(v) for v in range(5, 45)]


def test_numbers_run_on_without_one_task(spark):
    rows = [(i % 7, i, float(i * i % 11) if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, id int, v double")
    out = numbering.running_sum(df, "v", ["k", "id"], "total")
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    want = pd.DataFrame(rows, columns=["k", "id", "v"]).sort_values(["k", "id"])
    want["total"] = want["v"].fillna(0).cumsum()
    assert {r["id"]: r["total"] for r in out.collect()} == pytest.approx(dict(zip(want["id"], want["total"], strict=True)))
    ranks = {r["k"]: r["n"] for r in numbering.dense_ranks(df.withColumn("k", F.when(F.col("k") != 3, F.col("k"))), ["k"], "n").collect()}
    assert ranks == {0: 1, 1: 2, 2: 3, 4: 4, 5: 5, 6: 6}
    assert numbering.running_sum(df.where("false"), "v", ["id"], "total").count() == 0
    blocks = stats.block_statistics(df.where("v is not null"), "k", 3, "v", qs=[0.5])
    spread = {r["column"]: r for r in stats.describe_blocks(blocks, ["size", "mean"]).collect()}
    assert spread["size"]["num_not_nan"] == 3 and spread["size"]["max"] == max(r["size"] for r in blocks.collect())


def test_lattice_smoothing_with_holes(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(9, 7))
    v[r.random(v.shape) < 0.3] = np.nan
    rows = [("a", i, j, float(v[i, j])) for i in range(9) for j in range(7) if (i + j) % 5 or i in (0, 8) or j in (0, 6)]
    held = {(i, j): x for _, i, j, x in rows if not np.isnan(x)}
    rows += [(None, 0, 0, 2.0), (None, 2, 0, 4.0)]
    df = spark.createDataFrame(rows, "g string, ix int, iy int, v double")
    for keep in (True, False):
        got = {(r["g"], r["ix"], r["iy"]): r["v"] for r in lattice.smooth_lattice(df, "v", 1.2, ["g"], radius=3, keep_holes=keep).collect()}
        assert len(got) == 63 + 3
        for i in range(9):
            for j in range(7):
                w = {p: np.exp(-((p[0] - i) ** 2 + (p[1] - j) ** 2) / 2 / 1.44) for p in held if abs(p[0] - i) <= 3 and abs(p[1] - j) <= 3}
                want = sum(w[p] * held[p] for p in w) / sum(w.values())
                assert got["a", i, j] == (None if keep and (i, j) not in held else pytest.approx(want))
        assert got[None, 1, 0] == (None if keep else pytest.approx(3.0))


def test_bilinear_value_leaves_missing_corners_out(spark):
    raster = spark.createDataFrame([(0.0, 0.0, 1.0), (10.0, 0.0, 2.0), (0.0, 20.0, 5.0), (10.0, 20.0, None)], "x double, y double, v double")
    points = spark.createDataFrame([(1, 2.5, 0.0), (2, 2.5, 5.0), (3, 10.0, 20.0), (4, 300.0, 0.0), (5, None, 0.0), (6, 0.0, 20.0), (7, 2.5, 5.0)], "id int, x double, y double")
    got = {r["id"]: r["h"] for r in lattice.bilinear_value(points, raster, "x", "y", "v", (10.0, 20.0), "h").collect()}
    two = (0.75 * 0.75 * 1 + 0.25 * 0.75 * 2 + 0.75 * 0.25 * 5) / (1 - 0.25 * 0.25)
    assert got == {1: pytest.approx(1.25), 2: pytest.approx(two), 3: None, 4: None, 5: None, 6: 5.0, 7: pytest.approx(two)}


def test_smoothing_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([(None, 0.0, 0.0, 1.0), (None, 1.0, 0.0, 3.0), ("a", 0.0, 0.0, 9.0), ("a", 30.0, 0.0, None)], "g string, x double, y double, v double")
    want = {(r["g"], r["x"]): r["v"] for r in kernel_smooth(df, "v", 1.0, 1.0, by=["g"]).collect()}
    assert len(want) == 4 and want["a", 30.0] == pytest.approx(9.0)
    assert {(r["g"], r["x"]): r["v"] for r in kernel_smooth(df, "v", 1.0, 1.0, by=["g"], error=1e-12).collect()} == pytest.approx(want)
    assert {k: v for k, v in want.items() if k != ("a", 30.0)} == pytest.approx({(r["g"], r["x"]): r["v"] for r in kernel_smooth(df, "v", 1.0, 1.0, by=["g"], cutoff=9.0).where("v is not null").collect()})


@pytest.mark.parametrize("error", [0.2, 0.01])
def test_tree_smoothing_keeps_its_limit(spark, error):
    r = np.random.default_rng(7)
    dense = [(None, *r.uniform(0, 1.5, 2), float(r.normal())) for _ in range(1500)]
    wide = [("a", *r.uniform(-40, 40, 2), float(r.normal())) for _ in range(300)]
    rows = [(g, float(u), float(v), z) for g, u, v, z in [*dense, *wide]] + [("a", 1.0, 1.0, 5.0), ("a", 1.0, 1.0, 6.0), ("a", 2.0, 2.0, None), (None, None, 0.0, 3.0), ("b", 0.0, 0.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, v double")
    got = {(row["g"], row["x"], row["y"]): row["v"] for row in tree_smooth(df, "v", 1.0, 2.0, by=["g"], error=error).collect()}
    assert set(got) == {row[:3] for row in rows} and got[None, None, 0.0] is None and got["b", 0.0, 0.0] == pytest.approx(4.0)
    most = 0.0
    for g in (None, "a"):
        p = np.array([(x, y, v) for h, x, y, v in rows if h == g and x is not None and v is not None])
        at = np.array([k[1:] for k in got if k[0] == g and k[1] is not None])
        w = np.exp(-0.5 * ((at[:, :1] - p[:, 0]) ** 2 + ((at[:, 1:] - p[:, 1]) / 2) ** 2))
        off = np.abs(w @ p[:, 2] / w.sum(axis=1) - [got[g, x, y] for x, y in at]).max()
        assert off <= error * np.ptp(p[:, 2])
        most = max(most, off)
    # cells did stand for rows
    assert most > 1e-12


def test_tree_smoothing_of_nothing(spark):
    df = spark.createDataFrame([], "x double, y double, v double")
    assert tree_smooth(df, "v", 1.0, 1.0).count() == 0
    alone = spark.createDataFrame([(1.0, 2.0, None)], "x double, y double, v double")
    assert tree_smooth(alone, "v", 1.0, 1.0).count() == 0


def test_configurations_are_stored_alike_in_every_process():
    code = "import functools; from fieldspark.sources.store import json_text; from fieldspark.operators.gp import SparseGP; k = 3; f = (lambda k: lambda x: x * k)\n"
    code += "print(json_text({'f': f(5), 'm': SparseGP(), 'p': functools.partial(sorted, reverse=True), 's': {'b', 'a', 'c'}, 't': SparseGP}), json_text(f(5)) != json_text(f(6)), json_text(f(5)) == json_text(f(5)))"
    texts = {subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, env={"PYTHONPATH": ROOT, "PYTHONHASHSEED": str(seed), "PATH": "/usr/bin"}).stdout for seed in (1, 2)}
    assert len(texts) == 1 and texts.pop().strip().endswith("True True")


def test_tracks_run_on_over_batches_restarts_and_late_rows(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [[("a", 0), ("a", 1), ("b", 5)], [("a", 9), ("a", 2), ("b", 6), ("c", None)], [("a", 4), ("a", 20), ("b", 6.5)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame([(g, None if h is None else at(h), k) for g, h in batch], "g string, ts timestamp, k int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("g string, ts timestamp, k int").parquet(f"{tmp_path}/in")
        streams.write_tracks(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "ts", ["g"], ["ts"], timedelta(hours=3)).awaitTermination()
    got = {(r["g"], r["k"], None if r["ts"] is None else r["ts"].hour): r["track"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 0, 0): 0, ("a", 0, 1): 0, ("b", 0, 5): 0, ("a", 1, 2): 0, ("a", 1, 9): 1, ("b", 1, 6): 0, ("c", 1, None): 0, ("a", 2, 4): 1, ("a", 2, 20): 2, ("b", 2, 6): 0}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, day string")
    for batch_id in (0, 1, 1):
        streams.replace_batch(df.where(f"v > {batch_id}"), batch_id, f"{tmp_path}/t", ["day"])
    assert sorted((r["v"], r["batch"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, 0), (2, 0), (2, 1)]


def test_folds_with_overlapping_wheres_stay_apart(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long")
    wheres = [[{"col": "id", "comp": "<", "val": 20}, {"col": "id", "comp": ">=", "val": 10}]]
    f, rows = xval.where_folds(df, ["k"], wheres), xval.with_wheres(df, wheres)
    assert f.count() == 6 and f.select("fold_id").distinct().count() == 6
    held, train = xval.held_out_locations(rows, f, ["k"]), xval.training_rows(rows, f, ["k"])
    assert held.count() == 40 and train.count() == 80
    kept = {r["fold_id"]: (r["where_id"], r["k"]) for r in f.collect()}
    for r in train.collect():
        w, k = kept[r["fold_id"]]
        assert r["k"] != k and (r["id"] < 20 if w == 0 else r["id"] >= 10)
    assert "Cartesian" not in train._jdf.queryExecution().toString() and "NestedLoop" not in train._jdf.queryExecution().toString()


def test_cross_validation_with_wheres_equals_runs_on_parts(spark):
    r = np.random.default_rng(8)
    rows = [(float(x), float(y), float(np.cos(x) + r.normal() / 10), int(x + y) % 2, d) for x in range(5) for y in range(4) for d in (0, 1)]
    obs = spark.createDataFrame(rows, "x double, y double, obs double, k int, d int")
    places = spark.createDataFrame([(1, 1.0, 1.5), (2, 3.5, 1.5)], "expert_id long, x double, y double")
    c = ExpertConfig(["x", "y"], "obs", [Near(["x", "y"], "<=", 2.5)], GPConfig(lengthscales=[1.0, 1.0]), optimise=False, max_dist=2.0)
    wheres = [[{"col": "d", "comp": "==", "val": 0}, {"col": "d", "comp": "==", "val": 1}]]
    out = xval.cross_validate(places, obs, c, ["k"], wheres)
    got = {(r["where_id"], r["k"]): (r["n"], r["rmse"]) for r in out["scores"].join(out["folds"], "fold_id").collect()}
    assert len(got) == 4
    for d in (0, 1):
        part = xval.cross_validate(places, obs.where(f"d = {d}"), c, ["k"])
        own = part["scores"].join(part["folds"], "fold_id")
        for r in own.collect():
            assert got[d, r["k"]] == (r["n"], pytest.approx(r["rmse"], abs=1e-9))
    assert xval.mean_over_folds(out["scores"]).first()["n_folds"] == 4


def test_ingest_in_one_scan_skips_only_what_cannot_be_read(spark, tmp_path):
    from fieldspark.sources import ingest, store

    for k in range(5):
        spark.range(3).selectExpr("id", f"{k} AS k").coalesce(1).write.parquet(f"{tmp_path}/in/a b={k}")
    (tmp_path / "in" / "bad").mkdir()
    (tmp_path / "in" / "bad" / "x.parquet").write_bytes(b"not parquet")
    s = store.Store(spark, f"file://{tmp_path}/out")
    dirs = [f"{tmp_path}/in/a b={k}" for k in range(3)] + [f"file://{tmp_path}/in/a b=3", f"{tmp_path}/in/bad", f"{tmp_path}/in/a b=4"]
    run = lambda some: ingest.ingest(spark, s, "t", some, r"\.parquet$", schema="id long, k int", engine="parquet")
    assert run(dirs) == 15 and run(dirs) == 0
    assert sorted((r["id"], r["k"]) for r in s.read("t").collect()) == sorted((i, k) for i in range(3) for k in range(5))
    assert s.read("t").select(ingest.BATCH).distinct().count() == 5 == s.read("_t_batches").count()

    def jobs(n):
        fresh = store.Store(spark, f"file://{tmp_path}/out{n}")
        tag = f"ingest-{n}"
        spark.sparkContext.setJobGroup(tag, tag)
        ingest.ingest(spark, fresh, "t", dirs[:n], r"\.parquet$", schema="id long, k int", engine="parquet")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))

    assert jobs(1) == jobs(4)


def test_nearest_of_lone_points_and_clusters(spark):
    from fieldspark.operators import nearby

    r = np.random.default_rng(3)
    truth = np.concatenate([r.normal(size=(300, 2)), r.normal(size=(200, 2)) * 0.1 + [4000, -900], [[-1e6, 7.0]] * 3])
    points = np.concatenate([r.normal(size=(40, 2)) * 2, r.uniform(-5000, 5000, size=(40, 2)), [[-9e5, 0.0], [3e7, 3e7], [4000.0, -900.0]]])
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(truth)], "t long, x double, y double")
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double")
    got = {x["id"]: (x["t"], x["distance"]) for x in nearby.nearest(p, t, ["x", "y"], "id", "t", [], 0.5).collect()}
    far = np.sqrt(((points[:, None] - truth[None]) ** 2).sum(axis=2))
    assert got == {i: (int(d.argmin()), pytest.approx(d.min())) for i, d in enumerate(far)}
    assert nearby.nearest(p, t.where("false"), ["x", "y"], "id", "t", [], 0.5).where("t is null").count() == len(points)


def test_configurations_are_read_back():
    from dataclasses import asdict

    from fieldspark.operators.binning import BinConfig
    from fieldspark.operators.gp import model_by_name
    from fieldspark.sources.store import from_dict

    c = ExpertConfig(["x"], "obs", [Near("x", "<=", 3.0), Near(["x", "y"], "<", 2.0)], GPConfig(lengthscales=[2.0], bounds={"lengthscales": (0.1, 5.0)}), min_obs=7)
    assert from_dict(ExpertConfig, asdict(c)) == c and from_dict(BinConfig, asdict(BinConfig("v", 5.0))) == BinConfig("v", 5.0)
    with pytest.raises(ValueError, match="none_such"):
        from_dict(GPConfig, {"none_such": 1})
    assert isinstance(model_by_name("fieldspark.operators.gp.SparseGP"), SparseGP) and isinstance(model_by_name("fieldspark.operators.gp:ExactGP"), ExactGP)
    for bad, kind in (("nothing", ValueError), ("fieldspark.operators.gp.GPConfig", TypeError)):
        with pytest.raises(kind):
            model_by_name(bad)


def test_one_set_of_columns_for_all_tables(spark, tmp_path):
    from fieldspark.functions.columns import ColumnSpec
    from fieldspark.sources.store import Store, collect_results

    s = Store(spark, f"file://{tmp_path}/s")
    s.write(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "a_R")
    s.write(spark.createDataFrame([(3.0,)], "x double"), "b_R")
    specs = [ColumnSpec("twice", "*", ["x"], [2]), ColumnSpec("sum", "+", ["x", "y"]), ColumnSpec("more", "+", ["twice"], [1])]
    out = {t: df.first().asDict() for t, df in collect_results(s, "_R", col_funcs=specs).items()}
    assert out == {"a_R": {"x": 1.0, "y": 2.0, "twice": 2.0, "sum": 3.0, "more": 3.0}, "b_R": {"x": 3.0, "twice": 6.0, "more": 7.0}}


def test_parameters_at_adjusted_coordinates(spark):
    from fieldspark.operators.experts import wide_parameters

    params = spark.createDataFrame([(1.0, "lengthscales", 0, 5.0), (1.0, "lengthscales", 1, 6.0), (2.0, "kernel_variance", 0, 7.0)], "x double, param string, dim int, value double")
    experts = spark.createDataFrame([(1, 1.2), (2, 1.9), (3, 9.0)], "expert_id long, x double")
    got = {r["expert_id"]: (r["lengthscales"], r["kernel_variance"]) for r in wide_parameters(params, experts, ["x"], {"x": lambda c: F.round(c, 0)}).collect()}
    assert got == {1: ([5.0, 6.0], None), 2: (None, [7.0]), 3: (None, None)}


def test_matches_of_rows_that_repeat(spark):
    from fieldspark.operators.compare import match

    x = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 4.04)], "k string, v double")
    y = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 4.0)], "idx int, w double")
    assert {r["k"]: r["y_idx"] for r in match(x, y, "v", "w").collect()} == {"a": 0, "b": 0, "c": None, "d": None}
    assert {r["k"]: r["y_idx"] for r in match(x, y, "v", "w", tol=0.1).collect()} == {"a": 0, "b": 0, "c": None, "d": 2}
