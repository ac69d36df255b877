"""Expected values of functions and operators, and properties against plain versions."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldspark.functions import arrays, geo, predicates, timecols
from fieldspark.functions.columns import ColumnSpec, add_columns, rename_all, select_columns
from fieldspark.operators import binning, compare, experts, glue, gp, grid, nearby, stats, tracks, xval
from fieldspark.sources import ingest, scan, store


def one(df):
    return df.first()[0]


# ---- columns and predicates


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "A long, B long")


def test_columns(abc):
    out = add_columns(abc, [ColumnSpec("C", lambda a: a + 1, ["A"]), ColumnSpec("D", "*", ["B"], [2]), ColumnSpec(["E", "G"], lambda a: F.struct(a, -a), [0])])
    assert [tuple(r) for r in out.collect()] == [(1, 4, 2, 8, 1, -1), (2, 5, 3, 10, 2, -2), (3, 6, 4, 12, 3, -3)]
    with pytest.raises(KeyError):
        add_columns(abc, [ColumnSpec("C", "+", ["Z"], [1])])
    with pytest.raises(ValueError):
        add_columns(abc, [ColumnSpec(["C", "D"], lambda a: F.struct(a), ["A"])])
    with pytest.raises(ValueError):
        add_columns(abc, [ColumnSpec("C", "red", allowed=["blue"])])
    with pytest.raises(KeyError):
        select_columns(abc, ["A", "Z"])
    with pytest.raises(ValueError):
        rename_all(abc, ["a"])


def test_plain_keyword_arguments_win(abc):
    spec = ColumnSpec("C", lambda x, y: x + y, ["A"], col_kwargs={"y": "B"}, kwargs={"y": 100})
    assert one(add_columns(abc, [spec]).select("C")) == 101


def test_predicates(abc, spark):
    assert predicates.select_rows(abc, [{"col": "A", "comp": ">=", "val": 2}, {"col": "B", "comp": "<", "val": 6}]).count() == 1
    assert predicates.select_rows(abc, [{"col": "A", "comp": "==", "val": 1}, {"col": "B", "comp": "==", "val": 4}], "OR").count() == 1
    assert predicates.select_rows(abc, []).count() == 3
    holes = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert predicates.select_rows(holes, {"col": "v", "comp": ">=", "val": 1, "negate": True}).count() == 1
    with pytest.raises(ValueError):
        predicates.select_rows(abc, {"col": "A", "comp": "~", "val": 1})
    with pytest.raises(TypeError):
        predicates.select_rows(abc, {"func": "+", "cols": ["A"], "args": [1]})


def test_global_select_errors():
    dynamic = [{"loc_col": "t", "src_col": "t", "func": lambda a, b: a + b}]
    local = [{"col": "t", "comp": "<=", "val": 4}]
    assert predicates.global_select(dynamic, local, {"t": 10}) == [{"col": "t", "comp": "<=", "val": 14}]
    for bad in ((dynamic, [], {"t": 1}), (dynamic, local, None), ([{"loc_col": "t"}], local, {"t": 1}), (dynamic, local, {"x": 1})):
        with pytest.raises(ValueError):
            predicates.global_select(*bad)


# ---- times


def test_numbers_to_times(spark):
    def at(v, epoch="1950-01-01", unit="D"):
        return one(spark.range(1).select(timecols.timestamp_from_number(F.lit(v).cast("double"), epoch, unit).cast("string")))

    assert at(18262.5) == "2000-01-01 12:00:00"
    assert at(-1.5) == "1949-12-30 12:00:00"
    assert at(float("nan")) is None and at(1e100) is None
    assert at(438001.0, "1970-01-01", "h") == "2019-12-20 01:00:00"


def test_time_parts(spark):
    def at(y, m, d, hms):
        return one(spark.range(1).select(timecols.timestamp_from_parts(*map(F.lit, (y, m, d, hms)))))

    assert at(2021, 1, 10, 123456) == dt.datetime(2021, 1, 10, 12, 34, 56)
    for bad in ((2021, 13, 1, 0), (2021, 1, 0, 0), (2021, 1, 1, 240000)):
        with pytest.raises(PySparkException):
            at(*bad)


def test_file_name_times(spark):
    name = "x_y_20191031T233355_20191101T002424_a_b_c.nc"
    df = spark.range(11).withColumn("name", F.lit(name))
    out = timecols.spread_between(df, "name", "id", *timecols.name_times(F.col("name"))).orderBy("id").collect()
    assert out[0]["datetime"] == dt.datetime(2019, 10, 31, 23, 33, 55) and out[-1]["datetime"] == dt.datetime(2019, 11, 1, 0, 24, 24)
    assert out[1]["datetime"] - out[0]["datetime"] == dt.timedelta(seconds=302.9)


# ---- projection and grids


@pytest.mark.parametrize(
    ("centre", "want"),
    [((0, 90), (-5254767.014984061, 1409604.1043472202)), ((-90, 90), (-1409604.1043472204, -5254767.014984061)), ((0, 45), (-5882390.5299294265, 4659494.127247092))],
)
def test_projection(spark, centre, want):
    x, y = geo.project(F.lit(-105.01621), F.lit(39.57422), *centre)
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx(want, abs=1e-6)


def test_inverse_projection(spark):
    for (x, y, lon0, lat0), want in {(0.0, 0.0, 0, 90): (0, 90), (0.0, 110573.0, 0, 0): (0, 1), (111321.0, 0.0, 0, 0): (1.000026, 0)}.items():
        got = spark.range(1).select(*geo.unproject(F.lit(x), F.lit(y), lon0, lat0)).first()
        assert tuple(got) == pytest.approx(want, abs=1e-5)
    pts = spark.createDataFrame([(0.0, 90.0), (0.0, -89.0), (179.0, 10.0), (-60.0, 45.0), (12.5, -33.0)], "lon double, lat double")
    for centre in ((0, 90), (10, 50)):
        x, y = geo.project(F.col("lon"), F.col("lat"), *centre)
        q = pts.withColumns({"x": x, "y": y})
        for r in q.select("lon", "lat", *geo.unproject(F.col("x"), F.col("y"), *centre)).collect():
            assert abs(r[3] - r[1]) < 1e-3 and (abs(r[1]) == 90 or abs((r[2] - r[0] + 180) % 360 - 180) < 1e-3)


def test_degrees(spark):
    df = spark.createDataFrame([("60 15.5 S",), ("89 59 N",), (None,)], "s string")
    assert [r[0] for r in df.select(geo.degrees_from_text(F.col("s"))).collect()] == [pytest.approx(-60.2583333), pytest.approx(89.9833333), None]


def test_grid_sizes(spark):
    size = lambda **k: grid.grid_2d(spark, (-1, 1), (-1, 1), **k).count()
    assert size(grid_res=0.5) == size(step_size=0.5) == size(num_step=5) == 16
    assert size(num_step=5, center=False) == 25
    assert grid.grid_2d(spark, (-1, 1), (-1, 0), step_size=0.5).count() == 8
    assert grid.grid_2d(spark, (-1, 1), (-1, 0), step_size=0.5, center=False).count() == 15
    with pytest.raises(ValueError):
        grid.grid_2d(spark, (-1, 1), (-1, 1))


def test_lattice(spark):
    full = spark.createDataFrame([(0.0, 0.0, 1), (1.0, 0.0, 3), (0.0, 1.0, 2), (1.0, 1.0, 4)], "x double, y double, v long")
    arrange = lambda df: [r["v"] for r in grid.lattice_rows(grid.lattice_values(df, "x", "y", "v"), "v").orderBy("iy").collect()]
    assert arrange(full) == [[1, 3], [2, 4]]
    assert arrange(full.where("v <> 3")) == [[1, None], [2, 4]]
    for bad in (full.unionByName(full), full.withColumnRenamed("v", "w")):
        with pytest.raises(ValueError):
            grid.lattice_values(bad, "x", "y", "v")


# ---- binning and statistics


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(42)
    rows = [(["A", "B"][int(r.integers(2))], float(r.uniform(-100, 100)), float(r.uniform(-100, 100)), float(r.normal())) for _ in range(1000)]
    return spark.createDataFrame(rows, "category string, x double, y double, value double"), rows


BOX = {"grid_res": 20.0, "x_range": (-100, 100), "y_range": (-100, 100)}


def test_bins_equal_numpy(sample):
    df, rows = sample
    out = binning.bin_by(df, "value", ["category"], statistic=["mean", "count"], **BOX).collect()
    want = {}
    for c, x, y, v in rows:
        want.setdefault((c, min(int((x + 100) // 20), 9), min(int((y + 100) // 20), 9)), []).append(v)
    assert len(out) == len(want)
    for r in out:
        vs = want[r["category"], round((r["x"] + 90) / 20), round((r["y"] + 90) / 20)]
        assert r["value_mean"] == pytest.approx(np.mean(vs)) and r["value_count"] == len(vs)
    assert binning.bin_by(df, "value", statistic="count", dense=True, **BOX).count() == 100


@pytest.mark.parametrize("bad", [{"val_col": "nope"}, {"grid_res": None}, {"x_range": (100, -100)}, {"by": ["nope"]}, {"statistic": "nope"}])
def test_binning_errors(sample, bad):
    with pytest.raises(ValueError):
        binning.bin_by(sample[0], **{"val_col": "value", **BOX, **bad})


def test_group_limit(sample):
    with pytest.raises(ValueError):
        binning.bin_by(sample[0], "value", ["category"], limit=2, **BOX)


def test_weighted_values(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 1, 20.0), (2, 2, -5.0), (2, 2, 5.0)], "r long, d long, v double")
    assert {x["r"]: x["v"] for x in glue.weighted_values(df, "r", "d", ["v"], 1.0).collect()} == {1: 15.0, 2: 0.0}
    for bad in ({}, {"lengthscale": 1.0, "weight_function": "box"}):
        with pytest.raises(ValueError):
            glue.weighted_values(df, "r", "d", ["v"], **bad)


def test_glue_of_one_expert_is_the_identity(spark):
    df = spark.createDataFrame([(0.0, 0.0, float(i), 1.0, float(i * i), 0.5, 0.6) for i in range(5)], "x double, y double, pred_loc_x double, pred_loc_y double, f_star double, f_var double, y_var double")
    assert all(r["f_star"] == pytest.approx(r["pred_loc_x"] ** 2) for r in glue.glue_local_predictions(df, 10.0).collect())


def test_far_weights_give_null(spark):
    df = spark.createDataFrame([(0.0, 1e9, 1.0)], "x double, pred_loc_x double, f_star double")
    assert glue.glue(df, [("pred_loc_x", "x")], 1.0, ["f_star"]).first()["f_star"] is None


# ---- tracks


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=40, unique=True), st.integers(1, 60))
def test_tracks_partition_the_rows(spark, times, gap):
    df = spark.createDataFrame([(1, t) for t in times], "g int, t int")
    w = tracks.diff_distance(["t"], ["g"], ["t"])
    got = {r["t"]: r["track"] for r in tracks.number_tracks(df.withColumn("gap", w), "gap", gap, ["g"], ["t"]).collect()}
    want, track = {}, 0
    for a, b in itertools.pairwise([None, *sorted(times)]):
        track += a is not None and b - a > gap
        want[b] = track
    assert got == want


# ---- joins


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=25), st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=25), st.integers(1, 15))
def test_range_join_equals_all_pairs(spark, places, points, radius):
    e = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "expert_id long, x double, y double")
    o = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    got = sorted(tuple(r) for r in nearby.local_select(e, o, [nearby.Near(["x", "y"], "<=", radius), nearby.Near("x", ">=", -3)], ["id"], ["x", "y"]).select("expert_id", "id").collect())
    want = sorted((i, j) for i, (a, b) in enumerate(places) for j, (x, y) in enumerate(points) if math.hypot(x - a, y - b) <= radius and x >= a - 3)
    assert got == want


def test_match(spark):
    x = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 2, 1])], "idx long, v long")
    y = spark.createDataFrame([(0, 1), (1, 2), (2, 2)], "idx long, v long")
    assert [r["y_idx"] for r in compare.match(x, y, "v", "v").orderBy("idx").collect()] == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        compare.match(x, y.where("v = 1"), "v", "v", check=True)


# ---- arrays


def test_arrays(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "v array<array<double>>")
    rows = arrays.array_to_rows(df, "v")
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    assert one(arrays.rows_to_array(rows, "v", ["_dim_0", "_dim_1"])) == [[1.0, 2.0], [3.0, 4.0]]
    hole = rows.where("not (_dim_0 = 0 and _dim_1 = 1)")
    assert one(arrays.rows_to_array(hole, "v", ["_dim_0", "_dim_1"])) == [[1.0, None], [3.0, 4.0]]
    assert one(arrays.rows_to_array(hole, "v", ["_dim_0", "_dim_1"], fill=-999.0)) == [[1.0, -999.0], [3.0, 4.0]]
    with pytest.raises(ValueError):
        arrays.rows_to_array(rows.where("_dim_0 = 1"), "v", ["_dim_0", "_dim_1"])
    with pytest.raises(TypeError):
        arrays.rows_to_array(rows.withColumn("_dim_0", F.col("_dim_0") * 1.5), "v", ["_dim_0", "_dim_1"])


# ---- Gaussian processes


@pytest.mark.parametrize("kernel", gp.KERNELS)
def test_gp_gradient_and_prediction(kernel):
    r = np.random.default_rng(3)
    x, y = r.uniform(0, 10, (40, 2)), r.normal(size=40)
    c = gp.GPConfig(kernel=kernel, obs_mean="local")
    m = gp.ExactGP()
    p = {"lengthscales": np.array([1.3, 2.1]), "kernel_variance": np.array([0.8]), "likelihood_variance": np.array([0.2])}
    xs, ys, _, _ = gp.scaled(x, y, c)
    _, grads = m.objective(xs, ys, c, p)
    for n, v in p.items():
        for k in range(len(v)):
            up, down = {a: b.copy() for a, b in p.items()}, {a: b.copy() for a, b in p.items()}
            up[n][k] *= math.exp(1e-5)
            down[n][k] *= math.exp(-1e-5)
            slope = (m.objective(xs, ys, c, up)[0] - m.objective(xs, ys, c, down)[0]) / 2e-5
            assert grads[n][k] == pytest.approx(slope, rel=1e-4, abs=1e-6)
    new = r.uniform(0, 10, (7, 2))
    kernel_at = lambda a, b: gp.kernel_of(gp.squared_parts(a, b, p["lengthscales"]), kernel, 0.8)[0]
    ky = kernel_at(x, x) + 0.2 * np.eye(40)
    want = kernel_at(new, x) @ np.linalg.inv(ky) @ (y - y.mean())
    got = m.predict(x, y, c, p, new)
    assert np.allclose(got["f_star"], want) and np.allclose(got["f_var"], 0.8 - np.einsum("ij,jk,ik->i", kernel_at(new, x), np.linalg.inv(ky), kernel_at(new, x)))


def test_gp_fit_improves_and_keeps_bounds():
    r = np.random.default_rng(5)
    x = r.uniform(0, 10, (60, 1))
    y = np.sin(x[:, 0]) + 0.05 * r.normal(size=60)
    c = gp.GPConfig(bounds={"lengthscales": (0.5, 3.0)}, fixed=["kernel_variance"])
    m = gp.ExactGP()
    start, first, _ = m.fit(x, y, c, None, False)
    params, value, ok = m.fit(x, y, c)
    assert ok and value < first and 0.5 <= params["lengthscales"][0] <= 3.0 and params["kernel_variance"] == start["kernel_variance"]


def test_sparse_gp_with_all_points_is_exact():
    r = np.random.default_rng(6)
    x, y = r.uniform(0, 10, (50, 1)), r.normal(size=50)
    c = gp.GPConfig(num_inducing=50, likelihood_variance=0.1)
    p = gp.ExactGP().fit(x, y, c, None, False)[0]
    new = np.linspace(0, 10, 9)[:, None]
    a, b = gp.ExactGP().predict(x, y, c, p, new), gp.SparseGP().predict(x, y, c, p, new)
    assert np.allclose(a["f_star"], b["f_star"], atol=1e-3) and np.allclose(a["f_var"], b["f_var"], atol=1e-3)
    assert gp.SparseGP().fit(x, y, c, None, False)[1] == pytest.approx(gp.ExactGP().fit(x, y, c, None, False)[1], rel=1e-3)


# ---- runs, stores, ingest, cross-validation


def test_run_is_stored_and_resumed(spark, tmp_path):
    r = np.random.default_rng(8)
    obs = spark.createDataFrame([(float(a), float(b), float(np.sin(a))) for a, b in r.uniform(0, 10, (120, 2))], "x double, y double, obs double")
    places = spark.createDataFrame([(2.0, 2.0), (8.0, 8.0), (500.0, 500.0)], "x double, y double")
    c = experts.ExpertConfig(["x", "y"], "obs", [nearby.Near(["x", "y"], "<=", 3.0)], gp.GPConfig(lengthscales=[2.0, 2.0], likelihood_variance=0.01), pred_method="expert_loc")
    s = store.Store(spark, f"file://{tmp_path}/results")
    assert experts.run_and_store(s, places, obs, c) == experts.run_and_store(s, places, obs, c) == 1
    details = s.read("run_details").toPandas()
    assert len(details) == 3 and details[details.x == 500].objective_value.isna().all() and details[details.x == 500].num_obs.item() == 0
    assert s.read("preds").count() == 2 and s.read("params").count() == 2 * 4
    assert set(store.collect_results(s, coords=["x", "y"])) >= {"preds", "params", "run_details", "expert_locs"}
    smooth = glue.smooth_parameters(s.read("params"), {"lengthscales": glue.SmoothingConfig(100.0, 100.0)}, ["x", "y"], cutoff=None)
    from dataclasses import replace

    again = experts.run_experts(places, obs, replace(c, optimise=False), load_params=smooth)
    assert again.preds.count() == 2


def test_store_metadata(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    df = spark.range(3)
    s.write(df, "t", config={"a": 1}, run_info=True)
    s.write(df, "t", append=True, config={"a": 2})
    assert s.attribute("t", "config") == [{"a": 1}, {"a": 2}] and s.read("t").count() == 6 and s.tables() == ["t"]
    s.write(df, "t", config={"a": 3})
    assert s.attribute("t", "config") == [{"a": 3}] and s.read("t").count() == 3
    assert s.config_id({"x": 1, "y": [2]}) == s.config_id({"y": [2], "x": 1}) == 1 and s.config_id({"x": 2}) == 2
    with pytest.raises(ValueError):
        s.check_compatible({"x": 5})


def test_ingest_keeps_a_ledger(spark, tmp_path):
    for name, n in (("d1", 3), ("d2", 0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "A_RAW.csv").write_text("lon,lat\n" + "".join(f"{i},{i}\n" for i in range(n)))
    s = store.Store(spark, f"file://{tmp_path}/out")
    spec = ColumnSpec("source", lambda f: F.regexp_replace(f, "_RAW.csv", ""), filename_as_arg=True)
    run = lambda: ingest.ingest(spark, s, "obs", [str(tmp_path / "d1"), str(tmp_path / "d2"), str(tmp_path / "none")], r"_RAW\.csv$", schema="lon double, lat double", col_funcs=[spec], config={"v": 1})
    assert (run(), run()) == (3, 0)
    assert {r["source"] for r in s.read("obs").collect()} == {"A"}
    with pytest.raises(FileNotFoundError):
        scan.matching_files(str(tmp_path / "none"), ".")
    assert len(scan.matching_files(str(tmp_path), r"RAW", walk=True)) == 2


def test_ingest_writes_a_batch_again_that_was_not_noted(spark, tmp_path):
    for name in ("d1", "d2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "A.csv").write_text("lon,lat\n" + "".join(f"{i},{i}\n" for i in range(4)))
    s = store.Store(spark, f"file://{tmp_path}/out")
    run = lambda **more: ingest.ingest(spark, s, "obs", [str(tmp_path / "d1"), str(tmp_path / "d2")], r"\.csv$", schema="lon double, lat double", **more)
    assert run() == 8
    # as if the last run had died between the rows of the second batch and its ledger row
    noted = s.read("_obs_batches").where(F.col("file_dir").endswith("d1")).collect()
    s.write(spark.createDataFrame(noted, ingest.LEDGER_SCHEMA), "_obs_batches")
    assert run() == 4 and s.read("obs").count() == 8 and s.read("_obs_batches").count() == 2
    assert s.read("obs").select(ingest.BATCH).distinct().count() == 2
    assert run(overwrite=True) == 8 and s.read("obs").count() == 8


def test_folds_partition_the_rows(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long")
    f = xval.folds(df, ["k"])
    assert f.count() == 3
    held, train = xval.held_out_locations(df, f, ["k"]), xval.training_rows(df, f, ["k"])
    assert held.count() == 30 and train.count() == 60
    assert held.join(train, ["fold_id", "id"]).count() == 0


def test_smoothed_cross_validation_equals_runs_by_hand(spark):
    from fieldspark.operators.experts import ExpertConfig, fit_experts, long_parameters, predict_experts, select_for_experts, wide_parameters
    from fieldspark.operators.glue import SmoothingConfig, smooth_parameters
    from fieldspark.operators.gp import GPConfig
    from fieldspark.operators.nearby import Near, prediction_locations

    r = np.random.default_rng(5)
    rows = [(float(x), float(y), float(np.sin(x) + y / 5 + r.normal() / 10), (x * 3 + y) % 2) for x in range(6) for y in range(4)]
    obs = spark.createDataFrame(rows, "x double, y double, obs double, k int")
    places = spark.createDataFrame([(1, 1.0, 1.5), (2, 4.0, 1.5)], "expert_id long, x double, y double")
    c = ExpertConfig(["x", "y"], "obs", [Near(["x", "y"], "<=", 2.5)], GPConfig(lengthscales=[1.0, 1.0], bounds={"lengthscales": ([0.3, 0.3], [9.0, 9.0])}, max_iter=10), max_dist=2.0)
    smooth = {"lengthscales": SmoothingConfig(3.0, 3.0)}
    out = xval.cross_validate(places, obs, c, ["k"], smooth=smooth)
    fold = {f["k"]: f["fold_id"] for f in out["folds"].collect()}
    got = {(p["fold_id"], p["expert_id"], p["pred_loc_x"], p["pred_loc_y"]): p["f_star"] for p in out["preds"].collect()}
    want = {}
    for k in (0, 1):
        chosen = select_for_experts(places, obs.where(f"k <> {k}"), c)
        params = smooth_parameters(long_parameters(fit_experts(places, chosen, c), c.coords), smooth, c.coords)
        fitted = fit_experts(places, chosen, replace(c, optimise=False), wide_parameters(params, places, c.coords))
        at = prediction_locations(places, obs.where(f"k = {k}").select("x", "y"), 2.0, ["x", "y"], ["x", "y"])
        want |= {(fold[k], p["expert_id"], p["pred_loc_x"], p["pred_loc_y"]): p["f_star"] for p in predict_experts(fitted, chosen, at, c).collect()}
    assert got.keys() == want.keys() and len(got) > 8
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_statistics_of_a_column(spark):
    v = [1.0, 2.0, 4.0, 9.0, 12.5]
    r = stats.statistics(spark.createDataFrame([(x,) for x in v], "v double"), "v", qs=[0.25]).first()
    assert r["std"] == pytest.approx(np.std(v)) and r["q0.250"] == 2.0 and r["size"] == 5


def test_missing_gaps_and_missing_coordinates(spark):
    rows = [(1, 1.0), (2, float("nan")), (3, 0.5), (4, None), (5, 11.0)]
    out = tracks.number_tracks(spark.createDataFrame(rows, "k int, gap double"), "gap", 10.0, [], ["k"]).collect()
    assert {r["k"]: r["track"] for r in out} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 5e6, -5e6), (4, float("nan"), 0.0)], "id long, x double, y double")
    truth = spark.createDataFrame([(7, 1.0, 0.0, 70.0), (8, -1.0, 0.0, 80.0), (9, None, None, 90.0)], "t long, x double, y double, v double")
    got = {r["id"]: r["v"] for r in nearby.nearest(points, truth, ["x", "y"], "id", "t", ["v"], 1.0).collect()}
    assert got == {1: 70.0, 2: None, 3: 70.0, 4: None}
