"""What the findings of round 4 named, on small tables."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from fieldspark.llm import spelling
from fieldspark.operators import binning, stats
from tests.llm.test_search_and_variants import plain_counts, plain_variants, variant_rows


def final_plan(df):
    """The plan by which ``df`` ran, with what Spark changed while it did."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_are_joined_by_shuffles_alone(spark, monkeypatch):
    plans, written = {}, spelling.written

    def noted(df, name):
        plans[name] = plans.get(name, "") + final_plan(df)
        return written(df, name)

    monkeypatch.setattr(spelling, "written", noted)
    rows = variant_rows()
    out = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), planted=True)
    plans["result"] = final_plan(out)
    for name in ("spelling-pairs", "spelling-forms", "spelling-roots", "result"):
        assert "SortMergeJoin" in plans[name], name
    assert not any("Broadcast" in p for p in plans.values())
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out.collect()}
    assert got == plain_variants(plain_counts(rows))


def test_bin_means_are_the_same_in_any_order(spark):
    # 256 values of two digits, whose mean ends in a 5 at the tenth digit
    r = random.Random(4)
    rows, want = [], {}
    for k in range(60):
        v = [r.randint(2, 10) for _ in range(255)]
        v.append(5 + sum(v) % 2)
        rows += [(k, 0.5, x / 100) for x in v]
        want[k] = float((Decimal(sum(v)) / 25600).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    r.shuffle(rows)
    for order in (rows, sorted(rows), sorted(rows, reverse=True)):
        df = spark.createDataFrame(order, "k int, x double, obs double").coalesce(1)
        bins = binning.bin_by(df, "obs", ["k"], y_col=None, grid_res=1.0, x_range=(0.0, 1.0))
        assert {b["k"]: b["obs"] for b in bins.withColumn("obs", F.round("obs", 9)).collect()} == want


def test_bin_means_of_values_that_are_not_split(spark):
    groups = {
        "zero": [0.0, -0.0], "null": [None, 3.0], "nan": [1.0, float("nan")], "inf": [1.0, float("inf")], "both": [float("-inf"), float("inf")], "none": [1.0, -1.0],
        "tiny": [1e-20, 2e-20], "huge": [1e300, 3e300], "edge": [2.0**26, -(2.0**26) + 0.1], "third": [1 / 3, 2 / 3, 1e-8],
    }
    df = spark.createDataFrame([(k, 0.5, v) for k, vs in groups.items() for v in vs], "k string, x double, obs double")
    got = {row["k"]: row["obs"] for row in binning.bin_by(df, "obs", ["k"], y_col=None, grid_res=1.0, x_range=(0.0, 1.0)).collect()}
    old = {row["k"]: row["m"] for row in df.groupBy("k").agg(F.avg("obs").alias("m")).collect()}
    assert got == pytest.approx(old, rel=1e-15, nan_ok=True) and got["none"] == got["zero"] == 0.0
    assert df.where("obs is null").select(stats.steady_mean(F.col("obs"))).first()[0] is None
