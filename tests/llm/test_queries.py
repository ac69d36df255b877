"""The registered queries: SQL twins, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import pytest
from tests.conftest import TINY
from tests.oracle import assert_same

import corpus_pipeline
from fieldspark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import cases


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, TINY), ORACLE_SQL[name], TINY)


def test_line_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").collect()
    want = cases.lines_kept({r["doc_id"]: r["text"] for r in docs})
    import hashlib

    got = {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op5_line_dedup"](spark, TINY).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in want.items()}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, TINY), f"test-{name}")
        assert out.columns == docs.columns
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, out))
        if name == "toxicity":
            assert 0.8 * len(before) < len(after) <= len(before)
        elif name == "line_dedup":
            assert after == cases.lines_kept(before)
        elif name == "ngram_jaccard":
            assert set(after) == {i for i, (_, c) in cases.components(before).items() if i == c}
        else:
            kept = cases.substring_kept(before)
            assert {i: (t or "").encode().split() for i, t in after.items()} == kept
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).toPandas()
    assert set(rows.doc_id) == set(after) and rows.groupby("sequence_id").length.sum().max() <= 2048
    # the whole pipeline gives what its stages give one by one
    piece = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, TINY).toPandas()
    assert sorted(map(tuple, whole[piece].to_numpy().tolist())) == sorted(map(tuple, rows[piece].to_numpy().tolist()))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{TINY}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
