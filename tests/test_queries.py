"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from tests.conftest import TINY
from tests.oracle import assert_same

from fieldspark.plans.catalog import ORACLE_SQL, QUERIES, flagship


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, TINY), ORACLE_SQL[name], TINY)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, TINY).count() > 0


def test_flagship(spark):
    out = flagship(spark, TINY).toPandas()
    assert len(out) and out["f_star"].notna().all()
