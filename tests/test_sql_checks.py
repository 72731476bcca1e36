"""Every registered query against its SQL, on whole results."""

from __future__ import annotations

import duckdb
import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tidemark.checks.oracle import ORACLE
from tidemark.checks.queries import REGISTRY

CHECKED = sorted(ORACLE)
ROWS_ONLY = {"propensity_cv", "propensity_scores", "feature_importance", "top_feature", "model_metrics"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    with connect(sf_dir) as c:
        yield c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, connection, name):
    assert differences(REGISTRY[name](spark, sf_dir), connection, ORACLE[name]) == []


def test_every_query_but_the_fitted_models_has_sql():
    assert set(REGISTRY) - set(CHECKED) == ROWS_ONLY
    assert set(CHECKED) <= set(entry.oracle_sql()) and set(REGISTRY) <= set(entry.queries())


def test_comparison_notices_a_wrong_value(spark):
    with duckdb.connect() as c:
        df = spark.range(3).selectExpr("id", "CAST(id AS DOUBLE) AS x")
        good = "SELECT range AS id, CAST(range AS DOUBLE) AS x FROM range(3)"
        assert differences(df, c, good) == []
        assert differences(df, c, good.replace("AS DOUBLE) AS x", "AS DOUBLE) + 1e-9 AS x"))
        assert differences(df, c, good + " WHERE range < 2")
        assert differences(df, c, "SELECT CAST(range AS INTEGER) AS id, CAST(range AS DOUBLE) AS x FROM range(3)")


def test_entry_has_the_funnel(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "n_install" and df.count() == 1
