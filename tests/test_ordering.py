"""Histogram methods against brute force and against the windows they replace."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from tidemark.operators import dedup, joins, ordering
from tidemark.plans import engagement, propensity

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def ints(spark, values, name="v"):
    return spark.createDataFrame([(int(v),) for v in values], f"{name} long")


@few
@given(values=st.lists(st.integers(0, 6), min_size=1, max_size=40))
def test_rank_distribution_equals_windows(spark, values):
    df = ints(spark, values)
    by = Window.orderBy(F.desc("v"))
    direct = (
        df.select("v", F.ntile(4).over(by).alias("tile"), F.rank().over(by).alias("r"), F.percent_rank().over(by).alias("p"))
        .groupBy("v", "tile", "r", "p").count()
    )
    ours = engagement.rank_distribution(df, "v").select("v", "tile", "value_rank", "pct_rank", "n_rows")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, direct.collect()))


@pytest.mark.parametrize("values", [[5], [5, 5, 5], [1, 2, 3], [3, 3, 3, 3, 3], list(range(9)), list(range(10)), list(range(11))])
def test_bands_equal_windows(spark, values):
    df = ints(spark, values, "session_count")
    by = Window.orderBy(F.desc("session_count"))
    ranked = df.select(F.col("session_count").alias("s"), F.ntile(4).over(by).alias("q"), F.percent_rank().over(by).alias("p"))

    def mean(condition):
        return F.coalesce(F.round(F.avg(F.when(condition, F.col("s"))), 1), F.lit(0.0))

    direct = ranked.agg(
        mean(F.col("p") <= 0.1), F.percentile("s", 0.5), mean(F.col("p") >= 0.9), *[mean(F.col("q") == q) for q in (1, 2, 3, 4)]
    ).first()
    ours = engagement.engagement_bands(df.withColumn("purchase_day", F.lit(-1))).first()
    assert tuple(ours) == pytest.approx(tuple(direct))


@few
@given(
    values=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60),
    p=st.floats(0, 1, allow_nan=False),
)
def test_exact_percentile_equals_numpy(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ordering.exact_percentiles(df, "v", {"x": p, "low": 0.0, "high": 1.0}, buckets=4).first()
    assert got.x == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-6)
    assert (got.low, got.high) == (min(values), max(values))


def test_running_total_is_the_same_with_and_without_ranges(spark):
    rng = np.random.default_rng(7)
    hist = ordering.histogram(ints(spark, rng.integers(0, 500, 3000)), "v")
    for descending in (False, True):
        whole = ordering.running_total(hist, "v", ["n"], descending=descending)
        ranged = ordering.running_total(hist, "v", ["n"], descending=descending, buckets=7)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, ranged.collect()))


def test_numbering_is_dense_and_ordered(spark):
    df = ints(spark, [90, 3, 70, 10, 1000, 42, 8])
    numbered = ordering.global_row_number(df, "v", "id", buckets=3).collect()
    assert sorted((r.id, r.v) for r in numbered) == [(i + 1, v) for i, v in enumerate(sorted([90, 3, 70, 10, 1000, 42, 8]))]


def test_numbering_of_nothing(spark):
    assert ordering.global_row_number(ints(spark, []), "v", "id", buckets=3).count() == 0


def test_rank_in_class_is_a_permutation_per_class(spark):
    df = spark.range(500).select(F.col("id").alias("user_id"), (F.col("id") % 3 == 0).cast("int").alias("k"))
    ranked = ordering.rank_in_class_by_hash(df, "user_id", "k", 42).collect()
    for k in (0, 1):
        got = sorted(r.class_rank for r in ranked if r.k == k)
        assert got == list(range(1, len(got) + 1))
        assert {r.class_size for r in ranked if r.k == k} == {len(got)}
    again = ordering.rank_in_class_by_hash(df.repartition(7), "user_id", "k", 42).collect()
    assert {(r.user_id, r.class_rank) for r in ranked} == {(r.user_id, r.class_rank) for r in again}


def test_keep_first_takes_the_lowest_order(spark):
    df = spark.createDataFrame(
        [(3, "a", 1), (1, "a", 2), (2, "b", 3), (5, None, 4), (4, None, None)], "ord long, name string, x int"
    )
    assert sorted(map(tuple, dedup.keep_first(df, ["name"], "ord").collect())) == [(1, "a", 2), (2, "b", 3), (4, None, None)]


def test_salted_join_equals_plain_join(spark):
    left = spark.range(400).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("k"), (F.col("id") % 11).cast("string"))).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("absent", 3)], "k string, w int")
    plain = left.join(right, "k", "left")
    assert sorted(map(repr, joins.salted_left_join(left, right, "k", F.col("id")).select(*plain.columns).collect())) == sorted(
        map(repr, plain.collect())
    )


def test_id_overlap(spark):
    a, b = ints(spark, [1, 1, 2, 3], "k"), ints(spark, [3, 3, 4], "k")
    assert tuple(joins.id_overlap(a, b, "k").first()) == (2, 1, 1)


@few
@given(pairs=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=40))
def test_auc_equals_pair_counting(spark, pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    scored = spark.createDataFrame([(y, float(s)) for y, s in pairs], "label int, score double")
    got = propensity.roc_auc(scored).first()
    ranged = propensity.roc_auc(scored, buckets=3).first()
    assert (got.n_pos or 0, got.n_neg or 0) == (len(pos), len(neg))
    if pos and neg:
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got.roc_auc == pytest.approx(wins / len(pos) / len(neg))
        assert ranged.roc_auc == pytest.approx(got.roc_auc)
    else:
        assert got.roc_auc is None
