from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.plans import facts, propensity as pp


def test_early_buyers_are_left_out(make_users, make_events, rows):
    users = make_users(*[{"user_id": i, "ab_group": "control"} for i in (1, 2, 3)], {"user_id": 4})
    events = make_events(
        (1, "purchase_completed", 3), (2, "purchase_completed", 4), (2, "session_start", 3), (2, "session_start", 4),
        (2, "feature_used", 3, "collaboration_feature"), (3, "feature_used", 4, "collaboration_feature"),
    )
    got = pp.propensity_features(facts.user_facts(users, events))
    assert got.columns == ["user_id", "country", "acquisition_channel", "early_sessions", "used_collab_early", "target_purchased"]
    assert rows(got) == [(2, "US", "organic_search", 1, 1, 1), (3, "US", "organic_search", 0, 0, 0)]


@pytest.fixture(scope="module")
def features(spark):
    i = F.col("id")
    return spark.range(400).select(
        i.alias("user_id"),
        F.element_at(F.array(F.lit("BR"), F.lit("DE"), F.lit("US")), (i % 3 + 1).cast("int")).alias("country"),
        F.when(i % 2 == 0, "ads").otherwise("search").alias("acquisition_channel"),
        (i % 5).alias("early_sessions"),
        (i % 4 == 0).cast("int").alias("used_collab_early"),
        ((i % 4 == 0) & (i % 7 != 0)).cast("int").alias("target_purchased"),
    )


def test_split_is_exact_per_class(features):
    split = pp.stratified_split(features)
    for label in (0, 1):
        of_class = split.filter(F.col("target_purchased") == label)
        n, n_test = of_class.count(), of_class.filter("is_test").count()
        assert n_test == -(-n // 5)
        folds = [r["count"] for r in of_class.filter("NOT is_test").groupBy("fold").count().collect()]
        assert len(folds) == 5 and max(folds) - min(folds) <= 1
    assert split.filter("is_test AND fold IS NOT NULL").count() == 0


def names_of(encoder):
    return {r.feature for r in encoder.names.collect()}


def test_encoder_drops_the_first_category_and_zeroes_unseen_ones(features, spark):
    train = features.filter("country <> 'US'").union(features.filter("country = 'US'").limit(1).withColumn("country", F.lit("AR")))
    encoder = pp.fit_encoder(train)
    assert names_of(encoder) == {"early_sessions", "used_collab_early", "country_DE", "country_BR", "acquisition_channel_search"}
    unseen = features.filter("user_id = 5").select(*[c for c in features.columns if c != "country"], F.lit("XX").alias("country"))
    got = {(r.feature, r.value) for r in pp.encoded_long(encoder.transform(unseen), encoder).collect()}
    assert got == {("acquisition_channel_search", 1.0)}  # 5 % 5 sessions, no collaboration, unknown country


def test_encoder_with_a_single_category(features):
    one = features.withColumn("acquisition_channel", F.lit("ads"))
    assert names_of(pp.fit_encoder(one)) == {"early_sessions", "used_collab_early", "country_US", "country_DE"}


def test_encoder_with_thousands_of_categories(features, spark):
    many = spark.range(5000).select(
        F.col("id").alias("user_id"), F.format_string("c%04d", "id").alias("country"), F.lit("ads").alias("acquisition_channel"),
        F.lit(1).alias("early_sessions"), F.lit(0).alias("used_collab_early"), F.lit(0).alias("target_purchased"),
    )
    encoder = pp.fit_encoder(many)
    assert encoder.widths == {"country": 4999, "acquisition_channel": 0} and len(names_of(encoder)) == 5001
    rows = encoder.transform(many.filter("user_id < 3")).select("user_id", "features").collect()
    assert {r.features.size for r in rows} == {5001} and {r.user_id: r.features.numNonzeros() for r in rows} == {0: 1, 1: 2, 2: 2}


def test_class_weights_balance(features):
    weighted = pp.with_class_weight(features)
    sums = [r[1] for r in weighted.groupBy("target_purchased").agg(F.sum("weight")).collect()]
    assert sums == pytest.approx([200.0, 200.0])


def test_model_finds_the_driving_feature(features):
    fitted = pp.fit(features, n_trees=5)
    row = fitted.validation.first()
    assert row.n_folds == 5 and 0.8 < row.cv_roc_auc_mean <= 1.0 and row.cv_roc_auc_two_sd >= 0
    assert pp.top_feature(fitted.importances).first().Feature == "used_collab_early"
    assert sum(r.Importance for r in fitted.importances.collect()) == pytest.approx(1.0)
    ours = pp.roc_auc(fitted.scores).first().roc_auc
    held = fitted.encoder.transform(fitted.split.filter("is_test"))
    assert ours == pytest.approx(pp.exact_auc_evaluator().evaluate(fitted.model.transform(held)))
    checks = {r.measure: r.value for r in pp.model_checks(fitted).collect()}
    assert [checks[c] for c in ("scores_out_of_range", "predictions_unlike_scores", "rows_in_no_or_two_parts", "importances_off")] == [0] * 4


def test_folds_fit_their_own_encoder(features, monkeypatch):
    seen = []
    real = pp.fit_encoder
    monkeypatch.setattr(pp, "fit_encoder", lambda train: seen.append({r.fold for r in train.select("fold").distinct().collect()}) or real(train))
    pp.cross_validate(pp.stratified_split(features).filter("NOT is_test"), pp.forest(n_trees=2, max_depth=2))
    assert sorted(map(sorted, seen)) == [sorted(set(range(5)) - {k}) for k in (4, 3, 2, 1, 0)]


def test_report_figures(spark):
    # 3 of 4 zeros and 1 of 2 ones are right
    scored = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] + [(1, 0)], "label int, prediction int")
    got = {r["class"]: tuple(r)[1:] for r in pp.classification_report(scored).collect()}
    assert got["0"] == pytest.approx((0.75, 0.75, 0.75, 4))
    assert got["1"] == pytest.approx((0.5, 0.5, 0.5, 2))
    assert got["accuracy"][2:] == pytest.approx((4 / 6, 6))
    assert got["macro avg"] == pytest.approx((0.625, 0.625, 0.625, 6))
    assert got["weighted avg"] == pytest.approx((4 / 6, 4 / 6, 4 / 6, 6))


def test_report_with_a_class_never_predicted(spark):
    scored = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    got = {r["class"]: tuple(r)[1:] for r in pp.classification_report(scored).collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 1)


def test_metrics_in_long_form(spark):
    scored = spark.createDataFrame([(0, 0.2, 0), (1, 0.9, 1), (1, 0.1, 0)], "label int, score double, prediction int")
    got = {r.metric: r.value for r in pp.model_metrics(scored, buckets=2).collect()}
    assert got["roc_auc"] == pytest.approx(0.5)
    assert got["1 recall"] == 0.5 and got["0 precision"] == 0.5 and got["1 support"] == 2.0
    assert got["accuracy f1_score"] == pytest.approx(2 / 3) and "accuracy recall" not in got
