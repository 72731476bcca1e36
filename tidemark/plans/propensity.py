"""Propensity-to-convert model on early behaviour of trial users."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from statistics import fmean, pstdev

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import ratio, ratio_or_zero
from tidemark.operators.joins import salted_left_join
from tidemark.operators.ordering import rank_in_class_by_hash, running_total
from tidemark.plans.forest import forest_nodes, table_importances, table_scores
from tidemark.sources.staging import stage, together

CATEGORICAL = ("country", "acquisition_channel")
NUMERIC = ("early_sessions", "used_collab_early")
LABEL = "target_purchased"
SEED = 42
TEST_SIZE = 0.2
N_FOLDS = 5
N_TREES = 100
MAX_DEPTH = 5


def propensity_features(facts: DataFrame) -> DataFrame:
    """Features of trial users from their first days. Users who bought within
    those days are left out: the features would contain the answer."""
    return facts.filter(F.col("ab_group").isNotNull() & (F.col("purchased_early") == 0)).select(
        "user_id",
        *CATEGORICAL,
        "early_sessions",
        "used_collab_early",
        F.col("reached_purchase").alias(LABEL),
    )


def stratified_split(
    features: DataFrame, label: str = LABEL, test_size: float = TEST_SIZE, folds: int = N_FOLDS, seed: int = SEED
) -> DataFrame:
    """Adds ``is_test`` (exact share per class) and ``fold`` (0..folds-1, training rows only).

    Reproducible whatever the partitioning, unlike ``randomSplit``.
    """
    ranked = rank_in_class_by_hash(features, "user_id", label, seed)
    n_test = F.ceil(F.col("class_size") * F.lit(test_size))
    is_test = F.col("class_rank") <= n_test
    return ranked.select(
        *features.columns,
        is_test.alias("is_test"),
        F.when(~is_test, ((F.col("class_rank") - n_test - 1) % folds).cast("int")).alias("fold"),
    )


def class_weights(labelled: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, n, weight) with balanced weights n_total / (n_classes * n)."""
    classes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = classes.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    return classes.select(label, "n", ratio(totals["rows"], totals["classes"] * F.col("n")).alias("weight"))


def with_class_weight(train: DataFrame, label: str = LABEL) -> DataFrame:
    weights = class_weights(train, label).select(label, "weight")
    return train.join(F.broadcast(weights), label)  # one row per class


@dataclass(frozen=True)
class Encoder:
    """One-hot encoding without the alphabetically first category; unseen ones become all zeros.

    ``slots`` (column, value, slot) is a table, so the number of categories is no matter for the driver; the slots of a
    column follow each other in an order drawn by hash.
    """

    slots: DataFrame
    widths: dict[str, int]

    @property
    def names(self) -> DataFrame:
        """(slot, feature) of the feature vector."""
        numeric = F.array(*[F.struct(F.lit(i).cast("long").alias("slot"), F.lit(n).alias("feature")) for i, n in enumerate(NUMERIC)])
        spark = self.slots.sparkSession
        out = spark.range(1).select(F.inline(numeric))
        start = len(NUMERIC)
        for column, width in self.widths.items():
            its = self.slots.filter(F.col("column") == column)
            out = out.unionByName(its.select((F.col("slot") + start).alias("slot"), F.concat(F.lit(f"{column}_"), "value").alias("feature")))
            start += width
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``features``."""
        columns, spark = list(df.columns), df.sparkSession
        pieces = list(NUMERIC)
        for column, width in self.widths.items():
            if not width:
                continue
            its = self.slots.filter(F.col("column") == column).select(F.col("value").alias(column), F.col("slot").alias("_slot"))
            # a number beyond the last slot is unseen, and encoded as all zeros
            # a category may be very frequent, or missing in many rows
            numbered = salted_left_join(df, its, column, F.col("user_id")).withColumn(f"_{column}", F.coalesce("_slot", F.lit(width)).cast("double")).drop("_slot")
            encoder = OneHotEncoder(inputCol=f"_{column}", outputCol=f"_{column}_slots", handleInvalid="keep")
            df = encoder.fit(spark.range(1).select(F.lit(float(width - 1)).alias(f"_{column}"))).transform(numbered)
            pieces.append(f"_{column}_slots")
        return VectorAssembler(inputCols=pieces, outputCol="features").transform(df).select(*columns, "features")


def fit_encoder(train: DataFrame) -> Encoder:
    """Numbers the categories of the training rows by a distributed fold; only their count reaches the driver."""
    tables, widths = [], {}
    for column in CATEGORICAL:
        values = train.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
        base = values.agg(F.min("value")).scalar()
        ranked = rank_in_class_by_hash(values.filter(F.col("value") != base).withColumn("column", F.lit(column)), "value", "column", SEED)
        tables.append(ranked.select("column", "value", (F.col("class_rank") - 1).alias("slot")))
    slots = stage(reduce(DataFrame.unionByName, tables), "slots")
    found = {r["column"]: r["n"] for r in slots.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    widths = {column: found.get(column, 0) for column in CATEGORICAL}
    return Encoder(slots, widths)


def encoded_long(encoded: DataFrame, encoder: Encoder) -> DataFrame:
    """(user_id, feature, value): the non-zero slots of the feature vector."""
    filled = encoded.select("user_id", F.posexplode(vector_to_array("features")).alias("slot", "value")).filter("value <> 0")
    return filled.join(encoder.names, "slot").select("user_id", "feature", "value")


def forest(n_trees: int = N_TREES, max_depth: int = MAX_DEPTH, seed: int = SEED) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features",
        labelCol=LABEL,
        weightCol="weight",
        numTrees=n_trees,
        maxDepth=max_depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )


def exact_auc_evaluator() -> BinaryClassificationEvaluator:
    # numBins=0: every distinct score is a threshold
    return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=LABEL, numBins=0)


def fold_auc(train: DataFrame, classifier: RandomForestClassifier, fold: int) -> float:
    """ROC-AUC on one fold; encoder and class weights come from the other folds alone."""
    rest = with_class_weight(train.filter(F.col("fold") != fold))
    encoder = fit_encoder(rest)
    model = classifier.fit(encoder.transform(rest))
    return exact_auc_evaluator().evaluate(model.transform(encoder.transform(train.filter(F.col("fold") == fold))))


def cross_validate(train: DataFrame, classifier: RandomForestClassifier, folds: int = N_FOLDS) -> DataFrame:
    """One row: mean ROC-AUC over the stratified folds, and two standard deviations.

    The folds are fitted side by side: one fit alone rarely keeps a cluster busy. (The built-in cross-validator runs
    its folds one after another and caches two copies of the data for each.)
    """
    aucs = together([lambda fold=fold: fold_auc(train, classifier, fold) for fold in range(folds)])
    return train.sparkSession.createDataFrame(
        [(folds, fmean(aucs), 2 * pstdev(aucs))],
        "n_folds int, cv_roc_auc_mean double, cv_roc_auc_two_sd double",
    )


@dataclass(frozen=True)
class FittedModel:
    """A forest with everything that reports draw from it."""

    split: DataFrame
    encoder: Encoder
    model: RandomForestClassificationModel
    validation: DataFrame
    scores: DataFrame

    @cached_property
    def nodes(self) -> DataFrame:
        """The forest as a table."""
        return forest_nodes(self.model, self.split.sparkSession)

    @property
    def importances(self) -> DataFrame:
        return table_importances(self.nodes, self.encoder.names)


def fit(features: DataFrame, n_trees: int = N_TREES, validate: bool = True) -> FittedModel:
    """Split, cross-validate, fit on all training rows and score the hold-out; each once."""
    split = stage(stratified_split(features), "split")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    weighted = with_class_weight(train)
    encoder = fit_encoder(weighted)
    classifier = forest(n_trees)
    jobs = [lambda: classifier.fit(encoder.transform(weighted))]
    if validate:
        jobs.append(lambda: cross_validate(train, classifier))
    model, *validation = together(jobs)
    scored = stage(scores(model, encoder.transform(test)), "scored")
    return FittedModel(split, encoder, model, validation[0] if validation else None, scored)


def model_checks(fitted: FittedModel, tolerance: float = 1e-6) -> DataFrame:
    """(measure, value): counts of the hold-out and the folds, and how many rows break what must hold."""
    split, label = fitted.split, F.col(LABEL)
    held = fitted.scores.agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(F.col("label") == 1).alias("test_positives"),
        F.count_if(~F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("scores_out_of_range"),
        F.count_if(F.col("prediction") != (F.col("score") > 0.5).cast("int")).alias("predictions_unlike_scores"),
    )
    folds = split.agg(
        F.count_if(~F.col("is_test")).alias("train_rows"),
        F.count_if(~F.col("is_test") & (label == 1)).alias("train_positives"),
        F.count_if(F.col("is_test") == F.col("fold").isNotNull()).alias("rows_in_no_or_two_parts"),
        *[F.count_if(F.col("fold") == k).alias(f"fold_{k}_rows") for k in range(N_FOLDS)],
        *[F.count_if((F.col("fold") == k) & (label == 1)).alias(f"fold_{k}_positives") for k in range(N_FOLDS)],
    )
    known = fitted.importances.agg(
        F.count(F.lit(1)).alias("features"),
        F.sum(F.length("Feature")).alias("feature_name_chars"),
        F.coalesce((F.abs(F.sum("Importance") - 1) > tolerance).cast("int"), F.lit(1)).alias("importances_off"),
    )
    rescored = table_scores(fitted.nodes, fitted.encoder.transform(split.filter("is_test")), fitted.model.getMaxDepth())
    both = rescored.select("user_id", "table_score").join(fitted.scores, "user_id", "full_outer")
    unlike = F.abs(F.col("table_score") - F.col("score")) > tolerance
    by_table = both.agg(F.count_if(F.coalesce(unlike, F.lit(True))).alias("scores_unlike_the_models"))
    own = feature_importance(fitted.model, fitted.encoder).withColumnsRenamed({"Importance": "own"})
    pairs = fitted.importances.join(own, "Feature", "full_outer")
    apart = F.coalesce(F.abs(F.col("Importance") - F.col("own")) > tolerance, F.lit(True))
    by_gain = pairs.agg(F.count_if(apart).alias("importances_unlike_the_models"))
    frames = (held, folds, known, by_table, by_gain)
    parts = [df.select(*[F.col(c).cast("long").alias(c) for c in df.columns]).unpivot([], df.columns, "measure", "value") for df in frames]
    return reduce(DataFrame.unionByName, parts)


def scores(model: RandomForestClassificationModel, encoded: DataFrame) -> DataFrame:
    """(user_id, label, score, prediction)."""
    return model.transform(encoded).select(
        "user_id",
        F.col(LABEL).alias("label"),
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def feature_importance(model: RandomForestClassificationModel, encoder: Encoder) -> DataFrame:
    """(Feature, Importance) as the model itself holds them on the driver, most important first; one row per vector slot.
    Reports take :func:`~tidemark.plans.forest.table_importances`, which this one is to check."""
    rows = [(slot, float(x)) for slot, x in enumerate(model.featureImportances.toArray())]
    spark = encoder.slots.sparkSession
    weighed = spark.createDataFrame(rows, "slot long, Importance double")
    named = weighed.join(encoder.names, "slot").select(F.col("feature").alias("Feature"), "Importance")
    return named.orderBy(F.desc("Importance"), "Feature")


def top_feature(importances: DataFrame) -> DataFrame:
    return importances.orderBy(F.desc("Importance"), "Feature").limit(1)


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """One row: exact area under the ROC curve, ties counted half.

    Rows are folded to one per distinct score, and the fold is accumulated range by
    range; give ``buckets=SMALL`` where there are few distinct scores.
    """
    positive = F.count_if(F.col(label) == 1)
    hist = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(
        positive.alias("pos"), (F.count(F.lit(1)) - positive).alias("neg")
    )
    ranked = running_total(hist, score, ["neg"], buckets=buckets)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("wins")
    ).select("n_pos", "n_neg", ratio(F.col("wins"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"))


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1_score, support) per class, plus accuracy and averages."""
    confusion = scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    # at most classes x classes rows from here on
    sides = F.array(
        F.struct(F.col(label).cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col(prediction).cast("string").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    per_class = confusion.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    precision = ratio_or_zero(F.col("hits"), F.col("predicted"))
    recall = ratio_or_zero(F.col("hits"), F.col("support"))
    rated = per_class.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio_or_zero(2.0 * precision * recall, precision + recall).alias("f1_score"),
        "support",
        "hits",
    )
    measures = ("precision", "recall", "f1_score")
    summary = rated.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )

    def line(name: str, columns: list) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[c.alias(m) for m, c in zip(measures, columns)],
            F.col("support").alias("support"),
        )

    totals = summary.select(
        F.inline(
            F.array(
                line("accuracy", [F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("accuracy")]),
                line("macro avg", [F.col(f"macro_{m}") for m in measures]),
                line("weighted avg", [F.col(f"weighted_{m}") for m in measures]),
            )
        )
    )
    return rated.drop("hits").unionByName(totals)


def model_metrics(scored: DataFrame, buckets: int | None = None) -> DataFrame:
    """(metric, value): the classification report in long form and the ROC-AUC."""
    report = classification_report(scored).withColumn("support", F.col("support").cast("double"))
    long = report.unpivot(["class"], ["precision", "recall", "f1_score", "support"], "measure", "value").filter(
        F.col("value").isNotNull()
    )
    auc = roc_auc(scored, buckets=buckets).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    return long.select(F.concat_ws(" ", "class", "measure").alias("metric"), "value").unionByName(auc)
