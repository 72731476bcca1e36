"""A fitted forest as a table of its nodes, scored and explained with built-in expressions.

The model's own storage format holds a row a node. Read back, it gives (tree, node, feature, threshold, left values,
children, gain, weight, positive share): a score is the walk from the root of each tree, an importance the gain of the
nodes that split on a feature. Nothing of the size of the feature vector goes through the driver.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import ratio
from tidemark.sources.staging import new_path

LEAF = -1


def forest_nodes(model: RandomForestClassificationModel, spark) -> DataFrame:
    """One row a node. ``left_values`` are those of a two-valued feature that go left; others go left up to ``threshold``."""
    path = new_path(spark, "forest")
    model.write().save(path)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    stats = node["impurityStats"]
    weight = F.aggregate(stats, F.lit(0.0), lambda total, x: total + x)
    inner = node["leftChild"] >= 0
    values = split["leftCategoriesOrThreshold"]
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner & (split["numCategories"] < 0), F.get(values, F.lit(0))).alias("threshold"),
        F.when(inner & (split["numCategories"] >= 0), values).alias("left_values"),
        F.when(inner, node["leftChild"]).otherwise(F.lit(LEAF)).alias("left_child"),
        F.when(inner, node["rightChild"]).otherwise(F.lit(LEAF)).alias("right_child"),
        F.when(inner, node["gain"]).alias("gain"),
        weight.alias("weight"),
        ratio(F.get(stats, F.lit(1)), weight).alias("positive_share"),
    )


def _walk(tree: Column, x: Column, depth: int) -> Column:
    """The leaf of a tree that a feature array ends in; nodes are numbered by their place in the tree."""

    def step(at: Column, _: Column) -> Column:
        node = F.get(tree, at)
        value = F.get(x, node["feature"])
        goes_left = F.when(node["left_values"].isNotNull(), F.array_contains(node["left_values"], value)).otherwise(value <= node["threshold"])
        return F.when(node["left_child"] == LEAF, at).when(goes_left, node["left_child"]).otherwise(node["right_child"])

    return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))


def table_scores(nodes: DataFrame, encoded: DataFrame, max_depth: int, features: str = "features") -> DataFrame:
    """``encoded`` with ``table_score``, the mean positive share of the leaves. The forest, of bounded size by its depth and
    number of trees, comes as a scalar subquery."""
    per_tree = nodes.groupBy("tree").agg(
        F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "left_values", "left_child", "right_child", "positive_share"))).alias("nodes")
    )
    given = encoded.withColumns({"_trees": per_tree.agg(F.collect_list("nodes").alias("trees")).scalar(), "_x": vector_to_array(features)})
    shares = F.transform("_trees", lambda tree: _walk(tree, F.col("_x"), max_depth)["positive_share"])
    total = F.aggregate(shares, F.lit(0.0), lambda so_far, share: so_far + share)
    return given.withColumn("table_score", total / F.size("_trees")).drop("_trees", "_x")


def table_importances(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(Feature, Importance), most important first: gains by weight, as shares of each tree and then of the forest;
    ``names`` is (slot, feature), and features without a split get 0."""
    gains = nodes.filter("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    trees = gains.groupBy(F.col("tree").alias("of_tree")).agg(F.sum("gain").alias("total")).filter("total > 0")
    shares = gains.join(F.broadcast(trees), F.col("tree") == F.col("of_tree"))  # a row a tree
    per_feature = shares.groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("share"))
    whole = per_feature.agg(F.sum("share")).scalar()
    known = names.join(per_feature.withColumnsRenamed({"feature": "_slot"}), F.col("slot") == F.col("_slot"), "left")
    importance = F.coalesce(ratio(F.col("share"), whole), F.lit(0.0)).alias("Importance")
    return known.select(F.col("feature").alias("Feature"), importance).orderBy(F.desc("Importance"), "Feature")
