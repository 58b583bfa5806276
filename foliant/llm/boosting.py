"""Gradient-boosted trees fitted by Spark ML, applied as plain SQL expressions.

The fitted trees become nested CASE expressions over the feature columns, so that scoring stays inside the
query: no UDF, no join, and usable inside transform() on an array of candidates.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stored

TREES = 15
DEPTH = 4


def fit(rows: DataFrame, features: list[str], label: str = "label", weight: str | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 5, parts: int = 2) -> list[tuple[float, tuple]]:
    """(weight, tree) pairs from a table of features, a 0/1 label and perhaps row weights; [] without both labels.

    A tree is a prediction, or (feature, threshold, left, right) with left taken where feature <= threshold.
    The rows are written once and read back in few partitions, as every level of every tree is a job over them:
    parts at most, which suits the default up to some ten thousand rows.
    """
    kept = stored(rows.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("weight")).coalesce(parts), "boosting")
    if kept.select("label").distinct().count() < 2:
        return []
    vectors = VectorAssembler(inputCols=features, outputCol="vector").transform(kept).select("vector", "label", "weight").coalesce(parts)
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3).fit(vectors)
    return [(float(w), _read(t._java_obj.rootNode(), features)) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def _read(node, features: list[str]):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return features[split.featureIndex()], float(split.threshold()), _read(node.leftChild(), features), _read(node.rightChild(), features)


def probability(model: list, values: Mapping[str, Column] | Column, prior: float = 0.5) -> Column:
    """The model's probability of label 1. values: a column, or a struct column's field, for each feature."""
    if not model:
        return F.lit(float(prior))

    def walk(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        name, threshold, left, right = tree
        return F.when(values[name] <= threshold, walk(left)).otherwise(walk(right))

    margin = sum((w * walk(tree) for w, tree in model[1:]), model[0][0] * walk(model[0][1]))
    return 1 / (1 + F.exp(-2 * margin))
