"""Boosted trees with early stopping on a validation table, their gains and what each feature adds to a row's score.

Spark fits the trees. Their nodes are then a small table of their own (at most ROUNDS times twice a tree's leaves), from which scores, gains and
contributions are plain expressions: rows are scored inside generated code, without vectors.
"""

from __future__ import annotations

import dataclasses

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.sources import files

#: Trees at most, their depth, rate, share of rows and rows of a leaf at least; rounds without a better loss after which fitting ends.
ROUNDS, DEPTH, RATE, SHARE, LEAF, PATIENCE, SEED = 20, 3, 0.1, 0.8, 20, 8, 7


@dataclasses.dataclass(frozen=True)
class Node:
    tree: int
    id: int
    value: float
    rows: int
    gain: float
    left: int
    right: int
    feature: str | None
    threshold: float | None


@dataclasses.dataclass(frozen=True)
class Ensemble:
    """The trees up to the round with the least validation loss. `losses` has that of every round."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    nodes: dict[tuple[int, int], Node]
    losses: tuple[float, ...]

    @property
    def rounds(self) -> int:
        return len(self.weights)

    def _value(self, tree: int, node: int) -> Column:
        n = self.nodes[tree, node]
        if n.feature is None:
            return F.lit(n.value)
        return F.when(F.col(n.feature) <= n.threshold, self._value(tree, n.left)).otherwise(self._value(tree, n.right))

    def margin(self) -> Column:
        """Half the log odds of the label."""
        return sum((w * self._value(k, 0) for k, w in enumerate(self.weights)), F.lit(0.0))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin()))

    def base(self) -> float:
        """The margin before any feature is looked at: the mean of the rows fitted on, tree by tree."""
        return sum(w * self.nodes[k, 0].value for k, w in enumerate(self.weights))

    def _steps(self, tree: int, node: int, feature: str) -> Column | None:
        """What the questions about `feature` below a node add on a row's way down: the value of the child it goes to less that of the node."""
        n = self.nodes[tree, node]
        if n.feature is None:
            return None
        sides = []
        for child in (n.left, n.right):
            below = self._steps(tree, child, feature)
            own = F.lit(self.nodes[tree, child].value - n.value) if n.feature == feature else None
            sides.append(own + below if own is not None and below is not None else own if own is not None else below)
        if all(s is None for s in sides):
            return None
        left, right = (s if s is not None else F.lit(0.0) for s in sides)
        return F.when(F.col(n.feature) <= n.threshold, left).otherwise(right)

    def contribution(self, feature: str) -> Column:
        """The feature's part of the margin. The parts of all features and the base add up to it."""
        parts = [w * s for k, w in enumerate(self.weights) if (s := self._steps(k, 0, feature)) is not None]
        return sum(parts, F.lit(0.0))

    def gains(self) -> dict[str, float]:
        """For each feature, how much its splits lower the squared error, summed over the rows of their nodes."""
        out = dict.fromkeys(self.features, 0.0)
        for n in self.nodes.values():
            if n.feature is not None:
                out[n.feature] += n.gain * n.rows
        return out


def best_round(losses: list[float], patience: int = PATIENCE) -> int:
    """How many trees to keep: up to the least loss before `patience` rounds have brought none that is less."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def in_order(x: DataFrame, keys: tuple[str, ...] = ("date", "code")) -> DataFrame:
    """Rows dealt by their keys and sorted, so that what is drawn at random in a fit depends on the rows alone and not on how their files lie."""
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(parts, *keys).sortWithinPartitions(*keys)


def boosted(train: DataFrame, check: DataFrame, features: list[str], label: str, rounds: int = ROUNDS) -> Ensemble:
    """Fitted on `train` (of date and code, the features and the label); the number of trees is chosen by the log loss on `check`. Missing features must be filled before."""
    vector = VectorAssembler(inputCols=features, outputCol="features_")
    kept = lambda x: vector.transform(x.select(*features, F.col(label).cast("double").alias("label_")))
    booster = GBTClassifier(featuresCol="features_", labelCol="label_", maxIter=rounds, maxDepth=DEPTH, stepSize=RATE, subsamplingRate=SHARE, minInstancesPerNode=LEAF, seed=SEED)
    model = booster.fit(kept(in_order(train)))
    losses = [float(x) for x in model.evaluateEachIteration(kept(check))]
    path = files.new_path(train.sparkSession, "trees")
    model.write().save(path)
    n = F.col("nodeData")
    table = train.sparkSession.read.parquet(f"{path}/data").where(F.col("treeID") < best_round(losses)).select("treeID", n["id"].alias("id"), n["prediction"].alias("value"), n["rawCount"].alias("rows"), n["gain"].alias("gain"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("f"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"))
    nodes = {(r.treeID, r.id): Node(r.treeID, r.id, r.value, r.rows, r.gain, r.left, r.right, features[r.f] if r.f >= 0 else None, r.threshold) for r in table.collect()}
    return Ensemble(tuple(features), tuple(model.treeWeights[: best_round(losses)]), nodes, tuple(losses))
