"""Learning to rank: LambdaMART on Spark ML regression trees.

Each round turns the current scores into per-row gradients (lambda) and weights from label pairs of a query with at least one side in the top ``truncation``, fits a
regression tree on the gradients, and sets its leaves by a Newton step from a groupBy on the leaf. Pairs are never materialised as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.evaluation import QUERY, macro_average, query_metrics
from lodestar.operators.features import FEATURES
from lodestar.session import cut_lineage

TRAINED = [f for f in FEATURES if not f.startswith("f27")]
GAIN = {0: 0.0, 1: 1.0, 2: 3.0, 3: 7.0, 4: 15.0, 5: 31.0}


def tree_rows(tree, number: int, leaves: dict[float, float]) -> list[tuple]:
    """(tree, node, feature, threshold, left, right, value) of every node of a fitted tree, in depth-first order; leaves have feature -1 and carry their Newton value."""
    rows: list[list] = []
    seen = 0

    def visit(node) -> int:
        nonlocal seen
        at = len(rows)
        if node.subtreeDepth() == 0:
            rows.append([number, at, -1, 0.0, -1, -1, float(leaves.get(float(seen), 0.0))])
            seen += 1
            return at
        split = node.split()
        rows.append([number, at, int(split.featureIndex()), float(split.threshold()), 0, 0, 0.0])
        rows[at][4], rows[at][5] = visit(node.leftChild()), visit(node.rightChild())
        return at

    visit(tree._java_obj.rootNode())
    return [tuple(r) for r in rows]


NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


@dataclass
class Ranker:
    """Trees as node tables with Newton leaf values; ``score`` adds them up, all trees in one pass over Arrow batches."""

    features: list[str]
    learning_rate: float
    nodes: list[list[tuple]] = field(default_factory=list)
    gains: list[np.ndarray] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """Adds the model's score; null and NaN features count 0."""
        trees = [tuple(np.array(c) for c in list(zip(*t))[2:]) for t in self.nodes]
        rate, width = self.learning_rate, len(self.features)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in batches:
                x = np.nan_to_num(np.stack(xs.to_numpy()).astype(np.float64)) if len(xs) else np.zeros((0, width))
                total, every = np.zeros(len(x)), np.arange(len(x))
                for feature, threshold, left, right, value in trees:
                    at = np.zeros(len(x), np.int64)
                    while (inner := feature[at] >= 0).any():
                        go = np.where(x[every, np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at])
                        at = np.where(inner, go, at)
                    total += rate * value[at]
                yield pd.Series(total)

        scored = F.pandas_udf(run, "double")
        return rows.withColumn(name, scored(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features])))

    def importance(self, spark) -> DataFrame:
        """(feature, importance) summed over trees, scaled to 1."""
        total = np.sum(self.gains, axis=0) if self.gains else np.zeros(len(self.features))
        total = total / total.sum() if total.sum() > 0 else total
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, total)], "feature string, importance double")

    def by_group(self, spark, groups: dict[str, list[str]]) -> DataFrame:
        """(group, importance): the importance of the features of each group added up."""
        pairs = spark.createDataFrame([(g, f) for g, fs in groups.items() for f in fs], "group string, feature string")
        return pairs.join(self.importance(spark), "feature", "left").groupBy("group").agg(F.coalesce(F.sum("importance"), F.lit(0.0)).alias("importance"))

    def save(self, spark, path: str) -> None:
        """Write the model as two small Parquet tables under ``path``: nodes, and features with their gains per tree."""
        spark.createDataFrame([r for t in self.nodes for r in t], NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [(i, f, self.learning_rate, [float(g[i]) for g in self.gains]) for i, f in enumerate(self.features)]
        spark.createDataFrame(rows, "place int, feature string, learning_rate double, gains array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark, path: str) -> Ranker:
        """A model written by ``save``; a missing part raises."""
        rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        trees: dict[int, list[tuple]] = {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            trees.setdefault(r.tree, []).append(tuple(r))
        gains = np.array([r.gains for r in rows]).T if rows and len(rows[0].gains) else []
        return cls([r.feature for r in rows], rows[0].learning_rate, [trees[i] for i in sorted(trees)], list(gains))


def _leaf_value(leaves: dict[float, float], leaf: str) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in leaves.items() for x in (float(k), float(v))]) if leaves else None
    return F.coalesce(F.try_element_at(table, F.col(leaf)), F.lit(0.0)) if leaves else F.lit(0.0)


def _lambdas(pdf: pd.DataFrame, truncation: int) -> pd.DataFrame:
    order = np.lexsort((pdf["candidate_parent_asin"].to_numpy().astype(str), -pdf["score"].to_numpy()))
    label = np.clip(pdf["relevance_label"].to_numpy()[order], 0, 5)
    score, gain = pdf["score"].to_numpy()[order], np.array([GAIN[int(x)] for x in label])
    n = len(order)
    discount = 1 / np.log2(np.arange(2, n + 2))
    ideal = (np.sort(gain)[::-1][:truncation] * discount[: min(n, truncation)]).sum()
    grad, weight = np.zeros(n), np.zeros(n)
    if ideal > 0:
        for i in np.flatnonzero(label > label.min()):  # few rows have a label above the rest
            lower = np.flatnonzero(label < label[i])
            if i >= truncation:
                lower = lower[lower < truncation]
            delta = np.abs((gain[i] - gain[lower]) * (discount[i] - discount[lower])) / ideal
            rho = 1 / (1 + np.exp(np.clip(score[i] - score[lower], -30, 30)))
            grad[i] += (delta * rho).sum()
            grad[lower] -= delta * rho
            w = delta * rho * (1 - rho)
            weight[i] += w.sum()
            weight[lower] += w
    out = pdf[["_row"]].iloc[order].copy()
    out["_lambda"], out["_weight"] = grad, weight
    return out


def train(rows: DataFrame, valid: DataFrame | None = None, features: list[str] | None = None, rounds: int = 10, depth: int = 4, learning_rate: float = 0.1, truncation: int = 20, patience: int = 3, seed: int = 42) -> Ranker:
    """Fit a ranker; ``valid`` drives early stopping on ndcg_10 (rounds without gain up to ``patience``), and the trees after the best round are dropped. Queries without differing labels add no gradient."""
    features = features or TRAINED
    model = Ranker(features, learning_rate)
    base = rows.fillna(0.0, features).withColumn("_row", F.xxhash64(*QUERY, "candidate_parent_asin")).withColumn("score", F.lit(0.0))
    state = cut_lineage(VectorAssembler(inputCols=features, outputCol="_x").transform(base).select(*QUERY, "candidate_parent_asin", "relevance_label", "_row", "_x", "score"))
    held = None if valid is None else cut_lineage(VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(valid.fillna(0.0, features)).select(*QUERY, "candidate_parent_asin", "relevance_label", "_x", F.lit(0.0).alias("score")))
    best, since = -1.0, 0
    for number in range(rounds):
        lam = state.select(*QUERY, "candidate_parent_asin", "relevance_label", "_row", "score").groupBy(*QUERY).applyInPandas(lambda pdf: _lambdas(pdf, truncation), "_row long, _lambda double, _weight double")
        fit = cut_lineage(state.join(lam, "_row"))
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_lambda", predictionCol="_p", leafCol="_leaf", maxDepth=depth, minInstancesPerNode=10, seed=seed + number).fit(fit)
        placed = tree.transform(fit)
        sums = placed.groupBy("_leaf").agg(F.sum("_lambda").alias("g"), F.sum("_weight").alias("w")).collect()  # at most 2 ** depth rows
        leaves = {float(r["_leaf"]): float(r["g"] / (r["w"] + 1e-9)) if r["w"] > 1e-12 else 0.0 for r in sums}
        model.nodes.append(tree_rows(tree, number, leaves))
        model.gains.append(tree.featureImportances.toArray())
        state = cut_lineage(placed.withColumn("score", F.col("score") + _leaf_value(leaves, "_leaf") * learning_rate).select(*state.columns))
        if valid is not None:
            held = cut_lineage(tree.transform(held).withColumn("score", F.col("score") + _leaf_value(leaves, "_leaf") * learning_rate).select(*held.columns))
            m = macro_average(query_metrics(held)).first()
            model.history.append({"round": number, **m.asDict()})
            best, since = (m["ndcg_10"], 0) if (m["ndcg_10"] or 0) > best else (best, since + 1)
            if since >= patience:
                break
    if since:
        model.nodes, model.gains = model.nodes[:-since], model.gains[:-since]
    return model


def sample_queries(rows: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Whole queries whose hash falls under ``share``; groups are never cut."""
    return rows.filter(F.pmod(F.xxhash64(*QUERY, F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def split_queries(rows: DataFrame, valid: float = 0.2, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, valid, test) by the hash of the query; groups are never cut, null ids form queries too."""
    place = F.pmod(F.xxhash64(*QUERY, F.lit(seed)), F.lit(1_000_000))
    first, second = int(test * 1_000_000), int((test + valid) * 1_000_000)
    return rows.filter(place >= second), rows.filter((place >= first) & (place < second)), rows.filter(place < first)
