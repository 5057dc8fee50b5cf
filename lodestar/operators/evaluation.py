"""Ranking metrics: NDCG, hit rate, reciprocal rank, recall; system comparison, ablation, bootstrap, improvements."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.ranking import hot_groups, with_positions

QUERY = ["user_id", "query_parent_asin"]
CUTS = (1, 5, 10)

# The feature groups that ablation sets to zero.
ABLATIONS: dict[str, list[int]] = {
    "full": [], "no_retrieval": [1, 2, 3, 4], "no_product": [5, 6, 7, 8, 9, 10, 11, 12], "no_aspect": [13, 14, 15, 16, 17], "no_personalization": [18, 19, 20, 21, 22, 23], "no_temporal": [24, 25, 26],
    "no_nlp": [8, 10, 11, 12, 13, 14, 15, 16, 17, 24, 25, 26], "no_voice": [18], "no_bm25": [31], "no_user_embeddings": [4, 28, 29, 30],
}


def query_metrics(scored: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Metrics of every query with a positive label: ndcg@1/5/10, hr@1/5/10, mrr, recall@10.

    Order: score descending, null and NaN last, ties by smaller candidate; the ideal order is by label. Both orders share one exchange on the query; queries of any size (``with_positions``).
    """
    keys = [*(by or []), *QUERY]
    s = F.when(~F.isnan(F.col(score)), F.col(score))
    hot = hot_groups(scored, keys)
    r = scored.select(*keys, "candidate_parent_asin", "relevance_label", (-s).alias("_down"), (-F.col("relevance_label")).alias("_less"))
    r = with_positions(r, keys, "_down", ["candidate_parent_asin"], hot=hot).withColumn("_rank", F.col("position") + 1).drop("position", "group_rows")
    r = with_positions(r, keys, "_less", ["candidate_parent_asin"], hot=hot).withColumn("_ideal", F.col("position") + 1)
    gain = F.pow(F.lit(2.0), F.col("relevance_label")) - 1
    relevant = F.col("relevance_label") > 0

    def ndcg(k: int) -> Column:
        got = F.sum(F.when(F.col("_rank") <= k, gain / F.log2(F.col("_rank") + 1)).otherwise(0.0))
        best = F.sum(F.when(F.col("_ideal") <= k, gain / F.log2(F.col("_ideal") + 1)).otherwise(0.0))
        return F.when(best > 0, got / best).otherwise(0.0).alias(f"ndcg_{k}")

    out = r.groupBy(*keys).agg(
        *[ndcg(k) for k in CUTS],
        *[F.max(F.when((F.col("_rank") <= k) & relevant, 1.0).otherwise(0.0)).alias(f"hr_{k}") for k in CUTS],
        F.coalesce(1 / F.min(F.when(relevant, F.col("_rank"))), F.lit(0.0)).alias("mrr"),
        (F.sum(F.when(F.col("_rank") <= 10, F.col("relevance_label")).otherwise(0)) / F.sum("relevance_label")).alias("recall_10"),
        F.sum("relevance_label").alias("_mass"),
    )
    return out.filter("_mass > 0").drop("_mass")


METRICS = [*[f"ndcg_{k}" for k in CUTS], *[f"hr_{k}" for k in CUTS], "mrr", "recall_10"]


def macro_average(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    out = [*[F.avg(m).alias(m) for m in METRICS], F.stddev_pop("ndcg_10").alias("ndcg_10_std"), F.count(F.lit(1)).alias("evaluated_queries")]
    return per_query.groupBy(*by).agg(*out) if by else per_query.agg(*out)


def query_counts(rows: DataFrame) -> DataFrame:
    """Total, evaluated and skipped (no positive label) queries."""
    q = rows.groupBy(*QUERY).agg(F.max((F.col("relevance_label") > 0).cast("int")).alias("p"))
    return q.agg(F.count(F.lit(1)).alias("total_queries"), F.coalesce(F.sum("p"), F.lit(0)).alias("evaluated_queries"), F.count_if(F.col("p") == 0).alias("skipped_queries"))


def compare_systems(rows: DataFrame, systems: dict[str, Column]) -> DataFrame:
    """One row of macro metrics per system; scores are unpivoted once, so that all systems share one exchange on (system, query)."""
    long = rows.select(*QUERY, "candidate_parent_asin", "relevance_label", F.explode(F.array(*[F.struct(F.lit(n).alias("system"), c.cast("double").alias("score")) for n, c in systems.items()])).alias("e"))
    long = long.select(*QUERY, "candidate_parent_asin", "relevance_label", "e.system", "e.score")
    return macro_average(query_metrics(long, by=["system"]), ["system"])


def random_score(*ids: str) -> Column:
    """Seeded pseudo-random score of a row from its ids: independent of partitioning, the same in any engine with MD5."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *ids)), 1, 8), 16, 10).cast("long")
    return ((h * 1103515245 + 12345) % 2147483648) / F.lit(2147483648.0)


def improvement(metrics: DataFrame, base: str, system: str = "system") -> DataFrame:
    """Relative change of every metric against one system in percent; 0 where the base is 0."""
    b = metrics.filter(F.col(system) == base).select(*[F.col(m).alias(f"_{m}") for m in METRICS])
    return metrics.crossJoin(F.broadcast(b)).select(system, *[F.when(F.col(f"_{m}") > 0, (F.col(m) - F.col(f"_{m}")) / F.col(f"_{m}") * 100).otherwise(0.0).alias(f"{m}_change") for m in METRICS])


def ablation(rows: DataFrame, features: list[str], scorer, configs: dict[str, list[int]] | None = None) -> DataFrame:
    """Metrics per configuration with its features set to zero, and the drop of ndcg_10 against ``full`` in percent.

    ``scorer(columns) -> Column`` scores a row from (possibly zeroed) feature columns; rows are unpivoted over the configurations once.
    """
    systems = {}
    for name, zero in (configs or ABLATIONS).items():
        systems[name] = scorer({f: F.lit(0.0) if int(f[1:3]) in zero else F.col(f) for f in features})
    m = compare_systems(rows, systems).withColumnRenamed("system", "config")
    full = m.filter("config = 'full'").select(F.col("ndcg_10").alias("_full"))
    return m.crossJoin(F.broadcast(full)).withColumn("ndcg_10_change", F.when(F.col("_full") > 0, (F.col("ndcg_10") - F.col("_full")) / F.col("_full") * 100).otherwise(0.0)).drop("_full")


#: Distribution function of Poisson(1), as far as a double tells it from 1.
_POISSON = np.cumsum([np.exp(-1.0) / math.factorial(i) for i in range(19)])


def bootstrap_std(per_query: DataFrame, metric: str = "ndcg_10", rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Population standard deviation of the mean over Poisson(1) resamples of the queries.

    Weight and round of a query are a hash of its ids and the round, turned into a Poisson draw by inversion, whole batches at a time; a task gives ``rounds`` partial sums whatever its number of queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = np.zeros(rounds), np.zeros(rounds)
        number = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            h, v = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(h), 256):
                x = h[at : at + 256, None] + number
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")
                sums += v[at : at + 256] @ w
                weights += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(sums), pa.array(weights)], names=["round", "s", "w"])

    keyed = per_query.select(F.xxhash64(*QUERY, F.lit(seed)).alias("h"), F.col(metric).cast("double").alias("v")).dropna()
    means = keyed.mapInArrow(run, "round int, s double, w double").groupBy("round").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m")).dropna()  # a round that drew nothing has no mean
    return means.agg(F.lit(metric).alias("metric"), F.count(F.lit(1)).alias("rounds"), F.stddev_pop("m").alias("std"))


def compare_versions(first: DataFrame, second: DataFrame) -> DataFrame:
    """(system, metric, first, second, change): inner join of two metric frames on system and metric."""
    long = lambda m, n: m.select("system", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias(n)) for x in METRICS])).alias("e")).select("system", "e.*")
    both = long(first, "first").join(long(second, "second"), ["system", "metric"])
    return both.withColumn("change", F.when(F.col("first") > 0, (F.col("second") - F.col("first")) / F.col("first") * 100).otherwise(0.0))


def compare_query_versions(first: DataFrame, second: DataFrame, metric: str = "ndcg_10") -> DataFrame:
    """(user_id, query_parent_asin, first, second, change) of the queries that both per-query metric frames have."""
    both = first.select(*QUERY, F.col(metric).alias("first")).join(second.select(*QUERY, F.col(metric).alias("second")), QUERY)
    return both.withColumn("change", F.col("second") - F.col("first"))
