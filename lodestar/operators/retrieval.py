"""Vector retrieval: exact blocked top-k, inverted-file index, candidate generation, cold-start boost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.session import cut_lineage

ROWS_A_BLOCK = 4096
#: Recall for which the clusters to probe are chosen on a sample; above the 0.9 asked for, as other queries may do worse.
RECALL = 0.95


def top_k_single(items: DataFrame, vector: list[float], k: int) -> DataFrame:
    """(item, score, rank) of the ``k`` items nearest to one vector by inner product (ties: smaller item); planned as TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    best = items.select("item", C.dot(q, F.col("vec")).alias("score")).orderBy(F.col("score").desc(), "item").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "item")))


def _blocks(df: DataFrame, id_column: str, vec: str, name: str, rows: int) -> DataFrame:
    """Blocks of about ``rows`` rows each, the number taken from a count; block membership is a hash of the id."""
    n = max(1, -(-df.count() // rows))
    return df.select(F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int").alias(name), F.col(id_column).alias("id"), F.col(vec).cast("array<double>").alias("vec")), n


def _best_of_cell(k: int):
    """The up to ``k`` best items of a block of items for every query of a block of queries, by one matrix product."""

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.string()), "item": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        mat = lambda t: np.array(t.column("vec").combine_chunks().flatten()).reshape(t.num_rows, -1)
        order = np.argsort(np.array(b.column("id").to_pylist(), dtype=object))
        ids = np.array(b.column("id").to_pylist(), dtype=object)[order]
        scores = np.round(mat(a) @ mat(b)[order].T, 9)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        names = np.repeat(np.array(a.column("id").to_pylist(), dtype=object), top.shape[1])
        return pa.table({"query_id": pa.array(names, pa.string()), "item": pa.array(ids[top.reshape(-1)], pa.string()), "score": pa.array(np.take_along_axis(scores, top, 1).reshape(-1))})

    return cell


def exact_top_k(queries: DataFrame, items: DataFrame, k: int, rows: int = ROWS_A_BLOCK) -> DataFrame:
    """(query_id, item, score, rank) by inner product in double, exact, ties by smaller item.

    ``queries`` (query_id, vec) and ``items`` (item, vec) are cut into blocks; each pair of blocks is one matrix product that gives up to ``k`` rows per query, and a
    window merges them. Block size is bounded whatever the tables' sizes, and neither table is broadcast or collected. Scores are rounded to 9 decimals.
    """
    q, nq = _blocks(queries, "query_id", "vec", "qb", rows)
    x, nx = _blocks(items, "item", "vec", "xb", rows)
    left = q.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    right = x.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    found = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInArrow(_best_of_cell(k), "query_id string, item string, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ivf_centroids(items: DataFrame, nlist: int, sample_rows: int = 50_000, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """Spherical k-means centroids from the ``sample_rows`` items with the smallest hashes (a bounded sample; every item is assigned afterwards)."""
    t = items.orderBy(F.xxhash64("item"), "item").limit(sample_rows).select(F.col("vec").cast("array<double>").alias("vec")).toArrow()
    if not t.num_rows:
        return np.empty((0, 0))
    x = np.array(t.column(0).combine_chunks().flatten()).reshape(t.num_rows, -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    c = x[np.random.default_rng(seed).permutation(len(x))[: min(nlist, len(x))]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-9, sums / np.maximum(n, 1e-9), c)
    return c


def assign(df: DataFrame, id_column: str, centroids, nearest: int) -> DataFrame:
    """(id, vec, cluster): a row for each of the ``nearest`` clusters of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            k = min(nearest, len(c))
            top = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k].astype(np.int32)
            again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), k)))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(top.reshape(-1))], names=["id", "vec", "cluster"])

    return df.select(F.col(id_column).cast("string").alias("id"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "id string, vec array<double>, cluster int")


def build_ivf(items: DataFrame, path: str, nlist: int = 64) -> np.ndarray:
    """Write the inverted-file layout: items partitioned by cluster, centroids beside them; returns the centroids."""
    spark, c = items.sparkSession, ivf_centroids(items, nlist)
    assign(items, "item", spark.sparkContext.broadcast(c), 1).write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/lists")
    spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "cluster int, vec array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    return c


def load_ivf(spark, path: str) -> tuple[DataFrame, np.ndarray]:
    """(lists, centroids) of an index written by ``build_ivf``; a missing part raises before any work is done."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()
    return spark.read.parquet(f"{path}/lists"), np.array([r.vec for r in rows])


def probes_for_recall(queries: DataFrame, items: DataFrame, k: int, centroids: np.ndarray, recall: float = RECALL, sample_rows: int = 200) -> int:
    """Fewest clusters to probe with which the ``sample_rows`` queries with the smallest hashes (a bounded sample) find the share ``recall`` of their exact ``k`` nearest items."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample_rows).select(F.col("query_id").cast("string").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    vectors = {r["query_id"]: r["vec"] for r in some.collect()}
    if not vectors or not len(centroids):
        return 1
    home = assign(items, "item", items.sparkSession.sparkContext.broadcast(centroids), 1).select(F.col("id").alias("item"), "cluster")
    rows = exact_top_k(some, items, k).join(home, "item").select("query_id", "cluster").collect()  # at most k * sample_rows
    near = {q: np.argsort(np.argsort(-(centroids @ np.array(v)), kind="stable"), kind="stable") for q, v in vectors.items()}
    needed = np.sort([near[r["query_id"]][r["cluster"]] for r in rows])
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1 if len(needed) else 1


def list_count(n_items: int) -> int:
    """Clusters for a collection: the square root of its size, between 16 and 2048."""
    return min(2048, max(16, round(n_items**0.5)))


def ivf_top_k(queries: DataFrame, items: DataFrame, k: int, nlist: int | None = None, nprobe: int | None = None, centroids: np.ndarray | None = None, rows: int = ROWS_A_BLOCK) -> DataFrame:
    """(query_id, item, score, rank) over the ``nprobe`` nearest clusters of each query; None: as many as give a sample of the queries a recall of ``RECALL``.

    ``nlist`` None: ``list_count`` of the items. Queries meet the items of a cluster by matrix products of blocks of about ``rows`` rows, so a cluster of any size is spread.
    """
    sc = queries.sparkSession.sparkContext
    centroids = ivf_centroids(items, nlist or list_count(items.count())) if centroids is None else centroids
    nprobe = probes_for_recall(queries, items, k, centroids) if nprobe is None else nprobe
    c = sc.broadcast(centroids)
    x, q = cut_lineage(assign(items, "item", c, 1)), cut_lineage(assign(queries, "query_id", c, nprobe))
    # lists longer than a block are cut: at most one row per cluster says into how many
    blocks = lambda df, n: df.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(n))
    sizes = F.broadcast(blocks(x, "nx").join(blocks(q, "nq"), "cluster"))
    left = q.join(sizes, "cluster").select("cluster", F.pmod(F.xxhash64("id"), "nq").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("xb"), "id", "vec")
    right = x.join(sizes, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.pmod(F.xxhash64("id"), "nx").cast("int").alias("xb"), "id", "vec")
    cell = ["cluster", "qb", "xb"]
    scored = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_best_of_cell(k), "query_id string, item string, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fetch_vector(items: DataFrame, item: str) -> list[float] | None:
    """The vector of one item; None if it is not there. The condition reaches the scan of a stored index."""
    row = items.filter(F.col("item") == item).select("vec").first()
    return None if row is None else list(row["vec"])


def total(items: DataFrame) -> int:
    """Number of vectors of an index."""
    return items.count()


def latency_check(items: DataFrame, vectors: list[list[float]], k: int, limit_ms: float | None = None) -> dict:
    """Milliseconds of single-vector searches (the first warms up and is left out) and whether every one found ``k`` items; over ``limit_ms`` raises."""
    import time

    took, full = [], True
    for v in vectors:
        began = time.perf_counter()
        full &= len(top_k_single(items, v, k).collect()) == k
        took.append((time.perf_counter() - began) * 1000)
    took = took[1:] or took
    out = {"searches": len(took), "mean_ms": float(np.mean(took)) if took else 0.0, "max_ms": float(np.max(took)) if took else 0.0, "full": full}
    if limit_ms is not None and out["mean_ms"] > limit_ms:
        raise RuntimeError(f"a search takes {out['mean_ms']:.1f} ms, more than {limit_ms}")
    return out


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, recall): share of the rows of ``exact`` (query_id, item) that ``found`` has."""
    hit = exact.select("query_id", "item").join(found.select("query_id", "item", F.lit(1).alias("_hit")), ["query_id", "item"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"))


def self_recall(found: DataFrame) -> DataFrame:
    """Share of queries that find their own id."""
    one = found.groupBy("query_id").agg(F.max((F.col("item") == F.col("query_id")).cast("int")).alias("hit"))
    return one.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("hit"), 6).alias("self_recall"))


def norm_check(items: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Vectors, the largest distance of a norm from 1, and whether renormalising is due."""
    n = F.abs(C.norm(F.col("vec")) - 1)
    return items.agg(F.count(F.lit(1)).alias("n_vectors"), F.max(n).alias("max_deviation"), F.coalesce(F.max(n) > tolerance, F.lit(False)).alias("needs_renormalising"))


def candidates(retrieved: DataFrame, truth: DataFrame, top_k: int, inject: bool = True) -> DataFrame:
    """Retrieved rows (user_id, query_parent_asin, candidate_parent_asin, faiss_score, faiss_rank) with labels; with ``inject`` the missed positives too.

    ``truth`` (user_id, query_parent_asin, label): the query item is the relevant candidate. A missed positive gets score 0, rank ``top_k`` + 1 and ``is_forced_positive`` 1.
    """
    on = ["user_id", "query_parent_asin"]
    rows = retrieved.join(truth, on, "left").withColumn(
        "relevance_label", F.when(F.col("candidate_parent_asin") == F.col("query_parent_asin"), F.coalesce("label", F.lit(0))).otherwise(F.lit(0))
    )
    rows = rows.select(*on, "candidate_parent_asin", "faiss_score", "faiss_rank", "relevance_label", F.lit(0).alias("is_forced_positive"))
    if not inject:
        return rows
    have = rows.filter(F.col("candidate_parent_asin") == F.col("query_parent_asin")).select(*on)
    forced = truth.join(have, on, "left_anti").select(
        *on, F.col("query_parent_asin").alias("candidate_parent_asin"), F.lit(0.0).alias("faiss_score"), F.lit(top_k + 1).cast(rows.schema["faiss_rank"].dataType).alias("faiss_rank"), F.col("label").alias("relevance_label"), F.lit(1).alias("is_forced_positive")
    )
    return rows.unionByName(forced)


def cold_start_boost(retrieved: DataFrame, products: DataFrame, k: int, head: int = 10, least_categories: int = 3, legacy_scale: bool = False) -> DataFrame:
    """(query_id, item, boost_score, place): 0.2 similarity + 0.5 hidden gem (both min-max scaled within the query) + 0.3 category percentile, with a diverse head.

    ``retrieved`` (query_id, item, score). If the first ``head`` items span fewer than ``least_categories`` categories, the best items of unseen categories replace its tail. Missing percentiles count 0.5;
    ``legacy_scale`` leaves them in 0..100.
    """
    p = products.select(F.col("parent_asin").alias("item"), "leaf_category", F.col("hidden_gem_score").cast("double").alias("gem"), F.col("category_sentiment_percentile").cast("double").alias("pct"))
    r = retrieved.select("query_id", "item", "score").join(p, "item", "left")
    g = Window.partitionBy("query_id")
    scale = lambda c: (F.coalesce(c, F.lit(0.0)) - F.min(F.coalesce(c, F.lit(0.0))).over(g)) / (F.max(F.coalesce(c, F.lit(0.0))).over(g) - F.min(F.coalesce(c, F.lit(0.0))).over(g) + 1e-9)
    pct = F.coalesce(F.col("pct") if legacy_scale else F.col("pct") / 100, F.lit(0.5))
    r = r.withColumn("boost_score", F.round(0.2 * scale(F.col("score")) + 0.5 * scale(F.col("gem")) + 0.3 * pct, 9))
    order = [F.col("boost_score").desc(), F.col("item")]
    r = r.withColumn("place", F.row_number().over(g.orderBy(*order)))
    cat = F.coalesce("leaf_category", F.lit("unknown"))
    r = r.withColumn("_cat", cat).withColumn("_first", F.row_number().over(Window.partitionBy("query_id", "_cat").orderBy(*order)) == 1)
    in_head = F.col("place") <= head
    r = r.withColumn("_cats", F.sum((in_head & F.col("_first")).cast("int")).over(g))
    missing = F.greatest(F.lit(0), F.lit(least_categories) - F.col("_cats"))
    # first items of categories that the head lacks, best first; as many as the head needs move up to its end
    fresh = F.row_number().over(Window.partitionBy("query_id", F.col("_first") & ~in_head).orderBy(*order))
    r = r.withColumn("_moves", F.col("_first") & ~in_head & (fresh <= missing))
    r = r.withColumn("_moved", F.sum(F.col("_moves").cast("int")).over(g))
    key = F.when(F.col("_moves"), F.lit(1)).when(in_head & (F.col("place") <= head - F.col("_moved")), F.lit(0)).otherwise(F.lit(2))
    return r.withColumn("place", F.row_number().over(g.orderBy(key, *order))).filter(F.col("place") <= k).select("query_id", "item", "boost_score", "place")
