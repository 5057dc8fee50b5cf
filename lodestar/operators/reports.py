"""Reports and interactive entry points: diverse users, per-user explanation, product comparison, search, home feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import documents, retrieval
from lodestar.operators.evaluation import METRICS
from lodestar.operators.users import blended_query


def diverse_users(profiles: DataFrame, valid_users: DataFrame | None = None, n: int = 5, seed: int = 42) -> DataFrame:
    """(label, user_id): the busiest user, the least busy with at least 5 interactions, a role-playing and a shooter fan, then hash-ordered fill up to ``n`` different users."""
    p = profiles.groupBy("user_id").agg(F.max("interaction_count").alias("interaction_count"), F.max(F.array_join("top_categories", ", ")).alias("cats"))
    if valid_users is not None:
        p = p.join(valid_users.select("user_id").distinct(), "user_id", "left_semi")
    first = lambda df, label, i, *order: df.orderBy(*order).limit(1).select(F.lit(i).alias("i"), F.lit(label).alias("label"), "user_id")
    picks = first(p, "power", 0, F.col("interaction_count").desc(), "user_id")
    picks = picks.unionByName(first(p.filter("interaction_count >= 5"), "light", 1, "interaction_count", "user_id"))
    picks = picks.unionByName(first(p.filter(F.col("cats").rlike("(?i)Role|RPG")), "role_playing", 2, "user_id"))
    picks = picks.unionByName(first(p.filter(F.col("cats").rlike("(?i)Shoot|Action|FPS")), "shooter", 3, "user_id"))
    h = F.md5(F.concat_ws("|", "user_id", F.lit(str(seed))))
    fill = p.join(picks.select("user_id"), "user_id", "left_anti").orderBy(h, "user_id").limit(n).select((F.lit(10) + F.row_number().over(Window.orderBy(h, "user_id"))).alias("i"), F.lit("other").alias("label"), "user_id")
    every = picks.unionByName(fill)  # 4 + n rows at most
    one = every.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("i"))).filter("r = 1")
    return one.withColumn("r", F.row_number().over(Window.orderBy("i"))).filter(F.col("r") <= n).select("label", "user_id")


def user_report(rows: DataFrame, features: list[str], score: str = "score", k: int = 5, titles: DataFrame | None = None) -> DataFrame:
    """One row per query: ``k`` best candidates by retrieval and by model, the true item's rank in either order, in-top-10 flags, largest features of the model's first."""
    g = Window.partitionBy("user_id", "query_parent_asin")
    r = rows.withColumn("ann_rank", F.row_number().over(g.orderBy(F.col("f01_faiss_score").desc_nulls_last(), "candidate_parent_asin"))).withColumn("model_rank", F.row_number().over(g.orderBy(F.col(score).desc_nulls_last(), "candidate_parent_asin")))
    if titles is not None:
        r = r.join(titles.select(F.col("parent_asin").alias("candidate_parent_asin"), "title"), "candidate_parent_asin", "left")
    name = F.coalesce("title", "candidate_parent_asin") if titles is not None else F.col("candidate_parent_asin")
    top = lambda rank: F.transform(F.array_sort(F.collect_list(F.when(F.col(rank) <= k, F.struct(F.col(rank).alias("r"), name.alias("n"))))), lambda x: x["n"])
    why = F.slice(F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias("v"), F.lit(f).alias("f")) for f in features])), 1, 5)
    out = r.groupBy("user_id", "query_parent_asin").agg(
        top("ann_rank").alias("top_by_retrieval"), top("model_rank").alias("top_by_model"), F.min(F.when(F.col("relevance_label") > 0, F.col("ann_rank"))).alias("truth_rank_retrieval"),
        F.min(F.when(F.col("relevance_label") > 0, F.col("model_rank"))).alias("truth_rank_model"), F.max(F.when(F.col("model_rank") == 1, F.transform(why, lambda x: x["f"]))).alias("reasons"),
    )
    return out.withColumn("in_top10_retrieval", F.coalesce(F.col("truth_rank_retrieval") <= 10, F.lit(False))).withColumn("in_top10_model", F.coalesce(F.col("truth_rank_model") <= 10, F.lit(False)))


# The signals a product comparison lists.
COMPARED = "price average_rating rating_number review_count mean_sentiment consensus_score hidden_gem_score desc_richness_score verified_ratio helpful_ratio category_rating_percentile distinctive_score mean_aspect_gameplay mean_aspect_graphics mean_aspect_story mean_aspect_controls mean_aspect_value".split()


def compare_products(products: DataFrame, ids: list[str]) -> DataFrame:
    """(signal, one column per product id): 17 signals side by side; unknown ids give null columns."""
    chosen = products.filter(F.col("parent_asin").isin(ids))
    long = chosen.select("parent_asin", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("signal"), F.col(c).cast("double").alias("value")) for i, c in enumerate(COMPARED)])).alias("e")).select("parent_asin", "e.*")
    return long.groupBy("i", "signal").pivot("parent_asin", ids).agg(F.max("value")).orderBy("i").drop("i")


def search(spark: SparkSession, text: str, items: DataFrame, user: DataFrame | None = None, k: int = 10, fetch: int = 100, dimension: int = 64, rerank=None) -> DataFrame:
    """(item, score, rank) for a free-text query: understanding, encoding, 0.7 / 0.3 blend with the user's combined vector, exact retrieval, optional reranking.

    ``rerank(candidates) -> (item, score)``; ``user`` is a profile row frame.
    """
    q = documents.understand_queries(spark.createDataFrame([(text,)], "raw_query string"))
    vec = documents.encode_texts(q.select(F.lit("q").alias("id"), "final_query"), "id", "final_query", dimension).first()["embedding"]
    if user is not None and (row := user.select("combined_embedding").first()) and row[0] and len(row[0]) == dimension:
        vec = [0.7 * a + 0.3 * b for a, b in zip(vec, row[0])]
    found = retrieval.top_k_single(items, list(vec), fetch)
    if rerank is not None:
        found = rerank(found).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "item")))
    return found.filter(F.col("rank") <= k)


def home_feed(profiles: DataFrame, items: DataFrame, voices: DataFrame | None = None, k: int = 100, dimension: int = 64) -> DataFrame:
    """(query_id, item, score, rank): nearest items of every user's combined vector, half mixed with the voice vector where there is one. Users without a usable vector get none."""
    p = profiles.select("user_id", C.usable_vector(F.col("combined_embedding"), dimension).alias("c")).dropna().groupBy("user_id").agg(F.max("c").alias("c"))
    if voices is not None:
        p = p.join(voices, "user_id", "left").withColumn("c", F.when(F.col("voice").isNotNull(), C.scaled_sum((F.lit(0.5), F.col("c")), (F.lit(0.5), F.col("voice")))).otherwise(F.col("c").cast("array<double>")))
    return retrieval.exact_top_k(p.select(F.col("user_id").alias("query_id"), C.normalised(F.col("c")).alias("vec")), items, k)


def blended_users(queries: DataFrame, profiles: DataFrame, dimension: int = 64) -> DataFrame:
    """(user_id, query_id, vec): tier-blended unit query vectors; unknown users are tier 0. ``queries`` (user_id, query_id, query_vec)."""
    v = lambda c: C.usable_vector(F.col(c), dimension).alias(c)
    p = profiles.groupBy("user_id").agg(F.max(F.struct("cold_start_tier", "query_weight", "user_weight", v("uniform_embedding"), v("recency_embedding"), v("combined_embedding"))).alias("p"))
    q = queries.join(p, "user_id", "left")
    voice: Column = F.col("voice") if "voice" in queries.columns else F.lit(None).cast("array<double>")
    get = lambda c: F.col(f"p.{c}").cast("double")
    vec = blended_query(F.col("query_vec"), F.coalesce(F.col("p.cold_start_tier"), F.lit(0)), F.col("p.uniform_embedding"), F.col("p.recency_embedding"), F.col("p.combined_embedding"), voice, F.coalesce(get("query_weight"), F.lit(0.7)), F.coalesce(get("user_weight"), F.lit(0.3)))
    return q.select("user_id", "query_id", vec.alias("vec"))


def metrics_text(metrics: DataFrame, title: str = "Evaluation") -> str:
    """Plain-text table of a metrics frame (one row per system)."""
    rows = metrics.collect()
    name = "system" if "system" in metrics.columns else metrics.columns[0]
    lines = [title, "=" * len(title), f"{name:<20}" + "".join(f"{m:>11}" for m in METRICS)]
    return "\n".join(lines + [f"{str(r[name]):<20}" + "".join(f"{(r[m] or 0.0):>11.4f}" for m in METRICS) for r in rows])
