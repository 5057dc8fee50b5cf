"""The 31 ranking features of (user, query item, candidate) rows: raw values, statistics, scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import ASPECTS
from lodestar.functions import columns as C
from lodestar.functions.ranking import column_percentiles

KEYS = ["user_id", "query_parent_asin", "candidate_parent_asin", "relevance_label", "is_forced_positive"]

# The names of the features, in order.
FEATURES: list[str] = (
    "f01_faiss_score f02_faiss_rank f03_query_item_cosine f04_user_uniform_cosine f05_avg_rating f06_rating_count_log f07_review_count_log f08_mean_sentiment f09_price_normalized "
    "f10_hidden_gem_score f11_controversy_index f12_desc_richness f13_aspect_gameplay f14_aspect_graphics f15_aspect_story f16_aspect_controls f17_aspect_value f18_user_item_voice_cosine "
    "f19_category_match f20_price_tier_match f21_user_avg_sentiment_gap f22_top_aspect_match f23_interaction_count_log f24_sentiment_trajectory f25_verified_ratio f26_helpfulness_weighted_sentiment "
    "f27_is_forced_positive f28_user_recency_cosine f29_user_rating_cosine f30_user_combined_cosine f31_bm25_score"
).split()


@dataclass
class Range:
    low: Column
    high: Column
    fill: Column


def _finite(df: DataFrame, column: str) -> Column:
    """Column as double with NaN as null; null if the table lacks it."""
    if column not in df.columns:
        return F.lit(None).cast("double")
    return C.to_number(F.col(column).cast("double"))


def product_side(products: DataFrame) -> DataFrame:
    """What the features need of products, one row per candidate key (repeated keys: the greatest row)."""
    controversy = F.coalesce(_finite(products, "controversy_index"), _finite(products, "std_sentiment"))
    row = F.struct(
        _finite(products, "average_rating").alias("rating"), C.to_number(F.col("rating_number")).alias("n_ratings"), C.to_number(F.col("review_count")).alias("n_reviews"),
        _finite(products, "mean_sentiment").alias("sentiment"), C.feature_price(F.col("price")).alias("price"), _finite(products, "hidden_gem_score").alias("gem"), controversy.alias("controversy"),
        _finite(products, "desc_richness_score").alias("richness"), *[_finite(products, f"mean_aspect_{a}").alias(f"p_{a}") for a in ASPECTS], F.col("leaf_category").alias("category"), F.col("price_tier").alias("tier"),
        F.col("top_aspect").alias("best_aspect"), C.trajectory_code(F.col("sentiment_trajectory")).alias("trajectory"), _finite(products, "verified_ratio").alias("verified"), _finite(products, "helpfulness_weighted_sentiment").alias("weighted"),
    )
    return products.select(F.trim("parent_asin").alias("candidate_parent_asin"), row.alias("r")).groupBy("candidate_parent_asin").agg(F.max("r").alias("r")).select("candidate_parent_asin", "r.*")


def user_side(profiles: DataFrame, dimension: int = 64) -> DataFrame:
    vec = lambda c: C.usable_vector(F.col(c), dimension)
    row = F.struct(
        F.col("interaction_count").cast("double").alias("n_interactions"), _finite(profiles, "user_avg_sentiment").alias("u_sentiment"), *[_finite(profiles, f"user_aspect_{a}").alias(f"u_{a}") for a in ASPECTS],
        F.col("top_categories").alias("u_categories"), F.col("preferred_price_tier").alias("u_tier"), F.col("user_top_aspect").alias("u_aspect"),
        *[vec(f"{e}_embedding").alias(f"u_{e}") for e in ("uniform", "recency", "rating", "combined")],
    )
    return profiles.select(F.trim("user_id").alias("user_id"), row.alias("r")).groupBy("user_id").agg(F.max("r").alias("r")).select("user_id", "r.*")


def raw_features(candidates: DataFrame, products: DataFrame, profiles: DataFrame, items: DataFrame, top_k: int, query_vectors: DataFrame | None = None, voices: DataFrame | None = None, bm25: DataFrame | None = None, dimension: int = 64) -> DataFrame:
    """KEYS and f01..f31 of every candidate row; unknown values are null (they are filled when scaled).

    All joins are equi-joins on the user, the candidate or the query; Spark picks broadcast or shuffle by measured size. Cosines with a missing vector are 0, matches with a missing side 0.
    ``query_vectors`` (user_id, query_parent_asin, query_vec); ``voices`` (user_id, voice); ``bm25`` (user_id, query_parent_asin, candidate_parent_asin, bm25_scaled).
    Without ``query_vectors`` the query item's own vector is taken; without ``voices`` f18 is 0, without ``bm25`` f31 is 0.
    """
    cosine = lambda v: F.coalesce(C.dot(F.col(v), F.col("i_vec")), F.lit(0.0)).alias(f"cos_{v}")

    def with_cosines(c: DataFrame, *vectors: str) -> DataFrame:
        """Cosines right after the join, so that no later exchange carries the vectors."""
        return c.select(*[x for x in c.columns if x not in vectors], *[cosine(v) for v in vectors])

    c = candidates.join(product_side(products), "candidate_parent_asin", "left")
    c = c.join(items.select(F.col("item").alias("candidate_parent_asin"), F.col("vec").alias("i_vec")), "candidate_parent_asin", "left")
    c = with_cosines(c.join(user_side(profiles, dimension), "user_id", "left"), "u_uniform", "u_recency", "u_rating", "u_combined")
    if voices is not None:
        c = with_cosines(c.join(voices, "user_id", "left"), "voice")
    else:
        c = c.withColumn("cos_voice", F.lit(0.0))
    if query_vectors is not None:
        c = c.join(query_vectors, ["user_id", "query_parent_asin"], "left")
    else:
        c = c.join(items.select(F.col("item").alias("query_parent_asin"), F.col("vec").alias("query_vec")), "query_parent_asin", "left")
    c = with_cosines(c, "query_vec").drop("i_vec")
    if bm25 is not None:
        c = c.join(bm25, KEYS[:3], "left")
    flag = lambda b: F.coalesce(b, F.lit(False)).cast("double")
    log = lambda v: F.when(F.col(v).isNotNull(), F.log1p(F.greatest(F.col(v), F.lit(0.0))))
    values = [
        F.col("faiss_score"), F.col("faiss_rank") / F.lit(float(top_k)), F.col("cos_query_vec"), F.col("cos_u_uniform"), F.col("rating"), log("n_ratings"), log("n_reviews"), F.col("sentiment"), F.col("price"), F.col("gem"), F.col("controversy"),
        F.col("richness"), *[F.coalesce(F.col(f"p_{a}"), F.col(f"u_{a}"), F.lit(0.0)) for a in ASPECTS], F.col("cos_voice"), flag(F.array_contains("u_categories", F.col("category"))), flag((F.col("u_tier") == F.col("tier")) & (F.col("tier") != "")),
        F.abs(F.col("u_sentiment") - F.col("sentiment")), flag((F.col("u_aspect") == F.col("best_aspect")) & (F.col("u_aspect") != "")), F.log1p(F.greatest(F.coalesce("n_interactions", F.lit(0.0)), F.lit(0.0))), F.coalesce("trajectory", F.lit(0.5)),
        F.col("verified"), F.col("weighted"), F.col("is_forced_positive").cast("double"), F.col("cos_u_recency"), F.col("cos_u_rating"), F.col("cos_u_combined"), F.coalesce("bm25_scaled", F.lit(0.0)) if bm25 is not None else F.lit(0.0),
    ]
    return c.select(*KEYS, *[v.cast("double").alias(n) for v, n in zip(values, FEATURES)])


def feature_stats(products: DataFrame, profiles: DataFrame, top_k: int) -> DataFrame:
    """(feature, min, max, fill): published bounds where a feature has them, data bounds and exact medians elsewhere; no column is gathered in one task."""
    p, u = product_side(products), profiles.select(_finite(profiles, "user_avg_sentiment").alias("s"), F.col("interaction_count").cast("double").alias("n"))
    log = lambda c: F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))
    c, half = F.col, 0.5
    medians = {
        "m5": (c("rating"), half), "m6": (log(c("n_ratings")), half), "m7": (log(c("n_reviews")), half), "m8": (c("sentiment"), half), "x9": (c("price"), 0.99), "m9": (c("price"), half), "m10": (c("gem"), half),
        "m11": (c("controversy"), half), "m12": (c("richness"), half), "m25": (c("verified"), half), "m26": (c("weighted"), half), **{f"m_{x}": (c(f"p_{x}"), half) for x in ASPECTS},
    }
    bounds = p.agg(
        F.max(log(c("n_ratings"))).alias("x6"), F.max(log(c("n_reviews"))).alias("x7"), F.min("gem").alias("n10"), F.max("gem").alias("x10"), F.max("controversy").alias("x11"), F.min("sentiment").alias("pn"), F.max("sentiment").alias("px"),
    )
    a = bounds.crossJoin(F.broadcast(column_percentiles(p, medians)))
    b = u.agg(F.min("s").alias("un"), F.max("s").alias("ux"), F.stddev_samp("s").alias("us"), F.max(F.log1p(F.greatest("n", F.lit(0.0)))).alias("x23"))
    row = a.crossJoin(b)
    z, one = F.lit(0.0), F.lit(1.0)
    gap = F.greatest(F.abs(F.col("ux") - F.col("pn")), F.abs(F.col("un") - F.col("px")))
    col = F.col
    ranges = {1: (-one, one, F.lit(0.3)), 2: (F.lit(1.0 / top_k), one, F.lit(0.5)), 3: (-one, one, z), 4: (-one, one, z), 5: (one, F.lit(5.0), col("m5")), 6: (z, col("x6"), col("m6")), 7: (z, col("x7"), col("m7")), 8: (-one, one, col("m8")),
              9: (z, col("x9"), col("m9")), 10: (col("n10"), col("x10"), col("m10")), 11: (z, col("x11"), col("m11")), 12: (z, one, col("m12")), 18: (-one, one, z), 19: (z, one, z), 20: (z, one, z), 21: (z, gap, col("us")), 22: (z, one, z), 23: (z, col("x23"), z),
              24: (z, one, F.lit(0.5)), 25: (z, one, col("m25")), 26: (-one, one, col("m26")), 27: (z, one, z), 28: (-one, one, z), 29: (-one, one, z), 30: (-one, one, z), 31: (z, one, z)}
    ranges |= {13 + i: (-one, one, F.coalesce(col(f"m_{x}"), z)) for i, x in enumerate(ASPECTS)}
    rows = [F.struct(F.lit(n).alias("feature"), lo.cast("double").alias("min"), hi.cast("double").alias("max"), F.coalesce(fill.cast("double"), z).alias("fill")) for n, (lo, hi, fill) in ((FEATURES[i - 1], ranges[i]) for i in range(1, 32))]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scale_features(raw: DataFrame, stats: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Filled, min-max scaled and clipped to 0..1; a range under 1e-9 (or unknown) gives 0. ``stats``: feature -> (min, max, fill), 31 entries."""
    out = []
    for n in FEATURES:
        low, high, fill = stats[n]
        if low is None or high is None or high - low < 1e-9:
            out.append(F.lit(0.0).alias(n))
            continue
        v = F.coalesce(C.to_number(F.col(n)), F.lit(float(fill)))
        out.append(F.greatest(F.least((v - F.lit(float(low))) / F.lit(float(high - low)), F.lit(1.0)), F.lit(0.0)).alias(n))
    return raw.select(*KEYS, *out)


def stats_dict(stats: DataFrame) -> dict[str, tuple[float, float, float]]:
    """The 31 statistics rows on the driver."""
    return {r["feature"]: (r["min"], r["max"], r["fill"]) for r in stats.collect()}


def null_counts(raw: DataFrame) -> DataFrame:
    """(feature, n_null) and, for labels, counts of positives and forced rows in one pass."""
    one = raw.agg(*[F.count_if(C.to_number(F.col(n)).isNull()).alias(n) for n in FEATURES], F.count_if(F.col("relevance_label") > 0).alias("positives"), F.sum("is_forced_positive").cast("long").alias("forced"))
    names = [*FEATURES, "positives", "forced"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n_rows")) for n in names])).alias("r")).select("r.*")
