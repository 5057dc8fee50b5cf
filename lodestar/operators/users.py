"""User profiles: interaction statistics, weighted mean vectors, preferences, review signals, cold-start tiers, query blending."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import ASPECTS, Settings
from lodestar.functions import columns as C
from lodestar.functions.ranking import exact_percentiles
from lodestar.operators.products import DAY_MS, with_scalars

EMBEDDINGS = ("uniform", "recency", "rating", "combined")


def usable_item_vectors(vectors: DataFrame, id_column: str = "parent_asin", column: str = "embedding", dimension: int = 64) -> DataFrame:
    """(item, vec): one vector of the right length per item (of differing ones the greatest); NaN, null and other lengths count as missing."""
    v = vectors.select(C.key(F.col(id_column)).alias("item"), C.usable_vector(F.col(column), dimension).alias("vec"))
    return v.dropna().groupBy("item").agg(F.max("vec").alias("vec"))


def interaction_stats(reviews: DataFrame) -> DataFrame:
    """Counts, rating mean and spread (0 for one row), first and last time, activity and recency per user."""
    base = reviews.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("interaction_count"),
        F.avg("rating").alias("avg_rating_given"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("rating_std"),
        F.min("timestamp").alias("first_interaction_ts"),
        F.max("timestamp").alias("last_interaction_ts"),
    )
    base = base.withColumn("active_days", (F.col("last_interaction_ts") - F.col("first_interaction_ts")) / DAY_MS)
    base = with_scalars(base, _last=F.max("last_interaction_ts"))
    return base.withColumn("interaction_velocity", F.col("interaction_count") / F.greatest("active_days", F.lit(1.0))).withColumn(
        "recency_score", (F.col("_last") - F.col("last_interaction_ts")) / DAY_MS
    ).drop("_last")


def weighted_mean_vectors(rows: DataFrame, key: str, vec: str, weights: dict[str, Column]) -> DataFrame:
    """(key, one unit vector per weight): weighted means of ``vec``, normalised; null or non-positive weights are skipped, null if none is left.

    One aggregation with dense partial sums per key (map-side combine); rows are not multiplied by the dimension, hot keys leave a task as one row.
    """
    w = rows.filter(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec)).alias("_v"), *[F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_w_{n}") for n, c in weights.items()])
    never = F.lit(1e-300)  # the summarizer refuses groups without any weight; such means are dropped below
    means = w.groupBy(key).agg(
        *[Summarizer.mean(F.col("_v"), F.greatest(F.col(f"_w_{n}"), never)).alias(n) for n in weights], *[F.max(f"_w_{n}").alias(f"_m_{n}") for n in weights]
    )
    return means.select(key, *[F.when(F.col(f"_m_{n}") > 0, C.normalised(vector_to_array(n))).alias(n) for n in weights])


def user_vectors(reviews: DataFrame, items: DataFrame, recency_lambda: float = 0.01) -> DataFrame:
    """(user_id, uniform/recency/rating/combined_embedding) over the items a user interacted with."""
    last = reviews.agg(F.max("timestamp").alias("_last"))
    rows = reviews.join(items, reviews["parent_asin"] == items["item"]).crossJoin(F.broadcast(last))
    recency = F.exp(-F.lit(recency_lambda) * (F.col("_last") - F.col("timestamp")) / DAY_MS)
    weights = {"uniform_embedding": F.lit(1.0), "recency_embedding": recency, "rating_embedding": F.col("rating"), "combined_embedding": F.col("rating") * recency}
    return weighted_mean_vectors(rows, "user_id", "vec", weights)


def _shares(rows: DataFrame, value: str) -> DataFrame:
    """(user_id, value, n, first): counts per user and value, two-level so that a hot user is one row per value."""
    return rows.filter(F.coalesce(F.col(value), F.lit("unknown")) != "unknown").filter(F.col(value) != "").groupBy("user_id", value).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.coalesce("timestamp", F.lit(9e18)).alias("t"), F.col("parent_asin").alias("a"))).alias("first")
    )


def preferences(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Top-3 categories (ties: seen first), diversity, dominant category, entropy in nats, preferred price tier and price diversity."""
    looked = products.groupBy("parent_asin").agg(F.max("leaf_category").alias("leaf_category"), F.max("price_tier").alias("price_tier"))
    rows = reviews.select("user_id", "parent_asin", "timestamp").join(looked, "parent_asin", "left")
    cats, tiers = _shares(rows, "leaf_category"), _shares(rows, "price_tier")
    ordered = lambda v: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", F.col(v).alias("v")))), lambda x: x["v"])
    # one row per category of the catalogue at most in a user's list
    c = cats.groupBy("user_id").agg(ordered("leaf_category").alias("_cats"), F.sum("n").alias("_total"), F.sum(F.col("n") * F.log("n")).alias("_nlogn"))
    p = tiers.groupBy("user_id").agg(ordered("price_tier").alias("_tiers"))
    out = reviews.select("user_id").distinct().join(c, "user_id", "left").join(p, "user_id", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "user_id",
        F.coalesce(F.slice("_cats", 1, 3), empty).alias("top_categories"),
        F.coalesce(F.size(F.col("_cats")) / F.col("_total"), F.lit(0.0)).alias("category_diversity"),
        F.coalesce(F.try_element_at("_cats", F.lit(1)), F.lit("unknown")).alias("dominant_category"),
        F.greatest(F.coalesce(F.log("_total") - F.col("_nlogn") / F.col("_total"), F.lit(0.0)), F.lit(0.0)).alias("category_entropy"),
        F.coalesce(F.try_element_at("_tiers", F.lit(1)), F.lit("unknown")).alias("preferred_price_tier"),
        F.when(F.col("_tiers").isNull(), 0.0).otherwise(F.least(F.size("_tiers") / 4.0, F.lit(1.0))).alias("price_diversity"),
    )


def review_signals(scored: DataFrame) -> DataFrame:
    """Sentiment, length, votes, label shares and aspect means of a user's reviews, with their best and worst aspect.

    Aspects count if the share of users who have them is at least the 5th percentile of the non-zero shares; if a user has none of those, all of theirs count.
    """
    share = lambda x: F.count_if(F.col("sentiment_label") == x) / F.greatest(F.count("sentiment_label"), F.lit(1))
    any_aspect = F.coalesce(*[F.col(f"aspect_{a}") for a in ASPECTS]).isNotNull().cast("double")
    g = scored.groupBy("user_id").agg(
        F.avg("sentiment_score").alias("user_avg_sentiment"),
        F.coalesce(F.stddev_samp("sentiment_score"), F.lit(0.0)).alias("user_sentiment_std"),
        F.count("sentiment_score").cast("double").alias("user_review_count"),
        F.avg(C.word_count(F.col("text"))).alias("user_avg_review_length"),
        F.coalesce(F.sum("helpful_vote"), F.lit(0.0)).alias("user_helpful_votes_received"),
        F.avg(any_aspect).alias("user_aspect_coverage"),
        share("positive").alias("user_pos_ratio"),
        share("negative").alias("user_neg_ratio"),
        F.avg(F.col("verified_purchase").cast("double")).alias("user_verified_ratio"),
        *[F.avg(f"aspect_{a}").alias(f"user_aspect_{a}") for a in ASPECTS],
    )
    g = with_scalars(g, **{f"_s_{a}": F.avg(F.col(f"user_aspect_{a}").isNotNull().cast("double")) for a in ASPECTS})
    shares = F.filter(F.array(*[F.col(f"_s_{a}") for a in ASPECTS]), lambda x: x > 0)
    ordered = F.array_sort(shares)
    place = F.lit(0.05) * (F.size(ordered) - 1)
    low = F.floor(place).cast("int")
    at = lambda i: F.try_element_at(ordered, F.least(i + 1, F.size(ordered)))
    g = g.withColumn("_floor", at(low) + (at(low + 1) - at(low)) * (place - low))

    def pick(sign: int) -> Column:
        rows = F.array(*[F.struct((F.col(f"user_aspect_{a}") * sign).alias("s"), F.lit(-i).alias("i"), F.lit(a).alias("a"), (F.col(f"_s_{a}") >= F.col("_floor")).alias("ok")) for i, a in enumerate(ASPECTS)])
        known = F.filter(rows, lambda x: x["s"].isNotNull())
        good = F.filter(known, lambda x: x["ok"])
        return F.array_max(F.transform(F.when(F.size(good) > 0, good).otherwise(known), lambda x: F.struct(x["s"], x["i"], x["a"])))["a"]

    g = g.withColumn("user_top_aspect", pick(1)).withColumn("user_worst_aspect", pick(-1))
    return g.drop("_floor", *[f"_s_{a}" for a in ASPECTS])


def tiers(profiles: DataFrame, query_weight: float = 0.7) -> DataFrame:
    """Cold-start tier from the 5th and 25th percentile of interaction counts, query and user weight, activity flag (75th percentile of recency)."""
    quartiles = exact_percentiles(profiles, F.col("interaction_count"), [0.05, 0.25], "_q").crossJoin(exact_percentiles(profiles, F.col("recency_score"), [0.75], "_r"))
    p = profiles.crossJoin(F.broadcast(quartiles))  # one row
    n = F.col("interaction_count")
    tier = F.when(n.isNull(), 0).when(n < F.col("_q")[0], 1).when(n < F.col("_q")[1], 2).otherwise(3)
    first = min(0.9, 1.0 - 0.1 * query_weight)
    p = p.withColumn("cold_start_tier", tier)
    weight = F.when(F.col("cold_start_tier") <= 1, first).when(F.col("cold_start_tier") == 2, (first + query_weight) / 2).otherwise(query_weight)
    return p.withColumn("query_weight", weight).withColumn("user_weight", 1 - weight).withColumn("is_active", F.coalesce(F.col("recency_score") <= F.col("_r")[0], F.lit(False))).drop("_q", "_r")


def tier_distribution(profiles: DataFrame) -> DataFrame:
    counts = profiles.groupBy("cold_start_tier").agg(F.count(F.lit(1)).alias("n_users"))
    return counts.crossJoin(F.broadcast(profiles.agg(F.count(F.lit(1)).alias("_all")))).select("cold_start_tier", "n_users", F.round(F.col("n_users") / F.col("_all") * 100, 4).alias("percent"))


PROFILE_COLUMNS = (
    ["user_id", "interaction_count", "avg_rating_given", "rating_std", "first_interaction_ts", "last_interaction_ts", "active_days"]
    + [f"{e}_embedding" for e in EMBEDDINGS]
    + ["top_categories", "category_diversity", "dominant_category", "category_entropy", "preferred_price_tier", "price_diversity", "interaction_velocity", "recency_score"]
    + ["user_avg_sentiment", "user_sentiment_std", "user_review_count", "user_avg_review_length", "user_helpful_votes_received", "user_aspect_coverage", "user_pos_ratio", "user_neg_ratio", "user_verified_ratio"]
    + [f"user_aspect_{a}" for a in ASPECTS]
    + ["user_top_aspect", "user_worst_aspect", "cold_start_tier", "query_weight", "user_weight", "is_active"]
)


def profile_table(train: DataFrame, scored: DataFrame, products: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The 39-column user profile table: interactions from ``train``, review signals from ``scored`` (users without reviews have null ones)."""
    s = settings or Settings()
    p = interaction_stats(train).join(user_vectors(train, items, s.recency_lambda), "user_id", "left").join(preferences(train, products), "user_id", "left")
    p = tiers(p.join(review_signals(scored), "user_id", "left"), s.tier3_query_weight)
    keep = {"first_interaction_ts", "last_interaction_ts", "user_review_count"}
    out = []
    for c in PROFILE_COLUMNS:
        kind = dict(p.dtypes)[c]
        out.append(F.col(c).cast("float").alias(c) if kind == "double" and c not in keep else F.col(c).cast("array<float>").alias(c) if kind == "array<double>" else F.col(c))
    return p.select(*out)


def blended_query(query: Column, tier: Column, uniform: Column, recency: Column, combined: Column, voice: Column, query_weight: Column, user_weight: Column) -> Column:
    """Unit query vector of a user by cold-start tier; missing user vectors fall back along the published order."""
    s = C.scaled_sum
    with_weights = lambda v: s((query_weight, query), (user_weight, v))
    tier2 = F.when(recency.isNotNull(), with_weights(recency)).when(uniform.isNotNull(), with_weights(uniform)).otherwise(s((F.lit(1.0), query)))
    tier3 = (
        F.when(combined.isNotNull() & voice.isNotNull(), s((F.lit(0.5), query), (F.lit(0.3), combined), (F.lit(0.2), voice)))
        .when(voice.isNotNull(), s((F.lit(0.65), query), (F.lit(0.35), voice)))
        .when(combined.isNotNull(), s((F.lit(0.6), query), (F.lit(0.4), combined)))
        .when(recency.isNotNull(), with_weights(recency))
        .otherwise(s((F.lit(1.0), query)))
    )
    plain = s((F.lit(1.0), query))
    mixed = F.when(tier == 1, F.when(uniform.isNotNull(), with_weights(uniform)).otherwise(plain)).when(tier == 2, tier2).when(tier == 3, tier3).otherwise(plain)
    return C.normalised(mixed)


def history_vectors(histories: DataFrame, items: DataFrame, keys: list[str], dimension: int = 64) -> DataFrame:
    """Adds ``query_vec``: the unit mean of the vectors of the blank-separated ``history`` items; the zero vector if none is known."""
    keyed = histories.withColumn("_k", F.xxhash64(*keys))
    rows = keyed.select("_k", F.explode(C.tokens(F.col("history"))).alias("item")).join(items, "item")
    means = weighted_mean_vectors(rows, "_k", "vec", {"query_vec": F.lit(1.0)})
    zero = F.array_repeat(F.lit(0.0), dimension)
    return keyed.join(means, "_k", "left").withColumn("query_vec", F.coalesce("query_vec", zero)).drop("_k")


def lambda_diagnostic(reviews: DataFrame, items: DataFrame, lambdas: list[float]) -> DataFrame:
    """(recency_lambda, mean_difference): mean of 1 - cosine between uniform and recency vectors over all users, for each lambda."""
    last = reviews.agg(F.max("timestamp").alias("_last"))
    rows = reviews.join(items, reviews["parent_asin"] == items["item"]).crossJoin(F.broadcast(last))
    weights = {"u": F.lit(1.0)} | {f"r{i}": F.exp(-F.lit(x) * (F.col("_last") - F.col("timestamp")) / DAY_MS) for i, x in enumerate(lambdas)}
    v = weighted_mean_vectors(rows, "user_id", "vec", weights)
    one = v.agg(*[F.avg(1 - C.dot(F.col("u"), F.col(f"r{i}"))).alias(f"d{i}") for i in range(len(lambdas))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("recency_lambda"), F.col(f"d{i}").alias("mean_difference")) for i, x in enumerate(lambdas)])).alias("r")).select("r.*")


def voice_order(reviews: DataFrame) -> Column:
    """Position of a user's text: newest, then highest rated first."""
    w = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc_nulls_last(), F.col("rating").desc_nulls_last(), F.col("review_id"))
    return F.row_number().over(w)
