"""Product signals: one row per product from metadata and scored reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import ASPECTS, Settings
from lodestar.functions import columns as C
from lodestar.functions.ranking import exact_percentiles, join_percent_rank, with_positions
from lodestar.session import cut_lineage

DAY_MS = 86_400_000.0
_MEASURES = {"sentiment": "sentiment_score", **{f"aspect_{a}": f"aspect_{a}" for a in ASPECTS}}


def review_aggregates(scored: DataFrame) -> DataFrame:
    """Counts, means, ratios, coverage and spread of a product's reviews in one aggregation with map-side combine."""
    w = C.helpful_weight(F.col("helpful_vote"))
    n = F.count("sentiment_score")
    label = lambda x: F.count_if(F.col("sentiment_label") == x) / F.greatest(F.count(F.lit(1)), F.lit(1))
    aspects = []
    for a in ASPECTS:
        c = F.col(f"aspect_{a}")
        aspects += [F.avg(c).alias(f"mean_aspect_{a}"), F.avg(c.isNotNull().cast("double")).alias(f"coverage_{a}"), F.stddev_samp(c).alias(f"std_aspect_{a}")]
    return scored.groupBy("parent_asin").agg(
        n.cast("int").alias("review_count"),
        F.avg("sentiment_score").alias("mean_sentiment"),
        F.stddev_samp("sentiment_score").alias("std_sentiment"),
        F.avg(C.word_count(F.col("text"))).alias("avg_review_length"),
        (F.sum(w * F.col("sentiment_score")) / F.sum(w)).alias("helpfulness_weighted_sentiment"),
        (F.count_if(F.col("helpful_vote") > 0) / n).alias("helpful_ratio"),
        (F.count_if("verified_purchase") / n).alias("verified_ratio"),
        F.greatest((F.max("timestamp") - F.min("timestamp")) / DAY_MS, F.lit(0.0)).alias("days_on_market"),
        label("positive").alias("pos_ratio"),
        label("negative").alias("neg_ratio"),
        label("neutral").alias("neu_ratio"),
        *aspects,
    )


def temporal_windows(scored: DataFrame, s: Settings | None = None, tie: str = "review_id") -> DataFrame:
    """Means of the early, mid and recent slices of each product's reviews by time, and the months they start and end.

    Fewer than ``window_min_reviews`` reviews: every slice is all of them. Ranks come from ``with_positions``, so no product is too large for its task.
    """
    s = s or Settings()
    r = with_positions(scored, ["parent_asin"], "timestamp", [tie])
    n, rank = F.col("group_rows"), F.col("position")
    small = n < s.window_min_reviews
    k = F.greatest(F.lit(1), F.floor(n * F.lit(s.window_share)))
    low = F.floor(n * F.lit(s.mid_start))
    high = F.greatest(low + 1, F.floor(n * F.lit(s.mid_end)))
    slices = {"early": small | (rank < k), "mid": small | ((rank >= low) & (rank < high)), "recent": small | (rank >= n - k)}
    means = [F.avg(F.when(inside, F.col(c))).alias(f"{name}_{m}") for name, inside in slices.items() for m, c in _MEASURES.items()]
    agg = r.groupBy("parent_asin").agg(
        *means, F.min(F.when(slices["early"], F.col("timestamp"))).alias("_from"), F.max(F.when(slices["recent"], F.col("timestamp"))).alias("_to")
    )
    return agg.withColumn("early_period", C.period(F.col("_from"))).withColumn("recent_period", C.period(F.col("_to"))).drop("_from", "_to")


def listing_columns(meta: DataFrame) -> DataFrame:
    return (
        meta.withColumn("feature_count", F.size(C.parts(F.col("features"))).cast("short"))
        .withColumn("desc_richness_score", C.richness(F.col("description")))
        .withColumn("leaf_category", C.leaf_category(F.col("categories")))
        .withColumn("full_category_path", C.category_path(F.col("categories")))
    )


def with_scalars(df: DataFrame, **scalars: Column) -> DataFrame:
    """Cross join with one row of global aggregates (one row whatever the size of the table)."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in scalars.items()])))


def price_tiers(products: DataFrame) -> DataFrame:
    """budget / mid / premium / luxury at the exact 25th, 75th and 90th percentile of known prices; unknown without a price."""
    price = C.to_number(F.col("price"))
    p = products.crossJoin(F.broadcast(exact_percentiles(products, price, [0.25, 0.75, 0.9], "_p")))
    tier = F.when(price.isNull(), "unknown").when(price <= F.col("_p")[0], "budget").when(price <= F.col("_p")[1], "mid").when(price <= F.col("_p")[2], "premium").otherwise("luxury")
    return p.withColumn("price_tier", tier).drop("_p")


def _pick(candidates: list[tuple[str, Column, Column]], default: str, largest: bool = True) -> Column:
    """Name with the best score among eligible (name, score, eligible) entries; the first of equals; ``default`` if there is none."""
    rows = F.array(*[F.struct((score if largest else -score).alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name"), F.coalesce(ok & score.isNotNull(), F.lit(False)).alias("ok")) for i, (name, score, ok) in enumerate(candidates)])
    best = F.array_max(F.transform(F.filter(rows, lambda x: x["ok"]), lambda x: F.struct(x["s"], x["i"], x["name"])))
    return F.coalesce(best["name"], F.lit(default))


def _coverage_floor(products: DataFrame) -> DataFrame:
    """One row: the 5th percentile of non-zero coverages over all products and aspects, 0 without any."""
    values = products.select(F.explode(F.array(*[F.col(f"coverage_{a}").cast("double") for a in ASPECTS])).alias("c")).filter("c > 0")
    return exact_percentiles(values, F.col("c"), [0.05], "_q").select(F.coalesce(F.col("_q")[0], F.lit(0.0)).alias("_floor"))


def reality_gap(products: DataFrame, desc_sentiment: Column, keywords: dict[str, list[str]]) -> DataFrame:
    """Tone of the listing against the community's, over- and underrated aspects."""
    text = F.concat_ws(" ", F.coalesce("features", F.lit("")), F.coalesce("description", F.lit("")))
    p = products.withColumn("desc_sentiment", desc_sentiment)
    p = p.withColumn("hype_gap_score", F.col("desc_sentiment") - F.col("mean_sentiment")).withColumn("official_vs_community_gap", F.abs("hype_gap_score"))
    for a in ASPECTS:
        p = p.withColumn(f"_kw_{a}", C.keyword_frequency(text, keywords[a]))
    p = with_scalars(p, **{f"_med_{a}": F.median(f"_kw_{a}") for a in ASPECTS}).crossJoin(F.broadcast(_coverage_floor(products)))
    over, under = [], []
    for a in ASPECTS:
        ok = F.col(f"coverage_{a}") > F.col("_floor")
        mean, cov = F.col(f"mean_aspect_{a}").cast("double"), F.col(f"coverage_{a}").cast("double")
        med = F.when(F.col(f"_med_{a}") > 0, F.col(f"_med_{a}")).otherwise(F.lit(1.0))
        over.append((a, F.col(f"_kw_{a}") / med - mean, ok))
        under.append((a, mean - cov, ok))
    p = p.withColumn("overhyped_aspect", _pick(over, "insufficient data")).withColumn("underrated_aspect", _pick(under, "insufficient data"))
    return p.drop("_floor", *[f"_kw_{a}" for a in ASPECTS], *[f"_med_{a}" for a in ASPECTS])


def best_and_worst_aspects(products: DataFrame) -> DataFrame:
    p = products.crossJoin(F.broadcast(_coverage_floor(products)))
    entries = [(a, F.col(f"mean_aspect_{a}").cast("double"), F.col(f"coverage_{a}") > F.col("_floor")) for a in ASPECTS]
    return p.withColumn("top_aspect", _pick(entries, "insufficient data")).withColumn("worst_aspect", _pick(entries, "insufficient data", largest=False)).drop("_floor")


def _consensus(std: Column, most: Column) -> Column:
    """1 - std / max std in 0..1, 1 if nothing varies; null for a null spread."""
    return F.when(std.isNull() & (most > 0), F.lit(None)).when(F.coalesce(most, F.lit(0.0)) > 0, F.greatest(F.least(1 - std / most, F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(1.0))


def consensus_and_trends(products: DataFrame) -> DataFrame:
    """Consensus, controversy, velocity, trajectory, aspect trends and their summary; thresholds from one pass of global aggregates."""
    p = products.withColumn("sentiment_velocity", F.col("recent_sentiment") - F.col("early_sentiment"))
    deltas = {a: F.col(f"recent_aspect_{a}") - F.col(f"early_aspect_{a}") for a in ASPECTS}
    size = reduce(lambda x, y: x + y, [F.coalesce(F.sum(F.abs(d)), F.lit(0.0)) for d in deltas.values()])
    known = reduce(lambda x, y: x + y, [F.count(d) for d in deltas.values()])
    v, std = F.col("sentiment_velocity"), F.col("std_sentiment")
    has_std = {a: f"std_aspect_{a}" for a in ASPECTS if f"std_aspect_{a}" in products.columns}
    p = with_scalars(
        p, _max=F.max(std), _vm=F.avg(v), _vs=F.stddev_samp(v), _sm=F.avg(std), _ss=F.stddev_samp(std),
        _theta=F.when(known > 0, size / known).otherwise(F.lit(0.05)), **{f"_max_{a}": F.max(c) for a, c in has_std.items()},
    )
    p = p.withColumn("consensus_score", _consensus(std, F.col("_max"))).withColumn("controversy_index", std)
    for a in ASPECTS:
        p = p.withColumn(f"{a}_consensus", _consensus(F.col(has_std[a]), F.col(f"_max_{a}")) if a in has_std else F.lit(None).cast("double"))
    trajectory = (
        F.when(v.isNull() | std.isNull(), "stable").when(v > F.col("_vm") + F.col("_vs"), "rising").when(v < F.col("_vm") - F.col("_vs"), "declining")
        .when(std > F.col("_sm") + F.col("_ss"), "controversial").otherwise("stable")
    )
    p = p.withColumn("sentiment_trajectory", trajectory)
    notes = []
    for a, d in deltas.items():
        trend = F.when(d.isNull(), "N/A").when(d > F.col("_theta"), "improving").when(d < -F.col("_theta"), "declining").otherwise("stable")
        p = p.withColumn(f"{a}_trend", trend)
        notes.append(F.when(trend == "improving", F.format_string(f"{a.capitalize()} improved (+%.2f)", d)).when(trend == "declining", F.format_string(f"{a.capitalize()} declined (%.2f)", d)))
    joined = F.array_join(F.array_compact(F.array(*notes)), "; ")
    p = p.withColumn("aspect_trend_summary", F.when(joined == "", "stable").otherwise(joined))
    return p.drop("_max", "_vm", "_vs", "_sm", "_ss", "_theta", *[f"_max_{a}" for a in has_std])


def category_signals(products: DataFrame) -> DataFrame:
    """Category size, means, percentile ranks (average ties), distance to the category, out- and underperformed aspects, hidden gems.

    Category means are one aggregation joined back (a category that holds most products leaves each task as one row); ranks are hot-group safe.
    """
    stats = products.groupBy("leaf_category").agg(
        F.count("parent_asin").cast("int").alias("category_size"),
        F.avg("average_rating").alias("category_avg_rating"),
        F.avg("mean_sentiment").alias("category_avg_sentiment"),
        *[F.avg(f"mean_aspect_{a}").alias(f"category_avg_{a}") for a in ASPECTS],
        *[F.coalesce(F.stddev_samp(f"mean_aspect_{a}"), F.lit(0.0)).alias(f"_std_{a}") for a in ASPECTS],
    )
    p = products.join(stats, "leaf_category")
    for value, name in (("average_rating", "_rating"), ("mean_sentiment", "_sent"), ("rating_number", "_rn")):
        p = join_percent_rank(p, ["leaf_category"], value, name)
    p = p.withColumn("category_rating_percentile", F.col("_rating") * 100).withColumn("category_sentiment_percentile", F.col("_sent") * 100)
    p = p.withColumn("hidden_gem_score", (F.col("_sent") - F.col("_rn")) * 100)
    square = reduce(lambda x, y: x + y, [F.coalesce(F.pow(F.col(f"mean_aspect_{a}") - F.col(f"category_avg_{a}"), 2.0), F.lit(0.0)) for a in ASPECTS])
    p = p.withColumn("distinctive_score", F.sqrt(square))

    def names(sign: int) -> Column:
        hits = [F.when((F.col(f"mean_aspect_{a}") - F.col(f"category_avg_{a}")) * sign > 0.5 * F.col(f"_std_{a}"), F.lit(a)) for a in ASPECTS]
        joined = F.array_join(F.array_compact(F.array(*hits)), ", ")
        return F.when(joined == "", "none").otherwise(joined)

    p = p.withColumn("outperforms_aspects", names(1)).withColumn("underperforms_aspects", names(-1))
    return p.drop("_rating", "_sent", "_rn", *[f"_std_{a}" for a in ASPECTS])


def dominant_emotion(products: DataFrame) -> DataFrame:
    pos, neg = F.col("pos_ratio"), F.col("neg_ratio")
    p = with_scalars(products, _theta=F.coalesce(F.avg(F.abs(pos - neg)), F.lit(0.05)))
    label = F.when(pos > neg + F.col("_theta"), "positive").when(neg > pos + F.col("_theta"), "negative").otherwise("mixed")
    return p.withColumn("dominant_emotion", label).drop("_theta")


def product_table(meta: DataFrame, scored: DataFrame, settings: Settings | None = None, desc_sentiment: Column | None = None) -> DataFrame:
    """The 95-column signal table (order of ``PRODUCT_COLUMNS``). Products without reviews have null community signals."""
    from lodestar.operators import sentiment, tfidf

    s = settings or Settings()
    p = meta.join(review_aggregates(scored), "parent_asin", "left").join(temporal_windows(scored, s), "parent_asin", "left")
    p = p.join(sentiment.emotion_vocabulary(scored, s.lexicon), "parent_asin", "left")
    # every global threshold reads its table twice; the table is written once before, or plans would double at each step
    p = cut_lineage(price_tiers(cut_lineage(listing_columns(p))))
    listing = F.trim(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("features", F.lit(""))))
    tone = sentiment.bag_score(F.when(listing != "", listing), s.lexicon) if desc_sentiment is None else desc_sentiment
    p = cut_lineage(reality_gap(p, tone, s.aspects))
    p = cut_lineage(category_signals(cut_lineage(consensus_and_trends(p))))
    terms = tfidf.category_terms(p.select("parent_asin", "leaf_category"), scored, s.tfidf_max_features, s.tfidf_min_df)
    p = dominant_emotion(cut_lineage(best_and_worst_aspects(p.join(terms, "parent_asin", "left"))))
    doubles = {n for n, k in p.dtypes if k == "double"} - {"price", "average_rating"}
    out = [F.col(c).cast("float").alias(c) if c in doubles else F.coalesce(c, F.lit("")).alias(c) if c in ("top_tfidf_phrases", "distinctive_terms") else F.col(c) for c in PRODUCT_COLUMNS]
    return p.select(*out)


PRODUCT_COLUMNS: list[str] = (
    ["parent_asin", "title", "description", "features", "price", "store", "categories", "average_rating", "rating_number"]
    + ["review_count", "mean_sentiment", "std_sentiment", "avg_review_length", "helpfulness_weighted_sentiment", "helpful_ratio", "verified_ratio", "days_on_market"]
    + ["pos_ratio", "neg_ratio", "neu_ratio"]
    + [f"{m}_{a}" for a in ASPECTS for m in ("mean_aspect", "coverage")]
    + [f"{w}_{m}" for w in ("early", "mid", "recent") for m in _MEASURES]
    + ["early_period", "recent_period", "emotion_vocabulary", "feature_count", "desc_richness_score", "leaf_category", "full_category_path", "price_tier"]
    + ["desc_sentiment", "hype_gap_score", "official_vs_community_gap", "overhyped_aspect", "underrated_aspect", "consensus_score", "controversy_index"]
    + [f"{a}_consensus" for a in ASPECTS]
    + ["sentiment_velocity", "sentiment_trajectory"]
    + [f"{a}_trend" for a in ASPECTS]
    + ["aspect_trend_summary", "category_size", "category_avg_rating", "category_avg_sentiment", "category_rating_percentile", "category_sentiment_percentile"]
    + [f"category_avg_{a}" for a in ASPECTS]
    + ["distinctive_score", "outperforms_aspects", "underperforms_aspects", "hidden_gem_score", "top_tfidf_phrases", "distinctive_terms", "top_aspect", "worst_aspect", "dominant_emotion"]
)
