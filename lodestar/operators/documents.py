"""Text documents of products and users, greedy token budgets, rule-based query understanding, offline encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import ASPECTS
from lodestar.functions import columns as C
from lodestar.operators.users import voice_order
from lodestar.sources.readers import exists

BUDGET = 512
NONE = "N/A"


def _n(c: str, fmt: str = "%.3f", scale: float = 1.0) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string(fmt, F.col(c).cast("double") * scale)).otherwise(F.lit(NONE))


def _t(c: str) -> Column:
    return F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(NONE))


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _any(*columns: str) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def product_sections(p: DataFrame) -> list[Column]:
    """The eight sections of a product document; null where a section has no inputs."""
    perc = "%.1f%%"
    aspects = F.concat_ws("\n", *[F.when(F.col(f"mean_aspect_{a}").isNotNull(), _line(f"{a}: ", _n(f"mean_aspect_{a}"), ", coverage ", _n(f"coverage_{a}", perc, 100), ", consensus ", _n(f"{a}_consensus"), ", trend ", _t(f"{a}_trend"))) for a in ASPECTS])
    return [
        F.concat_ws("\n", _line("Title: ", _t("title")), _line("Store: ", _t("store"), " | Price: ", _n("price", "$%.2f"), " (", _t("price_tier"), ")"), _line("Category: ", _t("full_category_path"), " / ", _t("leaf_category")), _line("Days on market: ", _n("days_on_market", "%.0f"), " | Ratings: ", _n("rating_number", "%.0f"))),
        F.when(_any("description", "features", "desc_richness_score", "desc_sentiment"), F.concat_ws("\n", "description", _line("Features (", _n("feature_count", "%.0f"), "): ", _t("features")), _line("Richness: ", _n("desc_richness_score"), " | Tone: ", _n("desc_sentiment")))),
        F.when(_any("average_rating", "pos_ratio", "consensus_score"), F.concat_ws("\n", _line("Rating: ", _n("average_rating", "%.2f/5")), _line("Positive ", _n("pos_ratio", perc, 100), ", negative ", _n("neg_ratio", perc, 100), ", neutral ", _n("neu_ratio", perc, 100)), _line("Consensus: ", _n("consensus_score"), " | Controversy: ", _n("controversy_index")), _line("Verified ", _n("verified_ratio", perc, 100), " | Words per review ", _n("avg_review_length", "%.0f"), " | Helpful ", _n("helpful_ratio", perc, 100), " | Weighted sentiment ", _n("helpfulness_weighted_sentiment")))),
        F.when(_any(*[f"mean_aspect_{a}" for a in ASPECTS]), F.concat_ws("\n", aspects, _line("Praised: ", _t("top_aspect"), " | Criticised: ", _t("worst_aspect")))),
        F.when(_any("early_sentiment", "mid_sentiment", "recent_sentiment"), F.concat_ws("\n", _line("Early (", _t("early_period"), "): ", _n("early_sentiment"), " | Mid: ", _n("mid_sentiment"), " | Recent (", _t("recent_period"), "): ", _n("recent_sentiment")), _line("Trajectory: ", _t("sentiment_trajectory"), " | Velocity: ", _n("sentiment_velocity", "%+.3f")), _line("Trends: ", _t("aspect_trend_summary")))),
        F.when(_any("desc_sentiment", "mean_sentiment"), F.concat_ws("\n", _line("Official tone: ", _n("desc_sentiment"), " | Community tone: ", _n("mean_sentiment"), " | Gap: ", _n("hype_gap_score", "%+.3f")), _line("Overhyped: ", _t("overhyped_aspect"), " | Underrated: ", _t("underrated_aspect"), " | Hidden gem: ", _n("hidden_gem_score", "%.1f")))),
        F.when((F.col("leaf_category") != "Unknown") | _any("category_size", "category_avg_rating"), F.concat_ws("\n", _line("Category size: ", _n("category_size", "%.0f"), " | Rating rank: top ", F.when(F.col("category_rating_percentile").isNotNull(), F.format_string("%.0f%%", 100 - F.col("category_rating_percentile").cast("double"))).otherwise(NONE), " | Sentiment rank: top ", F.when(F.col("category_sentiment_percentile").isNotNull(), F.format_string("%.0f%%", 100 - F.col("category_sentiment_percentile").cast("double"))).otherwise(NONE)), _line("Category rating: ", _n("category_avg_rating", "%.2f"), " | Category sentiment: ", _n("category_avg_sentiment")), _line("Outperforms: ", _t("outperforms_aspects"), " | Underperforms: ", _t("underperforms_aspects"), " | Distinctiveness: ", _n("distinctive_score")))),
        F.when(_any("top_tfidf_phrases", "distinctive_terms", "emotion_vocabulary"), F.concat_ws("\n", _line("Keywords: ", _t("top_tfidf_phrases")), _line("Unique terms: ", _t("distinctive_terms")), _line("Emotions: ", _t("emotion_vocabulary")))),
    ]


def token_count(text: Column) -> Column:
    return C.word_count(text)


def _shrunk(words: Column, budget: Column) -> Column:
    """Words cut to three quarters again and again until they fit the budget; empty if nothing does."""
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.size(words), lambda n, _: F.when(n > budget, F.floor(n * 0.75).cast("int")).otherwise(n))
    return F.slice(words, 1, F.greatest(F.least(steps, budget), F.lit(0)))


def packed(sections: Column, budget: int) -> Column:
    """Sections joined by blank lines within ``budget`` tokens: the first is always kept, a section that does not fit is shortened and marked if more than 20 tokens are left, later ones may still fit."""
    kept = F.filter(sections, lambda s: s.isNotNull() & (F.trim(s) != ""))
    start = F.struct(F.slice(kept, 1, 1).alias("kept"), (F.lit(budget) - F.coalesce(token_count(F.try_element_at(kept, F.lit(1))), F.lit(0))).alias("left"))

    def add(state: Column, s: Column) -> Column:
        cost, left = token_count(s), state["left"]
        words = _shrunk(C.tokens(s), left - 1)
        cut = F.concat(F.array_join(words, " "), F.lit(" [truncated]"))
        return (
            F.when(cost <= left, F.struct(F.concat(state["kept"], F.array(s)).alias("kept"), (left - cost).alias("left")))
            .when((left > 20) & (F.size(words) > 0), F.struct(F.concat(state["kept"], F.array(cut)).alias("kept"), (left - F.size(words) - 1).alias("left")))
            .otherwise(state)
        )

    rest = F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))
    out = F.aggregate(rest, start, add, lambda s: s["kept"])
    return F.array_join(out, "\n\n")


def rich_documents(products: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(parent_asin, rich_text, token_count) of every product; whole documents if they fit the budget, else packed."""
    sections = F.array(*product_sections(products))
    whole = F.array_join(F.filter(sections, lambda s: s.isNotNull() & (F.trim(s) != "")), "\n\n")
    text = F.when(token_count(whole) <= budget, whole).otherwise(packed(sections, budget))
    return products.select("parent_asin", text.alias("rich_text")).withColumn("token_count", token_count(F.col("rich_text")))


def token_statistics(documents: DataFrame, budget: int = BUDGET) -> DataFrame:
    n = F.col("token_count")
    return documents.agg(F.count(F.lit(1)).alias("n_documents"), F.min(n).alias("min_tokens"), F.round(F.avg(n), 6).alias("mean_tokens"), F.max(n).alias("max_tokens"), F.count_if(n > budget).alias("over_budget"))


def voice_documents(profiles: DataFrame, reviews: DataFrame, budget: int = BUDGET, least_tier: int = 2) -> DataFrame:
    """(user_id, voice_document, tier) for users of at least ``least_tier``: profile sections, then the user's own words while they fit.

    Own texts come newest and highest rated first, each costing its tokens plus one; the first that does not fit is cut to what is left and ends the fill. The fill is a running sum, so only texts inside
    the budget are ever collected.
    """
    p = profiles.filter(F.col("cold_start_tier") >= least_tier).groupBy("user_id").agg(F.max(F.struct(*[F.col(c) for c in profiles.columns if c != "user_id" and not c.endswith("_embedding")])).alias("r")).select("user_id", "r.*")
    na = lambda c, f="%.2f": F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c).cast("double"))).otherwise(F.lit("n/a"))
    txt = lambda c: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit("n/a"))
    head = F.concat_ws(
        "\n",
        _line("Reviewer profile: ", C.critic_style(F.col("avg_rating_given")), " critic"),
        _line("Interactions: ", na("interaction_count", "%.0f"), ", mean rating ", na("avg_rating_given"), ", active days ", na("active_days", "%.0f"), ", pace ", na("interaction_velocity")),
        _line("Categories: ", F.coalesce(F.when(F.size("top_categories") > 0, F.array_join("top_categories", ", ")), F.lit("n/a")), "; main ", txt("dominant_category"), "; entropy ", na("category_entropy")),
        _line("Aspects: best ", txt("user_top_aspect"), ", worst ", txt("user_worst_aspect"), "; ", F.concat_ws(", ", *[_line(f"{a} ", na(f"user_aspect_{a}")) for a in ASPECTS])),
        _line("Price: ", txt("preferred_price_tier"), ", diversity ", na("price_diversity")),
        _line("Reviews: ", F.coalesce(F.col("user_review_count").cast("long"), F.lit(0)).cast("string"), ", words ", na("user_avg_review_length", "%.0f"), ", sentiment ", na("user_avg_sentiment"), ", votes ", na("user_helpful_votes_received", "%.0f")),
    )
    p = p.select("user_id", F.col("cold_start_tier").alias("tier"), head.alias("head")).withColumn("_left", F.lit(budget) - token_count(F.col("head")) - 10)
    p = p.withColumn("_fill", F.when(F.col("_left") > 20, F.col("_left") - 4).otherwise(F.lit(0)))
    texts = reviews.filter(F.trim("text") != "").withColumn("_n", voice_order(reviews)).select("user_id", "_n", C.tokens(F.col("text")).alias("_w"))
    run = Window.partitionBy("user_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.filter(F.col("_n") <= budget).withColumn("_used", F.coalesce(F.sum(F.size("_w") + 1).over(run), F.lit(0)))  # a text costs 2 at least: no more than budget / 2 can fit
    fitting = texts.join(p.select("user_id", "_fill"), "user_id").filter(F.col("_used") < F.col("_fill"))
    piece = F.array_join(F.slice("_w", 1, F.greatest(F.least(F.size("_w"), (F.col("_fill") - F.col("_used")).cast("int")), F.lit(0))), " ")
    own = fitting.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", piece.alias("t")))), lambda x: x["t"]), "\n").alias("_own"))
    out = p.join(own, "user_id", "left")
    doc = F.when(F.coalesce(F.trim("_own"), F.lit("")) != "", F.concat(F.col("head"), F.lit("\nIn their own words:\n"), F.col("_own"))).otherwise(F.col("head"))
    return out.select("user_id", doc.alias("voice_document"), "tier")


# Patterns and vocabularies that decide what a query asks for.
NUMBER = r"\s*\$?\s*([0-9]+(?:\.[0-9]+)?)"
MAX_PRICE = r"(?i)(?:under|below|less\s+than|at\s+most|no\s+more\s+than|cheaper?\s+than)" + NUMBER
MIN_PRICE = r"(?i)(?:over|above|more\s+than|at\s+least|greater\s+than)" + NUMBER
APPROX_PRICE = r"(?i)(?:around|approximately|about|~)" + NUMBER
LOW = r"(?i)\b(?:cheap|budget|affordable|free)\b"
HIGH = r"(?i)\b(?:premium|expensive|high.?end)\b"
ATTRIBUTES = [
    "great", "good", "best", "top", "amazing", "fun", "exciting", "challenging", "easy", "hard", "beautiful", "gorgeous", "stunning", "dark", "scary", "funny", "relaxing", "competitive",
    "immersive", "addictive", "classic", "new", "old", "cheap", "expensive", "popular", "underrated", "hidden", "rare", "long", "short", "violent", "family", "single", "multi", "local", "online",
    "free", "paid", "budget", "premium", "indie", "aaa",
]
INTENTS = [
    "game", "games", "title", "titles", "rpg", "fps", "shooter", "adventure", "action", "strategy", "puzzle", "platformer", "horror", "sports", "racing", "fighting", "simulation", "sandbox",
    "open.?world", "story", "multiplayer", "singleplayer", "co.?op", "campaign", "storyline", "character", "characters", "graphics", "gameplay", "controls", "music", "soundtrack",
    "console", "pc", "playstation", "xbox", "nintendo", "switch",
]
EXPANSIONS: dict[str, list[str]] = {
    "fps": ["first person shooter", "shooter", "action"],
    "rpg": ["role playing game", "role-playing", "adventure"],
    "mmo": ["massively multiplayer online", "online", "multiplayer"],
    "mmorpg": ["massively multiplayer online role playing game", "online rpg"],
    "rts": ["real time strategy", "strategy"],
    "tbs": ["turn based strategy", "strategy"],
    "jrpg": ["japanese role playing game", "rpg", "adventure"],
    "moba": ["multiplayer online battle arena", "competitive"],
    "soulslike": ["dark souls style", "challenging", "action rpg"],
    "roguelike": ["procedurally generated", "permadeath", "dungeon crawler"],
    "metroidvania": ["exploration", "platformer", "side-scroller"],
    "vr": ["virtual reality", "immersive"],
    "co-op": ["cooperative", "multiplayer", "together"],
    "coop": ["cooperative", "multiplayer"],
    "indie": ["independent game", "small studio"],
    "aaa": ["triple a", "big budget", "blockbuster"],
    "arpg": ["action role playing game", "action rpg"],
    "hack and slash": ["action", "combat", "beat em up"],
    "open world": ["sandbox", "exploration", "non-linear"],
    "sandbox": ["open world", "creative", "exploration"],
}


def understand_queries(queries: DataFrame) -> DataFrame:
    """(raw_query, intent, attributes, constraints, expanded, final_query) of each row of ``queries`` (raw_query, trimmed). Null counts as ''.

    Arrays are sorted and without repetition, except ``expanded``, which keeps the order of the expansion table. Low price preference wins over high.
    """
    q = F.trim(F.coalesce("raw_query", F.lit("")))
    number = lambda p: F.regexp_extract(q, p, 1).try_cast("double")
    listed = lambda words: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(q), F.lit(r"\b(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")\b"), F.lit(1))))
    expanded = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(q.rlike(r"(?i)\b" + k + r"\b"), F.array(*[F.lit(x) for x in v])) for k, v in EXPANSIONS.items()]))))
    constraints = F.struct(number(MAX_PRICE).alias("max_price"), number(MIN_PRICE).alias("min_price"), number(APPROX_PRICE).alias("approx_price"), F.when(q.rlike(LOW), "low").when(q.rlike(HIGH), "high").alias("price_preference"))
    out = queries.select(q.alias("raw_query"), listed(INTENTS).alias("intent"), listed(ATTRIBUTES).alias("attributes"), constraints.alias("constraints"), expanded.alias("expanded"))
    return out.withColumn("final_query", F.concat_ws(" ", F.array("raw_query"), "expanded", "attributes"))


def encode_texts(texts: DataFrame, id_column: str, text_column: str, dimension: int = 64, weights: DataFrame | None = None) -> DataFrame:
    """(id, embedding): deterministic offline text vectors, unit norm, zero for texts without words.

    Words are hashed to ``dimension`` signed buckets (a random projection), weighted by log term frequency and, if ``weights`` (term, idf) is given, by idf. A stand-in for a
    pretrained encoder with the same output contract.
    """
    words = texts.select(F.col(id_column).alias("_id"), F.explode_outer(F.regexp_extract_all(F.lower(text_column), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("term"))
    tf = words.groupBy("_id", "term").agg(F.count("term").alias("tf"))
    if weights is not None:
        tf = tf.join(weights, "term", "left").withColumn("_w", (1 + F.log(F.greatest("tf", F.lit(1)))) * F.coalesce("idf", F.lit(1.0)))
    else:
        tf = tf.withColumn("_w", 1 + F.log(F.greatest("tf", F.lit(1))))
    sign = F.when(F.pmod(F.xxhash64("term", F.lit(7)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    bucketed = tf.groupBy("_id", F.pmod(F.xxhash64("term"), F.lit(dimension)).cast("int").alias("_b")).agg(F.sum(F.when(F.col("term").isNotNull(), F.col("_w") * sign).otherwise(0.0)).alias("_s"))
    maps = bucketed.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("_b", F.lit(-1)), "_s"))).alias("_m"))  # at most ``dimension`` entries
    vec = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return maps.select(F.col("_id").alias(id_column), C.normalised(vec).cast("array<float>").alias("embedding"))


def inverse_document_frequency(texts: DataFrame, text_column: str) -> DataFrame:
    """(term, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    df = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_column), F.lit("[a-z0-9]{2,}"), F.lit(0)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def resume_encoding(texts: DataFrame, id_column: str, text_column: str, path: str, dimension: int = 64) -> int:
    """Append vectors of the ids not yet written under ``path``; returns how many were missing."""
    spark = texts.sparkSession
    todo = texts.join(spark.read.parquet(path).select(id_column), id_column, "left_anti") if exists(spark, path) else texts
    n = todo.count()
    if n:
        encode_texts(todo, id_column, text_column, dimension).write.mode("append").parquet(path)
    return n
