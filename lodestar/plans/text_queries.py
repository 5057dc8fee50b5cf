"""Queries over cleaning, splits, sentiment and product signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import ASPECT_KEYWORDS, ASPECTS, LEXICON
from lodestar.operators import cleaning, interactions, products, sentiment, tfidf
from lodestar.plans.catalog import Tables, rounded
from lodestar.session import cut_lineage, spread
from lodestar.plans.oracle_base import META, REVIEWS, SCORED, bag, num, nums, parts, tokens
from lodestar.sources import sinks

CORE_K = 3


def clean_meta(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).meta()


def clean_reviews(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).reviews()


def text_measures(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.text_measures(Tables(spark, d).meta())


def kcore_interactions(spark: SparkSession, d: str) -> DataFrame:
    edges = Tables(spark, d).reviews().select("user_id", "parent_asin", "rating")
    return interactions.k_core(edges, CORE_K)


def restricted_to_catalogue(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return interactions.restrict(t.reviews(), t.meta(), "parent_asin").select("review_id", "user_id", "parent_asin")


def leave_last_two_split(spark: SparkSession, d: str) -> DataFrame:
    return interactions.leave_last_out(Tables(spark, d).reviews()).select("user_id", "parent_asin", "split")


def train_without_heldout(spark: SparkSession, d: str) -> DataFrame:
    r = interactions.leave_last_out(Tables(spark, d).reviews())
    held = [r.filter(F.col("split") == s) for s in ("valid", "test")]
    return interactions.without(r.drop("split"), held, ["user_id", "parent_asin"]).select("user_id", "parent_asin", "rating")


def prefix_history(spark: SparkSession, d: str) -> DataFrame:
    sinks.front_coded(spark)  # a history begins with the one before it
    train = interactions.leave_last_out(Tables(spark, d).reviews()).filter("split = 'train'")
    return interactions.prefix_history(train.select("user_id", "parent_asin", "timestamp")).select("user_id", "parent_asin", "history")


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return interactions.split_counts(interactions.leave_last_out(Tables(spark, d).reviews()))


def lexicon_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Tables(spark, d).scored().select("review_id", "sentiment_score", "sentiment_label"))


def aspect_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Tables(spark, d).scored().select("review_id", *[f"aspect_{a}" for a in ASPECTS]))


def rule_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.score_by_rules(spread(Tables(spark, d).reviews()))


def sentiment_distribution(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.label_distribution(Tables(spark, d).scored())


def aspect_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.aspect_hit_rates(Tables(spark, d).scored(), list(ASPECTS))


def emotion_vocab(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.emotion_vocabulary(spread(Tables(spark, d).reviews()))


def item_base_agg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(products.review_aggregates(Tables(spark, d).scored()))


def temporal_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(products.temporal_windows(Tables(spark, d).scored()))


def price_tiers(spark: SparkSession, d: str) -> DataFrame:
    return products.price_tiers(Tables(spark, d).meta()).select("parent_asin", "price_tier")


def consensus_trends(spark: SparkSession, d: str) -> DataFrame:
    p = products.consensus_and_trends(Tables(spark, d).products())
    trends = [f"{a}_trend" for a in ASPECTS]
    return rounded(p.select("parent_asin", "consensus_score", "controversy_index", "sentiment_velocity", "sentiment_trajectory", *trends))


def trend_summary(spark: SparkSession, d: str) -> DataFrame:
    return products.consensus_and_trends(Tables(spark, d).products()).select("parent_asin", "aspect_trend_summary")


_CATEGORY = ["category_size", "category_avg_rating", "category_avg_sentiment", "category_rating_percentile", "category_sentiment_percentile", "hidden_gem_score", "distinctive_score"]


def category_signals(spark: SparkSession, d: str) -> DataFrame:
    raw = Tables(spark, d).products()
    p = products.category_signals(raw.drop(*_CATEGORY, "outperforms_aspects", "underperforms_aspects", *[f"category_avg_{a}" for a in ASPECTS]))
    return rounded(p.select("parent_asin", *_CATEGORY, "outperforms_aspects", "underperforms_aspects", *[f"category_avg_{a}" for a in ASPECTS]))


def reality_gap(spark: SparkSession, d: str) -> DataFrame:
    listing = F.trim(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("features", F.lit(""))))
    raw = Tables(spark, d).products()
    p = products.reality_gap(raw, sentiment.bag_score(F.when(listing != "", listing)), ASPECT_KEYWORDS)
    return rounded(p.select("parent_asin", "desc_sentiment", "hype_gap_score", "official_vs_community_gap", "overhyped_aspect", "underrated_aspect"))


def best_worst_aspect(spark: SparkSession, d: str) -> DataFrame:
    return products.best_and_worst_aspects(Tables(spark, d).products()).select("parent_asin", "top_aspect", "worst_aspect")


def dominant_emotion(spark: SparkSession, d: str) -> DataFrame:
    return products.dominant_emotion(Tables(spark, d).products().drop("dominant_emotion")).select("parent_asin", "dominant_emotion")


def product_table(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return products.product_table(cut_lineage(t.meta()), cut_lineage(t.scored()))  # both are read several times


def _weights(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    listed = products.listing_columns(t.meta()).select("parent_asin", "leaf_category")
    return tfidf.category_weights(listed, spread(t.reviews()))


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_weights(spark, d))


def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    listed = products.listing_columns(t.meta()).select("parent_asin", "leaf_category")
    return tfidf.category_terms(listed, spread(t.reviews()))


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the catalogue against its descriptions: queries are the products whose key hashes are divisible by 100 in SQL terms, that is every row of features_test's query items."""
    t = Tables(spark, d)
    queries = t.raw("features_test").select(F.col("query_parent_asin").alias("query_id")).distinct().join(t.meta().select(F.col("parent_asin").alias("query_id"), F.col("title").alias("text")), "query_id")
    docs = t.meta().select(F.col("parent_asin").alias("doc_id"), F.concat_ws(" ", "title", "description").alias("text"))
    return tfidf.bm25(queries, docs)


QUERIES = {
    f.__name__: f
    for f in (
        clean_meta, clean_reviews, text_measures, kcore_interactions, restricted_to_catalogue, leave_last_two_split, train_without_heldout, prefix_history, split_counts,
        lexicon_sentiment, aspect_sentiment, rule_sentiment, sentiment_distribution, aspect_hit_rates, emotion_vocab, item_base_agg, temporal_windows, price_tiers,
        consensus_trends, trend_summary, category_signals, reality_gap, best_worst_aspect, dominant_emotion, product_table, tfidf_weights, tfidf_top_terms, bm25_scores,
    )
}

_SPLIT = f"""{REVIEWS},
split AS (
  SELECT *, CASE WHEN n >= 3 AND r = 1 THEN 'test' WHEN n >= 3 AND r = 2 THEN 'valid' ELSE 'train' END AS split FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC NULLS LAST, parent_asin DESC) AS r FROM revc)
)"""


def _kcore_sql(k: int, passes: int = 20) -> str:
    steps = [f"{REVIEWS}", "e0 AS (SELECT user_id, parent_asin, rating FROM revc)"]
    for i in range(passes):
        steps.append(f"i{i} AS (SELECT * FROM e{i} WHERE parent_asin IN (SELECT parent_asin FROM e{i} GROUP BY 1 HAVING count(*) >= {k}))")
        steps.append(f"e{i + 1} AS MATERIALIZED (SELECT * FROM i{i} WHERE user_id IN (SELECT user_id FROM i{i} GROUP BY 1 HAVING count(*) >= {k}))")
    return "WITH " + ",\n".join(steps) + f" SELECT * FROM e{passes}"


def _label(x: str) -> str:
    return f"count(*) FILTER (WHERE sentiment_label = '{x}') / count(*)::DOUBLE"


_W = "greatest(coalesce(helpful_vote, 0), 1)"
_BASE = f"""WITH {SCORED}
SELECT parent_asin, CAST(count(sentiment_score) AS INTEGER) AS review_count, {num('avg(sentiment_score)', 'mean_sentiment')}, {num('stddev_samp(sentiment_score)', 'std_sentiment')},
  {num(f"avg(len({tokens('text')}))", 'avg_review_length')}, {num(f'sum({_W} * sentiment_score) / sum({_W})', 'helpfulness_weighted_sentiment')},
  {num('count(*) FILTER (WHERE helpful_vote > 0) / count(sentiment_score)', 'helpful_ratio')}, {num('count(*) FILTER (WHERE verified_purchase) / count(sentiment_score)', 'verified_ratio')},
  {num('greatest((max(timestamp) - min(timestamp)) / 86400000.0::DOUBLE, 0)', 'days_on_market')},
  {num(_label('positive'), 'pos_ratio')}, {num(_label('negative'), 'neg_ratio')}, {num(_label('neutral'), 'neu_ratio')},
  {", ".join(num(f'avg(aspect_{a})', f'mean_aspect_{a}') + ", " + num(f'avg((aspect_{a} IS NOT NULL)::INT)', f'coverage_{a}') + ", " + num(f'stddev_samp(aspect_{a})', f'std_aspect_{a}') for a in ASPECTS)}
FROM nlp GROUP BY parent_asin"""

_MEASURES = [("sentiment", "sentiment_score"), *[(f"aspect_{a}", f"aspect_{a}") for a in ASPECTS]]
_SLICES = {
    "early": "(n < 10 OR r < k)",
    "mid": "(n < 10 OR (r >= lo AND r < greatest(lo + 1, floor(n * 0.55::DOUBLE))))",
    "recent": "(n < 10 OR r >= n - k)",
}
_TEMPORAL = f"""WITH {SCORED},
pos AS (SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY timestamp ASC NULLS LAST, review_id) - 1 AS r, count(*) OVER (PARTITION BY parent_asin) AS n FROM nlp),
k AS (SELECT *, greatest(1, floor(n * 0.1::DOUBLE)) AS k, floor(n * 0.45::DOUBLE) AS lo FROM pos)
SELECT parent_asin, {", ".join(num(f"avg({c}) FILTER (WHERE {w})", f"{s}_{m}") for s, w in _SLICES.items() for m, c in _MEASURES)},
  strftime(make_timestamp(CAST(min(timestamp) FILTER (WHERE {_SLICES['early']}) AS BIGINT) * 1000), '%Y-%m') AS early_period,
  strftime(make_timestamp(CAST(max(timestamp) FILTER (WHERE {_SLICES['recent']}) AS BIGINT) * 1000), '%Y-%m') AS recent_period
FROM k GROUP BY parent_asin"""

_FLOAT_P = "prod AS (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN NOT isnan({c}) THEN CAST({c} AS DOUBLE) END AS {c}"
    for c in ["average_rating", "mean_sentiment", "std_sentiment", "pos_ratio", "neg_ratio", "early_sentiment", "recent_sentiment"]
    + [f"{p}_{a}" for p in ("mean_aspect", "coverage", "early_aspect", "recent_aspect") for a in ASPECTS]
) + ") FROM products_nlp)"

_CONSENSUS = f"""WITH {_FLOAT_P},
v AS (SELECT *, recent_sentiment - early_sentiment AS vel, {", ".join(f"recent_aspect_{a} - early_aspect_{a} AS d_{a}" for a in ASPECTS)} FROM prod),
g AS (SELECT max(std_sentiment) AS mx, avg(vel) AS vm, stddev_samp(vel) AS vs, avg(std_sentiment) AS sm, stddev_samp(std_sentiment) AS ss,
  ({" + ".join(f"coalesce(sum(abs(d_{a})), 0)" for a in ASPECTS)}) / ({" + ".join(f"count(d_{a})" for a in ASPECTS)}) AS th FROM v)
SELECT parent_asin, {num("CASE WHEN mx > 0 THEN CASE WHEN std_sentiment IS NOT NULL THEN greatest(least(1 - std_sentiment / mx, 1.0), 0.0) END ELSE 1.0 END", 'consensus_score')}, {num('std_sentiment', 'controversy_index')}, {num('vel', 'sentiment_velocity')},
  CASE WHEN vel IS NULL OR std_sentiment IS NULL THEN 'stable' WHEN vel > vm + vs THEN 'rising' WHEN vel < vm - vs THEN 'declining' WHEN std_sentiment > sm + ss THEN 'controversial' ELSE 'stable' END AS sentiment_trajectory,
  {", ".join(f"CASE WHEN d_{a} IS NULL THEN 'N/A' WHEN d_{a} > th THEN 'improving' WHEN d_{a} < -th THEN 'declining' ELSE 'stable' END AS {a}_trend" for a in ASPECTS)}
FROM v, g"""


def _prank(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY leaf_category ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY leaf_category, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY leaf_category) END"


def _names(sign: str) -> str:
    cond = {a: (f"mean_aspect_{a} - m_{a} > 0.5 * s_{a}" if sign == "+" else f"(mean_aspect_{a} - m_{a}) * -1 > 0.5 * s_{a}") for a in ASPECTS}
    return "coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{a}' END" for a, c in cond.items()) + "), ''), 'none')"


_CATEGORY_SQL = f"""WITH {_FLOAT_P},
c AS (SELECT leaf_category, CAST(count(parent_asin) AS INTEGER) AS category_size, avg(average_rating) AS ar, avg(mean_sentiment) AS ms,
  {", ".join(f"avg(mean_aspect_{a}) AS m_{a}, coalesce(stddev_samp(mean_aspect_{a}), 0) AS s_{a}" for a in ASPECTS)} FROM prod GROUP BY 1),
p AS (SELECT parent_asin, leaf_category, {", ".join(f"mean_aspect_{a}" for a in ASPECTS)}, {_prank('average_rating')} AS pr, {_prank('mean_sentiment')} AS ps, {_prank('rating_number')} AS pn FROM prod)
SELECT parent_asin, c.category_size, {num('ar', 'category_avg_rating')}, {num('ms', 'category_avg_sentiment')}, {num('pr * 100', 'category_rating_percentile')}, {num('ps * 100', 'category_sentiment_percentile')},
  {num('(ps - pn) * 100', 'hidden_gem_score')}, {num('sqrt(' + ' + '.join(f'coalesce(pow(mean_aspect_{a} - m_{a}, 2), 0)' for a in ASPECTS) + ')', 'distinctive_score')},
  {_names('+')} AS outperforms_aspects, {_names('-')} AS underperforms_aspects, {", ".join(num(f'm_{a}', f'category_avg_{a}') for a in ASPECTS)}
FROM p JOIN c USING (leaf_category)"""

_COV = f"""cov AS (SELECT coalesce(quantile_cont(c, 0.05), 0.0) AS floor FROM (SELECT unnest([{", ".join(f"coverage_{a}" for a in ASPECTS)}]) AS c FROM prod) WHERE c > 0)"""


def _best(entries: list[tuple[str, str, str]], name: str) -> str:
    """First name with the greatest score among eligible entries."""
    best = "greatest(" + ", ".join(f"CASE WHEN {ok} THEN {score} END" for _, score, ok in entries) + ")"
    whens = " ".join(f"WHEN ({ok}) AND {score} = {best} THEN '{a}'" for a, score, ok in entries)
    return f"CASE {whens} ELSE 'insufficient data' END AS {name}"


def _freq(a: str) -> str:
    t = "lower(coalesce(features, '') || ' ' || coalesce(description, ''))"
    return " + ".join(f"CAST((length({t}) - length(replace({t}, '{k}', ''))) / {len(k)} AS INT)" for k in ASPECT_KEYWORDS[a])


_LISTING = "nullif(trim(concat_ws(' ', coalesce(description, ''), coalesce(features, ''))), '')"
_GAP = f"""WITH {_FLOAT_P}, {_COV},
kw AS (SELECT *, {_LISTING} AS listing, {", ".join(f"{_freq(a)} AS kw_{a}" for a in ASPECTS)} FROM prod),
med AS (SELECT {", ".join(f"coalesce(nullif(median(kw_{a}), 0), 1) AS med_{a}" for a in ASPECTS)} FROM kw),
t AS (SELECT *, CASE WHEN listing IS NOT NULL THEN {bag('listing')} END AS tone FROM kw)
SELECT parent_asin, {num('tone', 'desc_sentiment')}, {num('tone - mean_sentiment', 'hype_gap_score')}, {num('abs(tone - mean_sentiment)', 'official_vs_community_gap')},
  {_best([(a, f"(kw_{a} / med_{a} - mean_aspect_{a})", f"coverage_{a} > floor AND mean_aspect_{a} IS NOT NULL") for a in ASPECTS], 'overhyped_aspect')},
  {_best([(a, f"(mean_aspect_{a} - coverage_{a})", f"coverage_{a} > floor AND mean_aspect_{a} IS NOT NULL") for a in ASPECTS], 'underrated_aspect')}
FROM t, med, cov"""

def _tfidf_base() -> str:
    return f"""{META}, {REVIEWS},
listed AS (SELECT parent_asin, coalesce({parts('categories')}[-1], 'Unknown') AS leaf_category FROM meta_c),
w AS (SELECT parent_asin, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN (SELECT_STOP)) AS ws FROM revc WHERE trim(text) <> ''),
grams AS (SELECT parent_asin, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
tf AS (SELECT leaf_category, parent_asin, term, count(*) AS tf FROM grams JOIN listed USING (parent_asin) GROUP BY ALL),
nd AS (SELECT leaf_category, count(*) AS n FROM listed SEMI JOIN w USING (parent_asin) GROUP BY 1),
voc AS (SELECT leaf_category, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL),
vok AS (SELECT * FROM voc JOIN nd USING (leaf_category) WHERE df >= CASE WHEN n < 2 THEN 1 ELSE 2 END
  QUALIFY row_number() OVER (PARTITION BY leaf_category ORDER BY total DESC, term) <= 50000),
raw AS (SELECT *, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS raw FROM tf JOIN vok USING (leaf_category, term)),
unit AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY parent_asin)) AS weight FROM raw),
wt AS (SELECT leaf_category, parent_asin, term, weight, sum(weight) OVER (PARTITION BY leaf_category, term) / n AS centroid FROM unit)"""


def _with_stop(sql: str) -> str:
    from lodestar.operators.tfidf import STOP_WORDS

    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    return sql.replace("SELECT_STOP", quoted)


def _top_terms(value: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT parent_asin, string_agg(term, ', ' ORDER BY v DESC, term) AS {name} FROM (
  SELECT parent_asin, term, round({value}, 9) AS v FROM wt WHERE round({value}, 9) > 0 QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY v DESC, term) <= {k}) GROUP BY 1)"""


_LEX_VALUES = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items())

SQL: dict[str, str] = {
    "clean_meta": f"WITH {META} SELECT * FROM meta_c",
    "clean_reviews": f"WITH {REVIEWS} SELECT * FROM revc",
    "text_measures": f"""WITH {META}
SELECT parent_asin, coalesce({parts('categories')}[-1], 'Unknown') AS leaf_category, array_to_string({parts('categories')}, ' > ') AS full_category_path, CAST(len({parts('features')}) AS SMALLINT) AS feature_count,
  {num(f"CASE WHEN len({tokens('lower(description)')}) > 0 THEN len(list_distinct({tokens('lower(description)')})) / len({tokens('lower(description)')})::DOUBLE ELSE 0 END", 'desc_richness_score')},
  CAST(len({tokens('description')}) AS INTEGER) AS description_words FROM meta_c""",
    "kcore_interactions": _kcore_sql(CORE_K),
    "restricted_to_catalogue": f"WITH {META}, {REVIEWS} SELECT review_id, user_id, parent_asin FROM revc WHERE EXISTS (SELECT 1 FROM meta_c WHERE meta_c.parent_asin = revc.parent_asin)",
    "leave_last_two_split": f"WITH {_SPLIT} SELECT user_id, parent_asin, split FROM split",
    "train_without_heldout": f"""WITH {_SPLIT} SELECT user_id, parent_asin, rating FROM split s
WHERE NOT EXISTS (SELECT 1 FROM split h WHERE h.split <> 'train' AND h.user_id = s.user_id AND h.parent_asin = s.parent_asin)""",
    "prefix_history": f"""WITH {_SPLIT} SELECT user_id, parent_asin,
  coalesce(string_agg(parent_asin, ' ') OVER (PARTITION BY user_id ORDER BY timestamp ASC NULLS LAST, parent_asin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
FROM split WHERE split = 'train'""",
    "split_counts": f"WITH {_SPLIT} SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT parent_asin) AS n_items FROM split GROUP BY split",
    "lexicon_sentiment": f"WITH {SCORED} SELECT review_id, {nums('sentiment_score')}, sentiment_label FROM nlp",
    "aspect_sentiment": f"WITH {SCORED} SELECT review_id, {nums(*[f'aspect_{a}' for a in ASPECTS])} FROM nlp",
    "sentiment_distribution": f"WITH {SCORED} SELECT sentiment_label, count(*) AS n, round(count(*) / (SELECT count(*) FROM nlp)::DOUBLE, 6) AS share FROM nlp GROUP BY 1",
    "aspect_hit_rates": f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{a}' AS aspect, count(aspect_{a}) AS hits, round(count(aspect_{a}) / count(*)::DOUBLE, 6) AS rate FROM nlp" for a in ASPECTS),
    "emotion_vocab": f"""WITH {REVIEWS}, lex(word, valence) AS (VALUES {_LEX_VALUES}),
w AS (SELECT DISTINCT parent_asin, unnest(regexp_extract_all(lower(text), '\\b[a-z]{{3,}}\\b')) AS word FROM revc),
k AS (SELECT parent_asin, word, valence FROM w JOIN lex USING (word) QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY abs(valence) DESC, word) <= 5)
SELECT parent_asin, string_agg(word, ', ' ORDER BY abs(valence) DESC, word) AS emotion_vocabulary FROM k GROUP BY 1""",
    "item_base_agg": _BASE,
    "temporal_windows": _TEMPORAL,
    "price_tiers": f"""WITH {META}, q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, quantile_cont(price, 0.9) AS c FROM meta_c)
SELECT parent_asin, CASE WHEN price IS NULL THEN 'unknown' WHEN price <= a THEN 'budget' WHEN price <= b THEN 'mid' WHEN price <= c THEN 'premium' ELSE 'luxury' END AS price_tier FROM meta_c, q""",
    "consensus_trends": _CONSENSUS,
    "trend_summary": f"""WITH {_FLOAT_P}, v AS (SELECT parent_asin, {", ".join(f"recent_aspect_{a} - early_aspect_{a} AS d_{a}" for a in ASPECTS)} FROM prod),
g AS (SELECT ({" + ".join(f"coalesce(sum(abs(d_{a})), 0)" for a in ASPECTS)}) / ({" + ".join(f"count(d_{a})" for a in ASPECTS)}) AS th FROM v)
SELECT parent_asin, coalesce(nullif(concat_ws('; ', {", ".join(f"CASE WHEN d_{a} > th THEN printf('{a.capitalize()} improved (+%.2f)', d_{a}) WHEN d_{a} < -th THEN printf('{a.capitalize()} declined (%.2f)', d_{a}) END" for a in ASPECTS)}), ''), 'stable') AS aspect_trend_summary FROM v, g""",
    "category_signals": _CATEGORY_SQL,
    "reality_gap": _GAP,
    "best_worst_aspect": f"""WITH {_FLOAT_P}, {_COV} SELECT parent_asin,
  {_best([(a, f"mean_aspect_{a}", f"coverage_{a} > floor AND mean_aspect_{a} IS NOT NULL") for a in ASPECTS], 'top_aspect')},
  {_best([(a, f"-mean_aspect_{a}", f"coverage_{a} > floor AND mean_aspect_{a} IS NOT NULL") for a in ASPECTS], 'worst_aspect')} FROM prod, cov""",
    "dominant_emotion": f"""WITH {_FLOAT_P}, g AS (SELECT coalesce(avg(abs(pos_ratio - neg_ratio)), 0.05) AS th FROM prod)
SELECT parent_asin, CASE WHEN pos_ratio > neg_ratio + th THEN 'positive' WHEN neg_ratio > pos_ratio + th THEN 'negative' ELSE 'mixed' END AS dominant_emotion FROM prod, g""",
    "tfidf_weights": _with_stop(f"WITH {_tfidf_base()} SELECT leaf_category, parent_asin, term, {nums('weight', 'centroid')} FROM wt"),
    "tfidf_top_terms": _with_stop(f"""WITH {_tfidf_base()}, {_top_terms('weight', 10, 'top_tfidf_phrases')}, {_top_terms('weight - centroid', 5, 'distinctive_terms')}
SELECT coalesce(a.parent_asin, b.parent_asin) AS parent_asin, top_tfidf_phrases, distinctive_terms FROM top_tfidf_phrases a FULL JOIN distinctive_terms b ON a.parent_asin = b.parent_asin"""),
    "bm25_scores": f"""WITH {META},
words AS (SELECT parent_asin AS doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, description)), '[a-z0-9]{{2,}}')) AS term FROM meta_c),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL), len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1),
sc AS (SELECT (SELECT avg(len) FROM len) AS al, (SELECT count(*) FROM meta_c) AS n), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT parent_asin AS query_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]{{2,}}')) AS term FROM meta_c WHERE parent_asin IN (SELECT query_parent_asin FROM features_test)),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) AS s FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), sc GROUP BY ALL)
SELECT query_id, doc_id, round(s, 6) AS bm25, round(s / max(s) OVER (PARTITION BY query_id), 6) AS bm25_scaled FROM s""",
}
