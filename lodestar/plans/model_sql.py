"""The SQL of ``model_queries``, where SQL can express them on whole tables."""

from __future__ import annotations

from lodestar.config import ASPECTS
from lodestar.operators.documents import APPROX_PRICE, ATTRIBUTES, EXPANSIONS, HIGH, INTENTS, LOW, MAX_PRICE, MIN_PRICE
from lodestar.operators.evaluation import ABLATIONS
from lodestar.operators.features import FEATURES
from lodestar.operators.reports import COMPARED
from lodestar.plans.oracle_base import META, REVIEWS, SCORED, num, nums, parts, tokens
from lodestar.plans.text_queries import _SPLIT

DAY = "86400000.0::DOUBLE"
TRAIN = f"{_SPLIT}, train AS (SELECT * FROM split WHERE split = 'train')"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda e: e::DOUBLE / sqrt(list_sum(list_transform({v}, lambda f: f::DOUBLE * f::DOUBLE))))"


def _usable(v: str) -> str:
    return f"CASE WHEN len({v}) = 64 AND len(list_filter({v}, lambda e: e IS NULL OR isnan(e))) = 0 THEN {v} END"


ITEMS = f"""items AS (SELECT trim(parent_asin) AS item, max(vec) AS vec FROM (SELECT parent_asin, {_usable('embedding')} AS vec FROM item_embeddings) WHERE vec IS NOT NULL AND trim(parent_asin) <> '' GROUP BY 1),
nrm AS (SELECT item, vec, sqrt({_dot('vec', 'vec')}) AS n FROM items),
uitems AS (SELECT item, CASE WHEN n > 1e-9 THEN list_transform(vec, lambda e: e::DOUBLE / n) ELSE vec::DOUBLE[] END AS vec FROM nrm)"""

_STATS = f"""{TRAIN},
ui AS (SELECT user_id, count(*) AS interaction_count, avg(rating) AS avg_rating_given, coalesce(stddev_samp(rating), 0) AS rating_std, min(timestamp) AS first_interaction_ts, max(timestamp) AS last_interaction_ts FROM train GROUP BY 1),
us AS (SELECT *, (last_interaction_ts - first_interaction_ts) / {DAY} AS active_days, ((SELECT max(last_interaction_ts) FROM ui) - last_interaction_ts) / {DAY} AS recency_score FROM ui)"""
_TIERS = f"""{_STATS},
q AS (SELECT quantile_cont(interaction_count::DOUBLE, 0.05) AS a, quantile_cont(interaction_count::DOUBLE, 0.25) AS b, quantile_cont(recency_score, 0.75) AS r FROM us),
ti AS (SELECT *, CASE WHEN interaction_count < a THEN 1 WHEN interaction_count < b THEN 2 ELSE 3 END AS cold_start_tier, coalesce(recency_score <= r, false) AS is_active FROM us, q)"""

_LISTED = f"""{META},
pq AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, quantile_cont(price, 0.9) AS c FROM meta_c),
listed AS (SELECT parent_asin, coalesce({parts('categories')}[-1], 'Unknown') AS leaf_category,
  CASE WHEN price IS NULL THEN 'unknown' WHEN price <= a THEN 'budget' WHEN price <= b THEN 'mid' WHEN price <= c THEN 'premium' ELSE 'luxury' END AS price_tier FROM meta_c, pq)"""


def _pref(column: str, name: str) -> str:
    return f"""{name} AS (SELECT user_id, v, count(*) AS n, min(struct_pack(t := coalesce(timestamp, 9e18), a := parent_asin)) AS f FROM (
  SELECT user_id, parent_asin, timestamp, {column} AS v FROM train LEFT JOIN listed USING (parent_asin)) WHERE coalesce(v, 'unknown') NOT IN ('unknown', '') GROUP BY ALL)"""


_PREFS = f"""WITH {_LISTED}, {TRAIN}, {_pref('leaf_category', 'cc')}, {_pref('price_tier', 'pc')},
c AS (SELECT user_id, list(v ORDER BY n DESC, f) AS vs, sum(n) AS total, sum(n * ln(n)) AS nlogn FROM cc GROUP BY 1), p AS (SELECT user_id, list(v ORDER BY n DESC, f) AS ts FROM pc GROUP BY 1)
SELECT u.user_id, coalesce(vs[1:3], CAST([] AS VARCHAR[])) AS top_categories, {num('coalesce(len(vs) / total::DOUBLE, 0)', 'category_diversity')}, coalesce(vs[1], 'unknown') AS dominant_category,
  {num('greatest(coalesce(ln(total) - nlogn / total, 0), 0)', 'category_entropy')}, coalesce(ts[1], 'unknown') AS preferred_price_tier, {num('CASE WHEN ts IS NULL THEN 0 ELSE least(len(ts) / 4.0, 1) END', 'price_diversity')}
FROM (SELECT DISTINCT user_id FROM train) u LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id)"""


def _pick(sign: str) -> str:
    vals = {a: f"{sign}user_aspect_{a}" for a in ASPECTS}
    good = {a: f"CASE WHEN s_{a} >= fl THEN {v} END" for a, v in vals.items()}
    gb, ab = f"greatest({', '.join(good.values())})", f"greatest({', '.join(vals.values())})"
    return "CASE " + " ".join(f"WHEN {good[a]} = {gb} THEN '{a}'" for a in ASPECTS) + f" WHEN {gb} IS NULL THEN CASE " + " ".join(f"WHEN {vals[a]} = {ab} THEN '{a}'" for a in ASPECTS) + " END END"


_SIGNALS = f"""WITH {SCORED},
g AS (SELECT user_id, avg(sentiment_score) AS user_avg_sentiment, coalesce(stddev_samp(sentiment_score), 0) AS user_sentiment_std, count(sentiment_score)::DOUBLE AS user_review_count, avg(len({tokens('text')})) AS user_avg_review_length,
  coalesce(sum(helpful_vote), 0) AS user_helpful_votes_received, avg((coalesce({", ".join(f"aspect_{a}" for a in ASPECTS)}) IS NOT NULL)::INT) AS user_aspect_coverage, count(*) FILTER (WHERE sentiment_label = 'positive') / count(*)::DOUBLE AS user_pos_ratio,
  count(*) FILTER (WHERE sentiment_label = 'negative') / count(*)::DOUBLE AS user_neg_ratio, avg(verified_purchase::INT) AS user_verified_ratio, {", ".join(f"avg(aspect_{a}) AS user_aspect_{a}" for a in ASPECTS)} FROM nlp GROUP BY 1),
s AS (SELECT {", ".join(f"avg((user_aspect_{a} IS NOT NULL)::INT) AS s_{a}" for a in ASPECTS)} FROM g),
fl AS (SELECT quantile_cont(x, 0.05) AS fl FROM (SELECT unnest([{", ".join(f"s_{a}" for a in ASPECTS)}]) AS x FROM s) WHERE x > 0)
SELECT user_id, {nums('user_avg_sentiment', 'user_sentiment_std', 'user_review_count', 'user_avg_review_length', 'user_helpful_votes_received', 'user_aspect_coverage', 'user_pos_ratio', 'user_neg_ratio', 'user_verified_ratio', *[f'user_aspect_{a}' for a in ASPECTS])},
  {_pick('')} AS user_top_aspect, {_pick('-')} AS user_worst_aspect FROM g, s, fl"""

_WEIGHTED = f"""{ITEMS}, {TRAIN}, mx AS (SELECT max(timestamp) AS m FROM train),
r AS (SELECT user_id, rating, (m - timestamp) / {DAY} AS days, generate_subscripts(vec, 1) AS pos, unnest(vec)::DOUBLE AS e FROM train JOIN items ON item = parent_asin, mx)"""


def _mean(weights: dict[str, str]) -> str:
    w = {k: f"coalesce({x}, 0)" for k, x in weights.items()}
    return f"m AS (SELECT user_id, pos, {', '.join(f'CASE WHEN max({x}) > 0 THEN sum({x} * e) / sum({x}) END AS {k}' for k, x in w.items())} FROM r GROUP BY ALL)"


_KINDS = {"uniform": "1.0::DOUBLE", "recency": "exp(-0.01::DOUBLE * days)", "rating": "rating", "combined": "rating * exp(-0.01::DOUBLE * days)"}
_USER_VECTORS = f"WITH {_WEIGHTED}, {_mean(_KINDS)} " + " UNION ALL ".join(
    f"SELECT user_id, '{k}' AS kind, CAST(pos - 1 AS INTEGER) AS pos, round({k} / CASE WHEN sqrt(sum({k} * {k}) OVER (PARTITION BY user_id)) > 1e-9 THEN sqrt(sum({k} * {k}) OVER (PARTITION BY user_id)) ELSE 1 END, 5) + 0.0::DOUBLE AS value FROM m WHERE {k} IS NOT NULL"
    for k in _KINDS
)
_LAMBDAS = {"l1": 0.001, "l2": 0.01, "l3": 0.1}
_LAMBDA = f"WITH {_WEIGHTED}, {_mean({'u': '1.0::DOUBLE'} | {k: f'exp(-{x}::DOUBLE * days)' for k, x in _LAMBDAS.items()})} " + " UNION ALL ".join(
    f"SELECT {x}::DOUBLE AS recency_lambda, round(avg(d), 5) + 0.0::DOUBLE AS mean_difference FROM (SELECT 1 - sum(u * {k}) / sqrt(sum(u * u) * sum({k} * {k})) AS d FROM m WHERE {k} IS NOT NULL GROUP BY user_id)" for k, x in _LAMBDAS.items()
)

_PROFILE_VECTORS = f"""prof AS (SELECT user_id, max(cold_start_tier) AS tier, max(query_weight)::DOUBLE AS qw, max(user_weight)::DOUBLE AS uw, max({_usable('uniform_embedding')}) AS u, max({_usable('recency_embedding')}) AS r, max({_usable('combined_embedding')}) AS c FROM user_profiles GROUP BY 1)"""
_BLENDED = f"""WITH {ITEMS}, {_PROFILE_VECTORS},
asked AS (SELECT DISTINCT user_id, query_parent_asin AS query_id FROM features_test),
w AS (SELECT a.user_id, query_id, x.vec AS q, coalesce(tier, 0) AS tier, coalesce(qw, 0.7) AS qw, coalesce(uw, 0.3) AS uw, u, r, c FROM asked a JOIN uitems x ON x.item = query_id LEFT JOIN prof p ON p.user_id = a.user_id),
b AS (SELECT *, CASE WHEN tier = 1 AND u IS NOT NULL THEN u WHEN tier = 2 THEN coalesce(r, u) WHEN tier = 3 THEN coalesce(c, r) END AS o,
  CASE WHEN tier = 3 AND c IS NOT NULL THEN 0.6::DOUBLE WHEN (tier = 1 AND u IS NOT NULL) OR (tier = 2 AND coalesce(r, u) IS NOT NULL) OR (tier = 3 AND r IS NOT NULL) THEN qw ELSE 1.0::DOUBLE END AS wq, CASE WHEN tier = 3 AND c IS NOT NULL THEN 0.4::DOUBLE ELSE uw END AS wo FROM w),
s AS (SELECT user_id, query_id, CASE WHEN o IS NULL THEN q ELSE list_transform(list_zip(q, o), lambda p: p[1]::DOUBLE * wq + p[2]::DOUBLE * wo) END AS v FROM b),
n AS (SELECT *, sqrt({_dot('v', 'v')}) AS n FROM s)
SELECT user_id, query_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v) / CASE WHEN n > 1e-9 THEN n ELSE 1 END, 5) + 0.0::DOUBLE AS value FROM n"""

_TOPK = f"""s AS (SELECT a.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS item, round({_dot('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)"""
_FEED = f"""WITH {ITEMS}, p AS (SELECT user_id, max({_usable('combined_embedding')}) AS c FROM user_profiles GROUP BY 1), pn AS (SELECT user_id, c, sqrt({_dot('c', 'c')}) AS n FROM p WHERE c IS NOT NULL),
pu AS (SELECT user_id, list_transform(c, lambda e: e::DOUBLE / CASE WHEN n > 1e-9 THEN n ELSE 1 END) AS v FROM pn)
SELECT user_id AS query_id, item, round(score, 6) + 0.0::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS INTEGER) AS rank FROM (SELECT user_id, item, round({_dot('v', 'vec')}, 9) AS score FROM pu, uitems) QUALIFY rank <= 10"""

_CANDS = f"""WITH {ITEMS}, {_SPLIT},
t AS (SELECT user_id, parent_asin AS query_parent_asin, CAST(round_even(rating, 0) AS INTEGER) AS label FROM split WHERE split = 'test' AND user_id IN (SELECT user_id FROM split WHERE split = 'train')),
e AS (SELECT user_id, generate_subscripts(vec, 1) AS pos, unnest(vec)::DOUBLE AS x FROM split JOIN items ON item = parent_asin WHERE split = 'train'),
m AS (SELECT user_id, list(x ORDER BY pos) AS v FROM (SELECT user_id, pos, avg(x) AS x FROM e GROUP BY ALL) GROUP BY 1),
mu AS (SELECT user_id, list_transform(v, lambda y: y / CASE WHEN n > 1e-9 THEN n ELSE 1 END) AS v FROM (SELECT *, sqrt({_dot('v', 'v')}) AS n FROM m)),
q AS (SELECT t.*, coalesce(v, list_transform(range(64), lambda i: 0.0::DOUBLE)) AS v FROM t LEFT JOIN mu USING (user_id)),
r AS (SELECT user_id, query_parent_asin, label, item, score, CAST(row_number() OVER (PARTITION BY user_id, query_parent_asin ORDER BY score DESC, item) AS INTEGER) AS rank FROM (SELECT user_id, query_parent_asin, label, item, round({_dot('v', 'vec')}, 9) AS score FROM q, uitems) QUALIFY rank <= 10)
SELECT user_id, query_parent_asin, item AS candidate_parent_asin, round(score, 5) + 0.0::DOUBLE AS faiss_score, rank AS faiss_rank, CASE WHEN item = query_parent_asin THEN label ELSE 0 END AS relevance_label, 0 AS is_forced_positive FROM r
UNION ALL SELECT user_id, query_parent_asin, query_parent_asin, 0.0::DOUBLE, 11, label, 1 FROM q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = q.user_id AND r.query_parent_asin = q.query_parent_asin AND item = q.query_parent_asin)"""


def _f(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN {c}::DOUBLE END"


_PSIDE = f"""ps AS (SELECT trim(parent_asin) AS c, {_f('average_rating')} AS rating, rating_number::DOUBLE AS nr, review_count::DOUBLE AS nv, {_f('mean_sentiment')} AS sent, CASE WHEN price >= 0 THEN price END AS price, {_f('hidden_gem_score')} AS gem,
  coalesce({_f('controversy_index')}, {_f('std_sentiment')}) AS contro, {_f('desc_richness_score')} AS rich, {", ".join(f"{_f(f'mean_aspect_{a}')} AS p_{a}" for a in ASPECTS)}, leaf_category AS cat, price_tier AS tier, top_aspect AS best,
  CASE sentiment_trajectory WHEN 'rising' THEN 1.0 WHEN 'controversial' THEN 0.25 WHEN 'declining' THEN 0.0 ELSE 0.5 END AS traj, {_f('verified_ratio')} AS ver, {_f('helpfulness_weighted_sentiment')} AS wsent FROM products_nlp)"""
_USIDE = f"""us0 AS (SELECT DISTINCT ON (user_id) trim(user_id) AS user_id, interaction_count::DOUBLE AS n, {_f('user_avg_sentiment')} AS us, {", ".join(f"{_f(f'user_aspect_{a}')} AS u_{a}" for a in ASPECTS)}, top_categories AS cats, preferred_price_tier AS ut, user_top_aspect AS ua,
  {", ".join(f"{_usable(f'{e}_embedding')} AS v_{e}" for e in ('uniform', 'recency', 'rating', 'combined'))} FROM user_profiles)"""
_GIVEN = f"""given AS (SELECT user_id, query_parent_asin, candidate_parent_asin, max(relevance_label) AS relevance_label, max(is_forced_positive) AS is_forced_positive, max({_f('f01_faiss_score')}) AS s1, max({_f('f02_faiss_rank')}) AS s2 FROM features_test GROUP BY ALL)"""
_LOG = "CASE WHEN {0} IS NOT NULL THEN ln(1 + greatest({0}, 0)) END"
_COS = "coalesce(" + _dot("{0}", "i.vec") + ", 0)"
_VALUES = [
    "s1", "s2", _COS.format("qv.vec"), _COS.format("v_uniform"), "rating", _LOG.format("nr"), _LOG.format("nv"), "sent", "price", "gem", "contro", "rich", *[f"coalesce(p_{a}, u_{a}, 0)" for a in ASPECTS], "0", "coalesce(list_contains(cats, cat), false)::INT",
    "coalesce(ut = tier AND tier <> '', false)::INT", "abs(us - sent)", "coalesce(ua = best AND ua <> '', false)::INT", "ln(1 + greatest(coalesce(n, 0), 0))", "coalesce(traj, 0.5)", "ver", "wsent", "is_forced_positive", _COS.format("v_recency"), _COS.format("v_rating"), _COS.format("v_combined"), "0",
]
_WIDE_FROM = "FROM given g LEFT JOIN ps ON ps.c = candidate_parent_asin LEFT JOIN us0 USING (user_id) LEFT JOIN uitems i ON i.item = candidate_parent_asin LEFT JOIN uitems qv ON qv.item = query_parent_asin"
_WIDE = f"{ITEMS}, {_PSIDE}, {_USIDE}, {_GIVEN}, wide AS (SELECT user_id, query_parent_asin, candidate_parent_asin, relevance_label, is_forced_positive, {', '.join(f'CAST({v} AS DOUBLE) AS {n}' for v, n in zip(_VALUES, FEATURES))} {_WIDE_FROM})"

_RANGES: dict[int, tuple[str, str, str]] = {1: ("-1", "1", "0.3"), 2: ("0.005", "1", "0.5"), 5: ("1", "5", "median(rating)"), 6: ("0", "max(lnr)", "median(lnr)"), 7: ("0", "max(lnv)", "median(lnv)"), 8: ("-1", "1", "median(sent)"), 9: ("0", "quantile_cont(price, 0.99)", "median(price)"), 10: ("min(gem)", "max(gem)", "median(gem)"), 11: ("0", "max(contro)", "median(contro)"), 12: ("0", "1", "median(rich)"), 21: ("0", "greatest(abs(any_value(ux) - min(sent)), abs(any_value(un) - max(sent)))", "any_value(ud)"), 23: ("0", "any_value(u23)", "0"), 24: ("0", "1", "0.5"), 25: ("0", "1", "median(ver)"), 26: ("-1", "1", "median(wsent)")}
_RANGES |= {i: ("-1", "1", "0") for i in (3, 4, 18, 28, 29, 30)} | {i: ("0", "1", "0") for i in (19, 20, 22, 27, 31)} | {13 + i: ("-1", "1", f"median(p_{a})") for i, a in enumerate(ASPECTS)}
_FSTATS = f"""{_PSIDE}, pl AS (SELECT *, ln(1 + greatest(coalesce(nr, 0), 0)) AS lnr, ln(1 + greatest(coalesce(nv, 0), 0)) AS lnv FROM ps), ur AS (SELECT max({_f('user_avg_sentiment')}) AS ux, min({_f('user_avg_sentiment')}) AS un, stddev_samp({_f('user_avg_sentiment')}) AS ud, max(ln(1 + greatest(interaction_count, 0))) AS u23 FROM user_profiles),
fs AS ({" UNION ".join(f"SELECT '{FEATURES[i - 1]}' AS feature, CAST({lo} AS DOUBLE) AS min, CAST({hi} AS DOUBLE) AS max, coalesce(CAST({fill} AS DOUBLE), 0) AS fill FROM pl, ur" for i, (lo, hi, fill) in sorted(_RANGES.items()))})"""

_FSTATS_ONLY = _FSTATS[_FSTATS.index("pl AS (") :]


def _scaled(n: str) -> str:
    get = lambda c: f"(SELECT {c} FROM fs WHERE feature = '{n}')"
    span = f"({get('max')} - {get('min')})"
    return f"round(CASE WHEN {span} IS NULL OR {span} < 1e-9 THEN 0 ELSE greatest(least((coalesce({n}, {get('fill')}) - {get('min')}) / {span}, 1), 0) END, 5) + 0.0::DOUBLE AS {n}"


_LAB = f"lab AS (SELECT user_id, query_parent_asin, candidate_parent_asin, max(relevance_label) AS relevance_label, {', '.join(f'max({_f(n)}) AS {n}' for n in FEATURES)} FROM features_test GROUP BY ALL)"
_METRIC = [*[f"ndcg_{k}" for k in (1, 5, 10)], *[f"hr_{k}" for k in (1, 5, 10)], "mrr", "recall_10"]


def _metrics(source: str, by: str = "") -> str:
    keys = f"{by}user_id, query_parent_asin"
    ndcg = lambda k: f"CASE WHEN sum(CASE WHEN i <= {k} THEN g / log2(i + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN r <= {k} THEN g / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= {k} THEN g / log2(i + 1) ELSE 0 END) ELSE 0 END AS ndcg_{k}"
    return f"""rk AS (SELECT *, pow(2, relevance_label) - 1 AS g, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC NULLS LAST, candidate_parent_asin) AS r, row_number() OVER (PARTITION BY {keys} ORDER BY relevance_label DESC, candidate_parent_asin) AS i FROM {source}),
pq AS (SELECT {keys}, {", ".join(ndcg(k) for k in (1, 5, 10))}, {", ".join(f"max(CASE WHEN r <= {k} AND relevance_label > 0 THEN 1.0 ELSE 0.0 END) AS hr_{k}" for k in (1, 5, 10))}, coalesce(1.0::DOUBLE / min(r) FILTER (WHERE relevance_label > 0), 0) AS mrr,
  sum(CASE WHEN r <= 10 THEN relevance_label ELSE 0 END) / sum(relevance_label)::DOUBLE AS recall_10 FROM rk GROUP BY ALL HAVING sum(relevance_label) > 0)"""


def _macro(by: str) -> str:
    return f"mc AS (SELECT {by}, {', '.join(f'avg({m}) AS {m}' for m in _METRIC)}, stddev_pop(ndcg_10) AS ndcg_10_std, count(*) AS evaluated_queries FROM pq GROUP BY ALL)"


_WEIGHTS = {1: 1.0, 5: 0.1, 8: 0.2, 13: 0.3, 18: 0.1, 24: 0.2, 30: 0.3, 31: 0.2}


def _linear(zero: list[int]) -> str:
    return "round(" + " + ".join(f"{w}::DOUBLE * " + ("0" if i in zero else f"coalesce({FEATURES[i - 1]}, 0)") for i, w in _WEIGHTS.items()) + ", 6)"


def _systems(scores: dict[str, str], name: str = "system") -> str:
    return "sy AS (" + " UNION ALL ".join(f"SELECT '{n}' AS {name}, user_id, query_parent_asin, candidate_parent_asin, relevance_label, CAST({s} AS DOUBLE) AS score FROM lab" for n, s in scores.items()) + ")"


_RANDOM = "((('0x' || substr(md5(concat_ws('|', user_id, query_parent_asin, candidate_parent_asin)), 1, 8))::BIGINT * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE"
_CHANGE = lambda m: f"CASE WHEN b.{m} > 0 THEN (a.{m} - b.{m}) / b.{m} * 100 ELSE 0 END"


def _r(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n}" for n in names)


_BOOST = f"""WITH {_GIVEN}, r0 AS (SELECT concat_ws('|', user_id, query_parent_asin) AS query_id, candidate_parent_asin AS item, s1 AS score FROM given WHERE s1 IS NOT NULL),
p AS (SELECT parent_asin AS item, coalesce(leaf_category, 'unknown') AS cat, {_f('hidden_gem_score')} AS gem, {_f('category_sentiment_percentile')} AS pct FROM products_nlp),
r1 AS (SELECT query_id, item, score, coalesce(cat, 'unknown') AS cat, coalesce(gem, 0) AS gem, coalesce(pct / 100, 0.5) AS pct FROM r0 LEFT JOIN p USING (item)),
r2 AS (SELECT *, round(0.2::DOUBLE * ((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-9)) + 0.5::DOUBLE * ((gem - min(gem) OVER w) / (max(gem) OVER w - min(gem) OVER w + 1e-9)) + 0.3::DOUBLE * pct, 9) AS boost_score FROM r1 WINDOW w AS (PARTITION BY query_id)),
r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boost_score DESC, item) AS pl, row_number() OVER (PARTITION BY query_id, cat ORDER BY boost_score DESC, item) = 1 AS fi FROM r2),
r4 AS (SELECT *, sum((pl <= 10 AND fi)::INT) OVER (PARTITION BY query_id) AS cats, row_number() OVER (PARTITION BY query_id, fi AND pl > 10 ORDER BY boost_score DESC, item) AS fr FROM r3),
r5 AS (SELECT *, fi AND pl > 10 AND fr <= greatest(0, 3 - cats) AS mv FROM r4), r6 AS (SELECT *, sum(mv::INT) OVER (PARTITION BY query_id) AS moved FROM r5)
SELECT query_id, item, boost_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN mv THEN 1 WHEN pl <= 10 - moved THEN 0 ELSE 2 END, boost_score DESC, item) AS INTEGER) AS place FROM r6 QUALIFY place <= 10"""

_DIVERSE = """WITH p AS (SELECT user_id, max(interaction_count) AS n, max(array_to_string(top_categories, ', ')) AS cats FROM user_profiles WHERE user_id IN (SELECT user_id FROM features_test) GROUP BY 1),
k AS (SELECT * FROM (SELECT 0 AS i, 'power' AS label, user_id FROM p ORDER BY n DESC, user_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 1, 'light', user_id FROM p WHERE n >= 5 ORDER BY n, user_id LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 2, 'role_playing', user_id FROM p WHERE regexp_matches(cats, '(?i)Role|RPG') ORDER BY user_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 3, 'shooter', user_id FROM p WHERE regexp_matches(cats, '(?i)Shoot|Action|FPS') ORDER BY user_id LIMIT 1)),
a AS (SELECT * FROM k UNION ALL SELECT 10 + row_number() OVER (ORDER BY md5(concat_ws('|', user_id, '42')), user_id), 'other', user_id FROM p WHERE user_id NOT IN (SELECT user_id FROM k)),
o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i) = 1)
SELECT label, user_id FROM o ORDER BY i LIMIT 5"""


def _words(c: str, words: list[str]) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower({c}), '\\b(' || '{'|'.join(sorted(words, key=lambda w: (-len(w), w)))}' || ')\\b', 1))), ',')"


_EXPANDED = "list_concat(" + ", ".join(f"CASE WHEN regexp_matches(q, '(?i)\\b{k}\\b') THEN {v!r} ELSE CAST([] AS VARCHAR[]) END" for k, v in EXPANSIONS.items()) + ")"
_ORDERED = "list_transform(list_filter(list_zip(e, range(1, len(e) + 1)), lambda p: list_position(e, p[1]) = p[2]), lambda p: p[1])"
_QU = f"""WITH {META}, q AS (SELECT trim(concat_ws(' ', title, description)) AS q FROM meta_c), x AS (SELECT q, {_EXPANDED} AS e, {_words('q', INTENTS)} AS intent, {_words('q', ATTRIBUTES)} AS attributes FROM q),
y AS (SELECT *, {_ORDERED} AS ex FROM x)
SELECT q AS raw_query, intent, attributes, TRY_CAST(nullif(regexp_extract(q, '{MAX_PRICE}', 1), '') AS DOUBLE) AS max_price, TRY_CAST(nullif(regexp_extract(q, '{MIN_PRICE}', 1), '') AS DOUBLE) AS min_price,
  TRY_CAST(nullif(regexp_extract(q, '{APPROX_PRICE}', 1), '') AS DOUBLE) AS approx_price, CASE WHEN regexp_matches(q, '{LOW}') THEN 'low' WHEN regexp_matches(q, '{HIGH}') THEN 'high' END AS price_preference,
  array_to_string(ex, ',') AS expanded, concat_ws(' ', q, nullif(array_to_string(ex, ' '), ''), nullif(replace(attributes, ',', ' '), '')) AS final_query FROM y"""

SQL: dict[str, str] = {
    "user_interactions": f"WITH {_STATS} SELECT user_id, interaction_count, {nums('avg_rating_given', 'rating_std', 'first_interaction_ts', 'last_interaction_ts', 'active_days')}, {num('interaction_count / greatest(active_days, 1)', 'interaction_velocity')}, {num('recency_score')} FROM us",
    "user_preferences": _PREFS,
    "user_review_signals": _SIGNALS,
    "user_vectors": _USER_VECTORS,
    "cold_start_tiers": f"WITH {_TIERS} SELECT user_id, cold_start_tier, {num('CASE cold_start_tier WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.7 END', 'query_weight')}, {num('CASE cold_start_tier WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 ELSE 0.3 END', 'user_weight')}, is_active FROM ti",
    "tier_distribution": f"WITH {_TIERS} SELECT cold_start_tier, count(*) AS n_users, round(count(*) / (SELECT count(*) FROM ti)::DOUBLE * 100, 4) AS percent FROM ti GROUP BY 1",
    "lambda_diagnostic": _LAMBDA,
    "blended_queries": _BLENDED,
    "vector_norms": f"WITH {ITEMS} SELECT item, {num('n', 'norm')}, {num('CASE WHEN n > 1e-9 THEN 1 ELSE n END', 'unit_norm')} FROM nrm",
    "norm_check": f"WITH {ITEMS} SELECT count(*) AS n_vectors, {num('max(abs(n - 1))', 'max_deviation')}, coalesce(max(abs(n - 1)) > 1e-4, false) AS needs_renormalising FROM nrm",
    "exact_topk": f"WITH {_TOPK} SELECT query_id, item, rank, {num('score')} FROM k",
    "single_query_topk": f"WITH {_TOPK} SELECT item, {num('score')}, rank FROM k WHERE query_id = '0'",
    "self_recall": f"WITH {_TOPK}, h AS (SELECT query_id, max((item = query_id)::INT) AS hit FROM k GROUP BY 1) SELECT count(*) AS n_queries, round(avg(hit), 6) AS self_recall FROM h",
    "home_feed": _FEED,
    "candidates_forced": _CANDS,
    "features_wide": f"WITH {_WIDE} SELECT user_id, query_parent_asin, candidate_parent_asin, relevance_label, is_forced_positive, {_r(5, *FEATURES)} FROM wide",
    "feature_stats": f"WITH {_FSTATS} SELECT feature, {_r(5, 'min', 'max', 'fill')} FROM fs",
    "features_scaled": f"WITH {_WIDE}, {_FSTATS_ONLY} SELECT user_id, query_parent_asin, candidate_parent_asin, relevance_label, is_forced_positive, {', '.join(_scaled(n) for n in FEATURES)} FROM wide",
    "feature_nulls": f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) FILTER (WHERE {n} IS NULL) AS n_rows FROM wide" for n in FEATURES)
    + " UNION ALL SELECT 'positives', count(*) FILTER (WHERE relevance_label > 0) FROM wide UNION ALL SELECT 'forced', CAST(sum(is_forced_positive) AS BIGINT) FROM wide",
    "query_metrics": f"WITH {_LAB}, sc AS (SELECT *, f01_faiss_score AS score FROM lab), {_metrics('sc')} SELECT user_id, query_parent_asin, {nums(*_METRIC)} FROM pq",
    "query_counts": f"WITH {_LAB}, g AS (SELECT user_id, query_parent_asin, max((relevance_label > 0)::INT) AS p FROM lab GROUP BY ALL) SELECT count(*) AS total_queries, CAST(coalesce(sum(p), 0) AS BIGINT) AS evaluated_queries, count(*) FILTER (WHERE p = 0) AS skipped_queries FROM g",
    "system_comparison": f"WITH {_LAB}, {_systems({'random': _RANDOM, 'bm25': 'f31_bm25_score', 'ann': 'f01_faiss_score', 'linear': _linear([])})}, {_metrics('sy', 'system, ')}, {_macro('system')} SELECT system, {nums(*_METRIC, 'ndcg_10_std')}, evaluated_queries FROM mc",
    "relative_improvement": f"WITH {_LAB}, {_systems({'bm25': 'f31_bm25_score', 'ann': 'f01_faiss_score'})}, {_metrics('sy', 'system, ')}, {_macro('system')} SELECT a.system, {', '.join(f'round({_CHANGE(m)}, 4) + 0.0::DOUBLE AS {m}_change' for m in _METRIC)} FROM mc a, (SELECT * FROM mc WHERE system = 'ann') b",
    "version_comparison": f"WITH {_LAB}, {_systems({'second': 'f31_bm25_score', 'first': 'f01_faiss_score'})}, {_metrics('sy', 'system, ')}, {_macro('system')} "
    + " UNION ALL ".join(f"SELECT 'model' AS system, '{m}' AS metric, round(b.{m}, 4) + 0.0::DOUBLE AS first, round(a.{m}, 4) + 0.0::DOUBLE AS second, round({_CHANGE(m)}, 4) + 0.0::DOUBLE AS change FROM (SELECT * FROM mc WHERE system = 'second') a, (SELECT * FROM mc WHERE system = 'first') b" for m in _METRIC),
    "ablation_metrics": f"WITH {_LAB}, {_systems({n: _linear(z) for n, z in ABLATIONS.items()}, 'config')}, {_metrics('sy', 'config, ')}, {_macro('config')} SELECT a.config, {', '.join(f'round(a.{m}, 4) + 0.0::DOUBLE AS {m}' for m in [*_METRIC, 'ndcg_10_std'])}, a.evaluated_queries, round({_CHANGE('ndcg_10')}, 4) + 0.0::DOUBLE AS ndcg_10_change FROM mc a, (SELECT * FROM mc WHERE config = 'full') b",
    "cold_start_boost": _BOOST,
    "diverse_users": _DIVERSE,
    "user_reasons": f"""WITH {META}, {_LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, query_parent_asin ORDER BY {_linear([])} DESC, candidate_parent_asin) AS m FROM lab),
t AS (SELECT r.*, coalesce(title, candidate_parent_asin) AS first_title FROM r LEFT JOIN meta_c ON meta_c.parent_asin = candidate_parent_asin WHERE m = 1),
u AS ({" UNION ALL ".join(f"SELECT user_id, query_parent_asin, first_title, '{f}' AS f, coalesce({f}, 0) AS v FROM t" for f in FEATURES)}),
k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id, query_parent_asin ORDER BY v DESC, f) <= 5)
SELECT user_id, query_parent_asin, first_title, string_agg(f, ',' ORDER BY v DESC, f) AS reasons FROM k GROUP BY ALL""",
    "query_version_comparison": f"WITH {_LAB}, {_systems({'second': 'f31_bm25_score', 'first': 'f01_faiss_score'})}, {_metrics('sy', 'system, ')} SELECT a.user_id, a.query_parent_asin, {num('a.ndcg_10', 'first')}, {num('b.ndcg_10', 'second')}, {num('b.ndcg_10 - a.ndcg_10', 'change')} FROM pq a JOIN pq b ON a.user_id = b.user_id AND a.query_parent_asin = b.query_parent_asin WHERE a.system = 'first' AND b.system = 'second'",
    "recent_history": f"WITH {REVIEWS} SELECT user_id, parent_asin, rating, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC NULLS LAST, parent_asin DESC) AS place FROM revc QUALIFY place <= 10",
    "user_report": f"""WITH {_LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, query_parent_asin ORDER BY f01_faiss_score DESC NULLS LAST, candidate_parent_asin) AS a, row_number() OVER (PARTITION BY user_id, query_parent_asin ORDER BY {_linear([])} DESC, candidate_parent_asin) AS m FROM lab)
SELECT user_id, query_parent_asin, string_agg(candidate_parent_asin, ',' ORDER BY a) FILTER (WHERE a <= 5) AS top_by_retrieval, string_agg(candidate_parent_asin, ',' ORDER BY m) FILTER (WHERE m <= 5) AS top_by_model,
  CAST(min(a) FILTER (WHERE relevance_label > 0) AS INTEGER) AS truth_rank_retrieval, CAST(min(m) FILTER (WHERE relevance_label > 0) AS INTEGER) AS truth_rank_model, coalesce(min(a) FILTER (WHERE relevance_label > 0) <= 10, false) AS in_top10_retrieval, coalesce(min(m) FILTER (WHERE relevance_label > 0) <= 10, false) AS in_top10_model FROM r GROUP BY ALL""",
    "product_comparison": "WITH t AS (SELECT *, row_number() OVER (ORDER BY parent_asin) AS i FROM products_nlp QUALIFY i <= 3) " + " UNION ALL ".join(f"SELECT '{c}' AS signal, {', '.join(f'round(CAST(max({c}) FILTER (WHERE i = {i}) AS DOUBLE), 4) + 0.0::DOUBLE AS product_{i}' for i in (1, 2, 3))} FROM t" for c in COMPARED),
    "token_statistics": f"WITH {META}, n AS (SELECT len({tokens(chr(39) + chr(39) + ' || concat_ws(chr(32), title, description)')}) AS n FROM meta_c) SELECT count(*) AS n_documents, CAST(min(n) AS INTEGER) AS min_tokens, round(avg(n), 6) AS mean_tokens, CAST(max(n) AS INTEGER) AS max_tokens, count(*) FILTER (WHERE n > 512) AS over_budget FROM n",
    "query_understanding": _QU,
}
