"""The SQL that registered queries must equal, where SQL can express them on whole tables."""

from __future__ import annotations

_ONE = """
one AS (
  SELECT user_id, query_parent_asin, candidate_parent_asin, max(f01) AS f01, max(f31) AS f31, max(f05) AS f05
  FROM (SELECT *, CASE WHEN NOT isnan(f01_faiss_score) THEN CAST(f01_faiss_score AS DOUBLE) END AS f01,
    CASE WHEN NOT isnan(f31_bm25_score) THEN CAST(f31_bm25_score AS DOUBLE) END AS f31,
    CASE WHEN NOT isnan(f05_avg_rating) THEN CAST(f05_avg_rating AS DOUBLE) END AS f05 FROM features_test)
  GROUP BY ALL
)"""

_PLACES = f"""{_ONE},
placed AS (
  SELECT user_id, query_parent_asin, candidate_parent_asin,
    rank() OVER (PARTITION BY user_id, query_parent_asin ORDER BY f01 DESC NULLS LAST) AS place_f01_faiss_score,
    rank() OVER (PARTITION BY user_id, query_parent_asin ORDER BY f31 DESC NULLS LAST) AS place_f31_bm25_score,
    rank() OVER (PARTITION BY user_id, query_parent_asin ORDER BY f05 DESC NULLS LAST) AS place_f05_avg_rating,
    count(*) OVER (PARTITION BY user_id, query_parent_asin) AS n_items
  FROM one
),
summed AS (SELECT *, place_f01_faiss_score + place_f31_bm25_score + place_f05_avg_rating AS place_sum FROM placed)"""

_TOP = f"""WITH {_ONE},
ranked AS (
  SELECT user_id, query_parent_asin, candidate_parent_asin,
    row_number() OVER (PARTITION BY user_id, query_parent_asin ORDER BY f01 DESC NULLS LAST, candidate_parent_asin) AS place FROM one
)"""

_WORDS = """
words AS (
  SELECT nullif(trim(parent_asin), '') AS parent_asin, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS term FROM reviews
)"""


def _listed(column: str) -> str:
    return f"""
listed AS (
  SELECT nullif(trim(parent_asin), '') AS parent_asin,
    unnest(list_distinct(list_transform(string_split(lower({column}), ','), lambda x: trim(x)))) AS term FROM products_nlp
)"""


def _scores(source: str, table: str) -> str:
    return f"""
tf AS (SELECT term, parent_asin, count(*) AS tf FROM {source} WHERE term <> '' GROUP BY ALL),
st AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(parent_asin) AS df FROM tf GROUP BY term),
n AS (SELECT greatest(count(DISTINCT nullif(trim(parent_asin), '')), 1) AS n FROM {table}),
sc AS (
  SELECT parent_asin, term, tf, df, cf,
    round(-log2(df / CAST(greatest(n, df) AS DOUBLE)) + log2(1.0::DOUBLE - exp(-cf / CAST(greatest(n, df) AS DOUBLE))), 6) + 0.0::DOUBLE AS ridf
  FROM tf JOIN st USING (term), n WHERE parent_asin IS NOT NULL
)"""


def _term_select(column: str) -> str:
    return f"(WITH {_listed(column)}, {_scores('listed', 'products_nlp')} SELECT *, round(tf * ridf, 6) + 0.0::DOUBLE AS score, 'products_nlp.{column}' AS field FROM sc)"


def _list_cases(column: str) -> str:
    return f"""(WITH {_listed(column)}, pairs AS (SELECT DISTINCT parent_asin, term FROM listed WHERE term <> '' AND parent_asin IS NOT NULL),
    few AS (SELECT term FROM pairs GROUP BY term HAVING count(*) IN (2, 3))
    SELECT 'products_nlp.{column}' AS field, parent_asin, term FROM pairs SEMI JOIN few USING (term))"""


def _nearest(name: str, table: str, key: str, column: str) -> str:
    """Exact nearest vectors of one set: id, other, cosine, place."""
    return f"""(WITH r AS (SELECT trim({key}) AS id, {column} AS v FROM {table} WHERE trim({key}) <> '' AND len({column}) = 64
  AND len(list_filter({column}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({column}, lambda x: x <> 0)) > 0),
u AS (SELECT id, max(v)::DOUBLE[] AS v FROM r GROUP BY id),
p AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM u a, u b WHERE a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS place FROM p WHERE cosine >= 0.85 QUALIFY place <= 5)
SELECT '{name}' AS vec_set, id, other, cosine, CAST(place AS INTEGER) AS place FROM k)"""


_NEAREST = f"near AS ({_nearest('item', 'item_embeddings', 'parent_asin', 'embedding')} UNION ALL {_nearest('user', 'user_profiles', 'user_id', 'combined_embedding')})"

_EDITED = """
texts AS (SELECT 'reviews.text' AS field, review_id AS id, text FROM reviews WHERE text IS NOT NULL
  UNION ALL SELECT 'meta_clean.description', trim(parent_asin), max(description) FROM meta_clean WHERE trim(parent_asin) <> '' AND description IS NOT NULL GROUP BY ALL),
cut AS (SELECT field, id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM texts),
runs AS (SELECT DISTINCT field, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM cut WHERE len(w) >= 40),
size AS (SELECT field, id, count(*) AS n FROM runs GROUP BY ALL),
shared AS (SELECT a.field, a.id AS id_a, b.id AS id_b, count(*) AS c FROM runs a JOIN runs b ON a.field = b.field AND a.g = b.g AND a.id < b.id GROUP BY ALL)"""


SQL: dict[str, str] = {
    "p2_found": f"WITH {_NEAREST} SELECT DISTINCT vec_set, least(id, other) AS id_a, greatest(id, other) AS id_b FROM near",
    "p2_nearest": f"WITH {_NEAREST} SELECT * FROM near",
    "p4_found": f"""WITH {_EDITED} SELECT shared.field, id_a, id_b FROM shared JOIN size x ON x.field = shared.field AND x.id = id_a JOIN size y ON y.field = shared.field AND y.id = id_b
WHERE c >= 0.5 * (x.n + y.n - c)""",
    "p3_found": f"""WITH {_WORDS}, g AS (SELECT parent_asin, term, count(*) AS n FROM words GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY term) AS total FROM g)
SELECT 'reviews.text' AS field, parent_asin, term FROM c WHERE parent_asin IS NOT NULL AND n >= 5 AND n >= 0.75 * total
UNION ALL {_list_cases("top_tfidf_phrases")} UNION ALL {_list_cases("distinctive_terms")}""",
    "p3_word_scores": f"WITH {_WORDS}, {_scores('words', 'reviews')} SELECT *, round(tf * ridf, 6) + 0.0::DOUBLE AS score FROM sc",
    "p3_term_scores": f"{_term_select('top_tfidf_phrases')} UNION ALL {_term_select('distinctive_terms')}",
    "p5_found": f"""WITH {_PLACES}
SELECT user_id, query_parent_asin, candidate_parent_asin FROM summed WHERE n_items >= 3
QUALIFY row_number() OVER (PARTITION BY user_id, query_parent_asin ORDER BY place_sum, candidate_parent_asin) = 1""",
    "p5_fused": f"""WITH {_PLACES}
SELECT *, round(1.0::DOUBLE / (60 + place_f01_faiss_score) + 1.0::DOUBLE / (60 + place_f31_bm25_score) + 1.0::DOUBLE / (60 + place_f05_avg_rating), 9) AS rrf FROM summed""",
    "p5_ranking": f"""WITH {_PLACES},
fused AS (SELECT *, round(1.0::DOUBLE / (60 + place_f01_faiss_score) + 1.0::DOUBLE / (60 + place_f31_bm25_score) + 1.0::DOUBLE / (60 + place_f05_avg_rating), 9) AS rrf FROM summed)
SELECT user_id, query_parent_asin, candidate_parent_asin, rrf, row_number() OVER (PARTITION BY user_id, query_parent_asin ORDER BY rrf DESC, candidate_parent_asin) AS position FROM fused""",
    "p6_found": f"{_TOP} SELECT user_id, query_parent_asin, candidate_parent_asin FROM ranked WHERE place <= 10",
    "p6_places": f"{_TOP} SELECT * FROM ranked WHERE place <= 10",
}
