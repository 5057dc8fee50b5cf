"""Building blocks of the comparison SQL: the same logical steps in plain DuckDB SQL."""

from __future__ import annotations

from lodestar.config import ASPECT_KEYWORDS, ASPECTS, LEXICON
from lodestar.functions.columns import SPACE

A = ASPECTS


def num(expr: str, name: str | None = None) -> str:
    """Rounded to 6 decimals, no negative zero."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0::DOUBLE AS {name or expr}"


def nums(*names: str) -> str:
    return ", ".join(num(n) for n in names)


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"


def parts(c: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({c}, ''), '.'), lambda v: trim(v)), lambda v: v <> '')"


def tokens(c: str) -> str:
    return f"list_filter(string_split({squeeze(f'coalesce({c}, chr(32))')}, ' '), lambda v: v <> '')"


_LEX_MAP = "MAP {" + ", ".join(f"'{w}': {v}::DOUBLE" for w, v in LEXICON.items()) + "}"
_LEX_RE = r"\b(" + "|".join(sorted(LEXICON, key=lambda w: (-len(w), w))) + r")\b"


def bag(c: str) -> str:
    s = f"coalesce(list_sum(list_transform(regexp_extract_all(lower({c}), '{_LEX_RE}', 1), lambda w: {_LEX_MAP}[w])), 0.0::DOUBLE)"
    return f"({s} / sqrt({s} * {s} + 15.0::DOUBLE))"


def aspect_re(a: str) -> str:
    return r"(?i)\b(?:" + "|".join(ASPECT_KEYWORDS[a]) + r")\b"


META = f"""
meta_s AS (
  SELECT nullif(trim({squeeze('parent_asin')}), '') AS parent_asin, {squeeze('title')} AS title0, {squeeze('description')} AS description, {squeeze('features')} AS features,
    TRY_CAST(nullif(regexp_extract(replace(CAST(price AS VARCHAR), ',', ''), '[0-9]+(\\.[0-9]+)?', 0), '') AS DOUBLE) AS price,
    {squeeze('store')} AS store, {squeeze('categories')} AS categories, average_rating, rating_number FROM meta_clean
),
meta_c AS (
  SELECT parent_asin, coalesce(nullif(title0, ''), parent_asin) AS title, description, features, price, store, categories, average_rating, rating_number
  FROM meta_s WHERE parent_asin IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY coalesce(nullif(title0, ''), parent_asin) NULLS LAST, description NULLS LAST, features NULLS LAST, price NULLS LAST, store NULLS LAST, categories NULLS LAST, average_rating NULLS LAST, rating_number NULLS LAST) = 1
)"""

REVIEWS = f"""
rev AS (
  SELECT review_id, nullif(trim(user_id), '') AS user_id, nullif(trim(parent_asin), '') AS parent_asin, rating, coalesce({squeeze('text')}, '') AS text,
    CAST(timestamp AS DOUBLE) AS timestamp, CAST(helpful_vote AS DOUBLE) AS helpful_vote, coalesce(verified_purchase, false) AS verified_purchase
  FROM reviews WHERE nullif(trim(user_id), '') IS NOT NULL AND nullif(trim(parent_asin), '') IS NOT NULL AND rating BETWEEN 1 AND 5 AND NOT isnan(rating)
),
revc AS (
  SELECT * FROM rev QUALIFY row_number() OVER (PARTITION BY user_id, parent_asin ORDER BY timestamp DESC NULLS LAST, review_id DESC NULLS LAST) = 1
)"""

_HITS = "\n    ".join(
    f"list_filter(sents, lambda s: regexp_matches(s, '{aspect_re(a)}')) AS h_{a}," for a in A
)
SCORED = f"""{REVIEWS},
sents AS (
  SELECT *, list_filter(string_split(regexp_replace(trim(text), '([.!?])[ ]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) >= 3) AS sents,
    {bag('text')} AS sentiment_score FROM revc
),
hits AS (SELECT *, {_HITS} 1 AS one FROM sents),
nlp AS (
  SELECT review_id, user_id, parent_asin, rating, text, timestamp, helpful_vote, verified_purchase, sentiment_score,
    CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
    {", ".join(f"CASE WHEN len(h_{a}) > 0 THEN list_sum(list_transform(h_{a}, lambda s: {bag('s')})) / len(h_{a}) END AS aspect_{a}" for a in A)}
  FROM hits
)"""

#: products_nlp with doubles and unusable values as null
PRODUCTS = "prod AS (SELECT * FROM products_nlp)"
