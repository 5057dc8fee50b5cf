"""Per-key results when a few keys hold most rows: two-stage salted aggregation.

Stage 0 counts rows per key (map-side combined, so a hot key leaves each task as one row) and keeps
the keys whose share reaches ``heavy_share``; at most ``1 / heavy_share`` keys can, so the list
has a proven bound and is broadcast. Stage 1 spreads the rows of those keys over ``salts`` partial groups. Stage 2
merges the partials under the original key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 0.005
SALTS = 64


def clean_key(column: Column | str) -> Column:
    """Trimmed key; blank becomes null (a row without a key)."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    return F.when(c != "", c)


def heavy_keys(df: DataFrame, keys: list[str], heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Keys (null excluded in the last column) owning at least ``heavy_share`` of all rows.

    At most ``1 / heavy_share`` rows per leading key combination of a fixed set; empty input gives no rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    groups = keys[:-1]
    total = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))  # from the counts: the table is not read again
    joined = counts.join(F.broadcast(total), groups) if groups else counts.crossJoin(F.broadcast(total))
    return (
        joined.filter(F.col(keys[-1]).isNotNull() & (F.col("_n") >= F.lit(heavy_share) * F.col("_total")))
        .select(*keys, F.lit(True).alias("_heavy"))
    )


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    partials: dict[str, Column],
    merges: dict[str, Column],
    spread: Column,
    heavy_share: float = HEAVY_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """One row per key combination; ``partials`` are computed per (key, salt), ``merges`` over them.

    ``spread`` is hashed into the salt of heavy keys. It must be a function of the row, not a draw: a
    task that runs again then sends every row where it went the first time. A partial that counts distinct values
    stays exact when ``spread`` is that value, since each value then meets one salt only.
    Rows with a null key form a group of their own (salted like heavy ones). An empty table gives no rows.
    """
    heavy = heavy_keys(df, keys, heavy_share)
    salt = F.when(
        F.col("_heavy") | F.col(keys[-1]).isNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    ).otherwise(F.lit(0))
    salted = df.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt)
    first = salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partials.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merges.items()])


def review_key_rows(reviews: DataFrame) -> DataFrame:
    """Each review twice: under its product and under its user."""
    rating = F.when(F.col("rating").between(1, 5) & ~F.isnan("rating"), F.col("rating"))
    product, user = clean_key("parent_asin"), clean_key("user_id")
    base = reviews.select(
        F.explode(
            F.array(
                F.struct(F.lit("reviews.parent_asin").alias("field"), product.alias("key_value"), user.alias("other")),
                F.struct(F.lit("reviews.user_id").alias("field"), user.alias("key_value"), product.alias("other")),
            )
        ).alias("k"),
        "review_id",
        rating.alias("rating"),
        F.coalesce("helpful_vote", F.lit(0)).alias("votes"),
        F.coalesce(F.col("verified_purchase").cast("int"), F.lit(0)).alias("verified"),
        F.length("text").alias("chars"),
    )
    return base.select("k.field", "k.key_value", "k.other", *base.columns[1:])


def key_summary(reviews: DataFrame, heavy_share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """Counts, means and distinct partners of every product and user of a review table.

    Keys are trimmed; null or blank keys own one row per field with ``key_value`` null. Ratings that are null, NaN or outside
    1..5 count as rows but not as ratings; a key without ratings has null mean. Null votes count 0.
    """
    rows = review_key_rows(reviews)
    partials = {
        "n": F.count(F.lit(1)),
        "rated": F.count("rating"),
        "rating_sum": F.sum("rating"),
        "votes": F.sum("votes"),
        "verified": F.sum("verified"),
        "chars": F.sum("chars"),
        "partners": F.countDistinct("other"),
        "top_rating": F.max("rating"),
        "low_rating": F.min("rating"),
    }
    merges = {
        "n_rows": F.sum("n"),
        "n_rated": F.sum("rated"),
        "mean_rating": F.round(F.sum("rating_sum") / F.sum("rated"), 6),
        "helpful_votes": F.sum("votes"),
        "verified_rows": F.sum("verified"),
        "text_chars": F.coalesce(F.sum("chars"), F.lit(0)),
        "n_partners": F.sum("partners"),
        "max_rating": F.max("top_rating"),
        "min_rating": F.min("low_rating"),
    }
    spread = F.coalesce("other", "review_id", F.lit(""))
    return salted_aggregate(rows, ["field", "key_value"], partials, merges, spread, heavy_share, salts)


def dominant_keys(reviews: DataFrame, share: float = 0.02) -> DataFrame:
    """Keys owning at least ``share`` of all rows of the table, from the salted counts.

    Rows without a key count in the total. Empty table: no rows.
    """
    rows = review_key_rows(reviews).select("field", "key_value", "review_id")
    counted = salted_aggregate(
        rows,
        ["field", "key_value"],
        {"n": F.count(F.lit(1))},
        {"n_rows": F.sum("n")},
        F.coalesce("review_id", F.lit("")),
    )
    total = counted.filter(F.col("field") == "reviews.parent_asin").agg(F.sum("n_rows").alias("total"))  # one row; every review counts once in either field
    return (
        counted.crossJoin(F.broadcast(total))
        .filter(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("total")))
        .select("field", "key_value")
    )


def heavy_limit(heavy_share: float = HEAVY_SHARE) -> int:
    """Most rows ``heavy_keys`` can return for one leading key."""
    return math.floor(1 / heavy_share)
