"""Cleaning of product metadata and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import columns as C

META = ["parent_asin", "title", "description", "features", "price", "store", "categories", "average_rating", "rating_number"]


def _string_columns(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array<string>"):
            c = C.flatten_list(c)
        out.append((C.squeeze(c) if kind in ("string",) or kind.startswith("array<string>") else c).alias(name))
    return df.select(*out)


def clean_meta(meta: DataFrame) -> DataFrame:
    """One row per product: lists flattened, white space normalised, title fallback, price parsed.

    Null and blank keys are dropped; of repeated keys the first in the order of all cleaned columns is kept. Extra columns are left out.
    """
    m = _string_columns(meta.select(*[c for c in META if c in meta.columns]))
    m = m.withColumn("parent_asin", C.key(F.col("parent_asin"))).filter(F.col("parent_asin").isNotNull())
    m = m.withColumn("price", C.parse_price(F.col("price")))
    m = m.withColumn("title", F.coalesce(C.key(F.col("title")), F.col("parent_asin")))
    order = [F.col(c).asc_nulls_last() for c in m.columns if c != "parent_asin"]
    w = Window.partitionBy("parent_asin").orderBy(*order)
    return m.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def valid_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with both keys and a rating in 1..5; text normalised ('' for null), numbers coerced."""
    r = reviews.select(
        *(["review_id"] if "review_id" in reviews.columns else []),
        C.key(F.col("user_id")).alias("user_id"),
        C.key(F.col("parent_asin")).alias("parent_asin"),
        C.to_number(F.col("rating")).alias("rating"),
        F.coalesce(C.squeeze(F.col("text")), F.lit("")).alias("text"),
        C.to_number(F.col("timestamp")).alias("timestamp"),
        C.to_number(F.col("helpful_vote")).alias("helpful_vote"),
        C.truthy(F.col("verified_purchase")).alias("verified_purchase"),
    )
    return r.dropna(subset=["user_id", "parent_asin", "rating"]).filter(F.col("rating").between(1, 5))


def latest_per_pair(reviews: DataFrame, tie: str = "review_id") -> DataFrame:
    """The latest review of each (user, product): timestamp descending, nulls last, then ``tie`` descending.

    The window is pruned by a group limit before the exchange, so a pair delivered many times leaves a task once.
    """
    w = Window.partitionBy("user_id", "parent_asin").orderBy(F.col("timestamp").desc_nulls_last(), F.col(tie).desc_nulls_last())
    return reviews.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def clean_reviews(reviews: DataFrame) -> DataFrame:
    return latest_per_pair(valid_reviews(reviews))


def text_measures(meta: DataFrame) -> DataFrame:
    """Derived text columns of products: leaf category, path, feature count, richness, word count."""
    return meta.select(
        "parent_asin",
        C.leaf_category(F.col("categories")).alias("leaf_category"),
        C.category_path(F.col("categories")).alias("full_category_path"),
        F.size(C.parts(F.col("features"))).cast("short").alias("feature_count"),
        F.round(C.richness(F.col("description")), 6).alias("desc_richness_score"),
        C.word_count(F.col("description")).alias("description_words"),
    )
