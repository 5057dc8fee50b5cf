"""How characteristic a term is of its record: residual inverse document frequency.

``ridf = observed idf - expected idf`` with observed ``-log2(df / N)`` and the Poisson expectation ``-log2(1 - exp(-cf / N))``; the score of a
term in a record is its frequency there times ``ridf``. A term scattered like chance (everyday words) has ridf near 0 whatever its
frequency; one concentrated in few records has a high one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.skew import clean_key

#: Allowance for rounding where ridf is compared with a bound; the exact test follows.
SLACK = 1e-9


def word_occurrences(reviews: DataFrame) -> DataFrame:
    """(parent_asin, term): each different word of each review once.

    A word is a maximal run of a-z, at least 3 letters, after lower-casing. Null and empty texts have none. Null or blank products stay null: their rows count in the collection.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    return reviews.select(clean_key("parent_asin").alias("parent_asin"), F.explode(words).alias("term"))


def listed_terms(products: DataFrame, column: str) -> DataFrame:
    """(parent_asin, term) of a comma-separated column: trimmed, lower-cased, inner blanks kept, empty entries dropped, each once per row."""
    terms = F.array_distinct(F.transform(F.split(F.lower(F.col(column)), ","), lambda t: F.trim(t)))
    return products.select(clean_key("parent_asin").alias("parent_asin"), F.explode(terms).alias("term")).filter(F.col("term") != "")


def residual(df: Column, cf: Column, n: Column) -> Column:
    """Observed minus expected idf of a term with ``df`` records and ``cf`` occurrences among ``n`` records."""
    return F.log2(n / df) + F.log2(-F.expm1(-cf / n))


def residual_idf(occurrences: DataFrame, n_records: DataFrame, least_record_frequency: int = 1, least_share: float = 0.0, most_records: int | None = None) -> DataFrame:
    """Score of every (record, term) of ``occurrences``, one input row per occurrence.

    ``n_records`` is a one-row frame with the number of records as ``n``. Output: parent_asin, term, tf (occurrences in the record), df (records with the
    term), cf (occurrences in the collection, those without a record included), ridf, score. Occurrences are counted per (record, term) with map-side
    combine before anything is joined; the join side of an everyday word has one row per record, never one per occurrence.
    ``least_record_frequency`` and ``least_share`` (tf / cf) keep only rows that reach both, ``most_records`` only terms of so many records; statistics still cover all rows. The terms are first
    selected by ridf: one of which a record holds ``least_share`` has at most 1 + (1 - ``least_share``) * cf records, so it has at least the ridf of such a term, and one of
    ``most_records`` at least that of a term that occurs once in each. The bounds themselves are checked after.
    Records with a null key score nothing but count in cf. Empty input: no rows.
    """
    tf = occurrences.groupBy("term", "parent_asin").agg(F.count(F.lit(1)).alias("tf"))
    stats = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("parent_asin").alias("df"), F.max(F.when(F.col("parent_asin").isNotNull(), F.col("tf"))).alias("_most"))
    # a term none of whose records reaches the bounds can be left out of the join: an exact test, not a cap
    stats = stats.filter((F.col("_most") >= least_record_frequency) & (F.col("_most") >= F.lit(least_share) * F.col("cf")))
    n, df, cf = F.greatest(F.col("n"), F.col("df")).cast("double"), F.col("df").cast("double"), F.col("cf").cast("double")
    stats = stats.crossJoin(F.broadcast(n_records)).withColumn("_ridf", residual(df, cf, n))
    if least_share > 0:
        stats = stats.filter(F.col("_ridf") >= residual(F.least(1 + (1 - F.lit(least_share)) * cf, n), cf, n) - SLACK)
    if most_records is not None:
        most = F.least(F.lit(float(most_records)), n)
        stats = stats.filter((F.col("_ridf") >= residual(most, most, n) - SLACK) & (F.col("df") <= most_records))
    # one condition on the count, so that it stays above the aggregation and both uses of ``tf`` share its exchange
    kept = tf.filter(F.when(F.col("parent_asin").isNotNull(), F.col("tf")) >= least_record_frequency)
    joined = kept.join(stats.drop("_most", "n"), "term").filter(F.col("tf") >= F.lit(least_share) * F.col("cf"))
    return joined.withColumn("ridf", F.round("_ridf", 6) + F.lit(0.0)).select(  # + 0: no negative zero
        "parent_asin", "term", "tf", "df", "cf", "ridf", (F.round(F.col("tf") * F.col("ridf"), 6) + F.lit(0.0)).alias("score")
    )


def record_count(df: DataFrame) -> DataFrame:
    """One row: the number of different non-blank products of a table, at least 1."""
    return df.select(clean_key("parent_asin").alias("k")).agg(F.greatest(F.countDistinct("k"), F.lit(1)).alias("n"))
