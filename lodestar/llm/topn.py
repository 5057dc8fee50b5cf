"""Top N per group with a total order (``row_number`` window pruned by Spark's group limit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_score(column: str) -> Column:
    """The score as double, NaN as null."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c), c)


def distinct_candidates(df: DataFrame, group: list[str], item: str, scores: list[str]) -> DataFrame:
    """One row per (group, item): copies collapse before the shuffle; of differing copies the highest score counts.

    The exchange is on group and item together, so a group that owns a third of all rows is spread by item.
    """
    return df.groupBy(*group, item).agg(*[F.max(usable_score(s)).alias(s) for s in scores])


def top_n_per_group(df: DataFrame, group: list[str], item: str, score: str, n: int) -> DataFrame:
    """The ``n`` highest-scoring items of each group with their position (1..n) as ``place``.

    Order: score descending, null and NaN last (equal to each other), equal scores by smaller item. Copies of a row count once.
    The optimiser puts a group limit before the exchange, so at most ``n`` rows per group leave a task, and
    another before the final window. Groups with fewer items give all of them; null group keys form a group; rows with a null item take part,
    ordered first among equal scores. Empty table: no rows.
    """
    one = distinct_candidates(df, group, item, [score])
    w = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), F.col(item).asc_nulls_first())
    return one.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
