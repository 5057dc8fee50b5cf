"""One ranking from several scores: reciprocal rank fusion with distributed places.

A place needs the number of better items of the same group. Groups up to ``hot_rows`` items are ranked by one window
per score over one exchange on the group. Larger groups are cut, per score, at approximate quantiles (a mergeable
sketch) into buckets of about ``hot_rows`` items, ranked inside (group, score, bucket) and shifted by the sizes
of the better buckets, so that no task ever holds a whole hot group. Both ways give the same places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.ranking import with_positions
from lodestar.llm.topn import distinct_candidates
from lodestar.session import cut_lineage

RRF_K = 60
HOT_ROWS = 200_000
#: Most groups whose list is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 100_000


def _place(score: str, group: list[str]) -> Column:
    return F.rank().over(Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last())).cast("long")


def _fuse(places: list[Column], k: int) -> tuple[Column, Column]:
    total = reduce(lambda a, b: a + b, places)
    fused = reduce(lambda a, b: a + b, [F.lit(1.0) / (F.lit(float(k)) + p) for p in places])
    return total, fused


def _hot_places(hot: DataFrame, group: list[str], item: str, scores: list[str], hot_rows: int) -> DataFrame:
    """Places of the items of hot groups, long form turned wide again."""
    long = hot.select(
        *group, item, "_size", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in scores])).alias("e")
    ).select(*group, item, "_size", "e.score", "e.value")
    key = [*group, "score"]
    cuts = long.groupBy(*key).agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)], 10_000).alias("_cuts"))
    joined = long.alias("l").join(cuts.alias("c"), [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key], "left")
    # bucket 0 holds the best values; nulls have a bucket of their own behind all others
    bucket = F.when(F.col("value").isNull(), F.lit(1_000)).otherwise(
        F.size(F.filter(F.array_distinct("_cuts"), lambda c: c > F.col("value")))
    )
    placed = joined.select(*[F.col(f"l.{k}") for k in key], F.col(f"l.{item}").alias(item), "value", bucket.alias("_bucket"))
    # equal values are one row here, so that a value shared by a whole group leaves each task once
    values = placed.groupBy(*key, "_bucket", "value").agg(F.count(F.lit(1)).alias("_n"))
    sizes = values.groupBy(*key, "_bucket").agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")  # at most 65 rows per key
    better = Window.partitionBy(*key, "_bucket").orderBy(F.col("value").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("_above", F.coalesce(F.sum("_n").over(better), F.lit(0)))

    def same(a: str, b: str, cols: list[str]) -> list[Column]:
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]

    value_places = ranked.alias("r").join(offsets.alias("o"), same("r", "o", [*key, "_bucket"])).select(
        *[F.col(f"r.{c}") for c in [*key, "_bucket", "value"]], (F.lit(1) + F.col("_off") + F.col("_above")).alias("place")
    )
    rows = placed.alias("p").join(value_places.alias("v"), same("p", "v", [*key, "_bucket", "value"]))
    return (
        rows.groupBy(*[F.col(f"p.{c}").alias(c) for c in group], F.col(f"p.{item}").alias(item))
        .agg(*[F.max(F.when(F.col("p.score") == s, F.col("place"))).alias(f"place_{s}") for s in scores])
    )


def reciprocal_rank_fusion(
    df: DataFrame, group: list[str], item: str, scores: list[str], k: int = RRF_K, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Places per score, their sum and the fused score of every different item of every group.

    Columns: group, item, ``place_<score>`` (1 + number of items of the group with a higher value; null and NaN share the place after the last
    value), ``place_sum``, ``rrf`` (sum of 1 / (k + place)) and ``n_items`` (different items of the group).
    Copies of a row count once; of differing copies each score's maximum counts. Empty table: no rows.
    """
    one = distinct_candidates(df.select(*group, item, *scores), group, item, scores)
    # at most rows / hot_rows groups; they are told apart before anything is gathered by group
    hot_groups = cut_lineage(one.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > hot_rows))
    n_hot = hot_groups.count()
    size = F.count(F.lit(1)).over(Window.partitionBy(*group))
    places = [_place(s, group).alias(f"place_{s}") for s in scores]
    if not n_hot:
        both = one.select(*group, item, size.alias("_size"), *places)
    else:
        listed = F.broadcast(hot_groups) if n_hot <= MOST_BROADCAST else hot_groups
        same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
        marked = one.alias("a").join(listed.alias("b"), same, "left").select("a.*", "b._size")
        cold = marked.filter("_size is null").drop("_size").select(*group, item, size.alias("_size"), *places)
        hot = _hot_places(marked.filter("_size is not null"), group, item, scores, hot_rows)
        both = cold.unionByName(hot.alias("a").join(listed.alias("b"), same).select("a.*", "b._size"))
    total, fused = _fuse([F.col(f"place_{s}") for s in scores], k)
    return both.select(
        *group, item, *[f"place_{s}" for s in scores], total.alias("place_sum"), fused.alias("rrf"), F.col("_size").alias("n_items")
    )


def ranking(fused: DataFrame, group: list[str], item: str, decimals: int = 9) -> DataFrame:
    """(group, item, rrf, position): the one order of each group, 1 for the highest fused score (rounded to ``decimals``; ties: smaller item, null first). Groups of any size."""
    rounded = fused.select(*group, item, F.round("rrf", decimals).alias("rrf")).withColumn("_down", -F.col("rrf"))
    placed = with_positions(rounded, group, "_down", [item])
    return placed.select(*group, item, "rrf", (F.col("position") + 1).alias("position"))


def least_place_sum(fused: DataFrame, group: list[str], item: str, least_items: int = 3) -> DataFrame:
    """Per group of at least ``least_items`` different items, the item with the least sum of places (ties: smaller item)."""
    return (
        fused.filter(F.col("n_items") >= least_items)
        .groupBy(*group)
        .agg(F.min(F.struct("place_sum", item)).alias("_best"))  # a mergeable minimum: nothing is sorted, hot groups leave a task as one row
        .select(*group, F.col(f"_best.{item}").alias(item))
    )
