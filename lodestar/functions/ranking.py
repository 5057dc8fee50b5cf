"""Positions and percent ranks inside groups of any size.

A window over a group runs in one task. Groups of more than ``HOT_ROWS`` rows are therefore cut at approximate quantiles of the ordering value (a mergeable sketch),
ranked inside (group, bucket) and shifted by the sizes of the buckets before. Equal values share a bucket, so the result is the one window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
CUTS = 64
_NULL_BUCKET = 1_000_000


def _same(a: str, b: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]


_ASK = object()


def with_positions(df: DataFrame, keys: list[str], value: str, ties: list[str], hot_rows: int = HOT_ROWS, weight: str | None = None, hot=_ASK) -> DataFrame:
    """Adds ``position`` (0-based, ascending by value, nulls last, then ``ties``) and ``group_rows``.

    With ``weight`` a row stands for that many: position is the weight before it, ``group_rows`` the weight of its group. ``hot`` is what ``hot_groups`` found, if that is known already.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    hot = hot_groups(df, keys, hot_rows, weight) if hot is _ASK else hot
    order = [F.col(value).asc_nulls_last(), *[F.col(t) for t in ties]]
    group = Window.partitionBy(*keys)

    def before(w) -> Column:
        return F.coalesce(F.sum(one).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if hot is None:
        return df.withColumn("position", before(group)).withColumn("group_rows", F.sum(one).over(group))
    hot_only = df.alias("d").join(hot.alias("h"), _same("d", "h", keys), "left_semi")
    cuts = hot_only.groupBy(*keys).agg(F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 10_000).alias("_cuts"))
    bucket = F.when(F.col("_cuts").isNull(), 0).when(F.col(value).isNull(), _NULL_BUCKET).otherwise(F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(value))))
    placed = df.alias("d").join(cuts.alias("c"), _same("d", "c", keys), "left").select("d.*", "c._cuts").withColumn("_bucket", bucket).drop("_cuts")
    sizes = placed.groupBy(*keys, "_bucket").agg(F.sum(one).alias("_n"))  # at most CUTS + 1 rows per key
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("group_rows", F.sum("_n").over(group)).drop("_n")
    inner = placed.withColumn("_in", before(Window.partitionBy(*keys, "_bucket")))
    both = inner.alias("a").join(offsets.alias("b"), _same("a", "b", [*keys, "_bucket"]))
    return both.select("a.*", (F.col("_in") + F.col("_off")).alias("position"), "b.group_rows").drop("_in", "_bucket")


def percent_ranks(df: DataFrame, keys: list[str], value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, value, ``name``): rank with average ties over the number of non-null values, one row per different value of a group.

    Equal values collapse before they are ranked, so a value that fills a group is one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_same"))
    placed = with_positions(counts, keys, value, [], hot_rows, weight="_same")
    return placed.select(*keys, value, ((F.col("position") + (F.col("_same") + 1) / 2) / F.col("group_rows")).alias(name))


def exact_percentiles(df: DataFrame, value: Column, shares: list[float], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row: ``name``, the exact percentiles (linear between neighbours) of the non-null, non-NaN values; null without any.

    Equal values collapse first and are positioned by buckets, so that no task holds all values, as the built-in exact percentile would.
    """
    v = df.select(value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_same"))
    placed = with_positions(v.withColumn("_g", F.lit(0)), ["_g"], "_v", [], hot_rows, weight="_same")
    last = F.col("group_rows") - 1
    out = []
    for i, s in enumerate(shares):
        at = F.lit(s) * last
        inside = lambda r: (F.col("position") <= r) & (r < F.col("position") + F.col("_same"))
        low, high = F.max(F.when(inside(F.floor(at)), F.col("_v"))), F.max(F.when(inside(F.ceil(at)), F.col("_v")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"_q{i}"))
    row = placed.agg(*out)
    return row.select(F.array(*[F.col(f"_q{i}") for i in range(len(shares))]).alias(name))


def column_percentiles(df: DataFrame, columns: dict[str, tuple[Column, float]], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row: for each name the exact percentile (linear between neighbours) of the non-null, non-NaN values of its column; null without any. One pass, no column in one task."""
    entries = F.array(*[F.struct(F.lit(n).alias("_g"), c.cast("double").alias("_v")) for n, (c, _) in columns.items()])
    long = df.select(F.explode(entries).alias("e")).select("e.*").filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = long.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_same"))
    placed = with_positions(counts, ["_g"], "_v", [], hot_rows, weight="_same")
    shares = F.create_map(*[x for n, (_, s) in columns.items() for x in (F.lit(n), F.lit(float(s)))])
    at = F.element_at(shares, F.col("_g")) * (F.col("group_rows") - 1)
    inside = lambda r: (F.col("position") <= r) & (r < F.col("position") + F.col("_same"))
    low, high = F.max(F.when(inside(F.floor(at)), F.col("_v"))), F.max(F.when(inside(F.ceil(at)), F.col("_v")))
    each = placed.groupBy("_g").agg((low + (high - low) * F.max(at - F.floor(at))).alias("_q"))
    return each.agg(*[F.max(F.when(F.col("_g") == n, F.col("_q"))).alias(n) for n in columns])


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, weight: str | None = None) -> DataFrame | None:
    """Groups of more than ``hot_rows`` rows; None if there are none."""
    one = F.lit(1) if weight is None else F.col(weight)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(one).alias("group_rows")).filter(F.col("_rows") > hot_rows)
    return None if hot.isEmpty() else hot


def join_percent_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``, the percent rank of ``value`` inside ``keys`` (null for null)."""
    ranks = percent_ranks(df, keys, value, name)
    return df.alias("d").join(ranks.alias("r"), _same("d", "r", [*keys, value]), "left").select("d.*", f"r.{name}")
