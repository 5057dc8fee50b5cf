"""Incremental profiles over an event stream: windowed activity and additive user state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events once per id within the watermark; later ones than ``delay`` are dropped by the state."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if e.isStreaming else e.dropDuplicates(["event_id"])


def windowed_activity(events: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n_events, total_value) per window; works on streams and batches alike."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value")).select("w.start", "w.end", "event_type", "n_events", "total_value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events")).select("user_id", "w.start", "w.end", "n_events")


STATE = ["n_events", "total_value", "weight_sum", "weighted_sum", "last_ts"]


def user_state(events: DataFrame, recency_lambda: float = 0.01) -> DataFrame:
    """Additive state per user: count, sum, recency-weighted sums and last time; two states of one user merge by sums and a maximum.

    Weights are exp(lambda * days since a fixed epoch): the factor of the latest day cancels in the weighted mean, so increments need no rescaling.
    """
    days = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1_577_836_800)) / 86_400.0
    w = F.exp(F.lit(recency_lambda) * days)
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value"), F.sum(w).alias("weight_sum"), F.sum(w * F.col("value")).alias("weighted_sum"), F.max(F.col("ts").cast("timestamp")).alias("last_ts")
    )


def merge_states(*states: DataFrame) -> DataFrame:
    both = states[0]
    for more in states[1:]:
        both = both.unionByName(more)
    sums = [F.sum(c).alias(c) for c in STATE[:-1]]
    return both.groupBy("user_id").agg(*sums, F.max("last_ts").alias("last_ts"))


def profile(state: DataFrame) -> DataFrame:
    return state.select("user_id", "n_events", (F.col("total_value") / F.col("n_events")).alias("mean_value"), F.try_divide("weighted_sum", "weight_sum").alias("recent_mean_value"), "last_ts")


KEPT_VERSIONS = 3


def keep_state(events: DataFrame, path: str, checkpoint: str):
    """Start a query that folds every micro-batch into the state table under ``path`` (one folder per version; the batch id makes a repeated batch harmless).

    A batch whose predecessor's version is missing fails instead of starting from nothing. The last ``KEPT_VERSIONS`` versions are kept, so that a repeated batch finds the one before it.
    """

    def fold(batch: DataFrame, number: int) -> None:
        from lodestar.sources.readers import exists, remove

        spark, fresh = batch.sparkSession, user_state(batch)
        if number > 0 and not exists(spark, f"{path}/{number - 1}/_SUCCESS"):
            raise RuntimeError(f"the state before batch {number} is missing under {path}")
        merged = merge_states(spark.read.parquet(f"{path}/{number - 1}"), fresh) if number > 0 else fresh
        merged.write.mode("overwrite").parquet(f"{path}/{number}")
        remove(spark, f"{path}/{number - KEPT_VERSIONS}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).outputMode("append").start()
