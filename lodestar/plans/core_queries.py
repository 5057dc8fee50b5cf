"""Registered core queries: name -> callable(spark, sf_dir), and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import skew
from lodestar.session import read_table
from lodestar.streaming import profiles

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.dominant_keys(read_table(spark, sf_dir, "reviews"))


def p1_key_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_summary(read_table(spark, sf_dir, "reviews"))


def windowed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily activity per event type; the same function runs on a stream."""
    a = profiles.windowed_activity(profiles.distinct_events(read_table(spark, sf_dir, "events")))
    return a.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n_events", F.round("total_value", 4).alias("total_value"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profiles.sessions(profiles.distinct_events(read_table(spark, sf_dir, "events")), "6 hours")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_events")


def user_event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive user state from two halves of the events, merged."""
    e = profiles.distinct_events(read_table(spark, sf_dir, "events"))
    halves = [profiles.user_state(e.filter(F.col("event_id") % 2 == n)) for n in (0, 1)]
    p = profiles.profile(profiles.merge_states(*halves))
    return p.select("user_id", "n_events", F.round(F.col("mean_value") * F.col("n_events"), 4).alias("total_value"), F.round("recent_mean_value", 5).alias("recent_mean_value"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_key_summary, windowed_activity, event_sessions, user_event_profile)}

_KEYED = """
keyed AS (
  SELECT 'reviews.parent_asin' AS field, nullif(trim(parent_asin), '') AS key_value, nullif(trim(user_id), '') AS other, r.* FROM reviews r
  UNION ALL
  SELECT 'reviews.user_id', nullif(trim(user_id), ''), nullif(trim(parent_asin), ''), r.* FROM reviews r
)"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_KEYED}
SELECT field, key_value FROM keyed WHERE key_value IS NOT NULL
GROUP BY field, key_value HAVING count(*) >= 0.02 * (SELECT count(*) FROM reviews)""",
    "p1_key_summary": f"""WITH {_KEYED},
rated AS (SELECT *, CASE WHEN rating BETWEEN 1 AND 5 AND NOT isnan(rating) THEN rating END AS r FROM keyed)
SELECT field, key_value, count(*) AS n_rows, count(r) AS n_rated, round(sum(r) / count(r), 6) AS mean_rating,
  CAST(sum(coalesce(helpful_vote, 0)) AS BIGINT) AS helpful_votes,
  CAST(sum(CASE WHEN verified_purchase THEN 1 ELSE 0 END) AS BIGINT) AS verified_rows,
  CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS text_chars,
  count(DISTINCT other) AS n_partners, max(r) AS max_rating, min(r) AS min_rating
FROM rated GROUP BY field, key_value""",
    "windowed_activity": """WITH e AS (SELECT DISTINCT ON (event_id) * FROM events)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n_events, round(sum(value), 4) AS total_value FROM e GROUP BY ALL""",
    "event_sessions": """WITH e AS (SELECT DISTINCT ON (event_id) * FROM events),
g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g WHERE user_id IS NOT NULL)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events FROM s GROUP BY user_id, n""",
    "user_event_profile": """WITH e AS (SELECT DISTINCT ON (event_id) *, exp(0.01 * (floor(epoch(ts)) - 1577836800) / 86400.0) AS w FROM events)
SELECT user_id, count(*) AS n_events, round(sum(value), 4) AS total_value, round(sum(w * value) / sum(w), 5) AS recent_mean_value FROM e GROUP BY 1""",
}
