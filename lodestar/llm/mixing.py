"""Mixing sources to target weights: hash-seeded Poisson replication.

Each different text draws its number of uses by inverting a Poisson distribution at a uniform hash of the text and the seed; the mean is the repetition rate that brings its
source to its share of all tokens. Uses beyond ``max_repeats`` are cut off, so the mean of the cut distribution is what must meet the rate: it is solved
on the histogram of tokens over the hash (at most ``BINS`` sums per listed source), which also takes the draw's noise out of the shares. The uses are exploded and ordered by
a second hash: a global shuffle that any number of partitions reproduces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokenize import VOCABULARY, encode_corpus
from lodestar.session import cut_lineage

BINS = 4096
MAX_SOURCES = 10_000


@dataclass
class Plan:
    source: str
    weight: float
    cap: int
    target: float
    available: int
    thresholds: list[float]
    capped: bool


def _thresholds(mean: float, cap: int) -> list[float]:
    """Poisson distribution function at 0 .. cap-1; a hash value u draws as many uses as there are thresholds <= u."""
    if math.isinf(mean):
        return [0.0] * cap
    term, total, out = math.exp(-mean), 0.0, []
    for i in range(cap):
        total += term
        out.append(min(total, 1.0))
        term *= mean / (i + 1)
    return out


def _tokens_above(hist: list[int], u: float) -> float:
    """Tokens of texts whose hash is at least ``u``, linear inside a bin."""
    at = min(int(u * BINS), BINS)
    if at >= BINS:
        return 0.0
    return hist[at] * (1 - (u * BINS - at)) + sum(hist[at + 1 :])


def solve(source: str, weight: float, cap: int, total: int, hist: list[int]) -> Plan:
    """Thresholds with which the source gives ``weight * total`` tokens, or as near as ``cap`` uses of all its texts come."""
    available, target = sum(hist), weight * total
    if available * cap <= target or cap <= 0:
        return Plan(source, weight, cap, target, available, _thresholds(math.inf, max(cap, 0)), True)
    reached = lambda mean: sum(_tokens_above(hist, u) for u in _thresholds(mean, cap))
    low, high = 0.0, 1.0
    while reached(high) < target and high < 700:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if reached(mid) < target else (low, mid)
    return Plan(source, weight, cap, target, available, _thresholds((low + high) / 2, cap), False)


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Listed sources (a small table; refused beyond ``MAX_SOURCES`` rows). Repeated sources: weights add up, the least cap counts."""
    rows = mix_targets.select(F.lower(F.trim("source")).alias("source"), "weight", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources")
    out: dict[str, tuple[float, int]] = {}
    for r in rows:
        if r.source and r.weight is not None and r.weight > 0:
            w, c = out.get(r.source, (0.0, 1 << 30))
            out[r.source] = (w + r.weight, min(c, r.max_repeats if r.max_repeats is not None else 1))
    return out


def _mix_units(documents: DataFrame, mix_targets: DataFrame, seed: int, vocabulary: str) -> tuple[DataFrame, DataFrame, int]:
    """(texts that may be used, one row per listed source with its plan, tokens to share out). The plans are solved in one task per source on at most ``BINS`` sums."""
    spark, targets = documents.sparkSession, _targets(mix_targets)
    listed = spark.createDataFrame([(s, w, c) for s, (w, c) in targets.items()], "source string, weight double, cap int")
    named = documents.select("doc_id", "text", F.lower(F.trim("source")).alias("source")).join(F.broadcast(listed.select("source", "cap")), "source")
    sized = encode_corpus(named.withColumn("_key", F.struct("doc_id", "source", "cap", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))), "_key", vocabulary, counts_only=True)
    docs = cut_lineage(sized.select("_key.*", "n_tokens"))
    total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # a text under several ids or sources is one text: it belongs to the source with the least cap, then to the smallest id
    units = (
        docs.filter("n_tokens > 0")
        .groupBy("digest")
        .agg(F.min(F.struct("cap", "doc_id", "source")).alias("u"), F.max("n_tokens").alias("n_tokens"))
        .select("u.doc_id", "u.source", "n_tokens", (F.shiftrightunsigned(F.xxhash64("digest", F.lit(seed)), 11) / F.lit(float(1 << 53))).alias("u"))
    )
    sums = units.groupBy("source", F.least(F.floor(F.col("u") * BINS), F.lit(BINS - 1)).cast("int").alias("b")).agg(F.sum("n_tokens").alias("n"))

    def solved(rows):
        import pandas as pd

        hist = [0] * BINS
        for b, n in zip(rows["b"], rows["n"]):
            if not pd.isna(b):
                hist[int(b)] = int(n)
        p = solve(rows["source"].iloc[0], float(rows["weight"].iloc[0]), int(rows["cap"].iloc[0]), total, hist)
        return pd.DataFrame([(p.source, p.weight, p.cap, p.target, p.available, p.thresholds, p.capped)], columns=["source", "weight", "max_repeats", "target_tokens", "available_tokens", "thresholds", "capped"])

    kinds = "source string, weight double, max_repeats int, target_tokens double, available_tokens bigint, thresholds array<double>, capped boolean"
    plans = cut_lineage(listed.join(sums, "source", "left").groupBy("source").applyInPandas(solved, kinds))  # at most MAX_SOURCES rows
    return units, plans, total


def _uses(documents: DataFrame, mix_targets: DataFrame, seed: int, vocabulary: str) -> tuple[DataFrame, DataFrame, int]:
    units, plans, total = _mix_units(documents, mix_targets, seed, vocabulary)
    drawn = units.join(F.broadcast(plans.select("source", "thresholds")), "source").withColumn("uses", F.size(F.filter("thresholds", lambda t: F.col("u") >= t)))
    return drawn.filter("uses > 0").select("doc_id", "source", "n_tokens", "uses"), plans, total


def mix(documents: DataFrame, mix_targets: DataFrame, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mix in its global order: doc_id, source, copy (1..), n_tokens, order_key, text.

    Sources are compared trimmed and lower-cased; documents of unlisted, null or blank sources and texts without tokens
    take no part. No text is used more often than the cap of its source, however many ids it has. A source that cannot reach its share within
    its cap gives all it may. Empty tables: no rows.
    """
    drawn, _, _ = _uses(documents, mix_targets, seed, vocabulary)
    copies = drawn.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"))
    keyed = copies.withColumn("order_key", F.xxhash64("doc_id", "copy", F.lit(seed + 1)))
    with_text = keyed.join(documents.select("doc_id", "text"), "doc_id")
    return with_text.repartitionByRange("order_key", "doc_id", "copy").sortWithinPartitions("order_key", "doc_id", "copy").select("doc_id", "source", "copy", "n_tokens", "order_key", "text")


def shares(documents: DataFrame, mix_targets: DataFrame, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per listed source: weight, cap, target and available tokens, tokens and uses in the mix, whether the cap bound it, the share reached of the mix
    (null for an empty mix) and of the size to share out (all tokens of listed sources)."""
    drawn, plans, total = _uses(documents, mix_targets, seed, vocabulary)
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mix_tokens"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    table = plans.drop("thresholds")
    both = table.join(got, "source", "left").fillna(0, ["mix_tokens", "uses", "most_uses"])
    everything = both.agg(F.sum("mix_tokens").alias("all_tokens"))
    return both.crossJoin(F.broadcast(everything)).select(
        *both.columns, F.when(F.col("all_tokens") > 0, F.col("mix_tokens") / F.col("all_tokens")).alias("reached_share"), F.lit(total).cast("long").alias("corpus_tokens"), (F.col("mix_tokens") / F.lit(float(max(total, 1)))).alias("share_of_corpus")
    )
