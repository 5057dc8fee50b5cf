"""Sentiment and aspect scores of reviews.

Two scorers with one output: ``bag`` (sum of valences, JVM only, SQL-expressible) and ``rules`` (published rule set: boosters, negation, capitals,
'but', punctuation), vectorised over Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import ASPECT_KEYWORDS, BOOSTERS, LEXICON, NEGATIONS
from lodestar.functions.columns import let, sentiment_label


def bag_score(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """s / sqrt(s * s + 15) of the summed valences of lexicon words; null for null text, 0 without lexicon words.

    One regular expression finds the lexicon words, so the valence lookup sees only those.
    """
    lexicon = lexicon or LEXICON
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(sorted(lexicon, key=lambda w: (-len(w), w))) + r")\b"), F.lit(1))
    table = F.create_map(*[F.lit(x) for w, v in lexicon.items() for x in (w, float(v))])
    s = F.aggregate(F.transform(found, lambda w: F.try_element_at(table, w)), F.lit(0.0), lambda a, v: a + v)
    return let(s, lambda v: v / F.sqrt(v * v + F.lit(15.0)))


class RuleScorer:
    """Compound score of one text by the published rules over a replaceable lexicon."""

    _word = re.compile(r"[A-Za-z][A-Za-z'\-]*")

    def __init__(self, lexicon: dict[str, float] | None = None):
        self.lexicon = lexicon or LEXICON

    def __call__(self, text: str | None) -> float:
        words = self._word.findall(text or "")
        if not words:
            return 0.0
        lower = [w.lower() for w in words]
        caps = any(w.isupper() and len(w) > 1 for w in words) and not all(w.isupper() for w in words)
        scores = [self._valence(i, words, lower, caps) for i in range(len(words))]
        if "but" in lower:
            at = lower.index("but")
            scores = [s * (0.5 if i < at else 1.5 if i > at else 1.0) for i, s in enumerate(scores)]
        total = sum(scores)
        marks = min(text.count("!"), 4) * 0.292
        questions = text.count("?")
        marks += 0.0 if questions < 2 else 0.18 * questions if questions <= 3 else 0.96
        total += marks if total > 0 else -marks if total < 0 else 0.0
        return total / math.sqrt(total * total + 15)

    def _valence(self, i: int, words: list[str], lower: list[str], caps: bool) -> float:
        v = self.lexicon.get(lower[i], 0.0)
        if v == 0.0 or lower[i] in BOOSTERS:
            return 0.0
        sign = 1 if v > 0 else -1
        if caps and words[i].isupper():
            v += 0.733 * sign
        for distance, decay in ((1, 1.0), (2, 0.95), (3, 0.9)):
            j = i - distance
            if j < 0 or lower[j] in self.lexicon:
                continue
            boost = BOOSTERS.get(lower[j], 0.0) * sign
            if boost and caps and words[j].isupper():
                boost += 0.733 * (1 if boost > 0 else -1)
            v += boost * decay
        if any(w in NEGATIONS for w in lower[max(0, i - 3) : i]):
            v *= -0.74
        return v


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _aspect_patterns(aspects: dict[str, list[str]]) -> dict[str, str]:
    return {a: r"\b(?:" + "|".join(re.escape(k).replace(r"\-", "-").replace(r"\ ", " ") for k in words) + r")\b" for a, words in aspects.items()}


def score_by_rules(reviews: DataFrame, aspects: dict[str, list[str]] | None = None, lexicon: dict[str, float] | None = None) -> DataFrame:
    """Adds sentiment_score, sentiment_label and aspect_<name> by the rule set; each sentence is scored once for all aspects."""
    patterns = {a: re.compile(p, re.IGNORECASE) for a, p in _aspect_patterns(aspects or ASPECT_KEYWORDS).items()}
    scorer, names = RuleScorer(lexicon), list(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            whole, by = [], {a: [] for a in names}
            for text in texts:
                whole.append(scorer(text))
                hits: dict[str, list[float]] = {a: [] for a in names}
                for sentence in _SENTENCE.split((text or "").strip()):
                    if len(sentence) < 3:
                        continue
                    matching = [a for a, p in patterns.items() if p.search(sentence)]
                    if matching:
                        score = scorer(sentence)
                        for a in matching:
                            hits[a].append(score)
                for a in names:
                    by[a].append(sum(hits[a]) / len(hits[a]) if hits[a] else None)
            labels = ["positive" if s >= 0.05 else "negative" if s <= -0.05 else "neutral" for s in whole]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(whole, pa.float64()), pa.array(labels, pa.string()), *[pa.array(by[a], pa.float64()) for a in names]],
                names=[*batch.schema.names, "sentiment_score", "sentiment_label", *[f"aspect_{a}" for a in names]],
            )

    base = ", ".join(f"`{n}` {k}" for n, k in reviews.dtypes)
    extra = ", ".join(["sentiment_score double", "sentiment_label string", *[f"aspect_{a} double" for a in names]])
    return reviews.mapInArrow(run, f"{base}, {extra}")


def score_by_bag(reviews: DataFrame, aspects: dict[str, list[str]] | None = None, lexicon: dict[str, float] | None = None) -> DataFrame:
    """The same columns from the bag scorer, in built-in functions only. Null text scores 0 and has no aspects."""
    text = F.coalesce("text", F.lit(""))
    sentences = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.length(s) >= 3)
    scored = F.transform(sentences, lambda s: F.struct(s.alias("s"), bag_score(s, lexicon).alias("score")))
    out = reviews.withColumn("sentiment_score", bag_score(text, lexicon)).withColumn("_sentences", scored)
    out = out.withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))


    def matching(pattern: str) -> Column:
        return F.filter("_sentences", lambda x: x["s"].rlike("(?i)" + pattern))

    for a, p in _aspect_patterns(aspects or ASPECT_KEYWORDS).items():
        out = out.withColumn(f"aspect_{a}", let(matching(p), lambda hits: F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x["score"]) / F.size(hits))))
    return out.drop("_sentences")


SCORERS: dict[str, Callable[..., DataFrame]] = {"bag": score_by_bag, "rules": score_by_rules}


def label_distribution(scored: DataFrame) -> DataFrame:
    """Rows and share per label (one row per label)."""
    counts = scored.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("sentiment_label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def aspect_hit_rates(scored: DataFrame, aspects: list[str]) -> DataFrame:
    one = scored.agg(*[F.count(f"aspect_{a}").alias(a) for a in aspects], F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_total"))
    rows = F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(a).alias("hits"), F.round(F.col(a) / F.col("_total"), 6).alias("rate")) for a in aspects])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def emotion_vocabulary(reviews: DataFrame, lexicon: dict[str, float] | None = None, top: int = 5) -> DataFrame:
    """(parent_asin, emotion_vocabulary): the ``top`` different lexicon words of a product's texts by absolute valence (ties: alphabetical).

    Words are counted once per product by a distinct with map-side combine before the ranking window.
    """
    lexicon = lexicon or LEXICON
    table = reviews.sparkSession.createDataFrame([(w, float(v)) for w, v in lexicon.items()], "word string, valence double")
    words = reviews.select("parent_asin", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)))).alias("word"))
    known = words.join(F.broadcast(table), "word").distinct()  # the lexicon is a parameter of fixed size
    w = Window.partitionBy("parent_asin").orderBy(F.abs("valence").desc(), "word")
    best = known.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top)
    return best.groupBy("parent_asin").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]), ", ").alias("emotion_vocabulary")
    )
