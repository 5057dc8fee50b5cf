"""The stages as one session's functions: each reads its inputs and writes one table; finished ones are skipped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.functions import columns as C
from lodestar.operators import cleaning, documents, evaluation, features, interactions, products, ranker, reports, retrieval, sentiment, tfidf, users
from lodestar.session import cut_lineage
from lodestar.sources import readers, sinks


@dataclass
class Stage:
    name: str
    output: str
    run: Callable[[SparkSession, Settings], DataFrame]


def _table(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    return spark.read.parquet(s.path(name))


def _meta(spark, s):
    return cleaning.clean_meta(_table(spark, s, "raw_meta"))


def _reviews(spark, s):
    r = cleaning.clean_reviews(_table(spark, s, "raw_reviews"))
    r = interactions.restrict(r, _table(spark, s, "meta"), "parent_asin")
    return interactions.k_core(r, s.min_reviews_per_user, s.min_reviews_per_item, passes=s.kcore_passes)


def _splits(spark, s):
    return interactions.leave_last_out(_table(spark, s, "reviews"))


def _histories(spark, s):
    return interactions.prefix_history(_table(spark, s, "splits"), split="split")


def _train(spark, s):
    return _table(spark, s, "histories").filter("split = 'train'").drop("split")


def _scored(spark, s):
    return sentiment.score_by_rules(_table(spark, s, "reviews"), s.aspects, s.lexicon)


def _products(spark, s):
    return products.product_table(_table(spark, s, "meta"), _table(spark, s, "reviews_nlp"), s)


def _documents(spark, s):
    return documents.rich_documents(_table(spark, s, "products_nlp"), s.token_budget)


def _vectors(spark, s):
    d = _table(spark, s, "products_rich")
    return documents.encode_texts(d, "parent_asin", "rich_text", s.dimension, documents.inverse_document_frequency(d, "rich_text"))


def _items(spark, s):
    return users.usable_item_vectors(_table(spark, s, "item_embeddings"), dimension=s.dimension)


def _profiles(spark, s):
    return users.profile_table(_train(spark, s), _table(spark, s, "reviews_nlp"), _table(spark, s, "products_nlp"), _items(spark, s), s)


def _voices(spark, s):
    v = documents.voice_documents(_table(spark, s, "user_profiles"), _table(spark, s, "reviews"), s.token_budget)
    return documents.encode_texts(v, "user_id", "voice_document", s.dimension).withColumnRenamed("embedding", "voice")


def _queries(spark, s):
    """(split, user_id, query_parent_asin, label, history, query_vec): every interaction of the three splits (of repeated ones of a split the last) against its earlier items, blended with the user's profile."""
    keys = ["split", "user_id", "parent_asin"]
    last = F.max_by(F.struct("rating", "history"), F.struct(F.size(C.tokens(F.col("history"))).alias("n"), "timestamp", "history")).alias("r")
    h = _table(spark, s, "histories").groupBy(*keys).agg(last).select("split", "user_id", F.col("parent_asin").alias("query_parent_asin"), C.graded_label(F.col("r.rating")).alias("label"), "r.history")
    q = users.history_vectors(h, _items(spark, s), ["split", "user_id", "query_parent_asin"], s.dimension).withColumn("query_id", F.to_json(F.struct("split", "query_parent_asin")))
    asked = q.select("user_id", "query_id", "query_vec").join(_table(spark, s, "user_voices").select("user_id", F.col("voice").cast("array<double>").alias("voice")), "user_id", "left")
    blended = reports.blended_users(asked, _table(spark, s, "user_profiles"), s.dimension).withColumnRenamed("vec", "query_vec")
    return q.drop("query_vec").join(blended, ["user_id", "query_id"]).select("split", "user_id", "query_parent_asin", "label", "history", "query_vec")


def _candidates(spark, s):
    q, items = _table(spark, s, "queries"), _items(spark, s)
    unit = items.select("item", C.normalised(F.col("vec")).alias("vec"))
    key = ["split", "user_id", "query_parent_asin"]
    found = retrieval.ivf_top_k(q.select(F.to_json(F.struct(*key)).alias("query_id"), F.col("query_vec").alias("vec")), unit, s.top_k)
    r = found.select(F.from_json("query_id", "split string, user_id string, query_parent_asin string").alias("k"), F.col("item").alias("candidate_parent_asin"), F.col("score").alias("faiss_score"), F.col("rank").alias("faiss_rank")).select("k.*", "candidate_parent_asin", "faiss_score", "faiss_rank")
    of = lambda df, name: df.filter(F.col("split") == name).drop("split")
    return _by_split(lambda name: retrieval.candidates(of(r, name), of(q.select(*key, "label"), name), s.top_k))


def _by_split(make: Callable[[str], DataFrame]) -> DataFrame:
    train, valid, test = (make(name).withColumn("split", F.lit(name)) for name in ("train", "valid", "test"))
    return train.unionByName(valid).unionByName(test)


def _title_scores(spark, s, candidates: DataFrame) -> DataFrame:
    """(split, user_id, query_parent_asin, candidate_parent_asin, bm25_scaled): titles of the query's history against titles and descriptions of its candidates."""
    key = ["split", "user_id", "query_parent_asin"]
    products = _table(spark, s, "products_nlp")
    titles = products.filter("title is not null").select(F.col("parent_asin").alias("item"), "title")
    history = _table(spark, s, "queries").select(F.to_json(F.struct(*key)).alias("query_id"), F.explode(C.tokens(F.col("history"))).alias("item"))
    asked = history.join(titles, "item").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("title")), " ").alias("text"))
    docs = products.select(F.col("parent_asin").alias("doc_id"), F.concat_ws(" ", "title", "description").alias("text"))
    pairs = candidates.select(F.to_json(F.struct(*key)).alias("query_id"), F.col("candidate_parent_asin").alias("doc_id"))
    found = tfidf.bm25(asked, docs, pairs=pairs)
    return found.select(F.from_json("query_id", "split string, user_id string, query_parent_asin string").alias("k"), F.col("doc_id").alias("candidate_parent_asin"), "bm25_scaled").select("k.*", "candidate_parent_asin", "bm25_scaled")


def _features(spark, s):
    c, p, u = _table(spark, s, "candidates"), _table(spark, s, "products_nlp"), _table(spark, s, "user_profiles")
    stats = features.stats_dict(features.feature_stats(p, u, s.top_k))
    words = cut_lineage(_title_scores(spark, s, c))

    def one(name: str) -> DataFrame:
        of = lambda df: df.filter(F.col("split") == name).drop("split")
        vectors = of(_table(spark, s, "queries")).select("user_id", "query_parent_asin", "query_vec")
        raw = features.raw_features(of(c), p, u, _items(spark, s), s.top_k, vectors, _table(spark, s, "user_voices"), of(words), s.dimension)
        return features.scale_features(raw, stats)

    return _by_split(one)


def _metrics(spark, s):
    rows = _table(spark, s, "features")
    of = lambda name: rows.filter(F.col("split") == name).drop("split")
    model = ranker.train(of("train"), of("valid"), rounds=s.rounds, depth=s.depth, patience=s.patience)
    model.save(spark, s.path("ranker"))
    test = model.score(of("test"), "model_score")
    systems = {"random": evaluation.random_score("user_id", "query_parent_asin", "candidate_parent_asin"), "bm25": F.col("f31_bm25_score"), "ann": F.col("f01_faiss_score"), "model": F.col("model_score")}
    return evaluation.compare_systems(test, systems)


STAGES = [
    Stage("clean metadata", "meta", _meta), Stage("clean and prune reviews", "reviews", _reviews), Stage("split", "splits", _splits), Stage("histories", "histories", _histories), Stage("sentiment and aspects", "reviews_nlp", _scored),
    Stage("product signals", "products_nlp", _products), Stage("product documents", "products_rich", _documents), Stage("product vectors", "item_embeddings", _vectors), Stage("user profiles", "user_profiles", _profiles),
    Stage("user voices", "user_voices", _voices), Stage("queries", "queries", _queries), Stage("candidates", "candidates", _candidates), Stage("features", "features", _features), Stage("evaluation", "metrics", _metrics),
]


def status(spark: SparkSession, s: Settings) -> list[tuple[str, str, bool]]:
    """(stage, output, done): done means the output carries its success marker."""
    return [(x.name, x.output, readers.exists(spark, f"{s.path(x.output)}/_SUCCESS")) for x in STAGES]


def run(spark: SparkSession, s: Settings, until: str | None = None, force: bool = False) -> list[str]:
    """Run what is not done yet, in order; a failing stage stops the run with its exception. Returns the stages that ran."""
    ran = []
    for stage in STAGES:
        if force or not readers.exists(spark, f"{s.path(stage.output)}/_SUCCESS"):
            sinks.write_table(stage.run(spark, s), s.path(stage.output))
            ran.append(stage.name)
            sinks.write_progress(s.path("progress.txt"), {name: done for name, _, done in status(spark, s)})
        if stage.output == until:
            break
    return ran
