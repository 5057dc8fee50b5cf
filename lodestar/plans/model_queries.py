"""Queries over users, retrieval, features, evaluation, documents and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import documents, evaluation, features, interactions, products, ranker, reports, retrieval, users
from lodestar.plans.catalog import Tables, rounded
from lodestar.plans.model_sql import SQL  # noqa: F401
from lodestar.session import cut_lineage

TOP_K = 10


def _train(t: Tables) -> DataFrame:
    return interactions.leave_last_out(t.reviews()).filter("split = 'train'").drop("split")


def _listed(t: Tables) -> DataFrame:
    return products.price_tiers(products.listing_columns(t.meta()))


def _items(t: Tables) -> DataFrame:
    return users.usable_item_vectors(t.raw("item_embeddings"))


def _unit_items(t: Tables) -> DataFrame:
    return _items(t).select("item", C.normalised(F.col("vec")).alias("vec"))


def _vec_items(t: Tables) -> DataFrame:
    return t.raw("embeddings").select(F.col("vec_id").cast("string").alias("item"), F.col("embedding").alias("vec"))


def _vec_queries(t: Tables) -> DataFrame:
    return t.raw("embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vec"))


def user_interactions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(users.interaction_stats(_train(Tables(spark, d))))


def user_preferences(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return rounded(users.preferences(_train(t), _listed(t)))


def user_review_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(users.review_signals(Tables(spark, d).scored()))


def user_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Long form (user, kind, position, value)."""
    t = Tables(spark, d)
    v = users.user_vectors(_train(t), _items(t))
    kinds = F.explode(F.array(*[F.struct(F.lit(e).alias("kind"), F.col(f"{e}_embedding").alias("v")) for e in users.EMBEDDINGS]))
    long = v.select("user_id", kinds.alias("k")).select("user_id", "k.kind", F.posexplode("k.v").alias("pos", "value"))
    return rounded(long, 5)


def cold_start_tiers(spark: SparkSession, d: str) -> DataFrame:
    p = users.tiers(users.interaction_stats(_train(Tables(spark, d))))
    return rounded(p.select("user_id", "cold_start_tier", "query_weight", "user_weight", "is_active"))


def tier_distribution(spark: SparkSession, d: str) -> DataFrame:
    return users.tier_distribution(users.tiers(users.interaction_stats(_train(Tables(spark, d)))))


def profile_table(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    train, listed = cut_lineage(_train(t)), cut_lineage(_listed(t))  # both are read several times
    return users.profile_table(train, t.scored(), listed, _items(t))


def lambda_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return rounded(users.lambda_diagnostic(_train(t), _items(t), [0.001, 0.01, 0.1]), 5)


def blended_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every user's profile blended into the vector of every item they are asked about in features_test (long form)."""
    t = Tables(spark, d)
    asked = t.raw("features_test").select("user_id", F.col("query_parent_asin").alias("query_id")).distinct()
    q = asked.join(_unit_items(t).select(F.col("item").alias("query_id"), F.col("vec").alias("query_vec")), "query_id")
    b = reports.blended_users(q, t.raw("user_profiles"))
    return rounded(b.select("user_id", "query_id", F.posexplode("vec").alias("pos", "value")), 5)


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    i = _items(Tables(spark, d))
    return rounded(i.select("item", C.norm(F.col("vec")).alias("norm"), C.norm(C.normalised(F.col("vec"))).alias("unit_norm")))


def norm_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.norm_check(_items(Tables(spark, d))))


def exact_topk(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return rounded(retrieval.exact_top_k(_vec_queries(t), _vec_items(t), TOP_K).select("query_id", "item", "rank", "score"), 6)


def single_query_topk(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    first = t.raw("embeddings").filter("vec_id = 0").first()["embedding"]
    return rounded(retrieval.top_k_single(_vec_items(t), list(first), TOP_K))


def self_recall(spark: SparkSession, d: str) -> DataFrame:
    """Self-recall of ivf_topk's index; ``ivf_recall`` has its recall against the exact result."""
    t = Tables(spark, d)
    return retrieval.self_recall(retrieval.ivf_top_k(_vec_queries(t), _vec_items(t), TOP_K, nlist=32))


def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return retrieval.ivf_top_k(_vec_queries(t), _vec_items(t), TOP_K, nlist=32)


def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of ivf_topk against exact_topk."""
    t = Tables(spark, d)
    return retrieval.recall_at_k(ivf_topk(spark, d), retrieval.exact_top_k(_vec_queries(t), _vec_items(t), TOP_K))


def home_feed(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return rounded(reports.home_feed(t.raw("user_profiles"), _unit_items(t), k=TOP_K))


def _history_queries(t: Tables) -> DataFrame:
    """(user_id, query_parent_asin, label, query_vec): the held-out interaction of each user against the mean of the earlier items."""
    split = interactions.leave_last_out(t.reviews())
    test = split.filter("split = 'test'").select("user_id", "parent_asin", C.graded_label(F.col("rating")).alias("label"))
    earlier = split.filter("split = 'train'").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("parent_asin")), " ").alias("history"))
    q = test.join(earlier, "user_id").select("user_id", F.col("parent_asin").alias("query_parent_asin"), "label", "history")
    return users.history_vectors(q, _items(t), ["user_id", "query_parent_asin"])


def _candidates(t: Tables, inject: bool = True) -> DataFrame:
    q = _history_queries(t)
    found = retrieval.exact_top_k(q.select(F.concat_ws("|", "user_id", "query_parent_asin").alias("query_id"), F.col("query_vec").alias("vec")), _unit_items(t), TOP_K)
    parts = F.split("query_id", r"\|")
    r = found.select(parts[0].alias("user_id"), parts[1].alias("query_parent_asin"), F.col("item").alias("candidate_parent_asin"), F.col("score").alias("faiss_score"), F.col("rank").alias("faiss_rank"))
    return retrieval.candidates(r, q.select("user_id", "query_parent_asin", "label"), TOP_K, inject)


def candidates_forced(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_candidates(Tables(spark, d)), 5)


def _given_candidates(t: Tables) -> DataFrame:
    """The candidate rows of features_test (copies of a row once), with the retrieval score and rank they carry."""
    f = t.raw("features_test")
    return f.groupBy("user_id", "query_parent_asin", "candidate_parent_asin").agg(
        F.max("relevance_label").alias("relevance_label"), F.max("is_forced_positive").alias("is_forced_positive"), F.max(C.to_number(F.col("f01_faiss_score").cast("double"))).alias("faiss_score"),
        F.max(C.to_number(F.col("f02_faiss_rank").cast("double"))).alias("faiss_rank"),
    )


def _raw_features(t: Tables) -> DataFrame:
    return features.raw_features(_given_candidates(t), t.raw("products_nlp"), t.raw("user_profiles"), _unit_items(t), top_k=1)


def features_wide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_raw_features(Tables(spark, d)), 5)


def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return rounded(features.feature_stats(t.raw("products_nlp"), t.raw("user_profiles"), 200), 5)


def features_scaled(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    stats = features.stats_dict(features.feature_stats(t.raw("products_nlp"), t.raw("user_profiles"), 200))
    return rounded(features.scale_features(_raw_features(t), stats), 5)


def feature_nulls(spark: SparkSession, d: str) -> DataFrame:
    return features.null_counts(_raw_features(Tables(spark, d)))


def _labelled(t: Tables) -> DataFrame:
    f = t.raw("features_test")
    cols = [c for c in features.FEATURES]
    return f.groupBy("user_id", "query_parent_asin", "candidate_parent_asin").agg(F.max("relevance_label").alias("relevance_label"), *[F.max(C.to_number(F.col(c).cast("double"))).alias(c) for c in cols])


def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.query_metrics(_labelled(Tables(spark, d)), "f01_faiss_score"))


def query_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.query_counts(_labelled(Tables(spark, d)))


def _linear(columns: dict):
    z = lambda c: F.coalesce(columns[c], F.lit(0.0))
    return z("f01_faiss_score") + 0.1 * z("f05_avg_rating") + 0.2 * z("f08_mean_sentiment") + 0.3 * z("f13_aspect_gameplay") + 0.1 * z("f18_user_item_voice_cosine") + 0.2 * z("f24_sentiment_trajectory") + 0.3 * z("f30_user_combined_cosine") + 0.2 * z("f31_bm25_score")


def system_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(Tables(spark, d))
    systems = {"random": evaluation.random_score("user_id", "query_parent_asin", "candidate_parent_asin"), "bm25": F.col("f31_bm25_score"), "ann": F.col("f01_faiss_score"), "linear": F.round(_linear({c: F.col(c) for c in features.FEATURES}), 6)}
    return rounded(evaluation.compare_systems(rows, systems))


def relative_improvement(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(Tables(spark, d))
    m = evaluation.compare_systems(rows, {"ann": F.col("f01_faiss_score"), "bm25": F.col("f31_bm25_score")})
    return rounded(evaluation.improvement(m, "ann"), 4)


def version_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(Tables(spark, d))
    first = evaluation.compare_systems(rows, {"model": F.col("f01_faiss_score")})
    return rounded(evaluation.compare_versions(first, evaluation.compare_systems(rows, {"model": F.col("f31_bm25_score")})), 4)


def ablation_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(Tables(spark, d))
    return rounded(evaluation.ablation(rows, features.FEATURES, lambda c: F.round(_linear(c), 6)), 4)


def bootstrap_std(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.bootstrap_std(evaluation.query_metrics(_labelled(Tables(spark, d)), "f01_faiss_score"))


def lambdamart_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Metrics on the fifth of the queries held out for testing; another fifth stops the training."""
    train, valid, test = ranker.split_queries(cut_lineage(_labelled(Tables(spark, d))))
    model = ranker.train(train, valid, rounds=50, depth=5, patience=10)
    return evaluation.macro_average(evaluation.query_metrics(model.score(test)))


def cold_start_boost(spark: SparkSession, d: str) -> DataFrame:
    """features_test's retrieval scores per query, boosted; queries are its (user, item) pairs."""
    t = Tables(spark, d)
    r = _given_candidates(t).filter("faiss_score is not null").select(F.concat_ws("|", "user_id", "query_parent_asin").alias("query_id"), F.col("candidate_parent_asin").alias("item"), F.col("faiss_score").alias("score"))
    return retrieval.cold_start_boost(r, t.products(), k=TOP_K)


def diverse_users(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return reports.diverse_users(t.raw("user_profiles"), t.raw("features_test"))


def user_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(Tables(spark, d)).withColumn("score", F.round(_linear({c: F.col(c) for c in features.FEATURES}), 6))
    out = reports.user_report(rows, features.FEATURES)
    return out.select("user_id", "query_parent_asin", F.array_join("top_by_retrieval", ",").alias("top_by_retrieval"), F.array_join("top_by_model", ",").alias("top_by_model"), "truth_rank_retrieval", "truth_rank_model", "in_top10_retrieval", "in_top10_model")


def user_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Title and largest features of the model's first candidate of every query."""
    t = Tables(spark, d)
    rows = _labelled(t).withColumn("score", F.round(_linear({c: F.col(c) for c in features.FEATURES}), 6))
    out = reports.user_report(rows, features.FEATURES, titles=t.meta().select("parent_asin", "title"))
    return out.select("user_id", "query_parent_asin", F.element_at("top_by_model", 1).alias("first_title"), F.array_join("reasons", ",").alias("reasons"))


def query_version_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(Tables(spark, d))
    first, second = (evaluation.query_metrics(rows, c) for c in ("f01_faiss_score", "f31_bm25_score"))
    return rounded(evaluation.compare_query_versions(first, second))


def recent_history(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest interactions of every user."""
    return interactions.last_items(Tables(spark, d).reviews(), 10).withColumn("place", F.col("place").cast("long"))


def product_comparison(spark: SparkSession, d: str) -> DataFrame:
    p = Tables(spark, d).products()
    ids = [r[0] for r in p.select("parent_asin").orderBy("parent_asin").limit(3).collect()]
    out = reports.compare_products(p, ids)
    return rounded(out.select("signal", *[F.col(f"`{i}`").alias(f"product_{n}") for n, i in enumerate(ids, 1)]), 4)


def rich_docs(spark: SparkSession, d: str) -> DataFrame:
    return documents.rich_documents(Tables(spark, d).products())


def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = Tables(spark, d).meta()
    return documents.token_statistics(m.select(documents.token_count(F.concat_ws(" ", "title", "description")).alias("token_count")))


def voice_docs(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return documents.voice_documents(t.raw("user_profiles"), t.reviews())


def query_understanding(spark: SparkSession, d: str) -> DataFrame:
    """Titles and descriptions of the catalogue read as queries."""
    q = documents.understand_queries(Tables(spark, d).meta().select(F.concat_ws(" ", "title", "description").alias("raw_query")))
    return q.select("raw_query", F.array_join("intent", ",").alias("intent"), F.array_join("attributes", ",").alias("attributes"), "constraints.max_price", "constraints.min_price", "constraints.approx_price", "constraints.price_preference", F.array_join("expanded", ",").alias("expanded"), "final_query")


def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = documents.rich_documents(Tables(spark, d).products())
    return documents.encode_texts(docs, "parent_asin", "rich_text", weights=documents.inverse_document_frequency(docs, "rich_text"))


def search_text(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    m = t.meta().select("parent_asin", F.concat_ws(" ", "title", "description").alias("text"))
    items = documents.encode_texts(m, "parent_asin", "text").select(F.col("parent_asin").alias("item"), F.col("embedding").alias("vec"))
    return reports.search(spark, "a relaxing story driven rpg under $20", items)


QUERIES = {
    f.__name__: f
    for f in (
        user_interactions, user_preferences, user_review_signals, user_vectors, cold_start_tiers, tier_distribution, profile_table, lambda_diagnostic, blended_queries, vector_norms, norm_check, exact_topk, single_query_topk,
        self_recall, ivf_topk, ivf_recall, home_feed, candidates_forced, features_wide, feature_stats, features_scaled, feature_nulls, query_metrics, query_counts, system_comparison, relative_improvement, version_comparison, ablation_metrics,
        bootstrap_std, lambdamart_rerank, cold_start_boost, diverse_users, user_report, user_reasons, query_version_comparison, recent_history, product_comparison, rich_docs, token_statistics, voice_docs, query_understanding, text_vectors, search_text,
    )
}
