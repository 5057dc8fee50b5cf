"""Registered queries of the subpackage; their SQL is in ``sql.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import distinctive, fusion, language, mixing, neardup, similar, tokenize, topn
from lodestar.llm.sql import SQL
from lodestar.session import read_spread, read_table

QUERY_KEY, CANDIDATE = ["user_id", "query_parent_asin"], "candidate_parent_asin"
FUSED_SCORES = ["f01_faiss_score", "f31_bm25_score", "f05_avg_rating"]


def _nearest(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    items = similar.usable_vectors(read_table(spark, sf_dir, "item_embeddings"), "parent_asin", "embedding")
    users = similar.usable_vectors(read_table(spark, sf_dir, "user_profiles"), "user_id", "combined_embedding")
    return [("item", similar.nearest(items)), ("user", similar.nearest(users))]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, items), (b, users) = _nearest(spark, sf_dir)
    both = similar.pairs(items).withColumn("vec_set", F.lit(a)).unionByName(similar.pairs(users).withColumn("vec_set", F.lit(b)))
    return both.select("vec_set", "id_a", "id_b")


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, items), (b, users) = _nearest(spark, sf_dir)
    return items.withColumn("vec_set", F.lit(a)).unionByName(users.withColumn("vec_set", F.lit(b)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews, products = read_spread(spark, sf_dir, "reviews"), read_table(spark, sf_dir, "products_nlp")
    words = distinctive.residual_idf(distinctive.word_occurrences(reviews), distinctive.record_count(reviews), 5, 0.75)
    out = words.select(F.lit("reviews.text").alias("field"), "parent_asin", "term")
    for column in ("top_tfidf_phrases", "distinctive_terms"):
        scored = distinctive.residual_idf(distinctive.listed_terms(products, column), distinctive.record_count(products), most_records=3)
        out = out.unionByName(scored.filter(F.col("df") >= 2).select(F.lit(f"products_nlp.{column}").alias("field"), "parent_asin", "term"))
    return out


def p3_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = read_spread(spark, sf_dir, "reviews")
    return distinctive.residual_idf(distinctive.word_occurrences(reviews), distinctive.record_count(reviews))


def p3_term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = read_table(spark, sf_dir, "products_nlp")
    both = [
        distinctive.residual_idf(distinctive.listed_terms(products, c), distinctive.record_count(products)).withColumn("field", F.lit(f"products_nlp.{c}"))
        for c in ("top_tfidf_phrases", "distinctive_terms")
    ]
    return both[0].unionByName(both[1])


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.review_and_description_texts(read_spread(spark, sf_dir, "reviews"), read_table(spark, sf_dir, "meta_clean"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(_texts(spark, sf_dir), words=3, threshold=0.5, least_words=40)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_texts(spark, sf_dir), words=5, threshold=0.8, least_words=5)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(read_table(spark, sf_dir, "features_test"), QUERY_KEY, CANDIDATE, FUSED_SCORES)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.least_place_sum(_fused(spark, sf_dir), QUERY_KEY, CANDIDATE)


def p5_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).withColumn("rrf", F.round("rrf", 9))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one order of candidates per query: position 1 has the highest fused score."""
    return fusion.ranking(_fused(spark, sf_dir), QUERY_KEY, CANDIDATE)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topn.top_n_per_group(read_table(spark, sf_dir, "features_test"), QUERY_KEY, CANDIDATE, "f01_faiss_score", 10)
    return best.select(*QUERY_KEY, CANDIDATE)


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topn.top_n_per_group(read_table(spark, sf_dir, "features_test"), QUERY_KEY, CANDIDATE, "f01_faiss_score", 10)
    return best.select(*QUERY_KEY, CANDIDATE, F.col("place").cast("long").alias("place"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(read_spread(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_spread(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(read_spread(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(read_spread(spark, sf_dir, "documents"), read_table(spark, sf_dir, "lang_samples"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_faults(_classified(spark, sf_dir))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "lang_label", "lang", "confidence")


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.passages(_classified(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_nearest, p3_found, p3_word_scores, p3_term_scores, p4_found, p4_groups, p5_found, p5_fused, p5_ranking, p6_found, p6_places,
        p7_ids, p8_mix, p8_shares, p9_found, p9_documents, p9_passages,
    )
}
