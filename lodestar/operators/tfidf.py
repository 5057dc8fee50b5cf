"""Per-category TF-IDF of product review texts, and Okapi BM25 over product texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.columns import let
from lodestar.functions.ranking import with_positions
from lodestar.session import cut_lineage


# Our own list of English function words (the usual public choice is a parameter).
STOP_WORDS = (
    "a about after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own "
    "same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who "
    "why will with would you your"
).split()


def terms_of(text: Column, stop: list[str]) -> Column:
    """Uni- and bigrams over the lower-cased word tokens (two or more of a-z, 0-9, _) that are not stop words."""
    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0)), lambda w: ~w.isin(stop))
    less = lambda words: F.greatest(F.size(words) - 1, F.lit(0))
    pairs = lambda words: F.zip_with(F.slice(words, 1, less(words)), F.slice(words, 2, less(words)), lambda a, b: F.concat_ws(" ", a, b))
    return let(kept, lambda words: F.concat(words, pairs(words)))


def category_weights(products: DataFrame, reviews: DataFrame, max_features: int = 50_000, min_df: int = 2, stop: list[str] | None = None) -> DataFrame:
    """(leaf_category, parent_asin, term, weight, centroid): L2-normalised (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) of every kept term.

    A product's document is all its review texts; n-grams are taken inside each review, so no product's texts are ever gathered in one task. Terms need a document frequency of
    ``min_df`` in the category (1 if it has fewer documents), and the ``max_features`` with the highest counts are kept (ties: alphabetical).
    """
    stop = STOP_WORDS if stop is None else stop
    docs = reviews.filter(F.coalesce(F.trim("text"), F.lit("")) != "").select("parent_asin", F.explode(terms_of(F.col("text"), stop)).alias("term"))
    per_product = docs.groupBy("parent_asin", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut_lineage(per_product.join(products.select("parent_asin", "leaf_category"), "parent_asin"))  # read three times below
    written = reviews.filter(F.coalesce(F.trim("text"), F.lit("")) != "").select("parent_asin").distinct()
    n_docs = products.join(written, "parent_asin", "left_semi").groupBy("leaf_category").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("leaf_category", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    known = df.join(n_docs, "leaf_category").filter(F.col("df") >= F.when(F.col("n") < min_df, 1).otherwise(min_df))
    placed = with_positions(cut_lineage(known.withColumn("_down", -F.col("total"))), ["leaf_category"], "_down", ["term"])  # a category of any size
    vocabulary = placed.filter(F.col("position") < max_features).drop("_down", "position", "group_rows")
    weighted = tf.join(vocabulary, ["leaf_category", "term"]).withColumn("raw", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    weighted = cut_lineage(weighted.select("leaf_category", "parent_asin", "term", "n", "raw"))
    lengths = weighted.groupBy("parent_asin").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    unit = weighted.join(lengths, "parent_asin").select("leaf_category", "parent_asin", "term", "n", (F.col("raw") / F.col("length")).alias("weight"))
    centroid = unit.groupBy("leaf_category", "term").agg((F.sum("weight") / F.max("n")).alias("centroid"))
    return unit.join(centroid, ["leaf_category", "term"]).select("leaf_category", "parent_asin", "term", "weight", "centroid")


def _top(weights: DataFrame, value: Column, k: int, name: str) -> DataFrame:
    w = Window.partitionBy("parent_asin").orderBy(F.col("v").desc(), "term")
    best = weights.withColumn("v", F.round(value, 9)).filter("v > 0").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    return best.groupBy("parent_asin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), ", ").alias(name))


def category_terms(products: DataFrame, reviews: DataFrame, max_features: int = 50_000, min_df: int = 2, stop: list[str] | None = None) -> DataFrame:
    """(parent_asin, top_tfidf_phrases, distinctive_terms): 10 terms by weight, 5 by weight above the category centroid."""
    weights = category_weights(products, reviews, max_features, min_df, stop)
    weights = cut_lineage(weights)
    return _top(weights, F.col("weight"), 10, "top_tfidf_phrases").join(_top(weights, F.col("weight") - F.col("centroid"), 5, "distinctive_terms"), "parent_asin", "full_outer")


#: Queries and documents that one task scores at most (about, as they are dealt by hash); queries in a block at least, if it's cut further to keep the cores busy.
BLOCK_QUERIES, BLOCK_DOCUMENTS, LEAST_QUERIES = 8192, 50_000, 256
#: Scores in a batch that goes back to Spark.
BATCH_SCORES = 100_000


def bm25(queries: DataFrame, documents: DataFrame, k1: float = 1.5, b: float = 0.75, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, bm25, bm25_scaled): Okapi scores of the documents that share a word with a query; scaled by the query's best.

    With ``pairs`` (query_id, doc_id) only those are scored (and scaled by their best), so that a common word doesn't meet all of its documents.

    ``queries`` (query_id, text) and ``documents`` (doc_id, text). Each different query word counts once. Without ``pairs`` the scores, which may be nearly as many as queries times documents, are never shuffled: see ``_block_scores``.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    tf = documents.select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    length = tf.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    scalars = length.agg(F.avg("len").alias("avg_len")).crossJoin(documents.agg(F.count(F.lit(1)).alias("n")))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    # statistics meet the postings only for terms that are asked for
    postings = tf.join(asked.select("term").distinct(), "term", "left_semi").join(length, "doc_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    if pairs is None:
        docs = postings.crossJoin(F.broadcast(scalars)).groupBy("doc_id").agg(_packed(part))
        found = asked.filter("query_id IS NOT NULL").distinct().join(df, "term").crossJoin(F.broadcast(scalars)).groupBy("query_id").agg(_packed(idf))
        return _block_scores(cut_lineage(found), cut_lineage(docs))
    postings = postings.join(df, "term").crossJoin(F.broadcast(scalars)).select("term", "doc_id", (idf * part).alias("part"))
    asked = asked.join(pairs.select("query_id", "doc_id").distinct(), "query_id")
    scores = asked.join(postings, ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.sum("part").alias("bm25"))
    best = scores.groupBy("query_id").agg(F.max("bm25").alias("_best"))
    return scores.join(best, "query_id").select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.round(F.col("bm25") / F.col("_best"), 6).alias("bm25_scaled"))


def _packed(value: Column) -> Column:
    """Terms and their values, in the order of the terms, as one struct of two arrays."""
    rows = F.array_sort(F.collect_list(F.struct("term", value.alias("value"))))
    return let(rows, lambda r: F.struct(F.array_join(F.transform(r, lambda x: x["term"]), " ").alias("terms"), F.transform(r, lambda x: x["value"]).alias("values"))).alias("has")


def _block_scores(queries: DataFrame, documents: DataFrame, block_queries: int | None = None, block_documents: int | None = None) -> DataFrame:
    """Scores of every query with every document that shares a term; ``has`` holds the terms of each with their weights.

    Blocks of queries meet blocks of documents, a pair of blocks in a task, which adds the weights up in one array over its documents and gives the scores out as they come. What is moved is the documents
    once per block of queries and the queries once per block of documents. The best score of a query may be in any block, so the sums are made twice: for the best, and for the scores.
    """
    spark = queries.sparkSession
    n_queries, n_documents = queries.count(), documents.count()
    down = max(1, -(-n_documents // (block_documents or BLOCK_DOCUMENTS)))
    for_cores = min(-(-n_queries // LEAST_QUERIES), -(-2 * spark.sparkContext.defaultParallelism // down))
    across = max(1, -(-n_queries // (block_queries or BLOCK_QUERIES)), for_cores)
    of = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = documents.select(of("doc_id", down).alias("d"), every(across).alias("q"), F.col("doc_id").cast("string").alias("id"), "has.*")

    def blocks(asked: DataFrame) -> DataFrame:
        asks = asked.select(every(down).alias("d"), of("query_id", across).alias("q"), F.col("query_id").cast("string").alias("id"), "has.*", "best")
        rows = held.withColumn("best", F.lit(None).cast("double")).withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)))
        rows = rows.select((F.col("q") * down + F.col("d")).cast("int").alias("block"), "asks", "id", "terms", "values", "best")
        return rows.repartitionById(across * down, "block").sortWithinPartitions("block", "asks")  # documents first

    best = blocks(queries.withColumn("best", F.lit(None).cast("double"))).mapInArrow(_best_of, "query_id string, best double").groupBy("query_id").agg(F.max("best").alias("best"))
    kinds = {**dict(queries.dtypes), **dict(documents.dtypes)}
    scores = blocks(queries.join(best.withColumn("query_id", F.col("query_id").cast(kinds["query_id"])), "query_id")).mapInArrow(_scores_of, "query_id string, doc_id string, bm25 double, bm25_scaled double")
    return scores.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("query_id", "doc_id")], "bm25", "bm25_scaled")


def _sums(batches):
    """For each query row of a sorted partition: (id, best, ids of the block's documents, positions with a score, their scores)."""
    block, rows, index = None, [], None
    for batch in batches:
        block_of, asks = batch["block"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((block_of[1:] != block_of[:-1]) | (asks[1:] != asks[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(asks)], strict=True):
            if start == end:
                continue
            run = batch.slice(start, end - start)
            if block_of[start] != block:
                block, rows, index = block_of[start], [], None
            if not asks[start]:
                rows.append(run)
                continue
            if index is None:
                index, rows = _postings(rows), []
            ids, terms, starts, places, weights = index
            for name, asked, values, best in zip(run["id"].to_pylist(), run["terms"].to_pylist(), run["values"].to_pylist(), run["best"].to_pylist(), strict=True):
                total = np.zeros(len(ids))
                for term, value in zip(asked.split(" "), values, strict=True):
                    if (k := terms.get(term)) is not None:
                        total[places[starts[k] : starts[k + 1]]] += value * weights[starts[k] : starts[k + 1]]
                at = np.flatnonzero(total)
                if len(at):
                    yield name, best, ids, at, total[at]


def _postings(batches: list[pa.RecordBatch]):
    """(document ids, place of each term, starts of the terms' postings, documents by place, weights), a document at most once in a term's."""
    if not batches:
        return pa.array([], "string"), {}, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, words, values = (table[c].combine_chunks() for c in ("id", "terms", "values"))
    words = pc.split_pattern(words, " ")
    places = np.repeat(np.arange(len(ids)), pc.list_value_length(words).to_numpy())
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
    return ids, {t: k for k, t in enumerate(coded.dictionary.to_pylist())}, starts, places[order], values.flatten().to_numpy()[order]


def _best_of(batches):
    names, best = [], []
    for name, _, _, _, scores in _sums(batches):
        names.append(name)
        best.append(scores.max())
    yield pa.RecordBatch.from_arrays([pa.array(names, "string"), pa.array(best, "double")], ["query_id", "best"])


def _scores_of(batches):
    held, n = [], 0
    for x in _sums(batches):
        held.append(x)
        n += len(x[3])
        if n >= BATCH_SCORES:
            yield from _written(held)
            held, n = [], 0
    yield from _written(held)


def _written(held: list):
    """One batch of the scores of some queries; rounded half up, as in SQL."""
    while held:
        ids, k = held[0][2], next((k for k, x in enumerate(held) if x[2] is not held[0][2]), len(held))  # of one block's documents
        some, held = held[:k], held[k:]
        names, at, scores = pa.array([x[0] for x in some], "string"), np.concatenate([x[3] for x in some]), np.concatenate([x[4] for x in some])
        n = [len(x[3]) for x in some]
        scaled = scores / np.repeat([x[1] for x in some], n)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(some)), n))), ids.take(pa.array(at)), *(pa.array(np.floor(v * 1e6 + 0.5) / 1e6) for v in (scores, scaled))], ["query_id", "doc_id", "bm25", "bm25_scaled"])
