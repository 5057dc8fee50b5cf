"""Thresholds forced low, storage round trips, and what a failure must not hide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import ranking
from lodestar.operators import evaluation, interactions, ranker, reports, retrieval, tfidf
from lodestar.sources import readers, sinks


def test_percentiles_of_several_columns(spark):
    rows = [(float(i % 7), None if i % 3 else float(i), float("nan")) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    columns = {"a5": (F.col("a"), 0.5), "a9": (F.col("a"), 0.9), "b5": (F.col("b"), 0.5), "c5": (F.col("c"), 0.5)}
    for hot in (1_000_000, 1):
        got = ranking.column_percentiles(df, columns, hot_rows=hot).first()
        assert got.a5 == np.percentile([r[0] for r in rows], 50) and got.a9 == pytest.approx(np.percentile([r[0] for r in rows], 90))
        assert got.b5 == np.percentile([r[1] for r in rows if r[1] is not None], 50) and got.c5 is None
    assert ranking.column_percentiles(df.limit(0), columns).first().a5 is None


def test_metrics_of_hot_queries(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [("u", f"q{i % 3}", f"c{i:03d}", int(rng.integers(0, 3)), float(rng.integers(0, 9)) if i % 5 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "user_id string, query_parent_asin string, candidate_parent_asin string, relevance_label int, score double")
    want = sorted(map(tuple, evaluation.query_metrics(df).collect()))
    monkeypatch.setattr(evaluation, "hot_groups", lambda d, keys: ranking.hot_groups(d, keys, 1))
    assert np.allclose([r[2:] for r in sorted(map(tuple, evaluation.query_metrics(df).collect()))], [r[2:] for r in want])
    both = evaluation.compare_query_versions(evaluation.query_metrics(df), evaluation.query_metrics(df)).collect()
    assert len(both) == 3 and all(r.change == 0 for r in both)


def test_splits_of_repeated_and_undated_rows(spark):
    rows = [("u", "a", 3), ("u", "a", 3), ("u", "b", 2), ("u", "c", None), ("v", "a", 1), ("v", "b", 2), (None, "a", 1), (None, "b", 2), (None, "c", 3)]
    df = spark.createDataFrame(rows, "user_id string, parent_asin string, timestamp int")
    got = sorted((r.user_id or "-", r.parent_asin, r.split) for r in interactions.leave_last_out(df).collect())
    assert got == [("-", "a", "train"), ("-", "b", "valid"), ("-", "c", "test"), ("u", "a", "test"), ("u", "a", "test"), ("u", "b", "valid"), ("u", "c", "train"), ("v", "a", "train"), ("v", "b", "train")]
    last = [(r.user_id, r.parent_asin, r.place) for r in interactions.last_items(df.withColumn("rating", F.lit(1.0)), 1).filter("user_id is not null").orderBy("user_id").collect()]
    assert last == [("u", "a", 1), ("v", "b", 1)]


def test_no_core_in_time_raises(spark):
    df = spark.createDataFrame([(f"u{i}", f"i{i}") for i in range(5)] + [(f"u{i}", f"i{i + 1}") for i in range(5)], "user_id string, parent_asin string")
    assert interactions.k_core(df, 2).count() == 0
    with pytest.raises(RuntimeError):
        interactions.k_core(df, 2, passes=1)


def test_clusters_are_searched_by_blocks(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(f"i{i:03d}", [float(v) for v in rng.normal(size=8)]) for i in range(150)], "item string, vec array<double>")
    queries = items.limit(40).withColumnRenamed("item", "query_id")
    exact = sorted(map(tuple, retrieval.exact_top_k(queries, items, 5).collect()))
    assert sorted(map(tuple, retrieval.ivf_top_k(queries, items, 5, nlist=3, nprobe=3, rows=7).collect())) == exact
    assert [retrieval.list_count(n) for n in (0, 10_000, 10**9)] == [16, 100, 2048]
    assert retrieval.total(items) == 150 and len(retrieval.fetch_vector(items, "i003")) == 8 and retrieval.fetch_vector(items, "none") is None
    seen = retrieval.latency_check(items, [retrieval.fetch_vector(items, "i003")] * 3, 5)
    assert seen["searches"] == 2 and seen["full"] and seen["max_ms"] >= seen["mean_ms"] > 0
    with pytest.raises(RuntimeError):
        retrieval.latency_check(items, [retrieval.fetch_vector(items, "i003")], 5, limit_ms=0.0)


def test_ranker_is_stored_and_scores_as_its_trees(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"u{q}", "q", f"c{c}", int(x > 0.6) + int(x > 0.9), float(x), float(rng.random())) for q in range(25) for c, x in enumerate(rng.random(8))]
    df = spark.createDataFrame(rows, "user_id string, query_parent_asin string, candidate_parent_asin string, relevance_label int, f01_faiss_score double, f05_avg_rating double")
    names = ["f01_faiss_score", "f05_avg_rating"]
    model = ranker.train(df, features=names, rounds=3, depth=2, learning_rate=0.3)
    first = {r.user_id + r.candidate_parent_asin: r.score for r in model.score(df).collect()}
    model.save(spark, str(tmp_path / "m"))
    again = ranker.Ranker.load(spark, str(tmp_path / "m"))
    assert again.features == names and {r.user_id + r.candidate_parent_asin: r.score for r in again.score(df).collect()} == first
    by_hand = {}
    for u, _, c, _, *x in rows:
        total = 0.0
        for tree in model.nodes:
            at = 0
            while tree[at][2] >= 0:
                at = tree[at][4] if x[tree[at][2]] <= tree[at][3] else tree[at][5]
            total += 0.3 * tree[at][6]
        by_hand[u + c] = total
    assert all(abs(first[k] - v) < 1e-9 for k, v in by_hand.items()) and len(set(first.values())) > 2
    groups = {r.group: r.importance for r in again.by_group(spark, {"retrieval": names[:1], "product": names[1:], "other": ["x"]}).collect()}
    assert abs(groups["retrieval"] + groups["product"] - 1) < 1e-9 and groups["other"] == 0 and groups["retrieval"] > 0.8
    assert model.score(df.limit(0)).count() == 0
    nulls = df.limit(1).withColumn("f01_faiss_score", F.lit(None).cast("double"))
    assert model.score(nulls).first().score is not None


def test_reports_go_to_the_file_system_of_their_path(spark, tmp_path):
    path = (tmp_path / "progress.txt").as_uri()
    sinks.write_progress(path, {"a": True, "b": False})
    sinks.write_progress(path, {"a": True, "b": True})
    assert (tmp_path / "progress.txt").read_text() == "[x] a\n[x] b\n"
    assert readers.exists(spark, path) and readers.remove(spark, path) and not readers.exists(spark, path)
    text = reports.metrics_text(spark.createDataFrame([("ann", *[0.5] * 8)], "system string, " + ", ".join(f"{m} double" for m in evaluation.METRICS)))
    assert "ann" in text and "0.5000" in text


def test_histories_by_blocks(spark):
    rows = [("u", f"i{i % 7}" if i % 5 else None, i % 11 or None) for i in range(40)] + [("v", None, 1), ("v", None, 2), ("v", "é", 3), ("v", "", 4), ("v", "b", 5), (None, "a", 2), (None, "b", 1), ("w", "a", 1)]
    df = spark.createDataFrame(rows, "user_id string, parent_asin string, timestamp int")
    want = []
    for user in {r[0] for r in rows}:
        seen = []
        for r in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2] is None, r[2] or 0, r[1] is not None, r[1] or "")):
            want.append((*r, " ".join(seen)))
            seen += [r[1]] if r[1] is not None else []
    for n in (1, 3, 2048):
        got = [tuple(r) for r in interactions.prefix_history(df, block_rows=n).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_histories_of_a_hot_user_are_spread(spark):
    n = 9000
    df = spark.range(n).select(F.lit("u").alias("user_id"), F.format_string("V%09d", "id").alias("parent_asin"), F.col("id").alias("timestamp"))
    h = interactions.prefix_history(df).select(F.spark_partition_id().alias("p"), F.length("history").alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    assert len(h) > 1 and sum(r.n for r in h) == sum(11 * i - 1 for i in range(1, n))


def test_written_histories_grow_with_the_rows(spark, tmp_path):
    import __spark_entry__

    h = __spark_entry__.queries()["prefix_history"](spark, "/root/testdata/sf0.01")
    h.write.parquet(str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    text = back.agg(F.sum(F.octet_length("history"))).first()[0]
    assert sum(f.stat().st_size for f in (tmp_path / "h").glob("*.parquet")) < text / 4
    assert back.exceptAll(h).count() == 0 and back.count() == h.count()


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 6))) for _ in range(n)]


def test_bm25_by_blocks(spark, monkeypatch):
    docs = [(f"d{i:02d}", t) for i, t in enumerate(texts(40, 1))] + [("none", None), ("copy", "w1 w2"), ("copy", "w1")]
    asked = [(f"q{i:02d}", t) for i, t in enumerate(texts(25, 2))] + [("none", None), ("other", "zz"), ("both", "w1 zz"), ("both", "w1 w3"), (None, "w1")]
    tf = {}
    for d, t in docs:
        for w in (t or "").split():
            tf.setdefault(d, {}).setdefault(w, 0)
            tf[d][w] += 1
    length = {d: sum(v.values()) for d, v in tf.items()}
    mean, want = sum(length.values()) / len(length), {}
    words = {q: {w for name, t in asked if name == q for w in (t or "").split()} for q, _ in asked if q}
    for q, some in words.items():
        for d, has in tf.items():
            if hit := some & set(has):
                df = {w: sum(w in v for v in tf.values()) for w in hit}
                want[q, d] = sum(np.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * has[w] * 2.5 / (has[w] + 1.5 * (0.25 + 0.75 * length[d] / mean)) for w in hit)
    best = {q: max(v for (n, _), v in want.items() if n == q) for q, _ in want}
    df_q, df_d = (spark.createDataFrame(x, f"{k} string, text string") for x, k in ((asked, "query_id"), (docs, "doc_id")))
    for sizes in ((4096, 50_000, 256, 100_000), (3, 7, 1, 5)):
        for name, n in zip(("BLOCK_QUERIES", "BLOCK_DOCUMENTS", "LEAST_QUERIES", "BATCH_SCORES"), sizes, strict=True):
            monkeypatch.setattr(tfidf, name, n)
        got = tfidf.bm25(df_q, df_d).collect()
        assert len(got) == len(want) and {(r.query_id, r.doc_id) for r in got} == set(want)
        assert all(abs(r.bm25 - want[r.query_id, r.doc_id]) < 2e-6 and abs(r.bm25_scaled - want[r.query_id, r.doc_id] / best[r.query_id]) < 2e-6 for r in got)
    assert tfidf.bm25(df_q.limit(0), df_d).count() == tfidf.bm25(df_q, df_d.limit(0)).count() == 0


def test_bm25_scores_are_not_shuffled(spark):
    rows = spark.range(300).select(F.format_string("d%03d", "id").alias("doc_id"), F.concat(F.lit("red fox "), F.col("id").cast("string")).alias("text"))
    out = tfidf.bm25(rows.withColumnRenamed("doc_id", "query_id"), rows)
    plan = out._jdf.queryExecution().executedPlan().toString()  # every exchange is below the step that makes the scores
    assert out.count() == 300 * 300 and "Exchange" not in plan[: plan.index("MapInArrow")]
