import gzip
import json

import pytest

from lodestar.config import Settings
from lodestar.plans import pipeline
from lodestar.sources import readers, sinks


def test_json_lines(spark, tmp_path):
    f = tmp_path / "m.jsonl.gz"
    lines = [json.dumps({"parent_asin": "a", "title": "t", "features": ["x", None], "other": 1}), "", "{broken", json.dumps({"parent_asin": "b"})]
    with gzip.open(f, "wt") as out:
        out.write("\n".join(lines) + "\n")
    rows, bad = readers.read_json_lines(spark, str(f), readers.META_SCHEMA, partitions=2)
    assert sorted(r.parent_asin for r in rows.collect()) == ["a", "b"] and [r.line for r in bad.collect()] == ["{broken"]
    assert "other" not in rows.columns and readers.count_lines(spark, str(f)) == 3
    with pytest.raises(ValueError):
        readers.read_reviews(spark, str(f), readers.META_SCHEMA)


def test_csv(spark, tmp_path):
    f = tmp_path / "i.csv"
    f.write_text("user_id,parent_asin,rating,timestamp,history\nu,p,x,12,\nu,q,4.0,,p\n")
    rows = readers.read_interactions(spark, str(f)).orderBy("parent_asin").collect()
    assert [(r.rating, r.timestamp, r.history) for r in rows] == [(None, 12.0, ""), (4.0, None, "p")]
    f.write_text("user_id,parent_asin\nu,p\n")
    with pytest.raises(ValueError):
        readers.read_interactions(spark, str(f))


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(str(i), [float(i)] * (2 if i else 3)) for i in range(5)], "id string, embedding array<double>")
    path = str(tmp_path / "t")
    sinks.write_table(df.limit(3), path)
    assert sinks.append_missing(df, path, "id") == 2 and spark.read.parquet(path).count() == 5
    assert readers.read_columns(spark, path, ["id", "nope"]).columns == ["id"]
    assert readers.read_rows_of(spark, path, "id", ["1", "2"]).count() == 2
    assert readers.read_vectors(spark, path, 2).count() == 4
    assert readers.read_vectors_if_any(spark, path + "x", 2) is None
    sinks.write_report(df, str(tmp_path / "r.json"))
    assert len(json.loads((tmp_path / "r.json").read_text())["rows"]) == 5


def test_pipeline_runs_and_skips(spark, tmp_path):
    import random

    rng = random.Random(0)
    s = Settings(data_dir=str(tmp_path), min_reviews_per_user=2, min_reviews_per_item=1, top_k=5, dimension=8)
    meta = [(f"p{i}", f"Title {i}", "A great game about things.", "fast. fun", 1.0 + i, "store", f"Games. C{i % 3}", 4.0, i) for i in range(12)]
    spark.createDataFrame(meta, "parent_asin string, title string, description string, features string, price double, store string, categories string, average_rating double, rating_number long").write.parquet(s.path("raw_meta"))
    rows = [(f"r{u}_{i}", f"u{u}", f"p{i}", float(rng.randint(1, 5)), "The story is great. Controls are bad!", 1_600_000_000_000 + 86_400_000 * (u * 3 + i), i % 3, True) for u in range(10) for i in rng.sample(range(12), 6)]
    spark.createDataFrame(rows, "review_id string, user_id string, parent_asin string, rating double, text string, timestamp long, helpful_vote long, verified_purchase boolean").write.parquet(s.path("raw_reviews"))
    ran = pipeline.run(spark, s, until="user_profiles")
    assert ran[-1] == "user profiles" and pipeline.run(spark, s, until="user_profiles") == []
    assert len(spark.read.parquet(s.path("products_nlp")).columns) == 95
    assert len(spark.read.parquet(s.path("user_profiles")).columns) == 39
    done = {name for _, name, ok in pipeline.status(spark, s) if ok}
    assert "user_profiles" in done and "metrics" not in done


def small_inputs(spark, s):
    import random

    rng = random.Random(1)
    meta = [(f"p{i}", f"Title{i} saga", f"A great game about things{i}.", "fast. fun", 1.0 + i, "store", f"Games. C{i % 3}", 4.0, i) for i in range(12)]
    spark.createDataFrame(meta, "parent_asin string, title string, description string, features string, price double, store string, categories string, average_rating double, rating_number long").write.parquet(s.path("raw_meta"))
    rows = [(f"r{u}_{i}", f"u{u}", f"p{i}", float(rng.randint(1, 5)), f"The story {i} is great. Controls are bad!", 1_600_000_000_000 + 86_400_000 * (u * 30 + n), i % 3, True) for u in range(10) for n, i in enumerate(rng.sample(range(12), 6))]
    spark.createDataFrame(rows, "review_id string, user_id string, parent_asin string, rating double, text string, timestamp long, helpful_vote long, verified_purchase boolean").write.parquet(s.path("raw_reviews"))


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    s = Settings(data_dir=str(tmp_path_factory.mktemp("whole")), min_reviews_per_user=2, min_reviews_per_item=1, top_k=5, dimension=8, rounds=4, patience=2)
    small_inputs(spark, s)
    pipeline.run(spark, s)
    return s


def test_pipeline_to_the_end(spark, finished):
    read = lambda name: spark.read.parquet(finished.path(name))
    splits, queries, candidates, features = read("splits"), read("queries"), read("candidates"), read("features")
    assert sorted((r["split"], r["count"]) for r in splits.groupBy("split").count().collect()) == [("test", 10), ("train", 40), ("valid", 10)]
    keys = lambda df, item: {(r.split, r.user_id, r[item]) for r in df.collect()}
    assert keys(splits, "parent_asin") == keys(queries, "query_parent_asin") == keys(candidates, "query_parent_asin") == keys(features, "query_parent_asin")
    assert features.count() == candidates.count()
    held = {(r.user_id, r.parent_asin): r.split for r in splits.collect()}
    for r in queries.collect():
        earlier = [held[r.user_id, x] for x in r.history.split()]
        assert r.query_parent_asin not in r.history.split() and set(earlier) <= {"train": {"train"}, "valid": {"train"}, "test": {"train", "valid"}}[r.split]
        assert len(earlier) == {"valid": 4, "test": 5}.get(r.split, len(earlier))
        assert sum(x * x for x in r.query_vec) == pytest.approx(1)  # users with an empty history have their profile
    assert {r.system for r in read("metrics").collect()} == {"random", "bm25", "ann", "model"}
    assert all(done for _, _, done in pipeline.status(spark, finished))


def test_features_have_history_vectors_voices_and_words(spark, finished):
    rows = spark.read.parquet(finished.path("features")).collect()
    own = [r for r in rows if r.query_parent_asin == r.candidate_parent_asin]
    assert any(r.f03_query_item_cosine < 0.99 for r in own)  # the query is not the held-out item itself
    for name in ("f18_user_item_voice_cosine", "f31_bm25_score"):
        assert len({r[name] for r in rows}) > 1 and all(0 <= r[name] <= 1 for r in rows)
    first = {(r.split, r.user_id, r.query_parent_asin) for r in spark.read.parquet(finished.path("queries")).collect() if not r.history}
    assert first and all(r.f31_bm25_score == 0 for r in rows if (r.split, r.user_id, r.query_parent_asin) in first)


def test_bm25_of_given_pairs(spark):
    from lodestar.operators import tfidf

    q = spark.createDataFrame([("q", "red fox"), ("r", "blue")], "query_id string, text string")
    docs = spark.createDataFrame([("a", "red fox red"), ("b", "red car"), ("c", "blue fox")], "doc_id string, text string")
    every = {(r.query_id, r.doc_id): r.bm25 for r in tfidf.bm25(q, docs).collect()}
    got = {(r.query_id, r.doc_id): (r.bm25, r.bm25_scaled) for r in tfidf.bm25(q, docs, pairs=spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "a")], "query_id string, doc_id string")).collect()}
    assert set(got) == {("q", "b"), ("q", "c")} and all(v[0] == every[k] for k, v in got.items()) and max(v[1] for v in got.values()) == 1
