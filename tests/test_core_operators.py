import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.config import ASPECTS, LEXICON, load_settings
from lodestar.functions import columns as C
from lodestar.functions.ranking import join_percent_rank, with_positions
from lodestar.operators import cleaning, documents, evaluation, features, interactions, ranker, retrieval, sentiment, users


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,price", [("from 14.99", 14.99), ("$1,299.00", 1299.0), ("N/A", None), (None, None), ("", None)])
def test_parse_price(spark, text, price):
    assert one(spark, C.parse_price(F.col("p")), p=text) == price


def test_scalar_cleaning(spark):
    assert one(spark, C.squeeze(F.col("t")), t="  a   b\n\tc ") == "a b c"
    assert one(spark, C.word_count(F.col("t")), t="") == 0
    assert one(spark, C.leaf_category(F.col("t")), t="Games. PC . ") == "PC"
    assert one(spark, C.leaf_category(F.col("t")), t=None) == "Unknown"
    assert one(spark, C.keyword_frequency(F.col("t"), ["fun", "un"]), t="Fun funny") == 4
    assert one(spark, C.graded_label(F.col("r")), r=2.5) == 2
    df = spark.createDataFrame([([" a ", None, "", "b"],), (None,)], "v array<string>")
    assert [r.x for r in df.select(C.flatten_list(F.col("v")).alias("x")).collect()] == ["a. b", ""]


def test_meta_and_reviews(spark):
    meta = spark.createDataFrame([(" A ", None, "d", "f", 1.0, "s", "c", 4.0, 1, "x"), ("A", "t", "d", "f", 1.0, "s", "c", 4.0, 1, "x"), (None,) * 10, ("", "t") + (None,) * 8],
                                 "parent_asin string, title string, description string, features string, price double, store string, categories string, average_rating double, rating_number long, _n string")
    assert [(r.parent_asin, r.title) for r in cleaning.clean_meta(meta).collect()] == [("A", "A")]
    rows = [("r1", "u", "p", 5.0, "a", 10, 1, True), ("r2", "u", " p", 4.0, None, None, None, None), ("r3", "u", "q", 0.0, "", 1, 1, True), ("r4", None, "q", 3.0, "", 1, 1, True), ("r5", "u", "z", float("nan"), "", 1, 1, True)]
    r = spark.createDataFrame(rows, "review_id string, user_id string, parent_asin string, rating double, text string, timestamp long, helpful_vote long, verified_purchase boolean")
    assert [x.review_id for x in cleaning.clean_reviews(r).collect()] == ["r1"]
    assert cleaning.clean_reviews(r.limit(0)).count() == 0


def test_k_core_needs_passes_and_collapses(spark):
    edges = [(f"u{i}", f"i{j}") for i in range(4) for j in range(3)] + [("u9", "i0"), ("u9", "i9"), ("u8", "i9")]
    df = spark.createDataFrame(edges, "user_id string, parent_asin string")
    kept = {tuple(r) for r in interactions.k_core(df, 3).collect()}
    assert kept == {(f"u{i}", f"i{j}") for i in range(4) for j in range(3)}
    assert interactions.k_core(df, 6).count() == 0
    assert interactions.k_core(df.limit(0), 2).count() == 0


def test_positions_are_the_same_in_buckets(spark):
    rows = [("a", float(i % 17) if i % 11 else None, i) for i in range(300)] + [("b", 1.0, 1), (None, 2.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    plain = sorted(map(tuple, with_positions(df, ["k"], "v", ["i"]).select("k", "i", "position", "group_rows").collect()), key=str)
    assert sorted(map(tuple, with_positions(df, ["k"], "v", ["i"], hot_rows=50).select("k", "i", "position", "group_rows").collect()), key=str) == plain


def test_rank_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = sorted((r.k, r.v or 0, r.p) for r in join_percent_rank(df, ["k"], "v", "p").collect())
    assert got == [("a", 0, None), ("a", 1.0, 0.5), ("a", 1.0, 0.5), ("a", 3.0, 1.0), ("b", 2.0, 1.0)]


def test_sentiment_rules():
    s = sentiment.RuleScorer()
    assert s("good") > 0 > s("bad") and s("") == 0 and s(None) == 0
    assert s("very good") > s("good") > s("good but bad")
    assert s("not good") < 0 and s("GOOD thing") > s("good thing") and s("good!!!") > s("good")
    assert abs(s("good") - LEXICON["good"] / math.sqrt(LEXICON["good"] ** 2 + 15)) < 1e-12


def test_bag_and_rules_share_columns(spark):
    df = spark.createDataFrame([("r1", "The story is great. The controls are terrible!"), ("r2", None), ("r3", "")], "review_id string, text string")
    a, b = sentiment.score_by_bag(df), sentiment.score_by_rules(df)
    assert a.columns == b.columns
    for scored in (a, b):
        r = {x.review_id: x for x in scored.collect()}
        assert r["r1"].aspect_story > 0 > r["r1"].aspect_controls and r["r1"].aspect_graphics is None
        assert r["r2"].sentiment_score == 0 and r["r3"].sentiment_label == "neutral"


def test_weighted_means_and_blending(spark):
    rows = [("u", [1.0, 0.0], 1.0), ("u", [0.0, 1.0], 3.0), ("u", None, 9.0), ("w", [1.0, 1.0], 0.0)]
    df = spark.createDataFrame(rows, "k string, v array<double>, w double")
    got = {r.k: r.m for r in users.weighted_mean_vectors(df, "k", "v", {"m": F.col("w")}).collect()}
    assert got["u"] == pytest.approx([0.25 / math.hypot(0.25, 0.75), 0.75 / math.hypot(0.25, 0.75)]) and got["w"] is None
    q, u, c, v = [1.0, 0.0], [0.0, 1.0], [0.0, -1.0], [-1.0, 0.0]
    cases = [(0, None, None, None, None), (1, u, None, None, None), (2, u, None, None, None), (3, None, None, c, v), (3, None, None, None, v), (3, None, None, c, None), (3, None, None, None, None)]
    df = spark.createDataFrame([(i, q, *x) for i, x in enumerate(cases)], "i int, q array<double>, t int, u array<double>, r array<double>, c array<double>, v array<double>")
    out = {r.i: r.x for r in df.select("i", users.blended_query(F.col("q"), F.col("t"), F.col("u"), F.col("r"), F.col("c"), F.col("v"), F.lit(0.8), F.lit(0.2)).alias("x")).collect()}
    unit = lambda a, b: [a / math.hypot(a, b), b / math.hypot(a, b)]
    want = [unit(1, 0), unit(0.8, 0.2), unit(0.8, 0.2), unit(0.3, -0.3), unit(0.3, 0), unit(0.6, -0.4), unit(1, 0)]
    for i, w in enumerate(want):
        assert out[i] == pytest.approx(w)


def test_exact_and_inverted_search(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(200, 8))
    items = spark.createDataFrame([(f"i{n:03d}", [float(v) for v in r]) for n, r in enumerate(x)], "item string, vec array<double>")
    queries = items.filter("item < 'i020'").withColumnRenamed("item", "query_id")
    got = {(r.query_id, r.rank): r.item for r in retrieval.exact_top_k(queries, items, 5, rows=37).collect()}
    s = np.round(x[:20] @ x.T, 9)
    for q in range(20):
        for n, j in enumerate(np.argsort(-s[q], kind="stable")[:5], 1):
            assert got[f"i{q:03d}", n] == f"i{j:03d}"
    every = {(r.query_id, r.rank): r.item for r in retrieval.ivf_top_k(queries, items, 5, nlist=4, nprobe=4).collect()}
    assert every == got
    assert retrieval.exact_top_k(queries.limit(0), items, 5).count() == 0


def test_forced_candidates(spark):
    r = spark.createDataFrame([("u", "q", "x", 0.9, 1), ("u", "q", "y", 0.8, 2), ("v", "y", "y", 0.7, 1)], "user_id string, query_parent_asin string, candidate_parent_asin string, faiss_score double, faiss_rank int")
    t = spark.createDataFrame([("u", "q", 5), ("v", "y", 3)], "user_id string, query_parent_asin string, label int")
    got = {(x.user_id, x.candidate_parent_asin): (x.faiss_score, x.faiss_rank, x.relevance_label, x.is_forced_positive) for x in retrieval.candidates(r, t, 2).collect()}
    assert got == {("u", "x"): (0.9, 1, 0, 0), ("u", "y"): (0.8, 2, 0, 0), ("u", "q"): (0.0, 3, 5, 1), ("v", "y"): (0.7, 1, 3, 0)}
    assert retrieval.candidates(r, t, 2, inject=False).count() == 3


LABELS = "user_id string, query_parent_asin string, candidate_parent_asin string, relevance_label int, score double"


def test_metrics(spark):
    rows = [("a", "q", f"c{i:02d}", int(i == at), 1.0 - i / 100) for at in (2,) for i in range(12)] + [("b", "q", f"c{i:02d}", int(i == 11), 1.0 - i / 100) for i in range(12)] + [("c", "q", "x", 0, 1.0)]
    got = {r.user_id: r for r in evaluation.query_metrics(spark.createDataFrame(rows, LABELS)).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].ndcg_10 == pytest.approx(1 / math.log2(4)) and got["a"].mrr == pytest.approx(1 / 3) and got["a"].hr_1 == 0 and got["a"].hr_5 == 1
    assert got["b"].ndcg_10 == 0 and got["b"].recall_10 == 0 and got["b"].mrr == pytest.approx(1 / 12)
    counts = evaluation.query_counts(spark.createDataFrame(rows, LABELS)).first()
    assert tuple(counts) == (3, 2, 1)
    b = evaluation.bootstrap_std(evaluation.query_metrics(spark.createDataFrame(rows, LABELS)), "mrr", rounds=50).first()
    assert b.rounds <= 50 and 0 <= b.std < 0.2


def test_ranker_beats_a_constant(spark):
    import random

    rng = random.Random(1)
    rows = []
    for q in range(30):
        for c in range(12):
            x, y = rng.random(), rng.random()
            rows.append((f"u{q}", "q", f"c{c:02d}", int(x > 0.8), y, x))
    df = spark.createDataFrame(rows, "user_id string, query_parent_asin string, candidate_parent_asin string, relevance_label int, f01_faiss_score double, f05_avg_rating double")
    model = ranker.train(df, features=["f01_faiss_score", "f05_avg_rating"], rounds=3, depth=2, learning_rate=0.3)
    scored = evaluation.macro_average(evaluation.query_metrics(model.score(df))).first().ndcg_5
    assert scored > 0.95
    top = model.importance(spark).orderBy(F.desc("importance")).first()
    assert top.feature == "f05_avg_rating"


def test_scaling():
    assert len(features.FEATURES) == 31 and features.FEATURES[30].startswith("f31")


def test_packing(spark):
    df = spark.createDataFrame([(["a b c", "d " * 30, "e f", None, " "],), (["x " * 60],), ([None],)], "s array<string>")
    got = [r.x for r in df.select(documents.packed(F.col("s"), 20).alias("x")).collect()]
    assert got[0].split() == "a b c e f".split() and len(got[1].split()) == 60 and got[2] == ""
    wide = df.limit(1).select(documents.packed(F.col("s"), 30).alias("x")).first().x
    assert "[truncated]" in wide and len(wide.split()) <= 30


def test_queries(spark):
    q = spark.createDataFrame([("cheap rpg under $20",), ("fps over 30",), ("around 50",), ("premium open world",), ("",), (None,)], "raw_query string")
    got = [r for r in documents.understand_queries(q).collect()]
    assert got[0].constraints.max_price == 20 and got[0].constraints.price_preference == "low" and "rpg" in got[0].intent
    assert got[1].constraints.min_price == 30 and got[2].constraints.approx_price == 50
    assert got[3].constraints.price_preference == "high" and got[3].expanded == ["sandbox", "exploration", "non-linear"] and got[3].intent == ["open world"] and got[3].attributes == ["premium"]
    assert got[3].final_query == "premium open world sandbox exploration non-linear premium"
    assert got[4].final_query == "" and got[5].final_query == ""


def test_text_vectors(spark):
    t = spark.createDataFrame([("a", "one two three"), ("b", "one two three"), ("c", ""), ("d", None)], "id string, text string")
    v = {r.id: r.embedding for r in documents.encode_texts(t, "id", "text", 16).collect()}
    assert v["a"] == v["b"] and abs(sum(x * x for x in v["a"]) - 1) < 1e-5 and not any(v["c"]) and not any(v["d"])


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"top_k": 7}')
    assert load_settings(str(f)).top_k == 7 and len(ASPECTS) == 5
    f.write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        load_settings(str(f))


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_exact_percentiles(spark, hot_rows):
    import numpy as np

    from lodestar.functions.ranking import exact_percentiles

    x = [float(v) for v in np.random.default_rng(2).normal(size=150).round(1)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "v double")
    got = exact_percentiles(df, F.col("v"), [0.05, 0.25, 0.75, 0.9], "q", hot_rows).first().q
    assert got == pytest.approx(list(np.percentile(x, [5, 25, 75, 90])))
    assert exact_percentiles(df.limit(0), F.col("v"), [0.5], "q", hot_rows).first().q == [None]


def test_inverted_file_reaches_the_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(f"i{i:04d}", v.tolist()) for i, v in enumerate(x)], "item string, vec array<double>")
    queries = items.filter("substr(item, 4) in ('00', '50')").withColumnRenamed("item", "query_id")
    exact = retrieval.exact_top_k(queries, items, 10)
    row = retrieval.recall_at_k(retrieval.ivf_top_k(queries, items, 10), exact).first()
    assert row.n_queries == queries.count() and row.recall >= 0.9
    assert retrieval.recall_at_k(retrieval.ivf_top_k(queries, items, 10, nprobe=1), exact).first().recall < 0.9
    assert retrieval.ivf_top_k(queries.limit(0), items, 10).count() == 0


def test_self_recall_is_of_the_index(spark, monkeypatch):
    from lodestar.plans import model_queries

    asked = []
    ivf = retrieval.ivf_top_k
    monkeypatch.setattr(retrieval, "ivf_top_k", lambda *a, **k: asked.append(k) or ivf(*a, **k).filter("item <> query_id"))
    assert model_queries.self_recall(spark, "/root/testdata/sf0.001").first().self_recall == 0 and asked == [{"nlist": 32}]


def test_registered_bootstrap_draws_a_thousand_rounds(spark):
    from lodestar.plans import model_queries

    assert model_queries.bootstrap_std(spark, "/root/testdata/sf0.001").first().rounds == 1000


def test_rerank_is_judged_on_held_out_queries(spark, monkeypatch):
    from lodestar.plans import model_queries

    seen = {}
    train, score = ranker.train, ranker.Ranker.score
    ids = lambda df: {(r.user_id, r.query_parent_asin) for r in df.select("user_id", "query_parent_asin").distinct().collect()}
    monkeypatch.setattr(ranker, "train", lambda rows, valid=None, **k: seen.update(train=ids(rows), valid=ids(valid) if valid is not None else set(), given=k) or train(rows, valid, **{**k, "rounds": 2}))
    monkeypatch.setattr(ranker.Ranker, "score", lambda self, rows, *a: seen.update(test=ids(rows)) or score(self, rows, *a))
    model_queries.lambdamart_rerank(spark, "/root/testdata/sf0.01").first()
    assert seen["train"] and seen["valid"] and seen["test"] and seen["given"] == {"rounds": 50, "depth": 5, "patience": 10}
    assert not seen["train"] & seen["valid"] and not (seen["train"] | seen["valid"]) & seen["test"]
