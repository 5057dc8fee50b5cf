import math

import numpy as np

from lodestar.llm import similar as S


def brute(rows, k, least):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = {}
    for a in range(len(ids)):
        best = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a and s[a, b] >= least)[:k]
        out[ids[a]] = [i for _, i in best]
    return out


def vectors(n=400, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    rows = {f"v{i:04d}": (centres[i % 60] + rng.normal(scale=0.45, size=dim)).astype(np.float32) for i in range(n)}
    for i in range(12):
        rows[f"copy{i}"] = rows["v0000"]
    rows["scaled"] = rows["v0001"] * np.float32(2)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows.items()], "id string, vec array<float>")


def agreement(got, want):
    hits = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def collect(df):
    out = {}
    for r in df.orderBy("id", "place").collect():
        out.setdefault(r.id, []).append(r.other)
    return out


def test_recall_against_brute_force(spark):
    rows = vectors()
    got, want = collect(S.nearest(frame(spark, rows))), brute(rows, 5, 0.85)
    assert agreement(got, want) >= 0.95
    for i, found in got.items():
        assert i not in found and len(found) <= 5


def test_copies_share_their_neighbours(spark):
    rows = vectors(120)
    got, want = collect(S.nearest(frame(spark, rows))), brute(rows, 5, 0.85)
    assert got["copy3"] == want["copy3"] and got["v0000"] == want["v0000"]


def test_members_of_long_files_are_posted_under_more_pivots(spark, monkeypatch):
    monkeypatch.setattr(S, "FILE", 16)
    for n in (300, 3000):  # ten times the vectors: no vector has more postings
        rows = vectors(n)
        df = frame(spark, rows)
        pivots = spark.sparkContext.broadcast(S.choose_pivots(df.withColumnRenamed("id", "cls"), n, 64)[:32])
        placed = S.with_nearest_pivots(df.selectExpr("xxhash64(id) AS cls", "vec"), pivots, 5, 64)
        posted = S.file_postings(placed, 5, 16)
        per_vector = [r["count"] for r in posted.groupBy("cls").count().collect()]
        assert len(per_vector) == len(rows) and max(per_vector) <= 10
        lengths = posted.filter("blocks = 1").groupBy("key").count().agg({"count": "max"}).first()[0]
        assert lengths is None or lengths <= 16
    rows = vectors(300)
    assert agreement(collect(S.nearest(frame(spark, rows))), brute(rows, 5, 0.85)) >= 0.95


def test_one_dense_cell_is_searched_exactly(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=64)
    rows = {f"v{i:03d}": (centre + rng.normal(scale=0.01, size=64)).astype(np.float32) for i in range(200)}
    rows |= {f"w{i:03d}": rng.normal(size=64).astype(np.float32) for i in range(200)}
    monkeypatch.setattr(S, "FILE", 8)
    monkeypatch.setattr(S, "choose_pivots", lambda c, n, d: S._unit(np.array([rows[f"w{i:03d}"] for i in range(32)])).astype(np.float32))
    got, want = collect(S.nearest(frame(spark, rows))), brute(rows, 5, 0.85)
    assert agreement(got, want) >= 0.95


def test_footrule_gain():
    a, b = np.array([[1, 2, 3]]), np.array([[1, 2, 3], [3, 2, 1], [7, 8, 9], [2, 9, 1]])

    def footrule(p, q):
        k = len(p)
        at = lambda z, v: list(z).index(v) if v in z else k
        return sum(abs(at(p, v) - at(q, v)) for v in {*p, *q})

    for j in range(4):
        assert footrule(a[0], b[j]) == 3 * 4 - 2 * S.footrule_gain(a, b)[0, j]


def test_unusable_vectors_and_repeated_rows(spark):
    dim = 64
    one = [1.0] * dim
    rows = [(" a ", one), ("a", one), ("b", [math.nan] * dim), ("c", [0.0] * dim), ("d", [1.0] * 3), ("e", None), (None, one), ("", one), ("f", [2.0] * dim), ("g", [None] * dim)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "parent_asin string, embedding array<float>, id string")
    usable = S.usable_vectors(df, "parent_asin", "embedding")
    assert {r.id for r in usable.collect()} == {"a", "f"}
    assert [(r.id_a, r.id_b) for r in S.pairs(S.nearest(usable)).collect()] == [("a", "f")]


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "id string, vec array<float>")
    assert S.nearest(none).count() == 0
    assert S.nearest(spark.createDataFrame([("a", [1.0] * 64)], "id string, vec array<float>")).count() == 0
