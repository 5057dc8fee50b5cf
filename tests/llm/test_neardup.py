import random
import re
from itertools import combinations

import numpy as np
import pytest

from lodestar.llm import neardup as N
from lodestar.llm import shingles as S


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def brute(rows, k, threshold, least):
    sets = {(f, i): {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for f, i, t in rows if len(w := words(t)) >= max(least, k)}
    out = set()
    for (fa, a), (fb, b) in combinations(sorted(sets), 2):
        x, y = sets[fa, a], sets[fb, b]
        if fa == fb and len(x & y) / len(x | y) >= threshold:
            out.add((fa, min(a, b), max(a, b)))
    return out


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [rng.choice(vocab) for _ in range(60)]
        rows.append(("a", f"d{i:04d}", " ".join(base)))
        if i % 3 == 0:
            edited = list(base)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(60)] = rng.choice(vocab)
            rows.append(("a", f"e{i:04d}", " ".join(edited).upper() + "!"))
        if i % 10 == 0:
            rows.append(("a", f"c{i:04d}", " ".join(base)))
            rows.append(("b", f"c{i:04d}", " ".join(base)))
    rows += [("a", "null", None), ("a", "empty", ""), ("a", "short", "one two"), ("a", "long", " ".join(rng.choice(vocab) for _ in range(20000)))]
    return rows


def test_shingles_match_python():
    texts = ["One two THREE, four; five-six", None, "", "ä b c d", "x", "KKelvin a b", "a1 b2 c3"]
    h, t, counts = S.shingle_hashes(texts, 3)
    assert list(counts) == [len(words(x)) for x in texts]
    for i, x in enumerate(texts):
        assert (t == i).sum() == max(0, len(words(x)) - 2)
    h2, t2, _ = S.shingle_hashes(["zzz", "one two three four five six"], 3)
    assert list(h2) == list(h[t == 0])


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "field string, id string, text string")
    got = [tuple(r) for r in N.similar_pairs(df, 3, 0.5, 10).select("field", "id_a", "id_b").collect()]
    want = brute(rows, 3, 0.5, 10)
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(set(got)) >= 0.97 * len(want)


def test_bands_follow_the_threshold(spark):
    for threshold in (0.3, 0.5, 0.6, 0.8):
        bands, rows = N.banding(threshold)
        assert (1 - threshold**rows) ** bands <= 1e-3 and bands * rows <= N.MOST_HASHES
    rng = random.Random(5)
    rows = []
    for i in range(200):  # 66 of 132 shingles in common: a similarity of exactly 0.5
        text = [f"x{rng.randrange(10**9)}" for _ in range(101)]
        other = [*text[:68], *[f"y{rng.randrange(10**9)}" for _ in range(33)]]
        rows += [("a", f"p{i:03d}", " ".join(text)), ("a", f"q{i:03d}", " ".join(other))]
    want = brute(rows, 3, 0.5, 10)
    df = spark.createDataFrame(rows, "field string, id string, text string")
    got = {tuple(r) for r in N.similar_pairs(df, 3, 0.5, 10).select("field", "id_a", "id_b").collect()}
    assert len(want) == 200 and got <= want and len(got) >= 198


def test_large_buckets_are_banded_again_and_go_through_blocks(spark, monkeypatch):
    rows = corpus(60)
    rows += [("a", f"h{i:03d}", rows[0][2] + f" tail{i} more{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "field string, id string, text string")
    pairs = lambda: {tuple(r) for r in N.similar_pairs(df, 3, 0.5, 10).select("field", "id_a", "id_b").collect()}
    plain, want = pairs(), brute(rows, 3, 0.5, 10)
    seen = []
    by_blocks = N._by_blocks
    monkeypatch.setattr(N, "HOT", 1)
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "HELD", 50)
    monkeypatch.setattr(N, "_by_blocks", lambda *a: seen.append(1) or by_blocks(*a))
    forced = pairs()
    assert seen and len(want) > 700
    assert plain <= want and forced <= want and len(want - plain) <= 2 and len(want - forced) <= 2


def test_postings_of_large_buckets_pass_through(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 5)
    monkeypatch.setattr(N, "HELD", 10)
    key, node = np.repeat([1, 2, 3], [4, 23, 1]).astype(np.uint32), np.arange(28)
    postings = N._filled(node, np.zeros((28, 7), "<u4"), np.arange(28), key)
    order = np.random.default_rng(0).permutation(28)
    rows = [(0, postings[o : o + 1].tobytes()) for o in [*order, *order[:9]]]
    df = spark.createDataFrame(rows, "part int, postings binary")
    found = N._candidates(df, 1, 0.5)
    assert {tuple(r) for r in N._pair_rows(found).collect()} == set(combinations(range(4), 2))
    assert sorted({r.node for r in N._large_rows(found).collect()}) == list(range(4, 27))


def test_recall_in_every_bin(spark):
    rng = random.Random(8)
    rows, group = [], 0
    for shared in range(68, 101, 2):  # similarity 0.5 to 0.98
        for _ in range(40):
            text = [f"x{rng.randrange(10**9)}" for _ in range(101)]
            rows += [("a", f"p{group:04d}", " ".join(text)), ("a", f"q{group:04d}", " ".join([*text[:shared], *[f"y{rng.randrange(10**9)}" for _ in range(101 - shared)]]))]
            group += 1
    want = brute_pairs_by_number(rows)
    df = spark.createDataFrame(rows, "field string, id string, text string")
    got = {r.id_a[1:] for r in N.similar_pairs(df, 3, 0.5, 10).collect()}
    for low in np.arange(0.5, 1, 0.05):
        own = [n for n, j in want.items() if low <= j < low + 0.05]
        assert not own or sum(n in got for n in own) >= 0.97 * len(own), low


def brute_pairs_by_number(rows):
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for _, i, t in rows for w in [words(t)]}
    return {n: len(sets["p" + n] & sets["q" + n]) / len(sets["p" + n] | sets["q" + n]) for n in {i[1:] for i in sets}}


def test_pruning_keeps_similar_pairs():
    schedule = N._schedule(0.5)
    assert [n for n, _ in schedule] == list(range(16, 113, 16)) and all(0 < m < n * 0.625 for n, m in schedule)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (2000, 112), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.6, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    x = list(N.packed_sketch(np.concatenate([a, b])).T)
    assert len(N.prune(x, np.arange(2000), np.arange(2000, 4000), schedule)) > 1990
    assert len(N.prune(x, np.arange(2000), 2000 + rng.permutation(2000), schedule)) < 60


def test_groups_are_components(spark):
    rows = corpus(80)
    df = spark.createDataFrame(rows, "field string, id string, text string")
    got = {(r.field, r.id): (r.group_id, r.n_links) for r in N.groups(df, 3, 0.5, 10).collect()}
    want = brute(rows, 3, 0.5, 10)
    assert len(got) == sum(len(words(t)) >= 10 for _, _, t in rows)
    for f, a, b in want:
        assert got[f, a][0] == got[f, b][0]
    for key, (_, n) in got.items():
        assert n == sum(key in ((f, a), (f, b)) for f, a, b in want)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "field string, id string, text string")
    assert N.similar_pairs(df, 3, 0.5, 10).count() == 0
    assert N.groups(df, 3, 0.5, 10).count() == 0
    meta = spark.createDataFrame([(" A ", "d"), ("A", "d"), (None, "x"), ("", "y"), ("B", None)], "parent_asin string, description string")
    reviews = spark.createDataFrame([("r", None, 1)], "review_id string, text string, id long")
    assert [tuple(r) for r in N.review_and_description_texts(reviews, meta).collect()] == [("meta_clean.description", "A", "d")]


@pytest.mark.parametrize("n", [0, 1])
def test_distinct(n):
    h, t = S.distinct(np.array([5, 5, 3] * n, np.uint64), np.array([0, 0, 0] * n, np.int64))
    assert list(h) == [3, 5] * n
