import math
from collections import Counter, defaultdict

from lodestar.llm import distinctive as D
from lodestar.llm import fusion as F
from lodestar.llm import topn as T

SCORES = ["s1", "s2", "s3"]


def rows():
    out = []
    for i in range(60):
        out.append(("u1", "q1", f"c{i:02d}", float(i % 7), None if i % 5 == 0 else float(i % 3), math.nan if i % 4 == 0 else 1000.0 * i))
    out += [("u1", "q2", "a", 1.0, 1.0, 1.0), ("u1", "q2", "b", 1.0, 1.0, 1.0), ("u1", "q2", "b", 1.0, 1.0, 1.0)]
    out += [(None, "q3", c, 2.0, 3.0, float(ord(c))) for c in "xyz"] + [("u1", "q1", "c03", 3.0, 0.0, 3000.0)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame([(*r, 1) for r in (rows() if data is None else data)], "u string, q string, c string, s1 double, s2 double, s3 double, place int")


def brute():
    groups = defaultdict(dict)
    for u, q, c, *s in rows():
        groups[u, q][c] = [None if x is None or math.isnan(x) else x for x in s]
    out = {}
    for g, items in groups.items():
        for c, s in items.items():
            out[(*g, c)] = [1 + sum(o[j] is not None and (s[j] is None or o[j] > s[j]) for o in items.values()) for j in range(3)]
    return out


def places(df):
    return {(r.u, r.q, r.c): [r[f"place_{s}"] for s in SCORES] for r in df.collect()}


def test_places_by_window_and_by_buckets(spark):
    want = brute()
    assert places(F.reciprocal_rank_fusion(frame(spark), ["u", "q"], "c", SCORES)) == want
    assert places(F.reciprocal_rank_fusion(frame(spark), ["u", "q"], "c", SCORES, hot_rows=2)) == want


def test_fused_score_and_best(spark):
    fused = F.reciprocal_rank_fusion(frame(spark), ["u", "q"], "c", SCORES)
    for r in fused.collect():
        assert abs(r.rrf - sum(1 / (60 + r[f"place_{s}"]) for s in SCORES)) < 1e-12
    want = {}
    for (u, q, c), p in brute().items():
        want.setdefault((u, q), []).append((sum(p), c))
    best = {(r.u, r.q): r.c for r in F.least_place_sum(fused, ["u", "q"], "c").collect()}
    assert best == {g: min(v)[1] for g, v in want.items() if len(v) >= 3}


def test_the_one_ranking(spark):
    want = {}
    for (u, q, c), p in brute().items():
        want.setdefault((u, q), []).append((-round(sum(1 / (60 + x) for x in p), 9), c))
    for hot in (200_000, 2):
        fused = F.reciprocal_rank_fusion(frame(spark), ["u", "q"], "c", SCORES, hot_rows=hot)
        got = {(r.u, r.q, r.c): r.position for r in F.ranking(fused, ["u", "q"], "c").collect()}
        assert got == {(*g, c): n + 1 for g, v in want.items() for n, (_, c) in enumerate(sorted(v))}


def test_top_n(spark):
    got = defaultdict(list)
    for r in T.top_n_per_group(frame(spark), ["u", "q"], "c", "s3", 5).orderBy("place").collect():
        got[r.u, r.q].append(r.c)
    groups = defaultdict(dict)
    for u, q, c, _, _, s in rows():
        groups[u, q][c] = s
    for g, items in groups.items():
        order = sorted(items, key=lambda c: (math.isnan(items[c]), -items[c] if not math.isnan(items[c]) else 0, c))
        assert got[g] == order[:5]


def test_empty_tables(spark):
    e = frame(spark, [])
    assert F.reciprocal_rank_fusion(e, ["u", "q"], "c", SCORES).count() == 0
    assert T.top_n_per_group(e, ["u", "q"], "c", "s1", 3).count() == 0
    assert D.residual_idf(D.word_occurrences(spark.createDataFrame([], "parent_asin string, text string")), spark.createDataFrame([(1,)], "n long")).count() == 0


def test_residual_idf(spark):
    data = [("p1", "rare rare word"), ("p1", "rare here"), (" p1 ", "rare"), ("p2", "common word"), ("p3", "common"), (None, "rare common"), ("", "common"), ("p2", None), ("p2", "")]
    reviews = spark.createDataFrame([(p, t, "x") for p, t in data], "parent_asin string, text string, term string")
    got = {(r.parent_asin, r.term): r for r in D.residual_idf(D.word_occurrences(reviews), D.record_count(reviews)).collect()}
    tf = Counter()
    for p, t in data:
        for w in set((t or "").split()):
            tf[(p or "").strip() or None, w] += 1
    assert set(got) == {k for k in tf if k[0]}
    r = got["p1", "rare"]
    assert (r.tf, r.df, r.cf) == (3, 1, 4)
    want = -math.log2(1 / 3) + math.log2(1 - math.exp(-4 / 3))
    assert abs(r.ridf - want) < 1e-6 and abs(r.score - 3 * want) < 1e-5
    assert got["p1", "rare"].ridf > got["p2", "common"].ridf
    few = D.residual_idf(D.word_occurrences(reviews), D.record_count(reviews), 3, 0.75).collect()
    assert [(x.parent_asin, x.term) for x in few] == [("p1", "rare")]
    for most in (1, 2, 3):
        kept = {(x.parent_asin, x.term) for x in D.residual_idf(D.word_occurrences(reviews), D.record_count(reviews), most_records=most).collect()}
        assert kept == {k for k, r in got.items() if r.df <= most}


def test_listed_terms(spark):
    p = spark.createDataFrame([("a", "X, y  z ,x,,"), ("b", None), ("c", ""), (" a ", "Q")], "parent_asin string, terms string")
    got = sorted((r.parent_asin, r.term) for r in D.listed_terms(p, "terms").collect())
    assert got == [("a", "q"), ("a", "x"), ("a", "y  z")]
