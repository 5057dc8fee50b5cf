from collections import defaultdict

from pyspark.sql import functions as F

from lodestar.operators import skew

SCHEMA = "review_id string, user_id string, parent_asin string, rating double, text string, helpful_vote long, verified_purchase boolean, key_value string"


def rows():
    out = []
    for i in range(400):
        p = "hot" if i % 3 == 0 else f"p{i % 90}"
        u = " heavy " if i % 4 == 0 else f"u{i % 60}"
        out.append((f"r{i}", u, p, [1.0, 5.0, 7.0, None, float("nan")][i % 5], "text " * (i % 3), i % 4 or None, i % 2 == 0, "clash"))
    return out + [("x1", None, "", 5.0, None, None, None, None), ("x2", "  ", None, 4.0, "", 1, True, None)]


def brute():
    out = defaultdict(lambda: [0, [], set()])
    for _, u, p, r, *_ in rows():
        u, p = (x.strip() or None if x else None for x in (u, p))
        for field, k, other in (("reviews.parent_asin", p, u), ("reviews.user_id", u, p)):
            g = out[field, k]
            g[0] += 1
            g[1] += [r] if r is not None and r == r and 1 <= r <= 5 else []
            g[2] |= {other} - {None}
    return out


def test_summary_equals_plain_grouping(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for share in (0.005, 0.9):
        got = {(r.field, r.key_value): r for r in skew.key_summary(df, heavy_share=share, salts=8).collect()}
        want = brute()
        assert set(got) == set(want)
        for k, (n, ratings, others) in want.items():
            r = got[k]
            assert (r.n_rows, r.n_rated, r.n_partners) == (n, len(ratings), len(others))
            assert (r.mean_rating is None) == (not ratings)
            if ratings:
                assert abs(r.mean_rating - sum(ratings) / len(ratings)) < 1e-6


def test_heavy_rows_are_spread(spark):
    df = skew.review_key_rows(spark.createDataFrame(rows(), SCHEMA))
    heavy = {(r.field, r.key_value) for r in skew.heavy_keys(df, ["field", "key_value"], 0.2).collect()}
    assert heavy == {("reviews.parent_asin", "hot"), ("reviews.user_id", "heavy")}


def test_dominant_keys_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {(r.field, r.key_value) for r in skew.dominant_keys(df, 0.2).collect()}
    assert got == {("reviews.parent_asin", "hot"), ("reviews.user_id", "heavy")}
    assert skew.dominant_keys(df.filter(F.lit(False))).count() == 0
    assert skew.key_summary(df.filter(F.lit(False))).count() == 0
