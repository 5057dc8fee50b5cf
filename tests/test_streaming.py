from datetime import datetime, timedelta

from lodestar.streaming import profiles as P

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events():
    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(hours=i), i % 4, ["view", "click"][i % 2], float(i)) for i in range(60)]
    return rows + rows[:5]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(events(), SCHEMA)
    folder = tmp_path / "in"
    for n in range(3):
        df.filter(f"event_id % 3 = {n}").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = P.keep_state(P.distinct_events(stream, "30 days"), str(tmp_path / "state"), str(tmp_path / "ckpt"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = max(int(p.name) for p in (tmp_path / "state").iterdir())
    got = {r.user_id: r for r in P.profile(spark.read.parquet(str(tmp_path / "state" / str(last)))).collect()}
    want = {r.user_id: r for r in P.profile(P.user_state(P.distinct_events(df))).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k].n_events == w.n_events and abs(got[k].recent_mean_value - w.recent_mean_value) < 1e-9 and got[k].last_ts == w.last_ts


def test_windows(spark):
    df = P.distinct_events(spark.createDataFrame(events(), SCHEMA))
    a = P.windowed_activity(df).collect()
    assert sum(r.n_events for r in a) == 60 and len(a) == 6
    assert sum(r.n_events for r in P.windowed_activity(df, "2 days", "1 day").collect()) == 120
    assert sum(r.n_events for r in P.sessions(df, "3 hours").collect()) == 60
    assert P.windowed_activity(df.limit(0)).count() == 0
