"""Folds over events against plain loops, in batch and as streams."""

import random
from collections import defaultdict

import pytest

from millrace.operators import limits as L
from millrace.streaming import events as ST


def call_rows(n=600, seed=3):
    rng = random.Random(seed)
    at = 0.0
    out = []
    for i in range(n):
        at += rng.choice([0.0, 0.1, 0.5, 3.0])
        out.append((rng.choice("ab"), rng.choice("xyz"), at, i))
    return out


def sliding(rows, t_limit, u_limit, window):
    hits, out = defaultdict(list), {}
    for t, u, at, i in rows:
        live = [h for h in hits[t] if h[0] > at - window]
        mine = [h for h in live if h[1] == u]
        out[i] = "tenant" if len(live) >= t_limit else "user" if len(mine) >= u_limit else "ok"
        hits[t] = live + [(at, u)] * (out[i] == "ok")
    return out


CALLS = "tenant string, user string, at double, call_id long"


def test_sliding_limit(spark):
    rows = call_rows()
    df = spark.createDataFrame(rows, CALLS).repartition(3)
    assert {r.call_id: r.verdict for r in L.sliding_limit(df, 12, 5, 10.0).collect()} == sliding(rows, 12, 5, 10.0)
    assert L.sliding_limit(df.limit(0)).count() == 0


def test_breaker_and_rates(spark):
    rng = random.Random(4)
    rows = [("k" + str(i % 2), float(i), i, rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, at double, call_id long, ok boolean").repartition(3)
    want, rate, state, low = {}, {}, {}, {}
    for k, at, i, ok in rows:
        s = state.setdefault(k, ["closed", 0, 0, 0.0])
        if s[0] == "open" and at - s[3] > 20:
            s[0], s[2] = "half_open", 0
        if s[0] != "open":
            if ok:
                s[1] = 0
                if s[0] == "half_open":
                    s[2] += 1
                    if s[2] >= 2:
                        s[0] = "closed"
            else:
                s[1] += 1
                if s[0] == "half_open" or s[1] >= 3:
                    s[0], s[3], s[1] = "open", at, 0
        want[i] = s[0]
        r = rate.get(k, 1.0)
        r = min(1.0, r + 0.1 * (1.0 - r)) if ok else max(0.0, r - 0.1)
        low[k] = low.get(k, False) or r < 0.2
        rate[k] = round(r, 3)
    assert {r.call_id: r.state for r in L.breaker(df, 3, 20.0, 2).collect()} == want
    got = {r.key: (r.rate, r.uses, r.deprecated) for r in L.skill_status(L.success_rates(df)).collect()}
    assert got == {k: (r, 200, low[k]) for k, r in rate.items()}


def test_breaker_is_open_at_the_very_end_of_its_recovery(spark):
    df = spark.createDataFrame([("k", 0.0, 1, False), ("k", 20.0, 2, True), ("k", 20.5, 3, True)], "key string, at double, call_id long, ok boolean")
    assert [r.state for r in L.breaker(df, 1, 20.0, 2).orderBy("call_id").collect()] == ["open", "open", "half_open"]


def test_deprecation_is_sticky_and_errors_are_the_last_twenty(spark):
    rows = [("a", float(i), i, i >= 9, f"e{i}") for i in range(40)] + [("b", float(i), i, False, f"e{i % 25}") for i in range(60)] + [("c", 1.0, 1, True, "x")]
    df = spark.createDataFrame(rows, "key string, at double, call_id long, ok boolean, error string")
    got = {r.key: (r.uses, r.deprecated) for r in L.skill_status(L.success_rates(df)).collect()}
    assert got == {"a": (40, True), "b": (60, True), "c": (1, False)}
    want = []
    for i in range(60):
        if f"e{i % 25}" not in want:
            want = [*want, f"e{i % 25}"][-20:]
    assert {r.key: r.errors for r in L.skill_errors(df).collect()} == {"a": [f"e{i}" for i in range(9)], "b": want}


@pytest.fixture
def stream(spark, tmp_path):
    def made(rows, schema, parts=3):
        step = -(-len(rows) // parts)
        for k in range(parts):
            spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    return made


def collected(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_limit_is_the_batch_limit(spark, stream):
    rows = call_rows(150)
    got = collected(spark, ST.sliding_limit(stream(rows, CALLS), 12, 5, 10.0), "limited")
    assert {r.call_id: r.verdict for r in got} == sliding(rows, 12, 5, 10.0)


def test_streamed_rates(spark, stream):
    rows = [("k", float(i), i, i % 3 > 0) for i in range(60)]
    schema = "key string, at double, call_id long, ok boolean"
    got = {r.call_id: r.rate for r in collected(spark, ST.success_rates(stream(rows, schema)), "rates")}
    assert got == {r.call_id: r.rate for r in L.success_rates(spark.createDataFrame(rows, schema)).collect()}


def test_streamed_windows(spark, stream):
    import datetime as d

    t0 = d.datetime(2024, 1, 1)
    rows = [(i, t0 + d.timedelta(minutes=20 * i), i % 2) for i in range(30)]
    s = stream(rows, "event_id long, ts timestamp, user long")
    got = collected(spark, ST.tumbling(s, "ts", ["user"]), "tumbled", "complete")
    assert sum(r.n for r in got) == 30 and {r.n for r in got} <= {1, 2}
    assert sum(r.n for r in collected(spark, ST.sliding(s, "ts", []), "slid", "complete")) == 120
    assert sum(r.n for r in collected(spark, ST.sessions(s, "ts", ["user"], "30 minutes"), "sessioned", "complete")) == 30


def test_micro_batches(spark, stream, tmp_path):
    s = stream([(i,) for i in range(9)], "i long")
    ST.micro_batches(s, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9
