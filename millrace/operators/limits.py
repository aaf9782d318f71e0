"""Rate limits, circuit breakers, running averages over event tables. What depends on the outcome of earlier rows is a fold: rows are dealt
by key, sorted, and streamed through one task with a state that is bounded by the limit, so a key of any size passes in bounded memory."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], object], out: str, out_type: str) -> DataFrame:
    """rows with a further column: step(state, row) for each row of a key in order, with a state of its own for each key."""
    names = rows.columns
    at = [names.index(k) for k in keys]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    kind = {"boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[out_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            made = []
            for row in b.to_pylist():
                k = tuple(row[names[i]] for i in at)
                if key is None or k != key[0]:
                    key, state = (k,), start()
                made.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], [*names, out])

    return dealt.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` {out_type}")


def sliding_limit(calls: DataFrame, tenant_limit: int = 60, user_limit: int = 20, window: float = 60.0) -> DataFrame:
    """calls(tenant, user, at in seconds, call_id) with verdict: ok, tenant or user. Calls of the last `window` seconds count, the tenant's
    first; a rejected call does not count."""

    def start():
        return deque(), Counter()

    def step(state, row) -> str:
        hits, by_user = state
        while hits and hits[0][0] <= row["at"] - window:
            _, user = hits.popleft()
            by_user[user] -= 1
            if not by_user[user]:
                del by_user[user]
        if len(hits) >= tenant_limit:
            return "tenant"
        if by_user[row["user"]] >= user_limit:
            return "user"
        hits.append((row["at"], row["user"]))
        by_user[row["user"]] += 1
        return "ok"

    return folded(calls, ["tenant"], ["at", "call_id"], start, step, "verdict", "string")


def fixed_limit(calls: DataFrame, tenant_limit: int = 60, user_limit: int = 20, window: int = 60) -> DataFrame:
    """The same in windows of fixed minutes: the tenant's counter goes up with every call, the user's with those that pass it."""
    rows = calls.withColumn("window", F.floor(F.col("at") / window))
    rows = rows.withColumn("tenant_n", F.row_number().over(Window.partitionBy("tenant", "window").orderBy("at", "call_id")))
    passed = F.col("tenant_n") <= tenant_limit
    w = Window.partitionBy("tenant", "user", "window").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    user_n = F.sum(passed.cast("long")).over(w)
    return rows.withColumn("verdict", F.when(~passed, F.lit("tenant")).when(user_n > user_limit, F.lit("user")).otherwise(F.lit("ok"))).drop("tenant_n")


def qps_limit(calls: DataFrame, limit: int = 100, seconds: float = 1.0) -> DataFrame:
    """calls(tenant, at in seconds, call_id) with n, the calls of the last so many seconds, rejected ones included, and verdict."""
    w = Window.partitionBy("tenant").orderBy((F.col("at") * 1_000_000).cast("long")).rangeBetween(-int(seconds * 1_000_000), 0)
    return calls.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("verdict", F.when(F.col("n") <= limit, F.lit("ok")).otherwise(F.lit("tenant")))


def breaker(calls: DataFrame, failures: int = 5, recovery: float = 60.0, successes: int = 3) -> DataFrame:
    """calls(key, at, call_id, ok) with state after the call: closed until so many failures in a row, open (calls are not made) up to and
    at the end of the recovery time, then half_open until so many successes, or open again at the first failure."""

    def start():
        return {"state": "closed", "bad": 0, "good": 0, "since": 0.0}

    def step(s, row) -> str:
        if s["state"] == "open":
            if row["at"] - s["since"] <= recovery:
                return "open"
            s.update(state="half_open", good=0)
        if row["ok"]:
            s["bad"] = 0
            if s["state"] == "half_open":
                s["good"] += 1
                if s["good"] >= successes:
                    s["state"] = "closed"
        else:
            s["bad"] += 1
            if s["state"] == "half_open" or s["bad"] >= failures:
                s.update(state="open", since=row["at"], bad=0)
        return s["state"]

    return folded(calls, ["key"], ["at", "call_id"], start, step, "state", "string")


def success_rates(uses: DataFrame, decay: float = 0.1, first: float = 1.0) -> DataFrame:
    """uses(key, at, call_id, ok) with rate after the use: r + d (1 - r) for a success, r - d for a failure, within 0 and 1, 3 digits."""

    def step(s, row) -> float:
        r = s["r"] + decay * (1 - s["r"]) if row["ok"] else s["r"] - decay
        s["r"] = round(max(0.0, min(1.0, r)), 3)
        return s["r"]

    return folded(uses, ["key"], ["at", "call_id"], lambda: {"r": first}, step, "rate", "double")


def skill_status(rates: DataFrame, least: float = 0.2, decay: float = 0.1, first: float = 1.0) -> DataFrame:
    """key, rate, uses, deprecated from success_rates(). A skill stays deprecated once its rate, before rounding, fell under `least`."""
    before = F.coalesce(F.lag("rate").over(Window.partitionBy("key").orderBy("at", "call_id")), F.lit(first))
    raw = F.when(F.col("ok"), F.least(F.lit(1.0), before + F.lit(decay) * (F.lit(1.0) - before))).otherwise(F.greatest(F.lit(0.0), before - F.lit(decay)))
    last = rates.withColumn("low", raw < least).groupBy("key").agg(F.max(F.struct("at", "call_id", "rate")).alias("l"), F.count(F.lit(1)).alias("uses"), F.max("low").alias("deprecated"))
    return last.select("key", F.col("l.rate").alias("rate"), "uses", "deprecated")


def skill_errors(uses: DataFrame, most: int = 20) -> DataFrame:
    """key, errors of uses(key, at, call_id, ok, error): what failures said, in order, each once while it is among the last `most`."""

    def step(s: list, row) -> list:
        if row["error"] not in s:
            s.append(row["error"])
            del s[:-most]
        return list(s)

    failed = uses.where("not ok and error <> ''")
    out = folded(failed, ["key"], ["at", "call_id"], list, step, "errors", "array<string>")
    return out.groupBy("key").agg(F.max_by("errors", F.struct("at", "call_id")).alias("errors"))


def ttl_hit(at: Column, before: Column, ttl: float) -> Column:
    """Whether a key read at `at` is still there from the read `before`."""
    return F.coalesce(at - before <= ttl, F.lit(False))
