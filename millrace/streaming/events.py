"""The library's event operators on streams: windows with watermarks, limits and running rates with state in Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, keys, n: events that come later than `late` after the latest time seen are left out."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, width, step)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def distinct_events(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def _stateful(rows: DataFrame, key: str, schema: str, step, start) -> DataFrame:
    """step(state, row) -> (state, out row) over the rows of a key, in order of at and call_id within a micro-batch; state is JSON."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else start()
        out = []
        for row in pd.concat(list(frames)).sort_values(["at", "call_id"]).to_dict("records"):
            s, made = step(s, row)
            out.append(made)
        state.update((json.dumps(s),))
        yield pd.DataFrame(out)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def sliding_limit(calls: DataFrame, tenant_limit: int = 60, user_limit: int = 20, window: float = 60.0) -> DataFrame:
    """call_id, tenant, verdict of calls(tenant, user, at, call_id): as the batch operator; the state holds tenant_limit calls at most."""

    def step(s: list, row: dict):
        s = [h for h in s if h[0] > row["at"] - window]
        if len(s) >= tenant_limit:
            verdict = "tenant"
        elif sum(h[1] == row["user"] for h in s) >= user_limit:
            verdict = "user"
        else:
            verdict = "ok"
            s.append([row["at"], row["user"]])
        return s, {"call_id": row["call_id"], "tenant": row["tenant"], "verdict": verdict}

    return _stateful(calls, "tenant", "call_id long, tenant string, verdict string", step, list)


def success_rates(uses: DataFrame, decay: float = 0.1, first: float = 1.0) -> DataFrame:
    """call_id, key, rate of uses(key, at, call_id, ok)."""

    def step(s: float, row: dict):
        r = s + decay * (1 - s) if row["ok"] else s - decay
        r = round(max(0.0, min(1.0, r)), 3)
        return r, {"call_id": row["call_id"], "key": row["key"], "rate": r}

    return _stateful(uses, "key", "call_id long, key string, rate double", step, lambda: first)


def micro_batches(rows: DataFrame, path: str, checkpoint: str, dead: str | None = None):
    """Appends a stream's rows to a Parquet folder batch by batch; a batch that cannot be written goes to the dead-letter folder as JSON
    lines, if there is one, else the stream fails."""

    def write(batch: DataFrame, number: int) -> None:
        try:
            batch.write.mode("append").parquet(path)
        except Exception:
            if dead is None:
                raise
            batch.write.mode("append").json(f"{dead}/batch-{number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
