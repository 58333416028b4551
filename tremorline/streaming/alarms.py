"""Streaming: per-reading alarms with state per node, and session aggregates with a watermark.

The alarm's state is one JSON string per node, at most 60 directions and a few numbers, so it fits any state store.
Restarting from the checkpoint and an idempotent sink give exactly-once alerts. Batch replay runs the same kernel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kernels as N
from ..operators.trackers import ALERTS


def fast_alarms(readings: DataFrame, refs: dict | None = None, cfg: N.AlarmConfig = N.AlarmConfig(), idle_ms: int = 0) -> DataFrame:
    """Alerts of a stream of readings (node, t in seconds, x, y, z and, to acknowledge, rearm).

    A reading with rearm = true takes its direction as the new reference and clears the latches. Readings of one batch
    are taken in time order; one that is older than the last reading its node has taken in comes too late and is left out, so that a
    stream gives the alerts of its history as far as it came in order. With idle_ms a node's state goes after so long without readings.
    """
    refs = refs or {}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else N.new_alarm(refs.get(key[0]))
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        found = []
        for r in rows.itertuples():
            if now["last"] is not None and r.t < now["last"]:
                continue
            if r.rearm:
                now = N.rearm(now, (r.x, r.y, r.z))
                continue
            alert = N.read_alarm(now, float(r.t), (r.x, r.y, r.z), cfg)
            if alert:
                found.append({"node": key[0], **alert})
        state.update((json.dumps(now),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(found, columns=["node", "t", "level", "angle_deg", "handling_like"])

    if "rearm" not in readings.columns:
        readings = readings.withColumn("rearm", F.lit(False))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return readings.select("node", "t", "x", "y", "z", "rearm").groupBy("node").applyInPandasWithState(run, f"node string, {ALERTS}", "state string", "append", timeout)


def session_aggregates(readings: DataFrame, time: str, value: str, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per node over a stream: count, mean and extremes, final once the watermark has passed them."""
    rows = readings.withWatermark(time, late).groupBy("node", F.session_window(time, gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select("node", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "low", "high")


def window_aggregates(readings: DataFrame, time: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling clock windows per node over a stream."""
    rows = readings.withWatermark(time, late).groupBy("node", F.window(time, width).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).select("node", F.col("w.start").alias("start"), "n", "mean", "std")


ANCHORED = "start timestamp, window_start timestamp, n long, mean double, std double"


def anchored_windows(readings: DataFrame, time: str, value: str, width_s: float = 300.0, gap_s: float = 120.0, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows per node that begin with their session, not with the clock; each is final when the watermark has passed it.

    State per node is what the watermark has not passed: readings that may still be reordered, and the sums of the open window. Readings behind
    the watermark are left out; so are nulls of time, and of the value in a window's sums.
    """
    rows = readings.select("node", F.col(time).alias("t"), F.col(value).cast("double").alias("v")).where("t is not null").withWatermark("t", late)

    def closed(s: dict) -> dict:
        n, total, square = s["sums"]
        mean = total / n if n else None
        return {"start": pd.Timestamp(s["session"], unit="us"), "window_start": pd.Timestamp(s["first"], unit="us"), "n": n, "mean": mean, "std": max(0.0, square / n - mean * mean) ** 0.5 if n else None}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {"waiting": [], "session": None, "last": None, "win": None, "first": None, "sums": [0, 0.0, 0.0]}
        mark = state.getCurrentWatermarkMs() * 1000
        for pdf in batches:
            us = pdf["t"].astype("int64") // (1000 if str(pdf["t"].dtype).startswith("datetime64[ns") else 1)
            now["waiting"] += [[int(t), None if pd.isna(v) else float(v)] for t, v in zip(us, pdf["v"], strict=True) if t >= mark]
        now["waiting"].sort(key=lambda r: r[0])
        found = []
        ready = [r for r in now["waiting"] if r[0] < mark]
        now["waiting"] = now["waiting"][len(ready) :]
        for t, v in ready:
            new = now["session"] is None or t - now["last"] > gap_s * 1e6
            win = 0 if new else int((t - now["session"]) // (width_s * 1e6))
            if now["session"] is not None and (new or win != now["win"]):
                found.append(closed(now))
                now["sums"] = [0, 0.0, 0.0]
            if now["session"] is None or new or win != now["win"]:
                now["first"] = t
            if new:
                now["session"] = t
            now["last"], now["win"] = t, win
            if v is not None:
                n, total, square = now["sums"]
                now["sums"] = [n + 1, total + v, square + v * v]
        if now["session"] is not None and not now["waiting"] and mark - now["last"] > gap_s * 1e6:
            found.append(closed(now))
            state.remove()
        else:
            state.update((json.dumps(now),))
            state.setTimeoutTimestamp(int(max(mark, (now["waiting"][0][0] if now["waiting"] else now["last"] + gap_s * 1e6)) // 1000) + 1)
        yield pd.DataFrame([{"node": key[0], **f} for f in found], columns=["node", "start", "window_start", "n", "mean", "std"])

    return rows.groupBy("node").applyInPandasWithState(run, f"node string, {ANCHORED}", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def publish(stream: DataFrame, path: str, checkpoint: str, key: list[str], once: bool = True):
    """Write a stream to Parquet by batch so that a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
