import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.operators import kernels as N
from tremorline.operators import trackers
from tremorline.streaming import alarms

REFS = {"a": (0.0, 0.0, 1.0)}


def readings(spark):
    rows = []
    for node in ("a", "b"):
        for i in range(120):
            lean = np.radians(3.0 if i >= 70 else 0.0)
            rows.append((node, 1000.0 + 3 * i, float(np.sin(lean)), 0.0, float(np.cos(lean)), False))
    return spark.createDataFrame(rows, "node string, t double, x double, y double, z double, rearm boolean")


def files(df, path, cuts):
    """The rows as files in time order, one per micro-batch."""
    t = [1000.0, *cuts, 1e9]
    for k, (a, b) in enumerate(zip(t, t[1:])):
        df.where((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.mode("append").parquet(path)


def drained(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_stream_equals_replay(spark, tmp_path):
    df = readings(spark)
    path = str(tmp_path / "in")
    files(df, path, (1090.0, 1210.0, 1300.0))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    drained(alarms.fast_alarms(stream, REFS), "alerts")
    got = sorted(tuple(r) for r in spark.table("alerts").select("node", "t", "level", "angle_deg", "handling_like").collect())
    want = sorted(tuple(r) for r in trackers.replay_alarms(df, ["node"], REFS).collect())
    assert got == want and {r[2] for r in got} >= {"EVENT", "STEP", "SESSION_STEP"}


def test_rearm_allows_new_alerts(spark, tmp_path):
    df = readings(spark).where("node = 'a'")
    more = df.select("node", (F.col("t") + 1000).alias("t"), "x", "y", "z", "rearm")
    ack = spark.createDataFrame([("a", 1999.0, 0.0, 0.0, 1.0, True)], df.schema)
    path = str(tmp_path / "in")
    files(df.unionByName(ack).unionByName(more), path, (1500.0, 1999.5))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    drained(alarms.fast_alarms(stream, REFS), "again")
    rows = spark.table("again").where("level = 'EVENT'").count()
    assert rows == 2


def test_session_windows_with_watermark(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 100, 3.0), ("a", 221, 5.0), ("b", 50, 2.0), ("a", 90000, 0.0), ("b", 90000, 0.0)]
    df = spark.createDataFrame(rows, "node string, s long, value double").select("node", F.timestamp_seconds("s").alias("ts"), "value")
    path = str(tmp_path / "in")
    df.where("ts < timestamp_seconds(1000)").coalesce(1).write.parquet(path)
    df.where("ts > timestamp_seconds(1000)").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    drained(alarms.session_aggregates(stream, "ts", "value"), "sessions")
    got = sorted((r.node, r.n, r["mean"]) for r in spark.table("sessions").collect())
    assert got == [("a", 1, 5.0), ("a", 2, 2.0), ("b", 1, 2.0)]
    drained(alarms.window_aggregates(stream, "ts", "value"), "windows")
    assert {(r.node, r.n) for r in spark.table("windows").collect()} == {("a", 3), ("b", 1)}


def test_publish_is_idempotent(spark, tmp_path):
    df = readings(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        alarms.publish(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["node", "t"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()


@pytest.mark.parametrize("seed", [0, 1])
def test_replay_does_not_depend_on_partitions(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("n", float(i * 3), *(np.array([0, 0, 1.0]) + rng.normal(0, 0.02, 3)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "node string, t double, x double, y double, z double")
    cfg = N.AlarmConfig(event_deg=1.0)
    one = trackers.replay_alarms(df.repartition(1), ["node"], {"n": (0, 0, 1)}, cfg).collect()
    assert one == trackers.replay_alarms(df.repartition(7), ["node"], {"n": (0, 0, 1)}, cfg).collect()


def slow_windows(rows, width, gap):
    """(session start, window start, n, mean) of values in time order."""
    out, session, last, win = [], None, None, None
    for t, v in sorted(rows):
        new = session is None or t - last > gap
        session = t if new else session
        if new or (t - session) // width != win:
            out.append([session, t, []])
        win, last = (t - session) // width, t
        out[-1][2].append(v)
    return sorted((a, b, len(v), round(float(np.mean(v)), 9)) for a, b, v in out)


def test_windows_anchored_at_their_session(spark, tmp_path):
    rng = np.random.default_rng(6)
    t = np.cumsum(rng.choice([5, 40, 200], 400, p=[0.6, 0.35, 0.05]))
    rows = [(node, int(x) + shift, float(rng.normal())) for node, shift in (("a", 0), ("b", 7)) for x in t]
    df = spark.createDataFrame(rows, "node string, s long, value double").select("node", F.timestamp_seconds("s").alias("ts"), "value", "s")
    path = str(tmp_path / "in")
    edges = [0, 2000, 4100, 6000, 10**6]
    for a, b in zip(edges, edges[1:]):  # readings of one batch in any order
        df.where((F.col("s") >= a) & (F.col("s") < b)).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(path)
    end = spark.createDataFrame([("z", 10**7, 0.0), ("z", 10**7 + 1, 0.0)], "node string, s long, value double").select("node", F.timestamp_seconds("s").alias("ts"), "value", "s")
    end.coalesce(1).write.mode("append").parquet(path)
    end.selectExpr("node", "ts + interval 1 day ts", "value", "s").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    drained(alarms.anchored_windows(stream, "ts", "value"), "anchored")
    for node in "ab":
        got = sorted((int(r.start.timestamp()), int(r.window_start.timestamp()), r.n, round(r["mean"], 9)) for r in spark.table("anchored").where(F.col("node") == node).collect())
        assert got == slow_windows([(s, v) for n, s, v in rows if n == node], 300, 120)


def test_late_readings_are_left_out(spark, tmp_path):
    df = readings(spark).where("node = 'a'")
    path = str(tmp_path / "in")
    files(df, path, (1090.0, 1210.0, 1300.0))
    late = df.limit(40).select("node", (F.col("t") - 500).alias("t"), F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), "rearm")
    late.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    drained(alarms.fast_alarms(stream, REFS), "late")
    got = sorted(tuple(r) for r in spark.table("late").select("node", "t", "level", "angle_deg", "handling_like").collect())
    assert got == sorted(tuple(r) for r in trackers.replay_alarms(df, ["node"], REFS).collect())
