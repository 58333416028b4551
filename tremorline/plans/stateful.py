"""Registered queries whose results depend on earlier decisions: held against brute force and published tables in the tests."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import robust
from ..operators import kernels as N
from ..operators import features as X
from ..operators import models, preparation, signal, thermal, trackers
from ..operators import series as S

NODE = ["node"]


def _cat():
    from . import catalogue

    return catalogue


def sessions(spark, sf: str) -> DataFrame:
    """Session medians of all nodes on a daily scale, as the trackers take them."""
    c = _cat()
    rows = c.ev(spark, sf).withColumn("day", F.floor(F.col("us") / (6 * c.HOUR)))
    mid = {k: robust.median(F.col(k).cast("double")).over(W.partitionBy("node", "day")) for k in ("value", "raw")}
    rows = rows.withColumns({f"off_{k}": F.abs(F.col(k) - m) for k, m in mid.items()})
    return rows.groupBy("node", "day").agg(
        (F.min("us") / float(c.HOUR)).alias("hours"), robust.median("value").alias("u"), robust.median(F.col("raw").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"),
        F.hypot(robust.MAD * robust.median("off_value"), robust.MAD * robust.median("off_raw")).alias("s_w"),
    )


STEPS = N.StepConfig(arm_tolerance=40.0, floor=10.0, sigma_min=1.0, z_limit=2.0, drift_floor=15.0)


def step_tracker(spark, sf):
    return trackers.track_steps(sessions(spark, sf), NODE, ["u", "v"], STEPS)


def load_tracker(spark, sf):
    return trackers.track_steps(sessions(spark, sf), NODE, ["u"], N.StepConfig(arm_tolerance=None, floor=5.0, sigma_min=10.0, z_limit=1.0, drift_hours=168.0, drift_floor=10.0, signed=True))


def level_detector(spark, sf):
    return trackers.detect_levels(sessions(spark, sf), NODE, N.LevelConfig(agree=40.0, floor=25.0), before=True)


def readings(spark, sf) -> DataFrame:
    rows = _cat().ev(spark, sf)
    return rows.select("node", (F.col("us") / float(S.SECOND)).alias("t"), (F.col("value") - 50).alias("x"), (F.col("raw") - 50.0).alias("y"), F.lit(300.0).alias("z"))


ALARM = N.AlarmConfig(event_deg=12.0, step_deg=4.0, small_deg=2.0, gap_s=6 * 3600.0)
REFS = {n: (0.0, 0.0, 1.0) for n in ("click", "error", "view")}


def fast_alarm_replay(spark, sf):
    return trackers.replay_alarms(readings(spark, sf), NODE, REFS, ALARM)


def fast_alarm_stream(spark, sf):
    """The same alerts from a stream over the events, drained, published by batch and read back."""
    import uuid

    from ..session import shared
    from ..streaming import alarms

    c = _cat()
    path = f"{shared(spark)}/tremorline/alarms-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("event_type").alias("node"), (us / float(S.SECOND)).alias("t"), (F.col("value") - 50).alias("x"), (F.get_json_object("props", "$.k").cast("int") - 50.0).alias("y"), F.lit(300.0).alias("z"))
    alarms.publish(alarms.fast_alarms(rows, REFS, ALARM), f"{path}/out", f"{path}/checkpoint", ["node", "t", "level"]).awaitTermination()
    return spark.read.schema(f"node string, {trackers.ALERTS}").option("recursiveFileLookup", True).parquet(f"{path}/out")


def injected_fault_eval(spark, sf):
    cfg = N.StepConfig(arm_tolerance=60.0, floor=45.0, sigma_min=1.0, z_limit=2.0, drift_floor=400.0)
    return trackers.fault_evaluation(sessions(spark, sf), NODE, ["u", "v"], cfg, steps=(20.0, 60.0, 120.0))


def texture_model(spark, sf):
    c = _cat()
    rows = c.win(spark, sf).groupBy("node", "session", "win").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"), F.avg("raw").alias("raw_mean"))
    return models.texture(rows.withColumn("log_std", F.log(F.col("std") + 1e-4)).drop("std"), NODE, ["mean", "raw_mean", "log_std"])


def autoencoder_scores(spark, sf):
    rows = _cat().win(spark, sf).groupBy("node", "session", "win").agg(F.avg("value").alias("a"), F.max("value").alias("b"), F.avg("raw").alias("c"), F.max("raw").cast("double").alias("d"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["session", "win"]).reset_index(drop=True)
        healthy = np.arange(len(pdf)) < max(4, int(len(pdf) * 0.7))
        error, limit = models.autoencoder_errors(pdf[["a", "b", "c", "d"]].to_numpy(float), healthy, 2)
        return pdf[["node", "session", "win"]].assign(error=error, anomaly=error > limit)

    return rows.groupBy("node").applyInPandas(run, "node string, session long, win long, error double, anomaly boolean")


def temp_attribution(spark, sf):
    """Sessions whose first channel follows a daily temperature with a lag, and what temperature explains of its events."""
    temp = np.array([(r.hours, r.value) for r in _cat()._temperature(spark).orderBy("hours").collect()])  # a fixed 720-row series
    rows = sessions(spark, sf)
    start = 473352.0  # hours from 1970 to 2024-01-01
    cfg = N.StepConfig(arm_tolerance=40.0, floor=10.0, sigma_min=1.0, z_limit=1.0, drift_floor=15.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hours", kind="stable").reset_index(drop=True)
        hours = pdf["hours"].to_numpy(float) - start
        inner = thermal.lagged(temp[:, 0], temp[:, 1], 3.0)
        u = pdf["u"].to_numpy(float) + 4 * np.nan_to_num(thermal.aligned(hours, temp[:, 0], inner, 3.0))

        def track(channels):
            t = N.StepTracker(hours, np.array([channels["u"]]), pdf["n"].to_numpy(float), pdf["s_w"].to_numpy(float), cfg).run()
            return t.state, t.epoch, t.shift

        out = thermal.attribute(thermal.Sessions(hours, {"u": u}, [np.array([h, h + 1.0, h + 2.0]) for h in hours]), track, temp[:, 0], temp[:, 1])
        frame = pd.DataFrame(out["rows"], columns=COLUMNS)
        return frame.assign(node=pdf["node"].iloc[0], tau_h=out["tau_h"], trusted=out["fits"]["u"].trusted)[["node", "tau_h", "trusted", *COLUMNS]]

    COLUMNS = ["hours", "raw_state", "temp_free_state", "verdict", "temp_c", "d_struct_temp_c", "observed_shift", "temp_free_shift", "temp_share", "pred_from_temp"]
    kinds = ["double", "string", "string", "string"] + ["double"] * 6
    return rows.groupBy("node").applyInPandas(run, "node string, tau_h double, trusted boolean, " + ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds, strict=True)))


def static_dynamic_split(spark, sf):
    rows = _cat().ev(spark, sf).select("node", "event_id", "us", "value")
    return signal.filtered(rows, NODE, "us", "value", 1.0, 0.1).select("node", "event_id", F.round("static", 6).alias("static"), F.round("dynamic", 6).alias("dynamic"))


def dominant_frequency(spark, sf):
    return signal.spectra(_cat().ev(spark, sf).select("node", "us", "value"), NODE, "us", "value", 1.0, 64)


def _prepared(spark, sf):
    """All events as a node's axes through the whole preparation, healthy in the first half of each node's rows."""
    rows = readings(spark, sf).select("node", (F.col("t") * S.SECOND).cast("bigint").alias("us"), "x", "y", "z").withColumn("heat", F.sin(F.col("us") / 1.3e10))
    rows = rows.withColumn("healthy", F.percent_rank().over(S.ordered(NODE, ["us"])) < 0.5)
    turn = ((1.0, 0.0, 0.0), (0.0, 0.8, -0.6), (0.0, 0.6, 0.8))
    how = preparation.Preparation(rate=4.0, accel=("x", "y", "z"), bias=(0.5, -0.5, 1.0), scale=(1.01, 0.99, 1.0), rotation=turn, ranges={"rot_x_cal": (-50.0, 250.0)}, step_s=1800.0, spectrum=32)
    return preparation.prepare(rows, NODE, ["us", "x", "y"], "RFM", how, F.col("healthy"), "heat")


def prepared_rows(spark, sf):
    return _prepared(spark, sf)["rows"].drop("x", "y", "z", "heat")


def prepared_faults(spark, sf):
    return _prepared(spark, sf)["faults"].groupBy("node").agg(F.count_if("any_fault").alias("faults"), F.count_if("packet_loss").alias("lost"), F.count_if("rot_x_cal_saturated").alias("saturated"))


def prepared_baseline(spark, sf):
    return _prepared(spark, sf)["baseline"]


def prepared_features(spark, sf):
    return _prepared(spark, sf)["features"]


def cointegration_test(spark, sf):
    return models.cointegrated(_cat().ev(spark, sf).withColumn("raw", F.col("raw").cast("double")), NODE, ["us", "event_id"], "value", "raw")


def node_model(spark, sf):
    """Windows of each node against a model of its first ones, the session shift as another vote, held for two windows."""
    c = _cat()
    rows = c.win(spark, sf).groupBy("node", "session", "win").agg(F.min("us").alias("start_us"), F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"), F.avg("raw").alias("norm"))
    scored = models.scored_windows(rows, NODE, "start_us", ["mean", "std", "norm"])
    shifts = X.first_shift(c.stab(spark, sf).where("n >= 3"), NODE, ["session"], ["u", "v"], 40.0).select("node", "session", "alert")
    scored = scored.join(shifts, ["node", "session"], "left").withColumn("votes", F.col("flag_maha").cast("int") + F.coalesce(F.col("alert"), F.lit(False)).cast("int"))
    held = F.min("votes").over(S.ordered(NODE, ["start_us"]).rowsBetween(-1, 0))
    return X.sensor_gate(scored, NODE, "std", "norm").withColumn("status", models.votes_status(F.col("stuck"), held, 2)).select("node", "session", "win", "maha", "iso", "flag_maha", "flag_iso", "votes", "status")


def stream_alignment(spark, sf):
    rows = _cat().ev(spark, sf).select("node", "us", "value")
    moved = rows.withColumn("i", F.row_number().over(W.partitionBy("node").orderBy("us"))).where("i > 7").drop("i")
    return signal.alignment(rows, moved, NODE, "us", "value")


def calibration_six_position(spark, sf):
    """Bias and scale recovered from synthetic captures in many positions, one of each event."""
    rows = _cat().ev(spark, sf).select(F.col("value") - 50, F.col("raw") - 50.0, F.when(F.col("event_id") % 2 == 0, 30.0).otherwise(-30.0)).toDF(*"xyz").dropna()
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    rows = rows.select(*[(9.81 * F.col(k) / size).alias(k) for k in "xyz"])
    raw = rows.select(*[(F.col(k) / s + b).alias(k) for k, s, b in zip("xyz", (1.02, 0.97, 1.05), (0.1, -0.2, 0.05), strict=True)])
    bias, scale = models.six_position_rows(raw, list("xyz"))
    rot = models.rotation_from_gravity(np.array(rows.agg(*[F.avg(k) for k in "xyz"]).first(), float))
    return spark.createDataFrame([(k, float(bias[i]), float(scale[i]), json.dumps([round(float(x), 6) for x in rot[i]])) for i, k in enumerate("xyz")], "axis string, bias double, scale double, rotation string")


def _tilt(spark, sf):
    """Acceleration samples of all nodes through the whole tilt pipeline, on the scale of these events."""
    from . import monitor

    rows = readings(spark, sf).select(F.col("node").alias("sensor_id"), (F.col("t") * S.SECOND).cast("bigint").alias("us"), "x", "y", "z")
    cfg = monitor.TiltConfig(window_s=6 * 3600.0, least_samples=3, gap_s=4 * 3600.0, jump_deg=60.0, session_samples=2, settle_h=6.0, norm_tolerance=0.5, least_windows=10, steps=STEPS)
    return monitor.tilt(rows, cfg)


def tilt_pipeline_segments(spark, sf):
    return _tilt(spark, sf)["segments"]


def tilt_pipeline_sessions(spark, sf):
    return _tilt(spark, sf)["sessions"].select("sensor_id", "segment", "session", "start_us", "u", "v", "n", "s_w", "state", "epoch", "shift", "z", "drift_day")


def alarm_references(spark, sf):
    from . import monitor

    rows = _tilt(spark, sf)["sessions"].drop("state", "epoch", "shift", "z", "drift_day")
    return monitor.alarm_references(monitor.epochs(trackers.detect_levels(rows, monitor.SEGMENT, N.LevelConfig(min_windows=1, agree=30.0, floor=25.0))), rows.groupBy("sensor_id").agg(F.max("segment").alias("segment")))


QUERIES = {
    f.__name__: f
    for f in (
        step_tracker, load_tracker, level_detector, fast_alarm_replay, fast_alarm_stream, injected_fault_eval, texture_model, autoencoder_scores, temp_attribution,
        static_dynamic_split, dominant_frequency, prepared_rows, prepared_faults, prepared_baseline, prepared_features, cointegration_test, node_model, stream_alignment, calibration_six_position, tilt_pipeline_segments, tilt_pipeline_sessions, alarm_references,
    )
}
