"""The monitoring pipelines end to end: parsed packets to tracked tilt and load, fused, exported, served to alarms.

All stages up to the session tables are native windows and aggregates keyed by (sensor, segment); only the trackers, on
one row per session, run in Python. Nothing loops over sensors on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import robust, vectors
from ..operators import features as X
from ..operators import kernels as N
from ..operators import models
from ..operators import series as S
from ..operators import trackers
from ..sources import packets, sinks

HOUR = 3600 * S.SECOND
SEGMENT = ["sensor_id", "segment"]


@dataclass(frozen=True)
class TiltConfig:
    window_s: float = 300.0
    least_samples: int = 20
    gap_s: float = 120.0
    jump_deg: float = 2.0
    session_samples: int = 30
    settle_h: float = 6.0
    norm_tolerance: float = 0.30
    direction_h: float = 24.0
    least_windows: int = 60
    steps: N.StepConfig = field(default_factory=N.StepConfig)
    zone: str = "Asia/Kolkata"
    low_sensitivity: float = 0.15
    norm_gate: float = 0.10


#: A load node's own tilt is windowed with a narrower norm gate.
NODE_TILT = TiltConfig(norm_tolerance=0.04)


@dataclass(frozen=True)
class LoadConfig:
    window_s: float = 300.0
    gap_s: float = 120.0
    least_samples: int = 3
    least_windows: int = 2
    valid_rows: int = 200
    fuse_s: float = 600.0
    steps: N.StepConfig = field(default_factory=lambda: N.LOAD)


def samples(clean: DataFrame) -> DataFrame:
    """Cleaned packets as rows of sensor_id, us and the acceleration."""
    return clean.select("sensor_id", F.unix_micros("server_time").alias("us"), *[F.col(f"acc_{a}").alias(a) for a in "xyz"])


def segmented(rows: DataFrame, cfg: TiltConfig = TiltConfig()) -> DataFrame:
    """Samples with their mounting: a turn of the session's median direction by more than the limit starts the next.

    Sessions with too few samples, and their rows, go.
    """
    rows = S.sessionize(rows, ["sensor_id"], ["us"], cfg.gap_s, name="_session")
    unit = vectors.unit(vectors.triple("x", "y", "z"))
    mids = rows.withColumns(dict(zip(("ux", "uy", "uz"), unit, strict=True))).groupBy("sensor_id", "_session").agg(F.count(F.lit(1)).alias("n"), *[robust.median(c).alias(c) for c in ("ux", "uy", "uz")])
    mids = mids.where(F.col("n") >= cfg.session_samples)
    direction = vectors.unit(vectors.triple("ux", "uy", "uz"))
    mids = mids.select("sensor_id", "_session", *[c.alias(n) for c, n in zip(direction, ("ux", "uy", "uz"), strict=True)])
    before = tuple(F.lag(c).over(S.ordered(["sensor_id"], ["_session"])) for c in ("ux", "uy", "uz"))
    mids = mids.withColumn("jump", vectors.angle_deg(vectors.triple("ux", "uy", "uz"), before))
    cut = S.segments(mids, ["sensor_id"], ["_session"], F.col("jump"), cfg.jump_deg)
    return rows.join(cut.select("sensor_id", "_session", "segment"), ["sensor_id", "_session"]).drop("_session")


def settled(rows: DataFrame, key: list[str], hours: float, us: str = "us") -> DataFrame:
    """Samples from so many hours after each series' first on."""
    first = F.min(us).over(W.partitionBy(*key))
    return rows.withColumn("_first", first).where(F.col(us) >= F.col("_first") + int(hours * HOUR)).drop("_first")


def plausible(rows: DataFrame, key: list[str], tolerance: float, norm: str = "norm") -> DataFrame:
    """Samples whose size is positive and near the median of their series."""
    rows = rows.withColumn("_mid", robust.median(norm).over(W.partitionBy(*key)))
    return rows.where((F.col(norm) > 0) & (F.abs(F.col(norm) - F.col("_mid")) / F.col("_mid") < tolerance)).drop("_mid")


def session_directions(rows: DataFrame, cfg: TiltConfig = TiltConfig(), least: int = 10, cut_deg: float = 0.3, ref_sessions: int = 2) -> DataFrame:
    """Sessions of segmented samples as median directions (x, y, z), numbered by epoch, with the epoch's reference (rx, ry, rz).

    A turn of more than cut_deg between sessions starts an epoch. The reference is the median of all samples of its first sessions.
    """
    rows = settled(rows, SEGMENT, cfg.settle_h)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*SEGMENT))).where(F.col("_n") >= least).drop("_n")
    rows = plausible(rows.withColumn("norm", vectors.norm(vectors.triple("x", "y", "z"))), SEGMENT, cfg.norm_tolerance)
    rows = S.sessionize(rows.select(*SEGMENT, "us", *[(F.col(c) / F.col("norm")).alias(c) for c in "xyz"]), SEGMENT, ["us"], cfg.gap_s)
    mids = rows.groupBy(*SEGMENT, "session").agg(F.min("us").alias("start_us"), F.count(F.lit(1)).alias("n"), *[robust.median(c).alias(c) for c in "xyz"]).where(F.col("n") >= least)
    unit = vectors.unit(vectors.triple("x", "y", "z"))
    mids = mids.select(*SEGMENT, "session", "start_us", "n", *[c.alias(n) for c, n in zip(unit, "xyz", strict=True)])
    w = S.ordered(SEGMENT, ["session"])
    jump = vectors.angle_deg(vectors.triple("x", "y", "z"), tuple(F.lag(c).over(w) for c in "xyz"))
    mids = S.segments(mids.withColumn("jump", jump), SEGMENT, ["session"], F.col("jump"), cut_deg, name="epoch").drop("jump")
    mids = mids.withColumn("_k", F.row_number().over(S.ordered([*SEGMENT, "epoch"], ["session"])))
    first = mids.where(F.col("_k") <= ref_sessions).select(*SEGMENT, "session", "epoch")
    ref = rows.join(first, [*SEGMENT, "session"]).groupBy(*SEGMENT, "epoch").agg(*[robust.median(c).alias(f"_{c}") for c in "xyz"])
    centre = vectors.unit(vectors.triple("_x", "_y", "_z"))
    ref = ref.select(*SEGMENT, "epoch", *[c.alias(f"r{n}") for c, n in zip(centre, "xyz", strict=True)])
    return mids.drop("_k").join(ref, [*SEGMENT, "epoch"]).withColumn("hours", F.col("start_us") / float(HOUR))


def baseline(rows: DataFrame, cfg: TiltConfig = TiltConfig(), compare: trackers.CompareConfig = trackers.CompareConfig()) -> dict[str, DataFrame]:
    """The plain comparator from acceleration samples: its detection curve and summary for each epoch of each mounting."""
    sessions = session_directions(segmented(rows, cfg), cfg, cut_deg=compare.cut_deg, ref_sessions=compare.ref_sessions)
    key = [*SEGMENT, "epoch"]
    return {"sessions": sessions, "detection": trackers.compare(sessions, key, compare), "epochs": trackers.compare(sessions, key, compare, True)}


def projected(rows: DataFrame, cfg: TiltConfig = TiltConfig()) -> DataFrame:
    """Settled, plausible samples of long enough segments, as degrees from the segment's early direction.

    Adds dev_u, dev_v, norm and the reference direction gx, gy, gz.
    """
    w = W.partitionBy(*SEGMENT)
    rows = settled(rows, SEGMENT, cfg.settle_h)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= cfg.least_samples * cfg.least_windows)
    rows = plausible(rows.withColumn("norm", vectors.norm(vectors.triple("x", "y", "z"))), SEGMENT, cfg.norm_tolerance)
    rows = rows.withColumns({"ux": F.col("x") / F.col("norm"), "uy": F.col("y") / F.col("norm"), "uz": F.col("z") / F.col("norm")})
    rows = rows.withColumn("_early", F.col("us") < F.min("us").over(w) + int(cfg.direction_h * HOUR))
    rows = rows.withColumn("_early", F.col("_early") | (F.count_if("_early").over(w) < 50))
    ref = rows.groupBy(*SEGMENT).agg(*[robust.median(F.when(F.col("_early"), F.col(c))).alias(f"_{c}") for c in ("ux", "uy", "uz")])
    mid = vectors.unit(vectors.triple("_ux", "_uy", "_uz"))
    ref = ref.select(*SEGMENT, *[c.alias(n) for c, n in zip(mid, ("gx", "gy", "gz"), strict=True)])
    rows = rows.join(ref, SEGMENT)
    du, dv = vectors.tilt(vectors.triple("ux", "uy", "uz"), vectors.triple("gx", "gy", "gz"))
    return rows.withColumns({"dev_u": du, "dev_v": dv}).drop("_n", "_early")


def tilt_windows(rows: DataFrame, cfg: TiltConfig = TiltConfig()) -> DataFrame:
    """Windows of projected samples: mean deviations, slopes per hour, median norm and robust spread."""
    rows = S.session_windows(S.sessionize(rows, SEGMENT, ["us"], cfg.gap_s), SEGMENT, cfg.window_s)
    key = [*SEGMENT, "session", "win"]
    w = W.partitionBy(*key)
    hours = (F.col("us") - F.min("us").over(w)) / float(HOUR)
    rows = rows.withColumns({"_h": hours, **{f"_m{c}": robust.median(c).over(w) for c in "xyz"}})
    rows = rows.withColumn("_d", F.sqrt(sum((F.pow(F.col(c) - F.col(f"_m{c}"), 2) for c in "xyz"), F.lit(0.0))))
    rows = rows.withColumn("_near", F.col("_d") <= F.greatest(F.lit(0.05), 4 * robust.MAD * robust.median("_d").over(w)))
    spread = F.greatest(*[F.coalesce(F.stddev_pop(F.when(F.col("_near"), F.col(c))), F.lit(0.0)) for c in "xyz"])
    out = rows.groupBy(*key).agg(
        F.min("us").alias("start_us"), F.avg("dev_u").alias("dev_u"), F.avg("dev_v").alias("dev_v"), F.regr_slope("dev_u", "_h").alias("slope_u"), F.regr_slope("dev_v", "_h").alias("slope_v"),
        robust.median("norm").alias("norm"), spread.alias("acc_std_max"), F.count(F.lit(1)).alias("n"), F.max("_h").alias("_span"), *[F.first(c).alias(c) for c in ("gx", "gy", "gz")],
    )
    out = out.where((F.col("n") >= cfg.least_samples) & (F.col("_span") > 0)).drop("_span").withColumn("log_std", F.log(F.col("acc_std_max") + 1e-4))
    return out.withColumn("_windows", F.count(F.lit(1)).over(W.partitionBy(*SEGMENT))).where(F.col("_windows") >= cfg.least_windows).drop("_windows")


def tilt_sessions(windows: DataFrame) -> DataFrame:
    """Session medians of windows with their scatter, as the trackers take them."""
    w = W.partitionBy(*SEGMENT, "session")
    rows = windows.withColumns({f"_o{c}": F.abs(F.col(f"dev_{c}") - robust.median(f"dev_{c}").over(w)) for c in "uv"})
    return rows.groupBy(*SEGMENT, "session").agg(
        F.min("start_us").alias("start_us"), robust.median("dev_u").alias("u"), robust.median("dev_v").alias("v"), F.count(F.lit(1)).alias("n"),
        F.hypot(robust.MAD * robust.median("_ou"), robust.MAD * robust.median("_ov")).alias("s_w"), *[F.first(c).alias(c) for c in ("gx", "gy", "gz")],
    ).withColumn("hours", F.col("start_us") / float(HOUR))


def local_minute(us: str, zone: str):
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(us), zone), "yyyy-MM-dd HH:mm")


def named(df: DataFrame) -> DataFrame:
    """The segment's name, counted from one; names are not stable between exports, start_us is."""
    return df.withColumn("name", F.concat("sensor_id", F.lit("_s"), (F.col("segment") + 1).cast("string")))


def summaries(tracked: DataFrame, key: list[str]) -> DataFrame:
    """Sessions by kind of each series."""
    return tracked.groupBy(*key).agg(
        F.min("start_us").alias("start_us"), F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("state").isin("OK", "DRIFT", "HIT", "EVENT", "BASE")).alias("monitored"),
        F.count_if(F.col("state").isin("UNARMED", "SETTLING")).alias("unarmed_settling"), F.count_if(F.col("state") == "EVENT").alias("events"), F.count_if(F.col("state") == "DRIFT").alias("drift_sessions"),
    )


def events(tracked: DataFrame, key: list[str], zone: str) -> DataFrame:
    rows = tracked.where(F.col("state").isin("EVENT", "DRIFT"))
    return rows.select(*key, F.col("state").alias("kind"), local_minute("start_us", zone).alias("when_local"), F.round(robust.finite(F.col("shift")), 3).alias("shift"), F.round(robust.finite(F.col("drift_day")), 3).alias("drift_day"))


def window_status(windows: DataFrame, tracked: DataFrame, cfg: TiltConfig = TiltConfig()) -> DataFrame:
    """Each window's status from its session's state, the texture model and the sensor gate."""
    scored = models.texture(windows, SEGMENT, ["slope_u", "slope_v", "log_std"], 1.0)
    rows = scored.join(tracked.select(*SEGMENT, "session", "state"), [*SEGMENT, "session"], "left")
    rows = X.sensor_gate(rows, SEGMENT, "acc_std_max", "norm", tolerance=cfg.norm_gate)
    sensor = F.col("stuck") | F.col("off_norm")
    status = X.status([("SENSOR", sensor), ("ALARM", F.col("state").isin("EVENT", "ALARM")), ("DRIFT", F.col("state") == "DRIFT"), ("WARNING", F.col("flag"))])
    return rows.withColumn("status", status).drop("stuck", "off_norm")


def tilt(rows: DataFrame, cfg: TiltConfig = TiltConfig()) -> dict[str, DataFrame]:
    """Windows, tracked sessions, segments and events of acceleration samples."""
    windows = tilt_windows(projected(segmented(rows, cfg), cfg), cfg)
    tracked = trackers.track_steps(tilt_sessions(windows), SEGMENT, ["u", "v"], cfg.steps)
    return {"windows": windows, "sessions": tracked, "segments": named(summaries(tracked, SEGMENT)), "events": named(events(tracked, SEGMENT, cfg.zone))}


CELL = ["sensor_id", "cell"]


def load(parsed: DataFrame, cfg: LoadConfig = LoadConfig(), zone: str = "Asia/Kolkata") -> dict[str, DataFrame]:
    """Windows with glitches, tracked sessions, segments and events of each load cell."""
    wide = packets.explode_cells(packets.clean_load(parsed)).where("sensor_id is not null").withColumn("us", F.unix_micros("server_time"))
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"{c}_kg").alias("kg"), F.col(f"{c}_raw").cast("double").alias("raw")) for c in sorted(set(packets.LABELS.values()))]))
    rows = wide.select("sensor_id", "us", cells)
    rows = S.session_windows(S.sessionize(rows, CELL, ["us"], cfg.gap_s), CELL, cfg.window_s)
    windows = X.load_windows(rows, CELL, "kg", "raw", cfg.least_samples)
    enough = cfg.least_windows * (cfg.steps.arm_sessions + 2)
    windows = windows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*CELL))).where(F.col("_n") >= enough).drop("_n")
    windows = S.glitches(windows, CELL, ["start_us"], "kg", "raw_std")
    off = F.abs(F.col("kg") - robust.median("kg").over(W.partitionBy(*CELL, "session")))
    table = windows.withColumn("_o", off).groupBy(*CELL, "session").agg(F.min("start_us").alias("start_us"), robust.median("kg").alias("kg"), F.count(F.lit(1)).alias("n"), (robust.MAD * robust.median("_o")).alias("s_w"))
    table = table.withColumn("hours", (F.col("start_us") - F.min("start_us").over(W.partitionBy(*CELL))) / float(HOUR))
    tracked = trackers.track_steps(table, CELL, ["kg"], cfg.steps)
    glitch = windows.groupBy(*CELL).agg(F.count_if("glitch").alias("suspected"), F.count(F.lit(1)).alias("windows")).where("suspected > 0")
    glitch = glitch.withColumn("pct", F.round(100 * F.col("suspected") / F.col("windows"), 2))
    return {"windows": windows, "sessions": tracked, "segments": summaries(tracked, CELL), "events": events(tracked, CELL, zone), "glitches": glitch}


def fuse(status: DataFrame, loads: dict[str, DataFrame], cfg: LoadConfig = LoadConfig(), zone: str = "Asia/Kolkata") -> DataFrame:
    """Tilt windows joined to the nearest load window's session state, where either is not quiet."""
    states = loads["windows"].join(loads["sessions"].select(*CELL, "session", "state"), [*CELL, "session"], "left")
    cells = states.select(*CELL).distinct()
    left = status.select("sensor_id", F.col("start_us").alias("us"), F.concat_ws("|", "segment", "session", "win").alias("id"), "segment", "status").join(cells, "sensor_id")
    right = states.select(*CELL, F.col("start_us").alias("us"), F.col("state").alias("load_state"))
    rows = S.nearest(left, right, CELL, int(cfg.fuse_s * S.SECOND), ["load_state"])
    moved, loaded = F.col("status").isin("ALARM", "DRIFT", "SENSOR", "WARNING"), F.coalesce(F.col("load_state").isin("EVENT", "ALARM", "DRIFT"), F.lit(False))
    fused = X.status([("EXPLAINED_BY_LOAD", moved & loaded), ("UNEXPLAINED_TILT", moved), ("LOAD_ONLY", loaded)])
    rows = named(rows.withColumn("fused_status", fused).where("fused_status <> 'OK'"))
    return rows.select("sensor_id", "name", "cell", local_minute("us", zone).alias("when_local"), F.col("status").alias("tilt_status"), "load_state", "fused_status")


def run(raw: DataFrame, tilt_cfg: TiltConfig = TiltConfig(), node_cfg: TiltConfig = NODE_TILT, load_cfg: LoadConfig = LoadConfig()) -> dict[str, DataFrame]:
    """Everything from a raw export: tilt of the sensors, load and tilt of the load nodes, their fusion, and the dashboard."""
    parsed = packets.preprocess(raw)
    rfm, rfl = parsed.where("device = 'RFM'"), parsed.where("device = 'RFL'")
    out = {f"tilt_{k}": v for k, v in tilt(samples(packets.clean_tilt(rfm)), tilt_cfg).items()}
    loads = load(rfl, load_cfg, tilt_cfg.zone)
    out |= {f"load_{k}": v for k, v in loads.items()}
    clean = packets.clean_load(rfl).where("sensor_id is not null").withColumn("_imu", ~F.coalesce("channels_all_zero", F.lit(True)))
    out["nodes"] = clean.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_imu").alias("imu_valid_rows")).withColumn("has_tilt", F.col("imu_valid_rows") >= load_cfg.valid_rows)
    own = clean.where("_imu").join(out["nodes"].where("has_tilt").select("sensor_id"), "sensor_id", "left_semi")
    node = tilt(samples(own), node_cfg)
    out |= {f"node_{k}": v for k, v in node.items()}
    out["fused"] = fuse(window_status(node["windows"], node["sessions"], node_cfg), loads, load_cfg, tilt_cfg.zone)
    rows = out["tilt_sessions"].select("sensor_id", "segment", "start_us", "state", "epoch", "u", "v", "n")
    out["dashboard"] = sinks.dashboard(out["tilt_segments"].drop("sensor_id", "segment").withColumnRenamed("name", "segment"), named(rows).drop("sensor_id", "segment").withColumnRenamed("name", "segment"), out["tilt_events"].drop("sensor_id", "segment").withColumnRenamed("name", "segment"))
    return out


def alarm_references(epochs: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Per sensor the reference and limits of the newest epoch of its newest mounting; null reference where it has none.

    epochs: sensor_id, segment, epoch, gx, gy, gz, ref_u, ref_v, quiet_max; latest: sensor_id, segment of the newest mounting.
    """
    if latest is None:
        latest = epochs.groupBy("sensor_id").agg(F.max("segment").alias("segment"))
    every = epochs.select("sensor_id").union(latest.select("sensor_id")).distinct()
    newest = epochs.withColumn("_rank", F.row_number().over(W.partitionBy(*SEGMENT).orderBy(F.desc("epoch")))).where("_rank = 1").drop("_rank")
    rows = every.join(latest, "sensor_id", "left").join(newest, SEGMENT, "left")
    ref = vectors.lean(vectors.unit(vectors.triple("gx", "gy", "gz")), F.col("ref_u"), F.col("ref_v"))
    quiet = F.coalesce(robust.finite(F.col("quiet_max")), F.lit(0.0))
    return rows.select("sensor_id", "segment", *[c.alias(n) for c, n in zip(ref, ("rx", "ry", "rz"), strict=True)], F.greatest(F.lit(0.20), 3 * quiet).alias("small_deg"), F.greatest(F.lit(0.50), 8 * quiet).alias("step_deg"), F.lit(2.0).alias("event_deg"))


def epochs(levels: DataFrame) -> DataFrame:
    """Reference and quietness of each epoch of the level detector's sessions."""
    rows = levels.where("epoch >= 0").groupBy(*SEGMENT, "epoch").agg(
        F.min("start_us").alias("start_us"), F.max("start_us").alias("end_us"), F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("windows"), *[F.first(c).alias(c) for c in ("gx", "gy", "gz")],
        F.first("ref_u", True).alias("ref_u"), F.first("ref_v", True).alias("ref_v"), F.max(F.when(F.col("state").isin("BASE", "OK"), robust.finite(F.col("shift")))).alias("quiet_max"),
    )
    return rows.withColumn("margin_x", F.when(F.col("quiet_max") > 0, 0.12 / F.col("quiet_max")).otherwise(F.lit(float("inf"))))


def turned(rows: DataFrame, degrees: list[float], onset: float, key: str = "sensor_id") -> DataFrame:
    """Copies of raw samples, one per angle, turned by it from a fraction of each sensor's time on.

    Every copy is a sensor of its own, `id@angle`, so all cases run through the pipeline together. The angle 0 is the control.
    """
    grid = rows.sparkSession.createDataFrame([(float(d),) for d in degrees], "theta double")
    ref = rows.groupBy(key).agg(*[robust.median(c).alias(f"_{c}") for c in "xyz"], F.min("us").alias("_from"), F.max("us").alias("_to"))
    axis, _ = vectors.basis(vectors.unit(vectors.triple("_x", "_y", "_z")))
    ref = ref.select(key, *[c.alias(n) for c, n in zip(axis, ("_ax", "_ay", "_az"), strict=True)], (F.col("_from") + (F.col("_to") - F.col("_from")) * onset).cast("bigint").alias("onset_us"))
    out = rows.crossJoin(F.broadcast(grid)).join(ref, key)  # a fixed list of angles for every sample
    moved = vectors.rotate(vectors.triple("x", "y", "z"), vectors.triple("_ax", "_ay", "_az"), F.when(F.col("us") >= F.col("onset_us"), F.col("theta")).otherwise(F.lit(0.0)))
    out = out.withColumns(dict(zip(("_x", "_y", "_z"), moved, strict=True)))
    return out.select(F.concat(key, F.lit("@"), F.col("theta").cast("string")).alias(key), "us", *[F.col(f"_{c}").alias(c) for c in "xyz"], "theta", "onset_us")


def raw_cases(rows: DataFrame, degrees: list[float], onset: float = 0.6, cfg: TiltConfig = TiltConfig()) -> DataFrame:
    """Per sensor and angle whether the whole pipeline reports an event after the onset, and after how many hours it is confirmed."""
    every = turned(rows, [0.0, *degrees], onset)
    about = every.groupBy("sensor_id").agg(F.first("theta").alias("theta"), F.first("onset_us").alias("onset_us"))
    sessions = tilt(every.drop("theta", "onset_us"), cfg)["sessions"].join(about, "sensor_id")
    w = S.ordered(SEGMENT, ["start_us"])
    late = sessions.withColumn("confirmed_us", F.lead("start_us").over(w)).where((F.col("state") == "EVENT") & (F.col("start_us") >= F.col("onset_us")))
    found = late.groupBy("sensor_id").agg(F.min("confirmed_us").alias("confirmed_us"))
    out = about.join(found, "sensor_id", "left")
    return out.select(F.substring_index("sensor_id", "@", 1).alias("sensor_id"), "theta", F.col("confirmed_us").isNotNull().alias("detected"), ((F.col("confirmed_us") - F.col("onset_us")) / float(HOUR)).alias("delay_h"))


def features(df: DataFrame, key: list[str], order: list[str], channel: str, size: int, step: int, rate: float) -> DataFrame:
    """Sliding-window features of a denoised channel: time domain, and faults among the window's samples."""
    clean = S.hampel(df, key, order, channel)
    flagged = S.fault_flags(clean, key, order, channel, -1e9, 1e9, 1 / rate)
    rows = S.sliding(flagged, key, order, size, step)
    out = X.time_domain(rows, [*key, "window_no"], "cleaned")
    faults = rows.groupBy(*key, "window_no").agg(F.count_if("any_fault").alias("faults"), F.count_if("outlier").alias("outliers"))
    return out.join(faults, [*key, "window_no"])
