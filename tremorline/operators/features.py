"""Window features, load windows, calibration, detection rules and regressions as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.robust import MAD, median
from .series import BUCKET_S, SECOND, ordered


def window_features(df: DataFrame, key: list[str], value: str, least: int, us: str = "us") -> DataFrame:
    """Per session window: first time, size, mean, population deviation and slope per hour since the window began."""
    every = [*key, "session", "win"]
    start = F.min(us).over(W.partitionBy(*every))
    rows = df.withColumn("_h", (F.col(us) - start) / float(3600 * SECOND))
    out = rows.groupBy(*every).agg(
        F.min(us).alias("start_us"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.regr_slope(F.col(value), F.col("_h")).alias("slope_h"), F.max("_h").alias("span_h"),
    )
    return out.where((F.col("n") >= least) & (F.col("span_h") > 0))


def robust_std(df: DataFrame, key: list[str], axes: list[str], floor: float = 0.05, reach: float = 4.0) -> DataFrame:
    """Per group the largest population deviation over axes of the samples near the group's median vector."""
    w = W.partitionBy(*key)
    rows = df.withColumns({f"_m{i}": median(a).over(w) for i, a in enumerate(axes)})
    rows = rows.withColumn("_d", F.sqrt(sum((F.pow(F.col(a) - F.col(f"_m{i}"), 2) for i, a in enumerate(axes)), F.lit(0.0))))
    rows = rows.withColumn("_near", F.col("_d") <= F.greatest(F.lit(floor), reach * MAD * median("_d").over(w)))
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_near").alias("n_near"),
        F.greatest(*[F.coalesce(F.stddev_pop(F.when(F.col("_near"), F.col(a))), F.lit(0.0)) for a in axes]).alias("std_max"),
    )


def load_windows(df: DataFrame, key: list[str], kg: str, raw: str, least: int = 3, us: str = "us") -> DataFrame:
    """Per window of load samples: median of the valid weights, spread of all raw values, first valid time."""
    valid = F.col(kg).isNotNull()
    out = df.groupBy(*key, "session", "win").agg(median(F.when(valid, F.col(kg))).alias("kg"), F.coalesce(F.stddev_pop(raw), F.lit(0.0)).alias("raw_std"), F.count_if(valid).alias("n"), F.min(F.when(valid, F.col(us))).alias("start_us"))
    return out.where(F.col("n") >= least)


def load_event(df: DataFrame, key: list[str], order: list[str], kg: str, tare: float, limit: float, rate: float, hz: float) -> DataFrame:
    """Weights beyond the limit from tare, or changing faster than the rate."""
    change = F.coalesce(F.abs(F.col(kg) - F.lag(kg).over(ordered(key, order))) * hz, F.lit(0.0))
    return df.withColumns({"over_limit": F.abs(F.col(kg) - tare) > limit, "over_rate": change > rate}).withColumn("load_event", F.col("over_limit") | F.col("over_rate"))


def time_domain(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Root mean square, peak, crest factor, excess kurtosis and skewness (population forms); null below two values."""
    out = df.groupBy(*key).agg(
        F.count(value).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("peak"), F.kurtosis(value).alias("kurtosis"), F.skewness(value).alias("skewness"),
    )
    crest = F.when(F.col("rms") > 0, F.col("peak") / F.col("rms"))
    out = out.withColumn("crest", crest)
    return out.select(*key, "n", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("rms", "peak", "crest", "kurtosis", "skewness")])


def calibrated(x: Column, bias: float, scale: float) -> Column:
    return (x - bias) * scale


def load_calibrated(raw: Column, tare: float, scale: float, per_degree: float = 0.0, temperature: Column | None = None, ref: float = 25.0) -> Column:
    out = (raw - tare) * scale
    return out if temperature is None else out - per_degree * (temperature - ref)


def confound_residual(df: DataFrame, key: list[str], y: str, x: str, healthy: Column) -> DataFrame:
    """What is left of y after the line on x fitted to healthy rows, on all rows."""
    fit = df.groupBy(*key).agg(F.regr_slope(F.when(healthy, F.col(y)), F.col(x)).alias("slope"), F.regr_intercept(F.when(healthy, F.col(y)), F.col(x)).alias("intercept"))
    return df.join(F.broadcast(fit) if not key else fit, key).withColumn("residual", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))


def harmonic_residual(df: DataFrame, key: list[str], y: str, hour: Column, days: Column | None = None, least_days: int = 3, least_hours: int = 8) -> DataFrame:
    """y without its daily harmonic, by least squares on [1, sin, cos] from sums alone; y itself with too little data.

    The three normal equations are solved by Cramer's rule, so fitting is one aggregate and scoring a projection.
    """
    angle = hour * (2 * 3.141592653589793 / 24)
    rows = df.withColumns({"_s": F.sin(angle), "_c": F.cos(angle), "_hour": F.floor(hour), "_day": days if days is not None else F.lit(0)})
    s, c, v = F.col("_s"), F.col("_c"), F.col(y)
    sums = {"n": F.count(F.lit(1)), "s": F.sum(s), "c": F.sum(c), "ss": F.sum(s * s), "cc": F.sum(c * c), "sc": F.sum(s * c), "y": F.sum(v), "ys": F.sum(v * s), "yc": F.sum(v * c)}
    fit = rows.groupBy(*key).agg(*[e.cast("double").alias(f"_{k}_") for k, e in sums.items()], F.countDistinct("_day").alias("_days"), F.countDistinct("_hour").alias("_hours"))
    g = {k: F.col(f"_{k}_") for k in sums}

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    a = [[g["n"], g["s"], g["c"]], [g["s"], g["ss"], g["sc"]], [g["c"], g["sc"], g["cc"]]]
    b = [g["y"], g["ys"], g["yc"]]
    whole = det(a)
    enough = (F.col("_days") >= (least_days if days is not None else 0)) & (F.col("_hours") >= least_hours) & (F.abs(whole) > 1e-9)
    part = [F.when(enough, det([[b[r] if k == j else a[r][k] for k in range(3)] for r in range(3)]) / whole).otherwise(F.lit(0.0)) for j in (1, 2)]
    fit = fit.select(*key, part[0].alias("k_sin"), part[1].alias("k_cos"))
    return rows.join(fit, key).withColumn("residual", v - F.col("k_sin") * s - F.col("k_cos") * c).drop("_s", "_c", "_hour", "_day")


def mahalanobis(values: list[Column], centre: list[float], inverse: list[list[float]]) -> Column:
    """Distance of a row from a stored model; the small matrix is written out as an expression."""
    off = [v - c for v, c in zip(values, centre, strict=True)]
    return F.sqrt(sum((off[i] * off[j] * inverse[i][j] for i in range(len(off)) for j in range(len(off))), F.lit(0.0)))


def intervals(df: DataFrame, key: list[str], us: str = "us", bucket_s: int = BUCKET_S) -> DataFrame:
    """(key, dt): seconds between neighbouring samples of each series, dealt by key and day; one row per day bridges to the day before."""
    part = [*key, "_bucket"]
    rows = df.where(F.col(us).isNotNull()).select(*key, F.col(us).alias("_us")).withColumn("_bucket", F.floor(F.col("_us") / F.lit(bucket_s * SECOND)).cast("long"))
    inside = rows.select(*key, (F.col("_us") - F.lag("_us").over(ordered(part, ["_us"]))).alias("_d"))
    days = rows.groupBy(*part).agg(F.min("_us").alias("_a"), F.max("_us").alias("_z"))
    between = days.select(*key, (F.col("_a") - F.lag("_z").over(ordered(key, ["_bucket"]))).alias("_d"))
    return inside.unionByName(between).where("_d is not null").select(*key, (F.col("_d") / float(SECOND)).alias("dt"))


def audit(df: DataFrame, key: list[str], us: str = "us", error: str = "parse_error", bad_clock: str = "device_clock_bad", zero: str = "channels_all_zero") -> DataFrame:
    """Stream health per key: rates, span, median interval, long gaps and duplicate times. An empty key is the whole stream, which no task orders alone."""
    base = (df if key else df.withColumn("_all", F.lit(1))).withColumns({f"_k{i}": F.col(c) for i, c in enumerate(key or ["_all"])})
    names = [f"_k{i}" for i in range(len(key or ["_all"]))]
    dt = intervals(base, names, us)
    mid = dt.groupBy(*names).agg(median("dt").alias("median_dt_s")).withColumnsRenamed({n: f"{n}m" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"{n}m")) for n in names]
    gaps = dt.join(mid, same).groupBy(*names, "median_dt_s").agg(F.count_if(F.col("dt") > 10 * F.col("median_dt_s")).alias("n_gaps")).withColumnsRenamed({n: f"{n}m" for n in names})
    whole = base.groupBy(*names).agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(f"{c}_rate") for c in (error, bad_clock, zero)],
        F.min(us).alias("first_us"), F.max(us).alias("last_us"), (F.count(us) - F.countDistinct(us)).alias("n_duplicate_times"),
    )
    out = whole.join(gaps, same, "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))
    columns = ["rows", *[f"{c}_rate" for c in (error, bad_clock, zero)], "first_us", "last_us", "median_dt_s", "n_gaps", "n_duplicate_times"]
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(key)], *columns)


def status(precedence: list[tuple[str, Column]], otherwise: str = "OK") -> Column:
    """The first status whose condition holds."""
    out = None
    for name, condition in precedence:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise)


def layered(fault: Column, triggers: dict[str, Column]) -> Column:
    """Names of the triggers that fire; none while a sensor fault holds."""
    fired = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in triggers.items()]), lambda x: x.isNotNull())
    return F.when(fault, F.array().cast("array<string>")).otherwise(fired)


def inject(df: DataFrame, key: list[str], order: list[str], column: str, kind: str, size: float, onset: float, hours: float | None = None, us: str = "us") -> DataFrame:
    """A synthetic fault in a column from a fraction of each series on: step, ramp, stuck or noise."""
    w = ordered(key, order)
    df = df.withColumns({"_rn": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*key))})
    df = df.withColumn("_on", F.col("_rn") >= F.floor(F.col("_n") * onset))
    start = F.min(F.when(F.col("_on"), F.col(us))).over(W.partitionBy(*key))
    stop = F.max(us).over(W.partitionBy(*key))
    span = F.lit(hours * 3600 * SECOND) if hours else (stop - start)
    frozen = F.first(F.when(F.col("_on"), F.col(column)), True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    value = F.col(column)
    changed = {
        "step": value + size, "ramp": value + size * F.least(F.lit(1.0), (F.col(us) - start) / F.when(span > 0, span)), "stuck": frozen, "noise": value * size,
    }
    if kind not in changed:
        raise ValueError(f"unknown fault {kind}")
    return df.withColumn(column, F.when(F.col("_on"), changed[kind]).otherwise(value)).withColumn("injected", F.col("_on")).drop("_rn", "_n", "_on")


def sensor_gate(df: DataFrame, key: list[str], spread: str, norm: str, share: float = 0.02, tolerance: float = 0.10) -> DataFrame:
    """stuck: a window's spread far below its series' median; off_norm: its size away from the median size."""
    w = W.partitionBy(*key)
    df = df.withColumns({"_s": median(spread).over(w), "_m": median(norm).over(w)})
    return df.withColumns({"stuck": F.col(spread) < F.greatest(F.lit(1e-6), share * F.col("_s")), "off_norm": F.abs(F.col(norm) - F.col("_m")) / F.col("_m") > tolerance}).drop("_s", "_m")


def first_shift(sessions: DataFrame, key: list[str], order: list[str], channels: list[str], limit: float, first: int = 5) -> DataFrame:
    """shift of each session from the median of the series' first ones, and alert, which holds from the first shift beyond the limit on."""
    rows = sessions.withColumn("_k", F.row_number().over(ordered(key, order)))
    rows = rows.withColumns({f"_r{c}": median(F.when(F.col("_k") <= first, F.col(c))).over(W.partitionBy(*key)) for c in channels})
    rows = rows.withColumn("shift", F.sqrt(sum((F.pow(F.col(c) - F.col(f"_r{c}"), 2) for c in channels), F.lit(0.0))))
    beyond = (F.col("_k") > first) & (F.col("shift") > limit)
    return rows.withColumn("alert", F.max(beyond.cast("int")).over(ordered(key, order).rowsBetween(W.unboundedPreceding, 0)) == 1).drop("_k", *[f"_r{c}" for c in channels])


def session_sigma(sessions: DataFrame, key: list[str], order: list[str], channels: list[str], scatter: str | None = None, floor: float = 0.02) -> DataFrame:
    """Noise of session medians: from the steps between neighbours over all channels, and the scatter inside sessions (column n counts its windows)."""
    w, whole = ordered(key, order), W.partitionBy(*key)
    rows = sessions.withColumns({f"_d{c}": F.col(c) - F.lag(c).over(w) for c in channels})
    rows = rows.withColumns({f"_o{c}": F.abs(F.col(f"_d{c}") - median(f"_d{c}").over(whole)) for c in channels})
    between = F.sqrt(sum((F.pow(MAD * median(f"_o{c}"), 2) for c in channels), F.lit(0.0))) / F.sqrt(F.lit(2.0))
    inside = [median(F.col(scatter) / F.sqrt(F.col("n")))] if scatter else []
    return rows.groupBy(*key).agg(F.greatest(F.lit(floor), between, *inside).alias("sigma"), F.count(F.lit(1)).alias("n"))


def diagnosed(sessions: DataFrame, key: list[str], order: list[str], channel: str, train: float = 0.70, held: float = 0.15) -> DataFrame:
    """By split of each series in time: size, median, robust sigma, 95th percentile of the absolute value, and the smallest step seen at 3 sigma."""
    q = (F.row_number().over(ordered(key, order)) - 1) / F.count(F.lit(1)).over(W.partitionBy(*key))
    rows = sessions.withColumn("_q", q).withColumn("split", F.when(F.col("_q") < train, "train").when(F.col("_q") < train + held, "val").otherwise("test"))
    rows = rows.withColumn("_off", F.abs(F.col(channel) - median(channel).over(W.partitionBy(*key, "split"))))
    sigma = MAD * median("_off") + 1e-6
    return rows.groupBy(*key, "split").agg(F.count(F.lit(1)).alias("sessions"), median(channel).alias("median"), sigma.alias("sigma"), F.percentile(F.abs(channel), 0.95).alias("p95"), (3 * sigma).alias("min_step"))


def fused_score(load: Column, tilt: Column, mode: str = "max") -> Column:
    """One score of two modalities: the larger, or their mean."""
    if mode not in ("max", "weighted"):
        raise ValueError(f"unknown mode {mode}")
    return F.greatest(load, tilt) if mode == "max" else 0.5 * load + 0.5 * tilt


def compensated(value: Column, k_inner: float, inner: Column, k_gradient: float, gradient: Column) -> Column:
    """A channel without its temperature effects; where a temperature is missing, as it is."""
    effect = (k_inner * inner + k_gradient * gradient).cast("double")
    return value - F.coalesce(F.when(~F.isnan(effect), effect), F.lit(0.0))


def plain_verdict(verdict: Column) -> Column:
    """A verdict without the remark in brackets at its end."""
    return F.regexp_replace(verdict, r" \(.*\)$", "")


def biggest(df: DataFrame, key: list[str], name: str, size: str = "n") -> DataFrame:
    """The largest part of each series and its size; of equal ones the first."""
    return df.groupBy(*key).agg(F.max(F.struct(F.col(size).alias("n"), (-F.col(name)).alias("m"))).alias("_b")).select(*key, F.col("_b.n").alias("n"), (-F.col("_b.m")).alias(name))


def means(df: DataFrame, key: list[str], value: str, healthy: Column) -> DataFrame:
    """Mean, sample deviation and count of the healthy rows of each series."""
    return df.where(healthy).groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def duplicates(df: DataFrame) -> DataFrame:
    """Whole rows that occur several times, and how often."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def sequence(values: Column, size: int = 24) -> Column:
    """An array's values at `size` even places from first to last, by linear interpolation, without their mean; two values at least."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n

    def point(i: Column) -> Column:
        at = i * (n - 1) / float(size - 1)
        low = F.least(F.floor(at), n - 2).cast("int")
        a, b = F.get(values, low), F.get(values, low + 1)
        return a + (b - a) * (at - low) - mean

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), point)
