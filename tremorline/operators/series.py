"""Operators on irregular time series: one row per sample, keyed by a node column and ordered by time.

Times are microseconds since 1970 in a bigint column (`us`), so boundaries are exact. Every operator takes the key columns
and an ordering that breaks ties, and adds columns to its input. Windows are partitioned by the key alone; filters on
the key therefore push below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.robust import MAD, array_median, median

SECOND = 1_000_000


def ordered(key: list[str], order: list[str]):
    return W.partitionBy(*key).orderBy(*order)


#: Stretch of time by which long series are dealt to tasks.
BUCKET_S = 86_400


def sessionize(df: DataFrame, key: list[str], order: list[str], gap_s: float, us: str = "us", name: str = "session", bucket_s: int = BUCKET_S) -> DataFrame:
    """Number runs of samples: a gap strictly longer than gap_s starts the next one, from 0.

    Rows are dealt by key and day, so a few busy nodes do not make a few endless tasks. Breaks are counted inside each day;
    one row per day then says whether the day begins a session and how many there were before.
    """
    gap, part = int(gap_s * SECOND), [*key, "_bucket"]
    w = ordered(part, order)
    rows = df.withColumn("_bucket", F.floor(F.col(us) / F.lit(bucket_s * SECOND)).cast("long"))
    rows = rows.withColumn("_new", F.coalesce((F.col(us) - F.lag(us).over(w) > gap).cast("long"), F.lit(0)))
    rows = rows.withColumn("_inside", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    days = rows.groupBy(*part).agg(F.min(us).alias("_a"), F.max(us).alias("_z"), F.max("_inside").alias("_breaks"))
    d = W.partitionBy(*key).orderBy("_bucket")
    begins = F.coalesce((F.col("_a") - F.lag("_z").over(d) > gap).cast("long"), F.lit(0))
    days = days.withColumn("_begins", begins + F.coalesce(F.lag("_breaks").over(d), F.lit(0)))
    days = days.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], F.sum("_begins").over(d.rowsBetween(W.unboundedPreceding, 0)).alias("_base"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(part)]
    return rows.join(days, same).withColumn(name, F.col("_base") + F.col("_inside")).drop("_bucket", "_new", "_inside", "_base", *[f"_k{i}" for i in range(len(part))])


def session_windows(df: DataFrame, key: list[str], width_s: float, us: str = "us", session: str = "session", name: str = "win") -> DataFrame:
    """Tumbling windows that start with their session, not with the clock."""
    start = F.min(us).over(W.partitionBy(*key, session))
    return df.withColumn(name, F.floor((F.col(us) - start) / F.lit(int(width_s * SECOND))).cast("long"))


def session_table(df: DataFrame, key: list[str], values: list[str], us: str = "us", session: str = "session") -> DataFrame:
    """Per session: first time, medians and sample count."""
    return df.groupBy(*key, session).agg(F.min(us).alias("start_us"), *[median(c).alias(c) for c in values], F.count(F.lit(1)).alias("n"))


def segments(df: DataFrame, key: list[str], order: list[str], jump: Column, limit: float, name: str = "segment") -> DataFrame:
    """Number stretches between rows whose jump from the row before exceeds the limit, from 0."""
    w = ordered(key, order)
    return df.withColumn("_cut", F.coalesce((jump > limit).cast("int"), F.lit(0))).withColumn(name, F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")


def persistent(flag: Column, key: list[str], order: list[str], rows: int) -> Column:
    """True where the flag held for the last `rows` rows, or for all so far where there are fewer."""
    return F.min(flag.cast("int")).over(ordered(key, order).rowsBetween(1 - rows, 0)) == 1


def latched(flag: Column, key: list[str], order: list[str]) -> Column:
    """True from the first true row on."""
    return F.max(flag.cast("int")).over(ordered(key, order).rowsBetween(W.unboundedPreceding, 0)) == 1


def run_length(df: DataFrame, flag: str, key: list[str], order: list[str], name: str = "run") -> DataFrame:
    """How many rows in a row, up to this one, the flag has been true."""
    w = ordered(key, order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_island", F.sum((~F.col(flag)).cast("int")).over(w))
    inside = W.partitionBy(*key, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col(flag).cast("int")).over(inside)).drop("_island")


def filled(column: str, key: list[str], order: list[str]) -> Column:
    """Nulls take the last value before them, or at the start the first after."""
    w = ordered(key, order)
    back = F.last(column, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return F.coalesce(back, F.first(column, True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def hampel(df: DataFrame, key: list[str], order: list[str], column: str, width: int = 7, sigmas: float = 3.0) -> DataFrame:
    """Outliers against the centred rolling median, replaced by it; edges without a full window are never outliers."""
    half = width // 2
    w = ordered(key, order).rowsBetween(-half, half)
    full = F.count(column).over(w) == width
    df = df.withColumn("_med", F.when(full, median(column).over(w))).withColumn("_diff", F.abs(F.col(column) - F.col("_med")))
    df = df.withColumn("_mad", F.when(F.count("_diff").over(w) == width, median("_diff").over(w)))
    df = df.withColumn("outlier", F.coalesce(F.col("_diff") > sigmas * MAD * F.col("_mad"), F.lit(False)))
    return df.withColumn("cleaned", F.when(F.col("outlier"), F.col("_med")).otherwise(F.col(column))).drop("_med", "_diff", "_mad")


def trailing(column: str, key: list[str], order: list[str], rows: int) -> Column:
    """The `rows` values before this row as an array."""
    return F.collect_list(column).over(ordered(key, order).rowsBetween(-rows, -1))


def trailing_z(df: DataFrame, key: list[str], order: list[str], column: str, rows: int = 12, floor: float = 0.02) -> DataFrame:
    """Robust z of a value against the `rows` before it; null until there are so many."""
    df = df.withColumn("_past", trailing(column, key, order, rows)).withColumn("_med", array_median(F.col("_past")))
    sigma = F.greatest(F.lit(floor), MAD * array_median(F.transform("_past", lambda x: F.abs(x - F.col("_med")))))
    return df.withColumn("z", F.when(F.size("_past") == rows, F.abs(F.col(column) - F.col("_med")) / sigma)).drop("_past", "_med")


def glitches(df: DataFrame, key: list[str], order: list[str], value: str, spread: str, rows: int = 12, limit: float = 6.0) -> DataFrame:
    """Windows whose raw spread jumps while their value stays: suspected sensor glitches."""
    df = df.withColumns({"_s": trailing(spread, key, order, rows), "_v": trailing(value, key, order, rows)})
    df = df.withColumns({"_sm": array_median(F.col("_s")), "_vm": array_median(F.col("_v"))})
    scale = F.greatest(F.lit(1.0), MAD * array_median(F.transform("_s", lambda x: F.abs(x - F.col("_sm")))))
    jump = (F.col(spread) - F.col("_sm")) / scale > limit
    still = F.abs(F.col(value) - F.col("_vm")) < F.greatest(F.lit(0.2), 0.01 * scale)
    return df.withColumn("glitch", F.coalesce((F.size("_s") == rows) & jump & still, F.lit(False))).drop("_s", "_v", "_sm", "_vm")


def cusum(df: DataFrame, key: list[str], order: list[str], z: Column, slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """Two-sided cumulative sums in closed form: the running sum less its running extreme; the first row counts 0."""
    w = ordered(key, order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_z", z)
    for side, step in (("_up", F.col("_z") - slack), ("_down", F.col("_z") + slack)):
        df = df.withColumn(side, F.sum(F.when(F.col("_i") > 1, step).otherwise(F.lit(0.0))).over(upto))
    df = df.withColumns({"pos": F.col("_up") - F.least(F.lit(0.0), F.min("_up").over(upto)), "neg": F.col("_down") - F.greatest(F.lit(0.0), F.max("_down").over(upto))})
    return df.withColumn("alarm", (F.col("pos") > limit) | (F.col("neg") < -limit)).drop("_i", "_z", "_up", "_down")


def _around(left: DataFrame, right: DataFrame, key: list[str], reach_us: int, picked: Column, us: str, id_col: str, names: list[str]) -> DataFrame:
    """Left rows with the right rows before (`_b`, at the same time included) and after (`_f`) them, within reach.

    Both sides are dealt by key and a stretch of time many times the reach; right rows near a border go to both stretches. One
    shuffle, no product of rows, and no task that holds a whole key. Of right rows at one time the largest wins.
    """
    width = F.lit(max(64 * reach_us, 600 * SECOND))
    a = left.withColumn("_cell", F.floor(F.col(us) / width).cast("long"))
    a = a.select(*key, "_cell", us, id_col, *names, F.lit(1).alias("_side"), F.lit(None).cast(right.select(picked.alias("x")).schema["x"].dataType).alias("_r"))
    low, high = (F.floor((F.col(us) + d) / width).cast("long") for d in (-reach_us, reach_us))
    b = right.withColumn("_cell", F.explode(F.sequence(low, high)))
    b = b.select(*key, "_cell", us, F.lit(None).cast(left.schema[id_col].dataType).alias(id_col), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.lit(0).alias("_side"), picked.alias("_r"))
    part = W.partitionBy(*key, "_cell")
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, 0)  # noqa: E731  growing frames both ways: one pass each
    rows = a.unionByName(b).withColumns({"_b": F.last("_r", True).over(upto(part.orderBy(us, "_side", "_r"))), "_f": F.last("_r", True).over(upto(part.orderBy(F.col(us).desc(), "_side", "_r")))})
    return rows.where("_side = 1")


def nearest(left: DataFrame, right: DataFrame, key: list[str], tolerance_us: int, values: list[str], us: str = "us", id_col: str = "id") -> DataFrame:
    """As-of join to the nearest right row in time, at most the tolerance away (inclusive; the earlier on a tie).

    Unmatched left rows keep nulls.
    """
    names = [c for c in left.columns if c not in key and c not in (us, id_col)]
    rows = _around(left, right, key, tolerance_us, F.struct(F.col(us).alias("at"), *values), us, id_col, names)
    behind, ahead = F.col(us) - F.col("_b.at"), F.col("_f.at") - F.col(us)
    use = F.when(F.col("_b").isNull() | (ahead < behind), F.col("_f")).otherwise(F.col("_b"))
    rows = rows.withColumn("_use", use).withColumn("_use", F.when(F.abs(F.col("_use.at") - F.col(us)) <= tolerance_us, F.col("_use")))
    return rows.select(*key, us, id_col, *names, F.col("_use.at").alias("right_us"), *[F.col(f"_use.{v}").alias(v) for v in values])


def interpolated(left: DataFrame, right: DataFrame, key: list[str], value: str, hole_us: int, us: str = "us", id_col: str = "id") -> DataFrame:
    """Linear interpolation between the right rows around each left row; null outside them or over holes longer than hole_us."""
    picked = F.struct(F.col(us).alias("at"), F.col(value).cast("double").alias("v"))
    rows = _around(left, right, key, hole_us, picked, us, id_col, [])
    span = F.col("_f.at") - F.col("_b.at")
    line = F.col("_b.v") + (F.col("_f.v") - F.col("_b.v")) * (F.col(us) - F.col("_b.at")) / span
    return rows.select(*key, us, id_col, F.when(span == 0, F.col("_b.v")).when(span <= hole_us, line).alias(value))


def resampled(df: DataFrame, key: list[str], values: list[str], step_s: float, us: str = "us") -> DataFrame:
    """Samples on a fixed grid from each key's first to last time: the nearest within half a step, and whether it is a gap."""
    step = int(step_s * SECOND)
    span = df.groupBy(*key).agg(F.min(us).alias("_a"), F.max(us).alias("_b"))
    grid = span.select(*key, F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))).alias(us)).withColumn("id", F.col(us))
    return nearest(grid, df, key, step // 2, values, us).drop("id").withColumn("gap", F.col("right_us").isNull())


def sliding(df: DataFrame, key: list[str], order: list[str], size: int, step: int) -> DataFrame:
    """Copies of each row for the windows of `size` rows, `step` apart, that hold it; a short series is one window."""
    df = df.withColumn("_i", F.row_number().over(ordered(key, order)) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*key)))
    last = F.greatest(F.lit(0), F.floor((F.col("_n") - size) / step))
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / step))
    high = F.least(last, F.floor(F.col("_i") / step))
    windows = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("window_no", F.explode(windows)).drop("_i", "_n")


def fault_flags(df: DataFrame, key: list[str], order: list[str], value: str, low: float, high: float, step_s: float, us: str = "us", width: int = 20, tol: float = 1e-6) -> DataFrame:
    """Flat line, saturation and packet loss of each sample, and whether any holds."""
    w = ordered(key, order)
    frame = w.rowsBetween(1 - width, 0)
    flat = F.coalesce((F.count(value).over(frame) == width) & (F.stddev_samp(value).over(frame) < tol), F.lit(False))
    margin = 0.01 * (high - low)
    loss = F.coalesce(F.col(us) - F.lag(us).over(w) > int(2 * step_s * SECOND), F.lit(False))
    df = df.withColumns({"flatline": flat, "saturated": F.coalesce((F.col(value) <= low + margin) | (F.col(value) >= high - margin), F.lit(False)), "packet_loss": loss})
    return df.withColumn("any_fault", F.col("flatline") | F.col("saturated") | F.col("packet_loss"))


def sample_flags(df: DataFrame, key: list[str], order: list[str], columns: list[str], ranges: dict[str, tuple[float, float]], step_s: float, us: str = "us", width: int = 20, tol: float = 1e-6, least_coherence: float = 0.3) -> DataFrame:
    """Every sensor fault of each sample: `<c>_flatline` of all columns, `<c>_saturated` of those with a range, packet_loss, rtc_reset (the
    device's clock is bad), rtc_error and channels_all_zero where the input has them, isolated_sensor_deviation (columns hardly move together), any_fault.

    Nulls in the device's own flags count as no fault; so do windows that are not full yet.
    """
    w = ordered(key, order)
    frame = w.rowsBetween(1 - width, 0)
    off = F.lit(False)
    flags = {}
    for c in columns:
        flags[f"{c}_flatline"] = F.coalesce((F.count(c).over(frame) == width) & (F.stddev_samp(c).over(frame) < tol), off)
        if c in ranges:
            flags[f"{c}_saturated"] = clip_saturated(c, *ranges[c])
    flags["packet_loss"] = F.coalesce(F.col(us) - F.lag(us).over(w) > int(2 * step_s * SECOND), off)
    for name, source in (("rtc_reset", "device_clock_bad"), ("rtc_error", "rtc_error"), ("channels_all_zero", "channels_all_zero")):
        if source in df.columns:
            flags[name] = F.coalesce(F.col(source).cast("boolean"), off)
    if len(columns) > 1:
        df = coherence(df, key, order, columns)
        flags["isolated_sensor_deviation"] = F.coalesce(F.col("coherence") < least_coherence, off)
    df = df.withColumns(flags)
    any_fault = off
    for name in flags:
        any_fault = any_fault | F.col(name)
    return df.withColumn("any_fault", any_fault)


def coherence(df: DataFrame, key: list[str], order: list[str], columns: list[str], width: int = 50) -> DataFrame:
    """Mean absolute rolling correlation over all pairs of columns; null until the window is full, and while a column stands still in it."""
    w = ordered(key, order).rowsBetween(1 - width, 0)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def corr(a: str, b: str) -> Column:
        return F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))

    mean = sum((F.abs(corr(a, b)) for a, b in pairs), F.lit(0.0)) / len(pairs)
    return df.withColumn("coherence", F.when(F.count(F.lit(1)).over(w) == width, mean))


def clip_saturated(column: str, low: float, high: float) -> Column:
    """Within one per cent of either end of the range."""
    margin = 0.01 * (high - low)
    return F.coalesce((F.col(column) <= low + margin) | (F.col(column) >= high - margin), F.lit(False))
