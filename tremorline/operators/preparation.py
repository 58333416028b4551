"""One node type's samples from raw axes to features: calibration, rotation, slow and fast parts, denoising, faults, baseline.

Everything is keyed, so all nodes run together. Windows and regressions are DataFrame expressions; only filters and spectra, which need a
whole series or window at once, run in NumPy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import features as X
from . import series as S
from . import signal

#: Samples of a window of features, in seconds, and whether it has a spectrum.
MODALITY = {"RFM": (10, True), "RFL": (60, False)}


@dataclass(frozen=True)
class Preparation:
    """What is known of the nodes. Steps without their input are left out, as for a node that is not commissioned yet."""

    rate: float
    accel: tuple[str, ...] = ()
    bias: tuple[float, ...] | None = None
    scale: tuple[float, ...] | None = None
    rotation: tuple[tuple[float, ...], ...] | None = None
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    step_s: float | None = None
    cutoff_hz: float = 25.0
    spectrum: int = 256


def denoised(df: DataFrame, key: list[str], order: list[str], columns: list[str], rate: float, width: int = 7, sigmas: float = 3.0, cutoff: float = 25.0) -> DataFrame:
    """`<c>_glitch`, outliers of the centred median, and `<c>_filt`, the low-passed column without them; the column itself stays."""
    for c in columns:
        df = S.hampel(df, key, order, c, width, sigmas).withColumnsRenamed({"outlier": f"{c}_glitch", "cleaned": f"_{c}_clean"})
    out = signal.smoothed(df, key, order, {f"_{c}_clean": f"{c}_filt" for c in columns}, rate, cutoff)
    return out.drop(*[f"_{c}_clean" for c in columns])


def rotated(df: DataFrame, columns: list[str], matrix: tuple[tuple[float, ...], ...], prefix: str = "rot_") -> DataFrame:
    """The axes turned by a fixed matrix, as `rot_<c>`."""
    return df.withColumns({f"{prefix}{c}": sum((F.col(x) * float(m) for x, m in zip(columns, row, strict=True)), F.lit(0.0)) for c, row in zip(columns, matrix, strict=True)})


def window_features(df: DataFrame, key: list[str], order: list[str], column: str, rate: float, window_s: float, overlap: float = 0.5, spectrum: int | None = 256) -> DataFrame:
    """Overlapping windows of samples of a channel: time-domain features and, with a spectrum, its strongest line.

    window_no counts from 0; a series shorter than a window is one window. Nulls are left out.
    """
    size = int(window_s * rate)
    rows = S.sliding(df.select(*dict.fromkeys([*key, *order, column])), key, order, size, max(1, int(size * (1 - overlap))))
    every = [*key, "window_no"]
    out = X.time_domain(rows, every, column)
    start = rows.groupBy(*every).agg(F.min(order[0]).alias("window_start"), F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_v"))))).alias("_w"))
    if spectrum:
        start = signal.strongest(start.withColumn("_w", F.col("_w._v").cast("array<double>")), "_w", rate, spectrum)
    return out.join(start.drop("_w"), every)


def prepare(df: DataFrame, key: list[str], order: list[str], kind: str, how: Preparation, healthy: Column | None = None, confound: str | None = None, us: str = "us") -> dict[str, DataFrame]:
    """rows with all added columns, their faults, the baseline of healthy rows, and window features of each axis.

    kind is RFM (short windows with spectra) or RFL (long ones, quasi-static). Parts whose inputs are not known are missing from the result.
    """
    axes = list(how.accel)
    if axes and how.bias is not None and how.scale is not None:
        df = df.withColumns({f"{c}_cal": X.calibrated(F.col(c), b, s) for c, b, s in zip(axes, how.bias, how.scale, strict=True)})
        axes = [f"{c}_cal" for c in axes]
    if axes and how.rotation is not None:
        df = rotated(df, axes, how.rotation)
        axes = [f"rot_{c}" for c in axes]
        df = signal.split(df, key, order, {c: (f"{c}_static", f"{c}_dynamic") for c in axes}, how.rate)
    out: dict[str, DataFrame] = {}
    if axes:
        df = denoised(df, key, order, axes, how.rate, cutoff=how.cutoff_hz)
        if healthy is not None and confound is not None:
            df = X.confound_residual(df, key, axes[0], confound, healthy).withColumnRenamed("residual", f"{axes[0]}_confound_resid").drop("slope", "intercept")
        if how.ranges and how.step_s:
            out["faults"] = S.sample_flags(df, key, order, axes, how.ranges, how.step_s, us)
        if healthy is not None:
            out["baseline"] = signal.node_baseline(df.where(healthy), key, order[0], axes, how.rate, how.spectrum)
        window_s, lines = MODALITY[kind]
        each = [window_features(df, key, order, c, how.rate, window_s, spectrum=how.spectrum if lines else None).withColumn("axis", F.lit(c)) for c in axes]
        features = each[0]
        for more in each[1:]:
            features = features.unionByName(more)
        out["features"] = features
    return {"rows": df, **out}


def single_fault(windows: DataFrame, key: list[str], status: Column, onset: Column, order: str = "start_us", before: int = 10, after: int = 20) -> tuple[DataFrame, DataFrame]:
    """One injected fault by series: (verdict, view).

    verdict: windows, the first flagged window at or after the onset, its status and its delay in hours; view: the windows
    around the onset. onset is a boolean column, true from the injection on.
    """
    w = S.ordered(key, [order])
    rows = windows.withColumns({"_i": F.row_number().over(w) - 1, "_on": onset, "_status": status})
    first = F.min(F.when(F.col("_on"), F.struct("_i", F.col(order).alias("at")))).over(W.partitionBy(*key))
    rows = rows.withColumn("_first", first)
    late = F.when((F.col("_i") >= F.col("_first._i")) & (F.col("_status") != "OK"), F.struct("_i", F.col(order).alias("at"), F.col("_status").alias("status")))
    verdict = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("windows"), F.first("_first").alias("_f"), F.min(late).alias("_hit"))
    verdict = verdict.select(*key, "windows", F.col("_f._i").alias("onset_window"), F.col("_hit").isNotNull().alias("detected"), F.col("_hit._i").alias("window"), F.col("_hit.status").alias("status"), ((F.col("_hit.at") - F.col("_f.at")) / float(3600 * S.SECOND)).alias("delay_h"))
    view = rows.where((F.col("_i") >= F.col("_first._i") - before) & (F.col("_i") < F.col("_first._i") + after))
    return verdict, view.withColumns({"window": F.col("_i"), "status": F.col("_status")}).drop("_i", "_on", "_first", "_status")
