"""Raw packet exports: scan, shape-driven parse into typed columns, times, load cells. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.robust import parsed_double

RAW = "device string, site string, time string, value string"
CHANNELS = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "mag_y", "mag_z"]
#: The shapes by which tokens are told apart.
RTC_ERROR = r"(?i)^\s*RTC\s*Error\s*$"
DATE, CLOCK, NUMBER = r"^\d{1,2}/\d{1,2}/\d{4}", r"^\d{1,2}:\d{2}:\d{2}$", r"^\s*-?\d+\s*$"
CELL = r"^\s*(\d+(?:\.\d+)?T?):\s*(-?\d+)\s*$"
_LABEL, _INT, _KG = r"\d+(?:\.\d+)?T?", r"-?\d+", r"-?\d+(?:\.\d+)?"
#: One load cell in a joined tail, and the longest stretch of whole ones from its start.
ONE_CELL = rf"\s*({_LABEL}):\s*({_INT})\s*,(?:\s*({_INT})\s*,)?\s*({_KG})\s*[kK][gG]\s*"
ALL_CELLS = rf"^((?:\s*{_LABEL}:\s*{_INT}\s*,(?:\s*{_INT}\s*,)?\s*{_KG}\s*[kK][gG]\s*(?:,|$))*)"
#: What parse() adds.
PARSED = ["sensor_id", "device_time_raw", "rtc_error", "parse_error", "nan_field_count", *CHANNELS, "channels_all_zero", "load_cells", "packet_counter", "load_cells_all_zero", "unparsed_front", "unparsed_tail"]
#: Load-cell labels by channel.
LABELS = {"5T": "LC_A", "500": "LC_A", "7.5T": "LC_B", "7.5": "LC_B"}


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A headerless export of four string columns; a header row is dropped by its third field."""
    rows = spark.read.schema(RAW).option("quote", '"').option("escape", '"').csv(path)
    return rows.where(F.coalesce(F.lower(F.trim("time")) != "time", F.lit(True)))


def _tokens(value: Column) -> Column:
    body = F.regexp_replace(F.trim(value), '^"+|"+$', "")
    return F.transform(F.split(body, ","), lambda t: F.trim(t))


def _once(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns as one generated row: later steps read them instead of each repeating their expressions."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def parse(df: DataFrame, value: str = "value", device: str = "device") -> DataFrame:
    """df with the columns of one parsed packet; pieces are told by their shape, not their place.

    parse_error marks content that is not explained; channels_all_zero and load_cells_all_zero mark dead parts.
    A null or empty packet has parse_error alone.
    """
    rfl = F.col(device) == "RFL"
    df = df.withColumn("_t", _tokens(F.col(value))).withColumn("_ok", F.col(value).isNotNull() & (F.length(F.regexp_replace(F.trim(value), '^"+|"+$', "")) > 0))
    df = _once(df, ["_t", "_ok"])
    token = lambda i: F.get(F.col("_t"), i)
    df = df.withColumn("_r0", F.coalesce(token(F.lit(0)).rlike(RTC_ERROR), F.lit(False)))
    df = df.withColumn("_id", ~F.col("_r0") & F.coalesce(token(F.lit(0)).rlike("^[A-Za-z]"), F.lit(False)))
    df = df.withColumn("_r1", F.col("_id") & F.coalesce(token(F.lit(1)).rlike(RTC_ERROR), F.lit(False)))
    df = df.withColumns({"rtc_error": F.when(F.col("_ok"), F.col("_r0") | F.col("_r1")), "sensor_id": F.when(F.col("_ok") & F.col("_id"), token(F.lit(0)))})
    df = df.withColumn("_at", (F.col("_r0") | F.col("_id")).cast("int") + F.col("_r1").cast("int"))
    here, after = token(F.col("_at")), token(F.col("_at") + 1)
    dated = ~(F.col("_r0") | F.col("_r1")) & F.coalesce(here.rlike(DATE), F.lit(False))
    split = dated & ~here.contains(" ") & F.coalesce(after.rlike(CLOCK), F.lit(False))
    df = _once(df.withColumns({"_dated": dated, "_split": split}), ["_r0", "_id", "_r1", "_at", "_dated", "_split"])
    df = df.withColumn("device_time_raw", F.when(F.col("_ok") & F.col("_split"), F.concat_ws(" ", here, after)).when(F.col("_ok") & F.col("_dated"), here))
    df = df.withColumn("_body", F.slice("_t", F.col("_at") + 1 + F.col("_dated").cast("int") + F.col("_split").cast("int"), F.size("_t")))
    df = df.withColumn("_cell", F.array_position(F.transform("_body", lambda t: t.rlike(CELL)), True).cast("int"))
    df = _once(df, ["_body", "_cell"])
    has = rfl & (F.col("_cell") > 0)
    front = F.when(rfl, F.when(has, F.slice("_body", 1, F.col("_cell") - 1)).otherwise(F.col("_body"))).otherwise(F.slice("_body", 1, 9))
    df = df.withColumn("_front", front)
    last = F.size("_front") - F.coalesce(F.array_position(F.transform(F.reverse("_front"), lambda t: t != ""), True), F.lit(0)) + 1
    df = df.withColumn("_front", F.when(rfl, F.when(F.exists("_front", lambda t: t != ""), F.slice("_front", 1, last.cast("int"))).otherwise(F.slice("_front", 1, 0))).otherwise(F.col("_front")))
    df = _once(df.withColumn("_v", F.transform("_front", lambda t: parsed_double(t))), ["_front", "_v"])
    zero = (F.size("_v") > 0) & F.forall("_v", lambda x: x.isNull() | (x == 0))
    nine, legacy = F.size("_v") == 9, rfl & (F.size("_v") > 9) & zero
    df = df.withColumns({
        "nan_field_count": F.when(F.col("_ok"), F.size(F.filter("_v", lambda x: x.isNull()))),
        "channels_all_zero": F.when(F.col("_ok") & nine, zero).when(F.col("_ok") & legacy, F.lit(True)),
        **{c: F.when(F.col("_ok") & nine, F.get("_v", F.lit(i))) for i, c in enumerate(CHANNELS)},
        "unparsed_front": F.when(F.col("_ok") & ~nine & ~legacy, F.col("_front")),
    })
    tail = F.filter(F.slice("_body", F.greatest(F.col("_cell"), F.lit(1)), F.size("_body")), lambda t: t != "")
    df = df.withColumn("_tail", F.when(has, F.concat_ws(",", tail)).otherwise(F.lit("")))
    df = _once(df.withColumn("_cells", F.regexp_extract("_tail", ALL_CELLS, 1)), ["_tail", "_cells"])
    part = lambda k: F.regexp_extract_all("_cells", F.lit(ONE_CELL), F.lit(k))
    cells = F.transform(
        F.arrays_zip(part(1).alias("l"), part(2).alias("r"), part(3).alias("s"), part(4).alias("k")),
        lambda c: F.struct(
            c["l"].alias("label"), c["r"].try_cast("bigint").alias("raw"), F.when(c["s"] != "", c["s"]).try_cast("bigint").alias("raw_2"), c["k"].try_cast("double").alias("weight_kg_reported"),
        ),
    )
    df = df.withColumn("load_cells", F.when(F.col("_ok") & rfl, cells)).withColumn("_rest", F.expr("substring(_tail, length(_cells) + 1)"))
    df = _once(df, ["load_cells", "_rest"])
    counter = F.col("_rest").rlike(NUMBER)
    df = df.withColumns({
        "packet_counter": F.when(F.col("_ok") & rfl & counter, F.trim("_rest").try_cast("int")),
        "load_cells_all_zero": F.when(F.col("_ok") & rfl, (F.size("load_cells") > 0) & F.forall("load_cells", lambda c: (c["raw"] == 0) & (F.coalesce(c["raw_2"], F.lit(0)) == 0) & (c["weight_kg_reported"] == 0))),
        "unparsed_tail": F.when(F.col("_ok") & rfl & (F.col("_rest") != "") & ~counter, F.split("_rest", ",")),
    })
    df = df.withColumn("parse_error", ~F.col("_ok") | F.col("unparsed_front").isNotNull() | F.col("unparsed_tail").isNotNull())
    kept = [c for c in df.columns if c not in PARSED and not c.startswith("_")]
    # One generated row: filters on parsed columns stay above it and are not expanded into the whole parse.
    return df.select(*kept, F.inline(F.array(F.struct(*PARSED))))


def add_times(df: DataFrame) -> DataFrame:
    """Server time in UTC, device time without zone, their parts, and whether the device clock is bad (null or before 2015)."""
    df = df.withColumns({"server_time": F.col("time").try_cast("timestamp"), "device_time": F.try_to_timestamp(F.col("device_time_raw"), F.lit("d/M/yyyy H:mm:ss")).cast("timestamp_ntz")})
    return df.withColumns({
        "server_date": F.to_date("server_time"), "server_time_of_day": F.date_format("server_time", "HH:mm:ss.SSSSSS"),
        "device_date": F.to_date("device_time"), "device_time_of_day": F.date_format("device_time", "HH:mm:ss.SSSSSS"),
        "device_clock_bad": F.coalesce(F.col("device_time") < F.lit("2015-01-01").cast("timestamp_ntz"), F.lit(True)),
    })


def preprocess(raw: DataFrame) -> DataFrame:
    """Parsed and timed packets of the known devices."""
    return add_times(parse(raw.where(F.col("device").isin("RFM", "RFL"))))


def unknown_devices(raw: DataFrame) -> DataFrame:
    """Devices that no parser takes."""
    return raw.select("device").exceptAll(raw.select("device").where(F.col("device").isin("RFM", "RFL"))).distinct()


def legacy_cells(value: Column) -> Column:
    """The older audit's view of load cells: label:raw pairs followed by a weight, nothing else."""
    return F.regexp_count(value, F.lit(r"\d+(?:\.\d+)?T?:-?\d+,-?\d+(?:\.\d+)?kg"))


def legacy_parse_error(df: DataFrame, value: str = "value", device: str = "device", name: str = "legacy_parse_error") -> DataFrame:
    """What an older audit calls an error: fewer than nine fields after sensor and date, or load-cell fields that are not
    label:raw and weight pairs with at most one counter. It knows no clock errors and no triplets."""
    df = df.withColumn("_t", F.split(F.regexp_replace(F.trim(value), '^"+|"+$', ""), ","))
    token = lambda i: F.get(F.col("_t"), i)
    df = df.withColumn("_i", F.coalesce(token(F.lit(0)).rlike("^[A-Za-z]"), F.lit(False)).cast("int"))
    dated = F.coalesce(token(F.col("_i")).rlike(DATE), F.lit(False))
    split = dated & ~token(F.col("_i")).contains(" ") & F.coalesce(F.trim(token(F.col("_i") + 1)).rlike(CLOCK), F.lit(False))
    df = df.withColumn("_i", F.col("_i") + dated.cast("int") + split.cast("int"))
    df = df.withColumn("_rest", F.filter(F.slice("_t", F.col("_i") + 10, F.size("_t")), lambda t: t != ""))
    pair = F.filter(F.transform("_rest", lambda t, i: t.contains(":") & F.coalesce(F.get(F.col("_rest"), i + 1).contains("kg"), F.lit(False))), lambda x: x)
    counter = F.coalesce(F.get(F.col("_rest"), F.size("_rest") - 1).rlike(r"^\s*-*\d+\s*$"), F.lit(False))
    left = (F.col(device) == "RFL") & (F.size("_rest") > 2 * F.size(pair) + counter.cast("int"))
    error = F.coalesce((F.size("_t") - F.col("_i") < 9) | left, F.lit(True))
    return df.withColumn(name, F.col(value).isNull() | error).drop("_t", "_i", "_rest")


def shape(value: Column) -> Column:
    """A packet's text with every number as N."""
    return F.regexp_replace(value, r"-?\d+(\.\d+)?", "N")


def fingerprint(df: DataFrame, value: str = "value", top: int = 10) -> DataFrame:
    """The most frequent packet shapes with their share and an example."""
    shapes = df.groupBy(shape(F.col(value)).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("example"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return shapes.crossJoin(F.broadcast(total)).select("shape", "n", (F.col("n") / F.col("total")).alias("share"), "example").orderBy(F.desc("n"), "shape").limit(top)


def explode_cells(df: DataFrame) -> DataFrame:
    """Load cells as columns by label; the last one wins where a label repeats, unknown labels are skipped."""
    out = df
    for channel in sorted(set(LABELS.values())):
        names = [k for k, v in LABELS.items() if v == channel]
        own = F.filter("load_cells", lambda c: c["label"].isin(names))  # noqa: B023
        last = F.get(own, F.size(own) - 1)
        out = out.withColumns({f"{channel}_kg": last["weight_kg_reported"], f"{channel}_raw": last["raw"]})
    return out


def clean_tilt(df: DataFrame, dedupe: bool = True) -> DataFrame:
    """Sound packets of named sensors, one per sensor and time: the first by ingest_id where there is one."""
    good = df.where(~F.coalesce("parse_error", F.lit(True)) & ~F.coalesce("channels_all_zero", F.lit(False)) & F.col("sensor_id").rlike(r"^RFM_\d+$") & F.col("server_time").isNotNull() & F.col("acc_x").isNotNull() & F.col("acc_y").isNotNull() & F.col("acc_z").isNotNull())
    return first_of(good, ["sensor_id", "server_time"]) if dedupe else good


def clean_load(df: DataFrame) -> DataFrame:
    """Sound packets with a time, whatever their channels hold."""
    return first_of(df.where(~F.coalesce("parse_error", F.lit(True)) & F.col("server_time").isNotNull()), ["sensor_id", "server_time"])


def first_of(df: DataFrame, key: list[str], order: str = "ingest_id") -> DataFrame:
    """One row per key: the smallest by the order column, or by all columns' hash where that is missing."""
    from pyspark.sql import Window as W

    by = F.col(order) if order in df.columns else F.xxhash64(*df.columns)
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(by))).where("_rank = 1").drop("_rank")


def read_temperature(spark: SparkSession, path: str, zone: str = "Asia/Kolkata") -> DataFrame:
    """(time, temperature) in UTC from local date and time columns; unreadable rows go, the first of equal times stays."""
    rows = spark.read.option("header", True).csv(path)
    local = F.try_to_timestamp(F.concat_ws(" ", "date", "time"))
    rows = rows.select(F.to_utc_timestamp(local, zone).alias("time"), F.col("temperature_C").try_cast("double").alias("temperature"), F.monotonically_increasing_id().alias("ingest_id"))
    return first_of(rows.where("time is not null and temperature is not null"), ["time"]).drop("ingest_id")


def pivot_fields(df: DataFrame, time: str = "_time", field: str = "_field", value: str = "_value", tags: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Long measurement rows as one row per time and tags with a column per field; names with a leading underscore,
    `result` and `table` go, and the columns are in sorted order."""
    tags = [t for t in (tags or []) if not t.startswith("_") and t not in ("result", "table")]
    wide = df.groupBy(time, *tags).pivot(field, fields).agg(F.first(value, True))
    return wide.select(time, *sorted(c for c in wide.columns if c != time))


def records(df: DataFrame) -> DataFrame:
    """(time, measurement, data) rows for a JSON table: rows without a time go; NaN and infinities become null."""
    names = [c for c in df.columns if c not in ("server_time", "device")]
    clean = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c in names]
    return df.where("server_time is not null").select(F.col("server_time").alias("time"), F.col("device").alias("measurement"), F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("data"))
