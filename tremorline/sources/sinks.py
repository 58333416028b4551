"""Sinks: partitioned Parquet, CSV and JSON tables, idempotent JDBC loads, and the dashboard document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.robust import finite


def write_parsed(df: DataFrame, path: str) -> None:
    """Parsed packets by device and day, so that time ranges and devices prune partitions."""
    df.write.mode("overwrite").partitionBy("device", "server_date").parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One table with its segment as a column; CSV with a header even where it is empty."""
    df.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """A written table; a file without columns gives no rows."""
    return spark.read.schema(schema).format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path)


def new_records(records: DataFrame, loaded: DataFrame) -> DataFrame:
    """Records that are not loaded yet, by time, measurement and content: a repeated load appends nothing."""
    return records.dropDuplicates(["time", "measurement", "data"]).join(loaded, ["time", "measurement", "data"], "left_anti")


#: One statement, so it is done whole or not at all; names are quoted as Spark's writer creates them.
MERGE = """INSERT INTO {table} ("time", "measurement", "data") SELECT DISTINCT s."time", s."measurement", {cast} FROM {staging} s
WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE t."time" = s."time" AND t."measurement" = s."measurement" AND t."data" = {cast})"""


def execute(spark: SparkSession, url: str, statement: str, **options: str) -> int:
    """Run one statement on the driver's connection to a database; the rows it changed."""
    jvm = spark.sparkContext._jvm
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    props = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            props.setProperty(name, options[name])
    link = jvm.java.sql.DriverManager.getConnection(url, props)
    try:
        return link.createStatement().executeUpdate(statement)
    finally:
        link.close()


def load_jdbc(records: DataFrame, url: str, table: str, page: int = 1000, cast: str = 's."data"', types: str = "measurement VARCHAR(256), data VARCHAR(32000)", **options: str) -> int:
    """Load the records that the table does not hold yet; how many these are.

    All are written to a staging table, which a repeated load replaces; one statement in the database then takes the distinct new
    ones. A task that is retried after its partition was committed therefore adds nothing, and the table is never read by Spark. cast
    turns a staged text into the table's own type, such as `s."data"::jsonb`.
    """
    staging = f"{table}_staging"
    rows = records.select("time", "measurement", "data").dropDuplicates()
    rows.write.mode("overwrite").format("jdbc").options(url=url, dbtable=staging, batchsize=str(page), createTableColumnTypes=types, **options).save()
    return execute(records.sparkSession, url, MERGE.format(table=table, staging=staging, cast=cast), **options)


CREATE = "CREATE TABLE IF NOT EXISTS {table} (id BIGSERIAL PRIMARY KEY, time TIMESTAMPTZ NOT NULL, measurement TEXT NOT NULL, data JSONB NOT NULL)"


def dashboard(segments: DataFrame, sessions: DataFrame, events: DataFrame, key: str = "segment") -> DataFrame:
    """One JSON document per segment with its sessions and events in time order; missing ones are empty lists, NaN is null."""
    segments, sessions, events = (d.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in d.dtypes]) for d in (segments, sessions, events))
    s = sessions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in sessions.columns if c != key]))).alias("session_rows"))
    e = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in events.columns if c != key]))).alias("event_rows"))
    rows = segments.join(s, key, "left").join(e, key, "left")
    for name in ("session_rows", "event_rows"):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("document"))
