"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it.

The library's concepts are mapped on the tables like this: a node is an event type, server time is `ts`, a scalar channel
is `value`, a raw reading is the number in `props`; vectors are (value - 50, raw - 50, 100). Sessions part at gaps of an
hour. Doubles are rounded to six digits on both sides, and times are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import robust, vectors
from ..operators import features as X
from ..operators import models, preparation, thermal, trackers
from ..operators import series as S
from ..sources import packets, sinks
from . import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GAP_S, WIN_S = 3600, 1800
NODE, ORDER = ["node"], ["us", "event_id"]
HOUR = 3600 * S.SECOND

#: The same events and sessions in DuckDB.
EV = """ev AS (SELECT event_type AS node, event_id, user_id, epoch_us(ts) AS us, value, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INTEGER) AS raw FROM events)"""
SES = EV + """, ses AS (SELECT * EXCLUDE (brk), CAST(sum(brk) OVER (PARTITION BY node ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
  FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY node ORDER BY us, event_id) > 3600000000 THEN 1 ELSE 0 END AS brk FROM ev))"""
WIN = SES + """, win AS (SELECT *, CAST(floor((us - min(us) OVER (PARTITION BY node, session)) / 1800000000.0::DOUBLE) AS BIGINT) AS win FROM ses)"""
STAB = SES + """, st AS (SELECT node, session, min(us) AS start_us, median(value) AS u, median(raw::DOUBLE) AS v, count(*) AS n FROM ses GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.select(F.col("event_type").alias("node"), "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", F.get_json_object("props", "$.k").cast("int").alias("raw"))


def ses(spark: SparkSession, sf: str) -> DataFrame:
    return S.sessionize(ev(spark, sf), NODE, ORDER, GAP_S)


def win(spark: SparkSession, sf: str) -> DataFrame:
    return S.session_windows(ses(spark, sf), NODE, WIN_S)


def stab(spark: SparkSession, sf: str) -> DataFrame:
    rows = ses(spark, sf).select("node", "session", "us", F.col("value").alias("u"), F.col("raw").cast("double").alias("v"))
    return S.session_table(rows, NODE, ["u", "v"])


def r6(column, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


# Parsing -----------------------------------------------------------------------------------------------------------

_DATE = "strftime(make_timestamp(us), '%d/%m/%Y %H:%M:%S')"
KINDS = 8


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    """Packets of eight kinds made from events, as an export would hold them."""
    e = ev(spark, sf).withColumn("kind", F.pmod("event_id", F.lit(KINDS)))
    date = F.date_format(F.timestamp_micros("us"), "dd/MM/yyyy HH:mm:ss")
    a, b = F.format_string("%.2f", "value"), F.col("raw").cast("string")
    nine = F.concat_ws(",", a, b, F.lit("1,2,3,4,5,6,7"))
    sensor = F.concat(F.lit("RFM_"), F.col("user_id").cast("string"))
    value = (
        F.when(F.col("kind") == 0, F.concat_ws(",", sensor, date, nine))
        .when(F.col("kind") == 1, F.concat_ws(",", date, nine, F.lit("")))
        .when(F.col("kind") == 2, F.concat_ws(",", sensor, F.lit("RTC Error"), nine))
        .when(F.col("kind") == 3, F.concat_ws(",", sensor, F.substring(date, 1, 10), F.substring(date, 12, 8), nine))
        .when(F.col("kind") == 4, F.concat_ws(",", sensor, date, a, b, F.lit("3")))
        .when(F.col("kind") == 5, F.concat_ws(",", sensor, date, F.lit("0,0,0,0,0,0,0,0,0")))
        .when(F.col("kind") == 6, F.concat_ws(",", date, nine, F.concat(F.lit("500:"), b), F.concat(a, F.lit("kg")), F.concat(F.lit("7.5T:"), b), b, F.concat(a, F.lit("kg")), F.lit("77")))
        .otherwise(F.lit(None))
    )
    device = F.when(F.col("kind") == 6, F.lit("RFL")).otherwise(F.lit("RFM"))
    return e.withColumns({"device": device, "site": F.lit("s"), "time": F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "value_kg": F.col("value"), "value": value})


@query("parse_packets", f"""WITH {EV}, k AS (SELECT *, event_id % 8 AS kind, round(value, 2) AS x FROM ev)
SELECT event_id, CASE WHEN kind IN (0, 2, 3, 4, 5) THEN 'RFM_' || user_id END AS sensor_id, CASE WHEN kind IN (0, 1, 3, 4, 5, 6) THEN {_DATE} END AS device_time_raw,
  CASE WHEN kind < 7 THEN kind = 2 END AS rtc_error, kind IN (4, 7) AS parse_error, CASE WHEN kind < 7 THEN 0 END::INTEGER AS nan_field_count,
  CASE WHEN kind IN (0, 1, 2, 3, 6) THEN x WHEN kind = 5 THEN 0.0 END::DOUBLE AS acc_x, CASE WHEN kind IN (0, 1, 2, 3, 6) THEN raw WHEN kind = 5 THEN 0 END::DOUBLE AS acc_y,
  CASE WHEN kind IN (0, 1, 2, 3, 6) THEN 7.0 WHEN kind = 5 THEN 0.0 END::DOUBLE AS mag_z, CASE WHEN kind IN (0, 1, 2, 3, 5, 6) THEN kind = 5 END AS channels_all_zero, us AS server_us,
  kind IN (2, 7) AS device_clock_bad FROM k""")
def parse_packets(spark, sf):
    rows = packets.preprocess(_packets(spark, sf))
    return rows.select("event_id", "sensor_id", "device_time_raw", "rtc_error", "parse_error", "nan_field_count", "acc_x", "acc_y", "mag_z", "channels_all_zero", F.unix_micros("server_time").alias("server_us"), "device_clock_bad")


@query("parse_load_cells", f"""WITH {EV}, k AS (SELECT *, round(value, 2) AS x FROM ev WHERE event_id % 8 = 6)
SELECT event_id, label, raw::BIGINT AS raw, CASE WHEN label = '7.5T' THEN raw END::BIGINT AS raw_2, x AS weight_kg_reported, 77::INTEGER AS packet_counter, raw = 0 AND x = 0 AS load_cells_all_zero
FROM k CROSS JOIN (VALUES ('500'), ('7.5T')) v(label)""")
def parse_load_cells(spark, sf):
    rows = packets.parse(_packets(spark, sf).where("device = 'RFL'").drop("raw"))
    return rows.select("event_id", "packet_counter", "load_cells_all_zero", F.inline_outer("load_cells"))


@query("load_explode_pivot", f"""WITH {EV} SELECT event_id, round(value, 2) AS "LC_A_kg", raw::BIGINT AS "LC_A_raw", round(value, 2) AS "LC_B_kg", raw::BIGINT AS "LC_B_raw" FROM ev WHERE event_id % 8 = 6""")
def load_explode_pivot(spark, sf):
    rows = packets.explode_cells(packets.parse(_packets(spark, sf).where("device = 'RFL'").drop("raw")))
    return rows.select("event_id", "LC_A_kg", "LC_A_raw", "LC_B_kg", "LC_B_raw")


@query("packet_fingerprint", """WITH p AS (SELECT regexp_replace(event_type || ',' || CAST(user_id % 7 AS VARCHAR) || ',' || props, '-?[0-9]+([.][0-9]+)?', 'N', 'g') AS shape,
  event_type || ',' || CAST(user_id % 7 AS VARCHAR) || ',' || props AS packet FROM events)
SELECT shape, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM p), 6) AS share, min(packet) AS example FROM p GROUP BY 1 ORDER BY n DESC, shape LIMIT 10""")
def packet_fingerprint(spark, sf):
    rows = table(spark, sf, "events").select(F.concat_ws(",", "event_type", (F.col("user_id") % 7).cast("string"), "props").alias("packet"))
    return packets.fingerprint(rows, "packet").select("shape", "n", r6("share"), "example")


@query("legacy_cell_audit", f"""WITH {EV}, k AS (SELECT event_id % 8 AS kind, * FROM ev WHERE event_id % 8 IN (0, 6))
SELECT kind, count(*) AS n, CAST(sum(CASE WHEN kind = 6 THEN 1 ELSE 0 END) AS BIGINT) AS cells FROM k GROUP BY 1""")
def legacy_cell_audit(spark, sf):
    rows = _packets(spark, sf).where("kind in (0, 6)")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(packets.legacy_cells(F.col("value"))).cast("bigint").alias("cells"))


@query("legacy_parse_error", f"WITH {EV} SELECT event_id, event_id % 8 IN (4, 6, 7) AS legacy_parse_error FROM ev")
def legacy_parse_error(spark, sf):
    return packets.legacy_parse_error(_packets(spark, sf)).select("event_id", "legacy_parse_error")


@query("influx_pivot", """SELECT epoch_us(ts) AS us, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'error' THEN value END) AS error,
  max(CASE WHEN event_type = 'view' THEN value END) AS view FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1""")
def influx_pivot(spark, sf):
    rows = ev(spark, sf).where("node in ('click', 'error', 'view')")
    return packets.pivot_fields(rows, "us", "node", "value", fields=["click", "error", "view"])


@query("json_records", """SELECT epoch_us(ts) AS time_us, event_type AS measurement, '{"event_id":' || event_id || ',"raw":' || CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INTEGER) || ',"bad":null}' AS data FROM events""")
def json_records(spark, sf):
    rows = ev(spark, sf).select(F.timestamp_micros("us").alias("server_time"), F.col("node").alias("device"), "event_id", "raw", F.lit(float("nan")).alias("bad"))
    return packets.records(rows).select(F.unix_micros("time").alias("time_us"), "measurement", "data")


@query("idempotent_load", """SELECT event_type AS measurement, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1""")
def idempotent_load(spark, sf):
    rows = ev(spark, sf).select(F.col("us").alias("time"), F.col("node").alias("measurement"), F.col("event_id").alias("data"))
    fresh = sinks.new_records(rows.unionByName(rows), rows.where("data % 3 = 0"))
    return fresh.groupBy("measurement").agg(F.count(F.lit(1)).alias("n"))


# Audit and cleaning ------------------------------------------------------------------------------------------------

def _flagged(spark, sf):
    return ev(spark, sf).withColumns({"parse_error": F.col("raw") < 5, "device_clock_bad": F.col("raw") > 90, "channels_all_zero": F.when(F.col("raw") > 10, F.col("raw") % 11 == 0)})


_AUDIT = """SELECT {key} count(*) AS rows, round(avg(CASE WHEN raw < 5 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS parse_error_rate, round(avg(CASE WHEN raw > 90 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS device_clock_bad_rate,
  round(avg(CASE WHEN raw > 10 AND raw % 11 = 0 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS channels_all_zero_rate, min(us) AS first_us, max(us) AS last_us, round(max(mid), 6) AS median_dt_s,
  CAST(sum(CASE WHEN dt > 10 * mid THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps, count(us) - count(DISTINCT us) AS n_duplicate_times
  FROM (SELECT *, median(dt) OVER ({part}) AS mid FROM (SELECT *, (us - lag(us) OVER ({part} ORDER BY us)) / 1000000.0::DOUBLE AS dt FROM ev)) {group}"""


def _audited(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("audit_stream", f"WITH {EV} " + _AUDIT.format(key="", part="", group=""))
def audit_stream(spark, sf):
    return _audited(X.audit(_flagged(spark, sf), []))


@query("audit_grouping_sets", f"WITH {EV} " + _AUDIT.format(key="'(all)' AS node,", part="", group="") + " UNION ALL " + _AUDIT.format(key="node,", part="PARTITION BY node", group="GROUP BY node"))
def audit_grouping_sets(spark, sf):
    rows = _flagged(spark, sf)
    return _audited(X.audit(rows, []).withColumn("node", F.lit("(all)")).unionByName(X.audit(rows, NODE)))


@query("clean_dedupe", f"""WITH {EV}, d AS (SELECT *, 0 AS copy FROM ev UNION ALL SELECT *, 1 FROM ev WHERE event_id % 3 = 0)
SELECT node, us, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, us ORDER BY event_id * 2 + copy) AS rn FROM d WHERE raw >= 5) WHERE rn = 1""")
def clean_dedupe(spark, sf):
    e = ev(spark, sf).where("raw >= 5")
    twice = e.withColumn("ingest_id", F.col("event_id") * 2).unionByName(e.where("event_id % 3 = 0").withColumn("ingest_id", F.col("event_id") * 2 + 1))
    return packets.first_of(twice, ["user_id", "us"]).select("node", "us", "event_id", "value")


@query("duplicate_rows", """WITH o AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 15 = 0)
SELECT *, count(*) AS copies FROM o GROUP BY ALL HAVING count(*) > 1""")
def duplicate_rows(spark, sf):
    rows = table(spark, sf, "orders")
    return X.duplicates(rows.unionByName(rows.where("o_orderkey % 5 = 0")).unionByName(rows.where("o_orderkey % 15 = 0")))


# Sessions, windows, segments -----------------------------------------------------------------------------------------

@query("sessionize", f"WITH {SES} SELECT event_id, node, us, session FROM ses")
def sessionize(spark, sf):
    return ses(spark, sf).select("event_id", "node", "us", "session")


@query("session_table", f"WITH {STAB} SELECT node, session, start_us, round(u, 6) AS u, round(v, 6) AS v, n FROM st")
def session_table(spark, sf):
    return stab(spark, sf).select("node", "session", "start_us", r6("u"), r6("v"), "n")


@query("session_scatter", f"""WITH {WIN}, m AS (SELECT node, session, win, avg(value) AS u FROM win GROUP BY 1, 2, 3), c AS (SELECT *, median(u) OVER (PARTITION BY node, session) AS mu FROM m)
SELECT node, session, round(1.4826::DOUBLE * median(abs(u - mu)), 8) AS s_w, count(*) AS n FROM c GROUP BY 1, 2""")
def session_scatter(spark, sf):
    m = win(spark, sf).groupBy("node", "session", "win").agg(F.avg("value").alias("u"))
    m = m.withColumn("off", F.abs(F.col("u") - robust.median("u").over(W.partitionBy("node", "session"))))
    return m.groupBy("node", "session").agg(F.round(robust.MAD * robust.median("off"), 8).alias("s_w"), F.count(F.lit(1)).alias("n"))


@query("window_features", f"""WITH {WIN}, h AS (SELECT *, (us - min(us) OVER (PARTITION BY node, session, win)) / 3600000000.0::DOUBLE AS h FROM win)
SELECT node, session, win, min(us) AS start_us, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(regr_slope(value, h), 5) AS slope_h
FROM h GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND max(h) > 0""")
def window_features(spark, sf):
    rows = X.window_features(win(spark, sf), NODE, "value", 2)
    return rows.select("node", "session", "win", "start_us", "n", r6("mean"), r6("std"), F.round("slope_h", 5).alias("slope_h"))


@query("robust_window_std", f"""WITH {SES}, m AS (SELECT node, session, value, raw::DOUBLE AS raw, median(value) OVER (PARTITION BY node, session) AS mv, median(raw::DOUBLE) OVER (PARTITION BY node, session) AS mr FROM ses),
d AS (SELECT *, sqrt((value - mv) * (value - mv) + (raw - mr) * (raw - mr)) AS d FROM m), k AS (SELECT *, d <= greatest(0.05::DOUBLE, 4.0::DOUBLE * 1.4826::DOUBLE * median(d) OVER (PARTITION BY node, session)) AS near FROM d)
SELECT node, session, count(*) AS n, count(*) FILTER (near) AS n_near, round(greatest(coalesce(stddev_pop(CASE WHEN near THEN value END), 0), coalesce(stddev_pop(CASE WHEN near THEN raw END), 0)), 6) AS std_max FROM k GROUP BY 1, 2""")
def robust_window_std(spark, sf):
    rows = X.robust_std(ses(spark, sf), ["node", "session"], ["value", "raw"])
    return rows.select("node", "session", "n", "n_near", r6("std_max"))


@query("load_windows", f"""WITH {WIN}, k AS (SELECT *, CASE WHEN raw % 4 <> 0 THEN value END AS kg FROM win)
SELECT node, session, win, round(median(kg), 6) AS kg, round(stddev_pop(raw), 6) AS raw_std, count(kg) AS n, min(CASE WHEN kg IS NOT NULL THEN us END) AS start_us FROM k GROUP BY 1, 2, 3 HAVING count(kg) >= 3""")
def load_windows(spark, sf):
    rows = win(spark, sf).withColumn("kg", F.when(F.col("raw") % 4 != 0, F.col("value")))
    return X.load_windows(rows, NODE, "kg", "raw").select("node", "session", "win", r6("kg"), r6("raw_std"), "n", "start_us")


_DIR = STAB + """, d AS (SELECT *, sqrt((u - 50) * (u - 50) + (v - 50) * (v - 50) + 10000.0::DOUBLE) AS len FROM st WHERE n >= 2),
un AS (SELECT node, session, start_us, (u - 50) / len AS x, (v - 50) / len AS y, 100 / len AS z FROM d),
jp AS (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w)))) AS jump FROM un WINDOW w AS (PARTITION BY node ORDER BY session))"""


def _jumps(spark, sf):
    d = vectors.unit((F.col("u") - 50, F.col("v") - 50, F.lit(100.0)))
    rows = stab(spark, sf).where("n >= 2").select("node", "session", "start_us", *[c.alias(n) for c, n in zip(d, "xyz", strict=True)])
    w = S.ordered(NODE, ["session"])
    back = tuple(F.lag(c).over(w) for c in "xyz")
    return rows.withColumn("jump", vectors.angle_deg(vectors.triple("x", "y", "z"), back))


def _segment_sql(limit: float) -> str:
    return f"WITH {_DIR} SELECT node, session, round(jump, 5) AS jump, CAST(sum(CASE WHEN jump > {limit} THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY session ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM jp"


@query("segment_split", _segment_sql(20.0))
def segment_split(spark, sf):
    return S.segments(_jumps(spark, sf), NODE, ["session"], F.col("jump"), 20.0).select("node", "session", F.round("jump", 5).alias("jump"), "segment")


@query("epoch_cut", _segment_sql(10.0))
def epoch_cut(spark, sf):
    return S.segments(_jumps(spark, sf), NODE, ["session"], F.col("jump"), 10.0).select("node", "session", F.round("jump", 5).alias("jump"), "segment")


@query("settle_and_norm_gate", f"""WITH {EV}, s AS (SELECT *, sqrt(value * value + raw * raw) AS norm FROM (SELECT *, min(us) OVER (PARTITION BY node) AS first FROM ev) WHERE us >= first + 86400000000),
m AS (SELECT *, median(norm) OVER (PARTITION BY node) AS mid FROM s) SELECT event_id, node, round(norm, 6) AS norm FROM m WHERE norm > 0 AND abs(norm - mid) / mid < 0.3""")
def settle_and_norm_gate(spark, sf):
    rows = monitor.settled(ev(spark, sf), NODE, 24.0).withColumn("norm", F.sqrt(F.col("value") * F.col("value") + F.col("raw") * F.col("raw")))
    return monitor.plausible(rows, NODE, 0.3).select("event_id", "node", r6("norm"))


def _compare_rows(spark, sf):
    """Vectors of all events, one mounting for each node."""
    e = ev(spark, sf)
    return e.select(F.col("node").alias("sensor_id"), F.lit(0).cast("bigint").alias("segment"), "us", (F.col("value") - 50).alias("x"), (F.col("raw") - 50.0).alias("y"), F.lit(300.0).alias("z"))


COMPARE = trackers.CompareConfig(cut_deg=25.0, floor_deg=4.0, fixed_deg=6.0, k_mad=2.0, steps_deg=(2.0, 5.0, 10.0, 20.0))
#: Epochs of the same events with their hits: h without, q with an injected turn, by session of the test part.
_COMPARE = f"""{EV}, v0 AS (SELECT node, event_id, us, value - 50 AS x, raw - 50.0::DOUBLE AS y, 300.0::DOUBLE AS z FROM ev),
v1 AS (SELECT *, sqrt(x * x + y * y + z * z) AS norm FROM v0 QUALIFY us >= min(us) OVER (PARTITION BY node) + 21600000000),
v2 AS (SELECT node, us, x / norm AS x, y / norm AS y, z / norm AS z, event_id FROM (SELECT *, median(norm) OVER (PARTITION BY node) AS mid FROM v1) WHERE norm > 0 AND abs(norm - mid) / mid < 0.3),
v3 AS (SELECT *, sum(CASE WHEN us - pr > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, lag(us) OVER (PARTITION BY node ORDER BY us, event_id) AS pr FROM v2)),
m0 AS (SELECT node, session, min(us) AS start_us, median(x) AS x, median(y) AS y, median(z) AS z FROM v3 GROUP BY 1, 2 HAVING count(*) >= 3),
m1 AS (SELECT node, session, start_us, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM m0),
m2 AS (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w)))) AS jump FROM m1 WINDOW w AS (PARTITION BY node ORDER BY session)),
m3 AS (SELECT *, CAST(sum(CASE WHEN jump > {COMPARE.cut_deg} THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY session ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM m2),
m4 AS (SELECT *, row_number() OVER (PARTITION BY node, epoch ORDER BY session) - 1 AS k, count(*) OVER (PARTITION BY node, epoch) AS c FROM m3),
f0 AS (SELECT node, epoch, median(v3.x) AS x, median(v3.y) AS y, median(v3.z) AS z FROM v3 JOIN (SELECT node, session, epoch FROM m4 WHERE k < {COMPARE.ref_sessions}) USING (node, session) GROUP BY 1, 2),
f1 AS (SELECT node, epoch, x / sqrt(x * x + y * y + z * z) AS rx, y / sqrt(x * x + y * y + z * z) AS ry, z / sqrt(x * x + y * y + z * z) AS rz FROM f0),
f2 AS (SELECT *, CASE WHEN abs(rx) <= abs(ry) AND abs(rx) <= abs(rz) THEN [0, rz, -ry] WHEN abs(ry) <= abs(rz) THEN [-rz, 0, rx] ELSE [ry, -rx, 0] END AS u FROM f1),
f3 AS (SELECT node, epoch, rx, ry, rz, ry * u[3] - rz * u[2] AS wx, rz * u[1] - rx * u[3] AS wy, rx * u[2] - ry * u[1] AS wz, sqrt(u[1] * u[1] + u[2] * u[2] + u[3] * u[3]) AS l FROM f2),
t0 AS (SELECT m4.node, m4.epoch, k - {COMPARE.ref_sessions} AS i, c - {COMPARE.ref_sessions} AS rest, x * rx + y * ry + z * rz AS a, (x * wx + y * wy + z * wz) / l AS b FROM m4 JOIN f3 ON m4.node = f3.node AND m4.epoch = f3.epoch WHERE c >= {COMPARE.least_sessions} AND k >= {COMPARE.ref_sessions}),
t1 AS (SELECT * FROM (SELECT *, greatest({COMPARE.least_train}, CAST(floor(rest * {COMPARE.train}) AS BIGINT)) AS train FROM t0) WHERE train + {COMPARE.least_test} <= rest),
sh AS (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, a)))) AS shift FROM t1),
lm AS (SELECT node, epoch, mid, greatest({COMPARE.floor_deg}::DOUBLE, mid + {COMPARE.k_mad}::DOUBLE * 1.4826::DOUBLE * median(abs(shift - mid))) AS thr FROM (SELECT *, median(shift) OVER (PARTITION BY node, epoch) AS mid FROM sh WHERE i < train) GROUP BY 1, 2, 3),
me AS (SELECT node, epoch, 'mad' AS method, thr FROM lm UNION ALL SELECT node, epoch, 'fixed', {COMPARE.fixed_deg}::DOUBLE FROM lm),
te AS (SELECT sh.node, sh.epoch, method, thr, i - train AS i, rest - train AS n, a, b, shift, shift > thr AS h FROM sh JOIN me ON sh.node = me.node AND sh.epoch = me.epoch WHERE i >= train)"""


@query("baseline_comparator", f"""WITH {_COMPARE}, st AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in COMPARE.steps_deg)}]) AS step_deg),
q AS (SELECT te.*, step_deg, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, a * cos(radians(step_deg)) + b * sin(radians(step_deg)))))) > thr AS q FROM te CROSS JOIN st),
s AS (SELECT node, epoch, method, step_deg, unnest(range(0, n - {COMPARE.persist} + 1)) AS s0 FROM (SELECT DISTINCT node, epoch, method, step_deg, n FROM q)),
x AS (SELECT q.*, s0, CASE WHEN i < s0 THEN h ELSE q END AS hit FROM q JOIN s USING (node, epoch, method, step_deg)),
y AS (SELECT *, hit AND coalesce(lag(hit) OVER (PARTITION BY node, epoch, method, step_deg, s0 ORDER BY i), false) AS done FROM x),
z AS (SELECT node, epoch, method, step_deg, thr, s0, min(CASE WHEN done THEN i END) AS fin FROM y GROUP BY ALL)
SELECT node, epoch, method, step_deg, round(thr, 4) AS limit_deg, round(avg(CASE WHEN fin >= s0 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS detect_rate, median(CASE WHEN fin >= s0 THEN fin - s0 + 1 END)::DOUBLE AS median_delay FROM z GROUP BY 1, 2, 3, 4, 5""")
def baseline_comparator(spark, sf):
    return _compared(spark, sf, False).select("node", "epoch", "method", "step_deg", F.round("limit_deg", 4).alias("limit_deg"), r6("detect_rate"), "median_delay")


def _compared(spark, sf, summary: bool):
    cfg = monitor.TiltConfig(gap_s=GAP_S)
    sessions = monitor.session_directions(_compare_rows(spark, sf), cfg, 3, COMPARE.cut_deg, COMPARE.ref_sessions)
    return trackers.compare(sessions, [*monitor.SEGMENT, "epoch"], COMPARE, summary).withColumnRenamed("sensor_id", "node")


@query("baseline_epochs", f"""WITH {_COMPARE}, d AS (SELECT *, h AND coalesce(lag(h) OVER (PARTITION BY node, epoch, method ORDER BY i), false) AS done FROM te)
SELECT node, epoch, max(n) AS test, round(max(shift), 4) AS test_shift_max, round(max(CASE WHEN method = 'mad' THEN thr END), 4) AS thr_mad, round(avg(CASE WHEN method = 'mad' THEN h::INTEGER END), 6) AS far_single_mad,
  round(avg(CASE WHEN method = 'fixed' THEN h::INTEGER END), 6) AS far_single_fixed, max(CASE WHEN method = 'mad' THEN done::INTEGER END)::DOUBLE AS false_alarm_in_span_mad, max(CASE WHEN method = 'fixed' THEN done::INTEGER END)::DOUBLE AS false_alarm_in_span_fixed FROM d GROUP BY 1, 2""")
def baseline_epochs(spark, sf):
    return _compared(spark, sf, True).select("node", "epoch", "test", F.round("test_shift_max", 4).alias("test_shift_max"), F.round("thr_mad", 4).alias("thr_mad"), r6("far_single_mad"), r6("far_single_fixed"), "false_alarm_in_span_mad", "false_alarm_in_span_fixed")


# Vectors -----------------------------------------------------------------------------------------------------------

_VEC = f"""{EV}, a AS (SELECT *, value - 50 AS ax, raw - 50.0::DOUBLE AS ay, 100.0::DOUBLE AS az FROM ev), n AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS len FROM a),
un AS (SELECT event_id, node, us, ax / len AS x, ay / len AS y, az / len AS z FROM n)"""


def _units(spark, sf):
    d = vectors.unit((F.col("value") - 50, F.col("raw") - F.lit(50.0), F.lit(100.0)))
    return ev(spark, sf).select("event_id", "node", "us", *[c.alias(n) for c, n in zip(d, "xyz", strict=True)])


@query("tilt_projection", f"WITH {_VEC} SELECT event_id, round(degrees(atan2(y, z)), 6) AS dev_u, round(degrees(atan2(-x, z)), 6) AS dev_v FROM un")
def tilt_projection(spark, sf):
    du, dv = vectors.tilt(vectors.triple("x", "y", "z"), vectors.triple(0.0, 0.0, 1.0))
    return _units(spark, sf).select("event_id", r6(du, "dev_u"), r6(dv, "dev_v"))


@query("rodrigues_rotate", f"WITH {_VEC}, r AS (SELECT *, radians(raw_deg) AS t FROM (SELECT *, (event_id % 90)::DOUBLE AS raw_deg FROM un)) SELECT event_id, round(x * cos(t) - y * sin(t), 6) AS rx, round(x * sin(t) + y * cos(t), 6) AS ry, round(z, 6) AS rz FROM r")
def rodrigues_rotate(spark, sf):
    out = vectors.rotate(vectors.triple("x", "y", "z"), vectors.triple(0.0, 0.0, 1.0), (F.col("event_id") % 90).cast("double"))
    return _units(spark, sf).select("event_id", *[r6(c, n) for c, n in zip(out, ("rx", "ry", "rz"), strict=True)])


@query("angle_to_previous", f"WITH {_VEC} SELECT event_id, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w)))), 4) AS angle FROM un WINDOW w AS (PARTITION BY node ORDER BY us, event_id)")
def angle_to_previous(spark, sf):
    w = S.ordered(NODE, ORDER)
    return _units(spark, sf).select("event_id", F.round(vectors.angle_deg(vectors.triple("x", "y", "z"), tuple(F.lag(c).over(w) for c in "xyz")), 4).alias("angle"))


@query("reference_vector", f"WITH {_VEC}, t AS (SELECT event_id, tan(radians(x * 10)) AS a, tan(radians(y * 10)) AS b FROM un) SELECT event_id, round(-b / sqrt(a * a + b * b + 1), 6) + 0.0::DOUBLE AS rx, round(a / sqrt(a * a + b * b + 1), 6) + 0.0::DOUBLE AS ry, round(1 / sqrt(a * a + b * b + 1), 6) AS rz FROM t")
def reference_vector(spark, sf):
    out = vectors.lean(vectors.triple(0.0, 0.0, 1.0), F.col("x") * 10, F.col("y") * 10)
    return _units(spark, sf).select("event_id", *[r6(c, n) for c, n in zip(out, ("rx", "ry", "rz"), strict=True)])


# Shift, persistence, runs ---------------------------------------------------------------------------------------------

@query("session_shift_latched", f"""WITH {STAB}, q AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY session) AS k FROM st WHERE n >= 3), ref AS (SELECT node, median(u) AS ru, median(v) AS rv FROM q WHERE k <= 5 GROUP BY 1),
s AS (SELECT q.*, sqrt((u - ru) * (u - ru) + (v - rv) * (v - rv)) AS shift FROM q JOIN ref USING (node))
SELECT node, session, start_us, n, round(shift, 6) AS shift, max(CASE WHEN k > 5 AND shift > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY session ROWS UNBOUNDED PRECEDING) = 1 AS alert FROM s""")
def session_shift_latched(spark, sf):
    rows = X.first_shift(stab(spark, sf).where("n >= 3"), NODE, ["session"], ["u", "v"], 40.0)
    return rows.select("node", "session", "start_us", "n", r6("shift"), "alert")


@query("persistence_filter", f"WITH {EV} SELECT event_id, min(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 1 AS held FROM ev")
def persistence_filter(spark, sf):
    return ev(spark, sf).select("event_id", S.persistent(F.col("value") > 40, NODE, ORDER, 2).alias("held"))


@query("run_length_hits", f"""WITH {EV}, i AS (SELECT *, sum(CASE WHEN value > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM ev)
SELECT event_id, CAST(sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY node, isl ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM i""")
def run_length_hits(spark, sf):
    return S.run_length(ev(spark, sf).withColumn("hit", F.col("value") > 40), "hit", NODE, ORDER).select("event_id", "run")


@query("running_fill", f"""WITH {EV}, g AS (SELECT *, CASE WHEN raw % 3 = 0 THEN value END AS g FROM ev)
SELECT event_id, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY node ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), first_value(g IGNORE NULLS) OVER (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM g""")
def running_fill(spark, sf):
    rows = ev(spark, sf).withColumn("g", F.when(F.col("raw") % 3 == 0, F.col("value")))
    return rows.select("event_id", S.filled("g", NODE, ORDER).alias("filled"))


@query("detection_delay", f"""WITH {EV}, o AS (SELECT *, min(us) OVER (PARTITION BY node) + 864000000000 AS onset FROM ev)
SELECT node, min(onset) AS onset_us, round((min(CASE WHEN us >= onset AND value > 200 THEN us END) - min(onset)) / 3600000000.0::DOUBLE, 6) AS delay_h FROM o GROUP BY 1""")
def detection_delay(spark, sf):
    rows = ev(spark, sf).withColumn("onset", F.min("us").over(W.partitionBy("node")) + 240 * HOUR)
    hit = F.min(F.when((F.col("us") >= F.col("onset")) & (F.col("value") > 200), F.col("us")))
    return rows.groupBy("node").agg(F.min("onset").alias("onset_us"), F.round((hit - F.min("onset")) / float(HOUR), 6).alias("delay_h"))


@query("latest_epoch", f"WITH {STAB} SELECT node, session, start_us FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY session DESC) AS rn FROM st WHERE n >= 3) WHERE rn = 1")
def latest_epoch(spark, sf):
    rows = stab(spark, sf).where("n >= 3").withColumn("rn", F.row_number().over(W.partitionBy("node").orderBy(F.desc("session"))))
    return rows.where("rn = 1").select("node", "session", "start_us")


# Outliers and faults ----------------------------------------------------------------------------------------------------

@query("hampel", f"""WITH {EV}, m AS (SELECT *, CASE WHEN count(*) OVER f = 7 THEN quantile_cont(value, 0.5) OVER f END AS med FROM ev WINDOW f AS (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
d AS (SELECT *, abs(value - med) AS diff FROM m), q AS (SELECT *, CASE WHEN count(diff) OVER f = 7 THEN quantile_cont(diff, 0.5) OVER f END AS mad FROM d WINDOW f AS (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT event_id, coalesce(diff > 3.0::DOUBLE * 1.4826::DOUBLE * mad, false) AS outlier, round(CASE WHEN coalesce(diff > 3.0::DOUBLE * 1.4826::DOUBLE * mad, false) THEN med ELSE value END, 6) AS cleaned FROM q""")
def hampel(spark, sf):
    return S.hampel(ev(spark, sf), NODE, ORDER, "value").select("event_id", "outlier", r6("cleaned"))


_PAST = "OVER (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


@query("fast_lane_z", f"""WITH {EV}, p AS (SELECT *, list(value) {_PAST} AS past FROM ev), m AS (SELECT *, list_median(past) AS med FROM p)
SELECT event_id, CASE WHEN len(past) = 12 THEN round(abs(value - med) / greatest(0.02::DOUBLE, 1.4826::DOUBLE * list_median(list_transform(past, lambda x: abs(x - med)))), 4) END AS z FROM m""")
def fast_lane_z(spark, sf):
    return S.trailing_z(ev(spark, sf), NODE, ORDER, "value").select("event_id", F.round("z", 4).alias("z"))


@query("glitch_flags", f"""WITH {EV}, p AS (SELECT *, list(raw::DOUBLE) {_PAST} AS ps, list(value) {_PAST} AS pv FROM ev), m AS (SELECT *, list_median(ps) AS sm, list_median(pv) AS vm FROM p),
s AS (SELECT *, greatest(1.0::DOUBLE, 1.4826::DOUBLE * list_median(list_transform(ps, lambda x: abs(x - sm)))) AS scale FROM m)
SELECT event_id, coalesce(len(ps) = 12 AND (raw - sm) / scale > 1.2::DOUBLE AND abs(value - vm) < greatest(0.2::DOUBLE, 0.01::DOUBLE * scale), false) AS glitch FROM s""")
def glitch_flags(spark, sf):
    rows = ev(spark, sf).withColumn("raw", F.col("raw").cast("double"))
    return S.glitches(rows, NODE, ORDER, "value", "raw", limit=1.2).select("event_id", "glitch")


_FAULT = f"""{EV}, f AS (SELECT *, coalesce(count(q) OVER w = 4 AND stddev_samp(q) OVER w < 0.000001, false) AS flatline, coalesce(raw <= 0.99 OR raw >= 98.01, false) AS saturated,
  coalesce(us - lag(us) OVER (PARTITION BY node ORDER BY us, event_id) > 3600000000, false) AS packet_loss FROM (SELECT *, floor(raw / 50) AS q FROM ev) WINDOW w AS (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def _faults(spark, sf):
    rows = ev(spark, sf).withColumn("q", F.floor(F.col("raw") / 50).cast("double"))
    flat = S.fault_flags(rows, NODE, ORDER, "q", -1e9, 1e9, 1800, width=4)
    return flat.withColumn("saturated", S.clip_saturated("raw", 0.0, 99.0)).withColumn("any_fault", F.col("flatline") | F.col("saturated") | F.col("packet_loss"))


@query("flatline", f"WITH {_FAULT} SELECT event_id, flatline FROM f")
def flatline(spark, sf):
    return _faults(spark, sf).select("event_id", "flatline")


@query("saturation", f"WITH {_FAULT} SELECT event_id, saturated FROM f")
def saturation(spark, sf):
    return _faults(spark, sf).select("event_id", "saturated")


@query("packet_loss", f"WITH {_FAULT} SELECT event_id, packet_loss FROM f")
def packet_loss(spark, sf):
    return _faults(spark, sf).select("event_id", "packet_loss")


@query("fault_flags", f"WITH {_FAULT} SELECT node, count(*) FILTER (flatline) AS flat, count(*) FILTER (saturated) AS saturated, count(*) FILTER (packet_loss) AS lost, count(*) FILTER (flatline OR saturated OR packet_loss) AS any_fault FROM f GROUP BY 1")
def fault_flags(spark, sf):
    return _faults(spark, sf).groupBy("node").agg(F.count_if("flatline").alias("flat"), F.count_if("saturated").alias("saturated"), F.count_if("packet_loss").alias("lost"), F.count_if("any_fault").alias("any_fault"))


@query("axis_coherence", f"""WITH {EV}, c AS (SELECT *, value + raw AS w FROM ev)
SELECT event_id, CASE WHEN count(*) OVER f = 50 THEN round((abs(corr(value, raw) OVER f) + abs(corr(value, w) OVER f) + abs(corr(raw, w) OVER f)) / 3, 5) END AS coherence FROM c WINDOW f AS (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def axis_coherence(spark, sf):
    rows = ev(spark, sf).withColumn("w", F.col("value") + F.col("raw"))
    return S.coherence(rows, NODE, ORDER, ["value", "raw", "w"]).select("event_id", F.round("coherence", 5).alias("coherence"))


@query("sensor_gate", f"""WITH {WIN}, a AS (SELECT node, session, win, avg(value) AS norm, stddev_pop(value) AS sd FROM win GROUP BY 1, 2, 3 HAVING count(*) >= 2), m AS (SELECT *, median(sd) OVER (PARTITION BY node) AS msd, median(norm) OVER (PARTITION BY node) AS mn FROM a)
SELECT node, session, win, sd < greatest(0.000001::DOUBLE, 0.02::DOUBLE * msd) AS stuck, abs(norm - mn) / mn > 0.10 AS off_norm FROM m""")
def sensor_gate(spark, sf):
    a = win(spark, sf).groupBy("node", "session", "win").agg(F.avg("value").alias("norm"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return X.sensor_gate(a, NODE, "sd", "norm").select("node", "session", "win", "stuck", "off_norm")


@query("load_event", f"""WITH {EV}, d AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY node ORDER BY us, event_id)) * 0.5::DOUBLE, 0) AS rate FROM ev)
SELECT event_id, abs(value - 50) > 100 AS over_limit, rate > 60 AS over_rate, abs(value - 50) > 100 OR rate > 60 AS load_event FROM d""")
def load_event(spark, sf):
    return X.load_event(ev(spark, sf), NODE, ORDER, "value", 50.0, 100.0, 60.0, 0.5).select("event_id", "over_limit", "over_rate", "load_event")


@query("cusum", f"""WITH {EV}, m AS (SELECT *, (value - avg(value) OVER (PARTITION BY node)) / stddev_samp(value) OVER (PARTITION BY node) AS z, row_number() OVER (PARTITION BY node ORDER BY us, event_id) AS i FROM ev),
s AS (SELECT *, sum(CASE WHEN i > 1 THEN z - 0.5::DOUBLE ELSE 0 END) OVER w AS up, sum(CASE WHEN i > 1 THEN z + 0.5::DOUBLE ELSE 0 END) OVER w AS down FROM m WINDOW w AS (PARTITION BY node ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, up - least(0.0::DOUBLE, min(up) OVER w) AS pos, down - greatest(0.0::DOUBLE, max(down) OVER w) AS neg FROM s WINDOW w AS (PARTITION BY node ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, round(pos, 5) AS pos, round(neg, 5) AS neg, pos > 5 OR neg < -5 AS alarm FROM r""")
def cusum(spark, sf):
    w = W.partitionBy("node")
    z = (F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)
    rows = S.cusum(ev(spark, sf).withColumn("z", z), NODE, ORDER, F.col("z"))
    return rows.select("event_id", F.round("pos", 5).alias("pos"), F.round("neg", 5).alias("neg"), "alarm")


# Joins in time ----------------------------------------------------------------------------------------------------------

_ASOF = f"""{EV}, l AS (SELECT * FROM ev WHERE node IN ('click', 'view')), rr AS (SELECT node AS rn, us AS rus, value AS rv, event_id AS rid, user_id AS ru FROM ev WHERE node = 'error'),
b AS (SELECT l.*, rus AS bus, rv AS bv FROM l ASOF LEFT JOIN (SELECT rus, max(rv) AS rv FROM rr GROUP BY 1) ON l.us >= rus),
a AS (SELECT b.*, rus AS aus, rv AS av FROM b ASOF LEFT JOIN (SELECT rus, max(rv) AS rv FROM rr GROUP BY 1) ON b.us <= rus),
j AS (SELECT *, CASE WHEN bus IS NULL OR aus - us < us - bus THEN aus ELSE bus END AS hit, CASE WHEN bus IS NULL OR aus - us < us - bus THEN av ELSE bv END AS hv FROM a),
k AS (SELECT *, CASE WHEN abs(hit - us) <= 600000000 THEN hit END AS right_us, CASE WHEN abs(hit - us) <= 600000000 THEN hv END AS other FROM j)"""


def _near(spark, sf):
    e = ev(spark, sf).withColumn("all", F.lit(1))
    left = e.where("node in ('click', 'view')").select("all", "us", F.col("event_id").alias("id"), "value")
    right = e.where("node = 'error'").select("all", "us", F.col("value").alias("other"))
    return S.nearest(left, right, ["all"], 600 * S.SECOND, ["other"])


@query("asof_nearest", f"WITH {_ASOF} SELECT event_id, us, right_us, other FROM k")
def asof_nearest(spark, sf):
    return _near(spark, sf).select(F.col("id").alias("event_id"), "us", "right_us", "other")


@query("asof_fusion_status", f"""WITH {_ASOF} SELECT status, count(*) AS n FROM (SELECT CASE WHEN value > 60 AND other > 60 THEN 'EXPLAINED_BY_LOAD' WHEN value > 60 THEN 'UNEXPLAINED_TILT' WHEN other > 60 THEN 'LOAD_ONLY' ELSE 'OK' END AS status FROM k) WHERE status <> 'OK' GROUP BY 1""")
def asof_fusion_status(spark, sf):
    tilt, load = F.col("value") > 60, F.coalesce(F.col("other") > 60, F.lit(False))
    rows = _near(spark, sf).withColumn("status", X.status([("EXPLAINED_BY_LOAD", tilt & load), ("UNEXPLAINED_TILT", tilt), ("LOAD_ONLY", load)]))
    return rows.where("status <> 'OK'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("resample_grid", f"""WITH {EV}, sp AS (SELECT node, min(us) AS a, max(us) AS z FROM ev GROUP BY 1), g AS (SELECT node, unnest(generate_series(a, z, 21600000000)) AS us FROM sp),
q AS (SELECT node, us, max(value) AS value FROM ev GROUP BY 1, 2), b AS (SELECT g.*, q.us AS bus, q.value AS bv FROM g ASOF LEFT JOIN q ON g.node = q.node AND g.us >= q.us), a AS (SELECT b.*, q.us AS aus, q.value AS av FROM b ASOF LEFT JOIN q ON b.node = q.node AND b.us <= q.us),
j AS (SELECT *, CASE WHEN bus IS NULL OR aus - us < us - bus THEN aus ELSE bus END AS hit, CASE WHEN bus IS NULL OR aus - us < us - bus THEN av ELSE bv END AS hv FROM a)
SELECT node, us, CASE WHEN abs(hit - us) <= 10800000000 THEN hv END AS value, abs(hit - us) > 10800000000 AS gap FROM j""")
def resample_grid(spark, sf):
    return S.resampled(ev(spark, sf), NODE, ["value"], 21600).select("node", "us", "value", "gap")


@query("interp_align", f"""WITH {EV}, l AS (SELECT * FROM ev WHERE node = 'click'), r AS (SELECT us AS rus, max(value) AS rv FROM ev WHERE node = 'view' GROUP BY 1),
b AS (SELECT l.event_id, l.us, rus AS bus, rv AS bv FROM l ASOF LEFT JOIN r ON l.us >= rus), a AS (SELECT b.*, rus AS aus, rv AS av FROM b ASOF LEFT JOIN r ON b.us <= rus)
SELECT event_id, us, round(CASE WHEN aus = bus THEN bv WHEN aus - bus <= 10800000000 THEN bv + (av - bv) * (us - bus)::DOUBLE / (aus - bus) END, 6) AS value FROM a""")
def interp_align(spark, sf):
    e = ev(spark, sf).withColumn("all", F.lit(1))
    left = e.where("node = 'click'").select("all", "us", F.col("event_id").alias("id"))
    right = e.where("node = 'view'").groupBy("all", "us").agg(F.max("value").alias("value"))
    return S.interpolated(left, right, ["all"], "value", 3 * HOUR).select(F.col("id").alias("event_id"), "us", r6("value"))


# Statistics and regressions -------------------------------------------------------------------------------------------------

@query("theil_sen_slope", f"""WITH {STAB}, f AS (SELECT node, start_us / 3600000000.0::DOUBLE AS x, u FROM st)
SELECT a.node, round(median((b.u - a.u) / (b.x - a.x)), 6) AS slope FROM f a JOIN f b ON a.node = b.node AND b.x > a.x GROUP BY 1""")
def theil_sen_slope(spark, sf):
    """All pairs of a node's sessions, in blocks: time grows with the square of their number, memory does not."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_us")
        slope = models.sen_interval(pdf["start_us"].to_numpy(float) / float(HOUR), pdf["u"].to_numpy(float))[0]
        return pd.DataFrame([{"node": pdf["node"].iloc[0], "slope": slope}]).dropna()

    return stab(spark, sf).select("node", "start_us", "u").groupBy("node").applyInPandas(run, "node string, slope double").select("node", r6("slope"))


@query("trend_interval", f"""WITH {STAB}, f AS (SELECT node, start_us / 86400000000.0::DOUBLE AS x, u FROM st), c AS (SELECT node, count(*)::DOUBLE AS n FROM f GROUP BY 1),
s AS (SELECT a.node, list_sort(list((b.u - a.u) / (b.x - a.x))) AS l FROM f a JOIN f b ON a.node = b.node AND b.x > a.x GROUP BY 1),
r AS (SELECT node, l, len(l) AS m, 1.959963984540054::DOUBLE * sqrt(n * (n - 1) * (2 * n + 5) / 18) AS spread FROM s JOIN c USING (node)),
q AS (SELECT node, (l[(m - 1) // 2 + 1] + l[m // 2 + 1]) / 2 AS slope, l[greatest(0, CAST(round((m - spread) / 2) AS BIGINT)) + 1] AS low, l[least(m - 1, CAST(round((m + spread) / 2) AS BIGINT) - 1) + 1] AS high FROM r)
SELECT node, round(slope, 6) AS slope_day, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS excludes_zero FROM q""")
def trend_interval(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_us")
        slope, low, high = models.sen_interval(pdf["start_us"].to_numpy(float) / 8.64e10, pdf["u"].to_numpy(float))
        return pd.DataFrame([{"node": pdf["node"].iloc[0], "slope_day": slope, "low": low, "high": high, "excludes_zero": bool(low > 0 or high < 0)}]).dropna()

    rows = stab(spark, sf).select("node", "start_us", "u").groupBy("node").applyInPandas(run, "node string, slope_day double, low double, high double, excludes_zero boolean")
    return rows.select("node", r6("slope_day"), r6("low"), r6("high"), "excludes_zero")


@query("mad_sigma", f"WITH {EV}, m AS (SELECT node, value, median(value) OVER (PARTITION BY node) AS med FROM ev) SELECT node, round(1.4826::DOUBLE * median(abs(value - med)) + 0.000001::DOUBLE, 6) AS sigma FROM m GROUP BY 1")
def mad_sigma(spark, sf):
    rows = ev(spark, sf).withColumn("d", F.abs(F.col("value") - robust.median("value").over(W.partitionBy("node"))))
    return rows.groupBy("node").agg(r6(robust.MAD * robust.median("d") + 1e-6, "sigma"))


@query("noise_sigma", f"""WITH {STAB}, q AS (SELECT *, u - lag(u) OVER (PARTITION BY node ORDER BY session) AS du FROM st WHERE n >= 2), m AS (SELECT *, median(du) OVER (PARTITION BY node) AS mu FROM q)
SELECT node, round(greatest(0.02::DOUBLE, 1.4826::DOUBLE * median(abs(du - mu)) / sqrt(2.0::DOUBLE)), 6) AS sigma, count(*) AS n FROM m GROUP BY 1""")
def noise_sigma(spark, sf):
    return X.session_sigma(stab(spark, sf).where("n >= 2"), NODE, ["session"], ["u"]).select("node", r6("sigma"), "n")


@query("quantile_threshold", f"WITH {EV} SELECT node, round(quantile_cont(value, 0.995), 6) AS threshold FROM ev GROUP BY 1")
def quantile_threshold(spark, sf):
    return ev(spark, sf).groupBy("node").agg(r6(F.percentile("value", 0.995), "threshold"))


_IST = "date_trunc('day', make_timestamp(us) + INTERVAL 330 MINUTE)"


@query("trend_daily", f"""WITH {EV}, d AS (SELECT node, epoch_us({_IST}) / 86400000000 AS day, median(value) AS m FROM ev GROUP BY 1, 2)
SELECT a.node, (SELECT count(*) FROM d c WHERE c.node = a.node) AS days, round(median((b.m - a.m) / (b.day - a.day)), 6) AS slope_day FROM d a JOIN d b ON a.node = b.node AND b.day > a.day GROUP BY 1""")
def trend_daily(spark, sf):
    day = F.datediff(F.to_date(F.from_utc_timestamp(F.timestamp_micros("us"), "Asia/Kolkata")), F.lit("1970-01-01")).cast("double")
    rows = ev(spark, sf).withColumn("day", day).groupBy("node", "day").agg(robust.median("value").alias("m"))
    rows = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("day", "m"))).alias("p"))
    return rows.select("node", F.size("p").cast("bigint").alias("days"), r6(robust.theil_sen(F.col("p.day"), F.col("p.m")), "slope_day"))


_MOMENTS = """count(value) AS n, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, avg(value) AS m1, avg(value * value) AS m2, avg(value * value * value) AS m3, kurtosis_pop(value) AS ku"""


@query("time_domain_features", f"""WITH {EV}, g AS (SELECT node, {_MOMENTS} FROM ev GROUP BY 1)
SELECT node, n, round(rms, 6) AS rms, round(peak, 6) AS peak, round(peak / rms, 6) AS crest, round(ku, 5) AS kurtosis, round((m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5), 5) AS skewness FROM g""")
def time_domain_features(spark, sf):
    rows = X.time_domain(ev(spark, sf), NODE, "value")
    return rows.select("node", "n", r6("rms"), r6("peak"), r6("crest"), F.round("kurtosis", 5).alias("kurtosis"), F.round("skewness", 5).alias("skewness"))


@query("sliding_windows", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY node) AS c FROM ev),
w AS (SELECT r.*, k FROM r JOIN (SELECT unnest(range(0, 200000)) AS k) ON i >= k * 50 AND i < k * 50 + 100 AND (k = 0 OR k * 50 + 100 <= c))
SELECT node, CAST(k AS BIGINT) AS window_no, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS peak FROM w GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    rows = S.sliding(ev(spark, sf), NODE, ORDER, 100, 50)
    return rows.groupBy("node", "window_no").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"), r6(F.max("value"), "peak"))


@query("ols_confound_residual", f"""WITH {EV}, f AS (SELECT node, regr_slope(value, raw) AS s, regr_intercept(value, raw) AS i FROM ev WHERE user_id % 2 = 0 GROUP BY 1) SELECT event_id, round(value - s * raw - i, 6) AS residual FROM ev JOIN f USING (node)""")
def ols_confound_residual(spark, sf):
    rows = ev(spark, sf).withColumn("raw", F.col("raw").cast("double"))
    return X.confound_residual(rows, NODE, "value", "raw", F.col("user_id") % 2 == 0).select("event_id", r6("residual"))


@query("cointegration_residual", f"""WITH {EV}, f AS (SELECT node, regr_slope(raw::DOUBLE, value) AS beta, regr_intercept(raw::DOUBLE, value) AS alpha FROM ev GROUP BY 1) SELECT event_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(raw - beta * value - alpha, 6) AS residual FROM ev JOIN f USING (node)""")
def cointegration_residual(spark, sf):
    rows = X.confound_residual(ev(spark, sf).withColumn("raw", F.col("raw").cast("double")), NODE, "raw", "value", F.lit(True))
    return rows.select("event_id", r6("intercept", "alpha"), r6("slope", "beta"), r6("residual"))


@query("harmonic_residual", f"""WITH {EV}, h AS (SELECT *, ((us / 1000000 + 19800) % 86400) / 3600.0::DOUBLE AS hour FROM (SELECT * REPLACE (us // 1 AS us) FROM ev)),
a AS (SELECT *, sin(hour * 2 * pi() / 24) AS s, cos(hour * 2 * pi() / 24) AS c FROM h),
f AS (SELECT node, count(*)::DOUBLE AS n, sum(s) AS s1, sum(c) AS c1, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(value) AS y, sum(value * s) AS ys, sum(value * c) AS yc FROM a GROUP BY 1),
g AS (SELECT node, n * (ss * cc - sc * sc) - s1 * (s1 * cc - sc * c1) + c1 * (s1 * sc - ss * c1) AS det, n * (ys * cc - sc * yc) - y * (s1 * cc - sc * c1) + c1 * (s1 * yc - ys * c1) AS ds,
  n * (ss * yc - ys * sc) - s1 * (s1 * yc - ys * c1) + y * (s1 * sc - ss * c1) AS dc FROM f)
SELECT event_id, round(value - ds / det * s - dc / det * c, 5) AS residual FROM a JOIN g USING (node)""")
def harmonic_residual(spark, sf):
    local = F.pmod(F.col("us") / float(S.SECOND) + 19800, F.lit(86400.0)) / 3600.0
    rows = X.harmonic_residual(ev(spark, sf), NODE, "value", local)
    return rows.select("event_id", F.round("residual", 5).alias("residual"))


def _temperature(spark: SparkSession) -> DataFrame:
    """720 hourly values of a daily and a slower wave, with one hole."""
    h = F.col("id").cast("double")
    wave = 25 + 8 * F.sin(h * 2 * 3.141592653589793 / 24) + 3 * F.cos(h / 100)
    return spark.range(720).where("id < 300 or id > 309").select(h.alias("hours"), wave.alias("value"))


@query("thermal_lag", """WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY i) AS k, i::DOUBLE AS x, 25 + 8 * sin(i * 2 * 3.141592653589793::DOUBLE / 24) + 3 * cos(i::DOUBLE / 100) AS y FROM range(720) r(i) WHERE i < 300 OR i > 309),
l AS (SELECT k, x, y, y AS ts FROM t WHERE k = 1 UNION ALL SELECT t.k, t.x, t.y, CASE WHEN t.x - l.x > 0 AND t.x - l.x <= 3 THEN t.y - (t.y - l.y) / (t.x - l.x) * 4 + (l.ts - (l.y - (t.y - l.y) / (t.x - l.x) * 4)) * exp(-(t.x - l.x) / 4) ELSE t.y END FROM l JOIN t ON t.k = l.k + 1)
SELECT x AS hours, round(y, 6) AS air, round(ts, 6) AS structure FROM l""")
def thermal_lag(spark, sf):
    rows = _temperature(spark).agg(F.sort_array(F.collect_list(F.struct("hours", "value"))).alias("p"))
    rows = rows.select(F.inline(F.arrays_zip(F.col("p"), thermal.lag_column(F.col("p"), 4.0).alias("structure"))))
    return rows.select(F.col("p.hours").alias("hours"), r6(F.col("p.value"), "air"), r6("structure"))


@query("calibrations", f"WITH {EV} SELECT event_id, round((value - 1.5) * 0.98, 6) AS acc, round(raw - 0.25::DOUBLE, 6) AS gyro, round((raw - 10) * 0.01 - 0.002 * (value - 25), 6) AS kg FROM ev")
def calibrations(spark, sf):
    e = ev(spark, sf)
    return e.select("event_id", r6(X.calibrated(F.col("value"), 1.5, 0.98), "acc"), r6(X.calibrated(F.col("raw"), 0.25, 1.0), "gyro"), r6(X.load_calibrated(F.col("raw"), 10, 0.01, 0.002, F.col("value")), "kg"))


@query("mahalanobis_score", f"WITH {EV} SELECT event_id, round(sqrt(0.01 * (value - 50) * (value - 50) + 2 * 0.002 * (value - 50) * (raw - 50) + 0.005 * (raw - 50) * (raw - 50)), 6) AS distance FROM ev")
def mahalanobis_score(spark, sf):
    return ev(spark, sf).select("event_id", r6(X.mahalanobis([F.col("value"), F.col("raw")], [50.0, 50.0], [[0.01, 0.002], [0.002, 0.005]]), "distance"))


@query("diagnose_split", f"""WITH {STAB}, k AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY session) - 1)::DOUBLE / count(*) OVER (PARTITION BY node) AS q FROM st),
p AS (SELECT *, CASE WHEN q < 0.70 THEN 'train' WHEN q < 0.85 THEN 'val' ELSE 'test' END AS split FROM k), m AS (SELECT *, median(u) OVER (PARTITION BY node, split) AS mu FROM p)
SELECT node, split, count(*) AS sessions, round(median(u), 6) AS median_u, round(1.4826::DOUBLE * median(abs(u - mu)) + 0.000001::DOUBLE, 6) AS sigma_u, round(quantile_cont(abs(u), 0.95), 6) AS p95_u, round(3 * (1.4826::DOUBLE * median(abs(u - mu)) + 0.000001::DOUBLE), 6) AS min_step FROM m GROUP BY 1, 2""")
def diagnose_split(spark, sf):
    rows = X.diagnosed(stab(spark, sf), NODE, ["session"], "u")
    return rows.select("node", "split", "sessions", r6("median", "median_u"), r6("sigma", "sigma_u"), r6("p95", "p95_u"), r6("min_step"))


# Status, sets, documents ---------------------------------------------------------------------------------------------------

@query("status_precedence", f"WITH {EV} SELECT status, count(*) AS n FROM (SELECT CASE WHEN raw < 3 THEN 'SENSOR' WHEN value > 200 THEN 'ALARM' WHEN value > 150 THEN 'DRIFT' WHEN raw > 90 THEN 'WARNING' ELSE 'OK' END AS status FROM ev) GROUP BY 1")
def status_precedence(spark, sf):
    s = X.status([("SENSOR", F.col("raw") < 3), ("ALARM", F.col("value") > 200), ("DRIFT", F.col("value") > 150), ("WARNING", F.col("raw") > 90)])
    return ev(spark, sf).groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("layered_decision", f"""WITH {EV} SELECT event_id, CASE WHEN raw < 3 THEN '' ELSE concat_ws('|', CASE WHEN value > 150 THEN 'step' END, CASE WHEN raw > 90 THEN 'load' END, CASE WHEN value > 100 AND raw > 50 THEN 'texture' END) END AS triggers FROM ev""")
def layered_decision(spark, sf):
    t = X.layered(F.col("raw") < 3, {"step": F.col("value") > 150, "load": F.col("raw") > 90, "texture": (F.col("value") > 100) & (F.col("raw") > 50)})
    return ev(spark, sf).select("event_id", F.array_join(t, "|").alias("triggers"))


@query("semi_anti_coverage", f"""WITH {STAB}, q AS (SELECT node, session FROM st WHERE n >= 3) SELECT node, count(*) FILTER (q.session IS NOT NULL) AS kept, count(*) FILTER (q.session IS NULL) AS dropped FROM ses LEFT JOIN q USING (node, session) GROUP BY 1""")
def semi_anti_coverage(spark, sf):
    good = stab(spark, sf).where("n >= 3").select("node", "session")
    rows = ses(spark, sf)
    kept = rows.join(good, ["node", "session"], "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("kept"))
    lost = rows.join(good, ["node", "session"], "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("dropped"))
    return kept.join(lost, "node", "full").select("node", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


@query("set_ops_devices", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 100)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'distinct', count(*) FROM a""")
def set_ops_devices(spark, sf):
    e = ev(spark, sf)
    a, b = e.where("node = 'click'").select("user_id").distinct(), e.where("node = 'error' and value > 100").select("user_id").distinct()
    count = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").union(count(a.subtract(b), "except")).union(count(a, "distinct"))


@query("segment_state_counts", f"WITH {STAB} SELECT node, count(*) AS sessions, count(*) FILTER (u > 60) AS events, count(*) FILTER (u > 50 AND u <= 60) AS drift_sessions, round((max(start_us) - min(start_us)) / 86400000000.0::DOUBLE, 6) AS days FROM st GROUP BY 1")
def segment_state_counts(spark, sf):
    return stab(spark, sf).groupBy("node").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("u") > 60).alias("events"), F.count_if((F.col("u") > 50) & (F.col("u") <= 60)).alias("drift_sessions"), F.round((F.max("start_us") - F.min("start_us")) / float(24 * HOUR), 6).alias("days"))


@query("eval_pool", f"""WITH {EV} SELECT raw % 10 AS fault, count(*) AS n, round(avg(CASE WHEN value > 60 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS detect_rate, round(median(CASE WHEN value > 60 THEN value END), 6) AS median_delay, count(DISTINCT node) AS epochs FROM ev GROUP BY 1""")
def eval_pool(spark, sf):
    hit = F.col("value") > 60
    return ev(spark, sf).groupBy((F.col("raw") % 10).alias("fault")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(hit.cast("double")), "detect_rate"), r6(robust.median(F.when(hit, F.col("value"))), "median_delay"), F.countDistinct("node").alias("epochs"))


@query("biggest_segment", f"WITH {STAB} SELECT node, max(n) AS n, arg_max(session, n * 1000000 - session) AS session FROM st GROUP BY 1")
def biggest_segment(spark, sf):
    return X.biggest(stab(spark, sf), NODE, "session")


def _inject_sql(expr: str) -> str:
    return f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY node) AS c FROM ev),
o AS (SELECT *, i >= floor(c * 0.6::DOUBLE) AS inj FROM r), s AS (SELECT *, min(CASE WHEN inj THEN us END) OVER (PARTITION BY node) AS a, max(us) OVER (PARTITION BY node) AS z,
first_value(CASE WHEN inj THEN value END IGNORE NULLS) OVER (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS frozen FROM o)
SELECT event_id, inj AS injected, round(CASE WHEN inj THEN {expr} ELSE value END, 6) AS value FROM s"""


def _injected(kind: str, size: float):
    return lambda spark, sf: X.inject(ev(spark, sf), NODE, ORDER, "value", kind, size, 0.6).select("event_id", "injected", r6("value"))


for _kind, _size, _sql in (("step", 5.0, "value + 5"), ("ramp", 5.0, "value + 5 * least(1.0::DOUBLE, (us - a)::DOUBLE / (z - a))"), ("stuck", 0.0, "frozen"), ("noise", 3.0, "value * 3")):
    query(f"inject_{_kind}", _inject_sql(_sql))(_injected(_kind, _size))


@query("dashboard_nested_json")
def dashboard_nested_json(spark, sf):
    rows = stab(spark, sf)
    segments = rows.groupBy("node").agg(F.count(F.lit(1)).alias("sessions"))
    events = rows.where("u > 60 and n >= 3").select("node", "start_us", "u")
    return sinks.dashboard(segments, rows.select("node", "start_us", "u", "n"), events, "node")


# Smaller operators ---------------------------------------------------------------------------------------------------------

@query("harmonic_time_features", f"WITH {EV}, h AS (SELECT event_id, us / 3600000000.0::DOUBLE AS t FROM ev) SELECT event_id, round(sin(2 * pi() * t / 24), 5) AS sin_day, round(cos(2 * pi() * t / 24), 5) AS cos_day, round(sin(2 * pi() * t / 8766), 6) AS sin_year, round(cos(2 * pi() * t / 8766), 6) AS cos_year FROM h")
def harmonic_time_features(spark, sf):
    t = F.col("us") / float(HOUR)
    wave = lambda f, p: f(t * (2 * 3.141592653589793) / p)
    return ev(spark, sf).select("event_id", F.round(wave(F.sin, 24), 5).alias("sin_day"), F.round(wave(F.cos, 24), 5).alias("cos_day"), r6(wave(F.sin, 8766), "sin_year"), r6(wave(F.cos, 8766), "cos_year"))


@query("hours_and_log", f"WITH {EV} SELECT event_id, round(us / 3600000000.0::DOUBLE, 6) AS t_h, round(ln(value + 0.0001::DOUBLE), 6) AS log_value FROM ev")
def hours_and_log(spark, sf):
    return ev(spark, sf).select("event_id", r6(F.col("us") / float(HOUR), "t_h"), r6(F.log(F.col("value") + 1e-4), "log_value"))


@query("min_data_guard", f"WITH {EV}, g AS (SELECT user_id FROM ev GROUP BY 1 HAVING count(*) >= 30) SELECT user_id, count(*) AS n, round(median(value), 6) AS mid FROM ev WHERE user_id IN (SELECT user_id FROM g) GROUP BY 1")
def min_data_guard(spark, sf):
    e = ev(spark, sf)
    enough = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 30")
    return e.join(enough, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(robust.median("value"), "mid"))


@query("time_and_sensor_filter", f"WITH {EV} SELECT event_id, node, us FROM ev WHERE node IN ('click', 'view') AND us >= epoch_us(TIMESTAMP '2024-01-10') AND us < epoch_us(TIMESTAMP '2024-01-12')")
def time_and_sensor_filter(spark, sf):
    rows = table(spark, sf, "events").where("event_type in ('click', 'view') and ts >= timestamp_ntz '2024-01-10 00:00:00' and ts < timestamp_ntz '2024-01-12 00:00:00'")
    return rows.select("event_id", F.col("event_type").alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("session_state_lookup", f"""WITH {STAB}, m AS (SELECT node, session, CASE WHEN u > 60 THEN 'EVENT' WHEN u > 50 THEN 'DRIFT' END AS state FROM st WHERE n >= 2)
SELECT event_id, coalesce(state, 'NONE') AS state, coalesce(state IN ('EVENT', 'DRIFT'), false) AS flag FROM ses LEFT JOIN m USING (node, session)""")
def session_state_lookup(spark, sf):
    states = stab(spark, sf).where("n >= 2").select("node", "session", F.when(F.col("u") > 60, "EVENT").when(F.col("u") > 50, "DRIFT").alias("state"))
    rows = ses(spark, sf).join(states, ["node", "session"], "left")
    return rows.select("event_id", F.coalesce("state", F.lit("NONE")).alias("state"), F.coalesce(F.col("state").isin("EVENT", "DRIFT"), F.lit(False)).alias("flag"))


@query("feature_score_join", f"""WITH {WIN}, f AS (SELECT node, session, win, avg(value) AS mean FROM win GROUP BY 1, 2, 3), s AS (SELECT node, session, win, max(raw) AS score FROM win WHERE raw > 20 GROUP BY 1, 2, 3)
SELECT node, session, win, round(mean, 6) AS mean, score FROM f LEFT JOIN s USING (node, session, win)""")
def feature_score_join(spark, sf):
    key = ["node", "session", "win"]
    rows = win(spark, sf)
    return rows.groupBy(*key).agg(r6(F.avg("value"), "mean")).join(rows.where("raw > 20").groupBy(*key).agg(F.max("raw").alias("score")), key, "left")


@query("history_union", f"WITH {EV}, h AS (SELECT *, 0 AS batch FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT *, 1 FROM ev WHERE event_id % 2 = 1) SELECT event_id, batch, min(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 1 AS held FROM h")
def history_union(spark, sf):
    e = ev(spark, sf)
    both = e.where("event_id % 2 = 0").withColumn("batch", F.lit(0)).unionByName(e.where("event_id % 2 = 1").withColumn("batch", F.lit(1)))
    return both.select("event_id", "batch", S.persistent(F.col("value") > 30, NODE, ORDER, 2).alias("held"))


@query("node_baseline", f"WITH {EV} SELECT node, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM ev WHERE us < epoch_us(TIMESTAMP '2024-01-08') GROUP BY 1")
def node_baseline(spark, sf):
    return X.means(ev(spark, sf), NODE, "value", F.col("us") < 1704672000 * S.SECOND).select("node", r6("mean"), r6("std"), "n")


@query("vote_status", f"""WITH {EV}, v AS (SELECT event_id, raw, CAST(value > 100 AS INTEGER) + CAST(raw > 60 AS INTEGER) + CAST(value > 60 AND raw > 40 AS INTEGER) AS votes FROM ev)
SELECT event_id, votes, CASE WHEN raw < 2 THEN 'SENSOR' WHEN votes >= 3 THEN 'ALARM' WHEN votes >= 2 THEN 'WARNING' WHEN votes >= 1 THEN 'WATCH' ELSE 'OK' END AS status FROM v""")
def vote_status(spark, sf):
    votes = (F.col("value") > 100).cast("int") + (F.col("raw") > 60).cast("int") + ((F.col("value") > 60) & (F.col("raw") > 40)).cast("int")
    return ev(spark, sf).withColumn("votes", votes).select("event_id", "votes", models.votes_status(F.col("raw") < 2, F.col("votes"), 3).alias("status"))


@query("fuse_decision", f"WITH {EV} SELECT event_id, greatest(value, raw::DOUBLE) AS strongest, round(0.5 * value + 0.5 * raw, 6) AS blended FROM ev")
def fuse_decision(spark, sf):
    load, tilt = F.col("value"), F.col("raw").cast("double")
    return ev(spark, sf).select("event_id", X.fused_score(load, tilt).alias("strongest"), r6(X.fused_score(load, tilt, "weighted"), "blended"))


@query("session_thermal_features", f"""WITH {SES}, t AS (SELECT i::DOUBLE AS x, 25 + 8 * sin(i * 2 * 3.141592653589793::DOUBLE / 24) + 3 * cos(i::DOUBLE / 100) AS y FROM range(720) r(i) WHERE i < 300 OR i > 309),
k AS (SELECT *, us / 3600000000.0::DOUBLE - 473352 AS h FROM ses), b AS (SELECT k.*, t.x AS bx, t.y AS yb FROM k ASOF LEFT JOIN t ON k.h >= t.x), a AS (SELECT b.*, t.x AS ax, t.y AS ya FROM b ASOF LEFT JOIN t ON b.h <= t.x),
v AS (SELECT node, session, CASE WHEN ax = bx THEN yb WHEN ax - bx <= 3 THEN yb + (ya - yb) * (h - bx) / (ax - bx) END AS ta FROM a) SELECT node, session, round(avg(ta), 5) AS air FROM v GROUP BY 1, 2""")
def session_thermal_features(spark, sf):
    temp = _temperature(spark).select(F.lit(1).alias("all"), ((F.col("hours") + 473352) * HOUR).cast("bigint").alias("us"), F.col("value").alias("ta"))
    rows = ses(spark, sf).withColumn("all", F.lit(1)).withColumn("id", F.struct("node", "session", "event_id"))
    out = S.interpolated(rows.select("all", "us", "id"), temp, ["all"], "ta", 3 * HOUR)
    return out.groupBy(F.col("id.node").alias("node"), F.col("id.session").alias("session")).agg(F.round(F.avg("ta"), 5).alias("air"))


@query("compensate_projection", f"WITH {EV} SELECT event_id, round(value - 0.05 * (raw - 50) - 0.01 * (raw - 40), 6) AS free FROM ev")
def compensate_projection(spark, sf):
    return ev(spark, sf).select("event_id", r6(X.compensated(F.col("value"), 0.05, F.col("raw") - 50, 0.01, F.col("raw") - 40), "free"))


@query("local_clock", f"WITH {EV} SELECT event_id, strftime(make_timestamp(us) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS when_local FROM ev")
def local_clock(spark, sf):
    return ev(spark, sf).select("event_id", F.date_format(F.from_utc_timestamp(F.timestamp_micros("us"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm").alias("when_local"))


@query("verdict_counts", f"WITH {EV} SELECT regexp_replace(CASE WHEN raw % 3 = 0 THEN 'NOT_TEMP (no temperature data)' WHEN raw % 3 = 1 THEN 'NOT_TEMP' ELSE 'PARTLY_TEMP' END, ' \\(.*\\)$', '') AS verdict, count(*) AS n FROM ev GROUP BY 1")
def verdict_counts(spark, sf):
    v = F.when(F.col("raw") % 3 == 0, "NOT_TEMP (no temperature data)").when(F.col("raw") % 3 == 1, "NOT_TEMP").otherwise("PARTLY_TEMP")
    return ev(spark, sf).groupBy(X.plain_verdict(v).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("window_sequences", f"""WITH {WIN}, g AS (SELECT node, session, win, list(value ORDER BY us, event_id) AS v FROM win GROUP BY 1, 2, 3 HAVING count(*) >= 2),
p AS (SELECT *, i * (len(v) - 1) / 23.0::DOUBLE AS pos FROM g CROSS JOIN range(24) r(i)), q AS (SELECT *, least(floor(pos), len(v) - 2)::BIGINT AS low FROM p)
SELECT node, session, win, len(v) AS n, round(list_avg(v), 6) AS mean, i AS place, round(v[low + 1] + (v[low + 2] - v[low + 1]) * (pos - low) - list_avg(v), 5) AS value FROM q""")
def window_sequences(spark, sf):
    """Each window's values as a sequence of fixed length without its mean."""
    g = win(spark, sf).groupBy("node", "session", "win").agg(F.transform(F.sort_array(F.collect_list(F.struct("us", "event_id", "value"))), lambda r: r["value"]).alias("v"), F.avg("value").alias("mean")).where("size(v) >= 2")
    rows = g.select("node", "session", "win", F.size("v").cast("bigint").alias("n"), r6("mean"), F.posexplode(X.sequence(F.col("v"))).alias("place", "value"))
    return rows.select("node", "session", "win", "n", "mean", F.col("place").cast("bigint").alias("place"), F.round("value", 5).alias("value"))


_ALL_FAULTS = f"""{EV}, c AS (SELECT *, floor(raw / 50)::DOUBLE AS q, value + 3 * raw AS w, raw > 90 AS device_clock_bad, CASE WHEN raw > 5 THEN raw % 13 = 0 END AS rtc_error, raw % 17 = 0 AS zero FROM ev),
f AS (SELECT *, coalesce(count(*) OVER t = 4 AND stddev_samp(q) OVER t < 0.000001, false) AS q_flatline, coalesce(count(*) OVER t = 4 AND stddev_samp(value) OVER t < 0.000001, false) AS value_flatline, coalesce(count(*) OVER t = 4 AND stddev_samp(w) OVER t < 0.000001, false) AS w_flatline,
  value <= 3 OR value >= 297 AS value_saturated, coalesce(us - lag(us) OVER o > 3600000000, false) AS packet_loss, coalesce(rtc_error, false) AS rtc,
  CASE WHEN count(*) OVER h = 50 THEN (abs(corr(q, value) OVER h) + abs(corr(q, w) OVER h) + abs(corr(value, w) OVER h)) / 3 END AS co
  FROM c WINDOW o AS (PARTITION BY node ORDER BY us, event_id), t AS (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), h AS (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, coalesce(co < 0.45, false) AS alone FROM f)"""


@query("sample_fault_flags", f"""WITH {_ALL_FAULTS} SELECT event_id, q_flatline, value_flatline, w_flatline, value_saturated, packet_loss, device_clock_bad AS rtc_reset, rtc AS rtc_error, zero AS channels_all_zero, alone AS isolated_sensor_deviation,
  q_flatline OR value_flatline OR w_flatline OR value_saturated OR packet_loss OR device_clock_bad OR rtc OR zero OR alone AS any_fault FROM g""")
def sample_fault_flags(spark, sf):
    rows = ev(spark, sf).withColumns({"q": F.floor(F.col("raw") / 50).cast("double"), "w": F.col("value") + 3 * F.col("raw"), "device_clock_bad": F.col("raw") > 90, "rtc_error": F.when(F.col("raw") > 5, F.col("raw") % 13 == 0), "channels_all_zero": F.col("raw") % 17 == 0})
    out = S.sample_flags(rows, NODE, ORDER, ["q", "value", "w"], {"value": (0.0, 300.0)}, 1800, width=4, least_coherence=0.45)
    return out.select("event_id", "q_flatline", "value_flatline", "w_flatline", "value_saturated", "packet_loss", "rtc_reset", "rtc_error", "channels_all_zero", "isolated_sensor_deviation", "any_fault")


@query("single_fault_view", f"""WITH {STAB}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY start_us) - 1 AS i, count(*) OVER (PARTITION BY node) AS c, CASE WHEN u > 75 THEN 'ALARM' WHEN u > 60 THEN 'WARNING' ELSE 'OK' END AS status FROM st),
o AS (SELECT node, min(i) AS oi, arg_min(start_us, i) AS ous FROM r WHERE i >= floor(c * 0.5) GROUP BY 1), h AS (SELECT r.node, min(i) AS i, arg_min(status, i) AS status, arg_min(start_us, i) AS us FROM r JOIN o USING (node) WHERE i >= oi AND status <> 'OK' GROUP BY 1)
SELECT r.node, count(*) AS windows, max(oi) AS onset_window, max(h.i) IS NOT NULL AS detected, max(h.i) AS "window", max(h.status) AS status, round(max((h.us - ous) / 3600000000.0::DOUBLE), 6) AS delay_h, count(*) FILTER (r.i >= oi - 10 AND r.i < oi + 20) AS shown FROM r JOIN o USING (node) LEFT JOIN h USING (node) GROUP BY 1""")
def single_fault_view(spark, sf):
    rows = stab(spark, sf).withColumn("c", F.count(F.lit(1)).over(W.partitionBy("node")))
    onset = F.row_number().over(S.ordered(NODE, ["start_us"])) - 1 >= F.floor(F.col("c") * 0.5)
    verdict, view = preparation.single_fault(rows, NODE, X.status([("ALARM", F.col("u") > 75), ("WARNING", F.col("u") > 60)]), onset)
    shown = view.groupBy("node").agg(F.count(F.lit(1)).alias("shown"))
    return verdict.join(shown, "node", "left").select("node", "windows", F.col("onset_window").cast("bigint").alias("onset_window"), "detected", F.col("window").cast("bigint").alias("window"), "status", r6("delay_h"), "shown")


@query("fault_region_rates", f"""WITH {STAB}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY start_us) - 1 AS i, count(*) OVER (PARTITION BY node) AS c FROM st),
x AS (SELECT node, start_us, kind, u + CASE WHEN kind = 'step' THEN 30 ELSE 0 END AS u, v * CASE WHEN kind = 'noise' THEN 2 ELSE 1 END AS v FROM r CROSS JOIN (VALUES ('clean'), ('step'), ('noise')) k(kind) WHERE i >= floor(c / 3)),
s AS (SELECT *, u > 75 AS flag_u, v > 80 AS flag_v, CASE WHEN u > 75 AND v > 80 THEN 'ALARM' WHEN u > 90 THEN 'WARNING' ELSE 'OK' END AS status FROM x)
SELECT node, kind AS fault, round(avg(flag_u::INTEGER), 6) AS flag_u, round(avg(flag_v::INTEGER), 6) AS flag_v, round(avg(CASE WHEN status <> 'OK' THEN 1 ELSE 0 END), 6) AS fused, round(avg((flag_u OR flag_v)::INTEGER), 6) AS any_flag,
  round((min(CASE WHEN status <> 'OK' THEN start_us END) - min(start_us)) / 3600000000.0::DOUBLE, 6) AS delay_h FROM s GROUP BY 1, 2""")
def fault_region_rates(spark, sf):
    rows = stab(spark, sf).withColumns({"i": F.row_number().over(S.ordered(NODE, ["start_us"])) - 1, "c": F.count(F.lit(1)).over(W.partitionBy("node"))})
    rows = rows.withColumn("post", F.col("i") >= F.floor(F.col("c") / 3)).withColumn("fault", F.explode(F.array(*[F.lit(k) for k in ("clean", "step", "noise")])))
    rows = rows.withColumns({"u": F.col("u") + F.when(F.col("fault") == "step", 30).otherwise(0), "v": F.col("v") * F.when(F.col("fault") == "noise", 2).otherwise(1)})
    rows = rows.withColumns({"flag_u": F.col("u") > 75, "flag_v": F.col("v") > 80})
    rows = rows.withColumn("status", X.status([("ALARM", F.col("flag_u") & F.col("flag_v")), ("WARNING", F.col("u") > 90)]))
    out = models.region_rates(rows, NODE, "fault", ["flag_u", "flag_v"], "status", "post", "start_us")
    return out.select("node", "fault", r6("flag_u"), r6("flag_v"), r6("fused"), r6("any_flag"), r6("delay_h"))


from . import stateful  # noqa: E402

QUERIES.update(stateful.QUERIES)
