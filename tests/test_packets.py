import pytest
from pyspark.sql import functions as F

from tremorline.sources import packets as P

R, L = "RFM", "RFL"
PACKETS = [
    (1, R, "01/09/2026 11:59:58,4.69,-7.84,-3.60,-26.69,42.25,-14.06,-0.06,0.12,0.00"),
    (2, L, "26/08/2026 14:46:45,00,00,00,00,,00.0,00.0,00.0,00.0,00.0,00.0,00.0"),
    (3, R, "RFM_0002,12/09/2026,03:36:40,1.07,-9.44,-0.62,-32.88,5.56,-3.25,0.00,0.06,-0.06,"),
    (4, L, "RFL_01,11/09/2026 15:47:16,-0.56,-0.09,9.41,14.38,-41.75,-22.69,0.06,0.00,0.06,500:-31197,0.00kg,7.5:-30151,1.85kg,1243"),
    (5, R, "RFM_0001,01/01/2000 00:02:11,0.13,-0.20,-10.02,-0.50,-6.25,3.25,-3.31,-6.19,-2.06,"),
    (6, L, "D001,RTC Error,0,0,0,0,0,0,0,0,0,5T:1684,-24221,0.00kg,7.5T:0,0,0.00kg"),
    (7, L, "RTC Error,1,2,3,4,5,6,7,8,9,500:0,0.00kg"),
    (8, L, "RFL_01,11/09/2026 15:47:16,1,2,3,4,5,6,7,8,9,500:1,0.10kg,junk,7"),
    (9, L, "RFL_01,11/09/2026 15:47:16,1,2,3,4,5,6,7,8,9,1243"),
    (10, R, "RFM_0002,12/09/2026 03:36:40,1,2,3,4,5,6,7,8"),
    (11, R, "RFM_0002,12/09/2026 03:36:40,1,2,3,4,,6,7,8,9"),
    (12, R, None), (120, L, ""),
    (13, R, "RFM_0002,12/09/2026,x,1,2,3,4,5,6,7,8,9"),
    (14, L, "D1,1,2,3,4,5,6,7,8,9,500:5"),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, d, "site", "2026-09-15T06:53:02.5+00:00", v) for i, d, v in PACKETS], f"no int, {P.RAW}")
    return {r.no: r for r in P.add_times(P.parse(df)).collect()}


def test_fixtures(got):
    g = got
    assert g[1].sensor_id is None and g[1].device_time_raw == "01/09/2026 11:59:58" and g[1].acc_x == 4.69 and g[1].mag_z == 0.0
    assert not g[1].parse_error and g[1].channels_all_zero is False and g[1].nan_field_count == 0 and g[1].load_cells is None
    assert not g[2].parse_error and g[2].channels_all_zero and g[2].acc_x is None and g[2].nan_field_count == 1
    assert g[2].load_cells == [] and g[2].packet_counter is None and g[2].load_cells_all_zero is False
    assert g[3].sensor_id == "RFM_0002" and g[3].device_time_raw == "12/09/2026 03:36:40" and not g[3].parse_error and g[3].mag_z == -0.06
    assert [tuple(c) for c in g[4].load_cells] == [("500", -31197, None, 0.0), ("7.5", -30151, None, 1.85)]
    assert g[4].packet_counter == 1243 and not g[4].parse_error and g[4].load_cells_all_zero is False
    assert not g[5].parse_error and g[5].device_clock_bad and g[4].device_clock_bad is False
    assert g[6].rtc_error and g[6].sensor_id == "D001" and g[6].device_time_raw is None and g[6].channels_all_zero and not g[6].parse_error
    assert [tuple(c) for c in g[6].load_cells] == [("5T", 1684, -24221, 0.0), ("7.5T", 0, 0, 0.0)] and g[6].packet_counter is None
    assert g[7].rtc_error and g[7].sensor_id is None and g[7].load_cells_all_zero
    assert g[8].parse_error and g[8].unparsed_tail == ["junk", "7"] and g[8].acc_x == 1.0
    assert g[9].parse_error and len(g[9].unparsed_front) == 10 and g[9].acc_x is None
    assert g[10].parse_error and len(g[10].unparsed_front) == 8
    assert not g[11].parse_error and g[11].nan_field_count == 1 and g[11].gyro_y is None
    for k in (12, 120):
        assert g[k].parse_error and g[k].sensor_id is None and g[k].rtc_error is None and g[k].channels_all_zero is None
    assert g[13].device_time_raw == "12/09/2026" and g[13].device_time is None and g[13].device_clock_bad and g[13].acc_x is None and g[13].mag_z == 8.0
    assert g[14].parse_error and g[14].unparsed_tail == ["500:5"] and g[14].load_cells == []
    assert g[1].server_time_of_day == "06:53:02.500000" and str(g[1].server_date) == "2026-09-15"


def test_export_clean_and_explode(spark, tmp_path):
    lines = ["device,site,time,value"] + [f'{d},s,2026-09-15T06:53:0{i % 10}+00:00,"{v or ""}"' for i, (_, d, v) in enumerate(PACKETS)]
    (tmp_path / "x.csv").write_text("\n".join([*lines, 'XYZ,s,2026-09-15T00:00:00Z,"1"']))
    raw = P.read_export(spark, str(tmp_path / "x.csv"))
    assert raw.count() == len(PACKETS) + 1
    assert [r.device for r in P.unknown_devices(raw).collect()] == ["XYZ"]
    parsed = P.preprocess(raw)
    assert {r.sensor_id for r in P.clean_tilt(parsed).collect()} == {"RFM_0001", "RFM_0002"}
    rows = {r.packet_counter: r for r in P.explode_cells(P.clean_load(parsed.where("device = 'RFL'"))).collect()}
    assert rows[1243].LC_A_kg == 0.0 and rows[1243].LC_B_kg == 1.85 and rows[1243].LC_B_raw == -30151
    assert P.fingerprint(raw).first().n >= 1
    data = P.records(parsed.withColumn("bad", F.lit(float("nan")))).collect()
    assert len(data) == len(PACKETS) and all('"bad":null' in r.data for r in data)


def test_temperature_and_pivot(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,time,temperature_C\n2026-09-15,12:23:00,30.5\n2026-09-15,12:23:00,99\nx,y,1\n2026-09-15,13:23:00,warm\n")
    (r,) = P.read_temperature(spark, str(tmp_path / "t.csv")).collect()
    assert str(r.time) == "2026-09-15 06:53:00" and r.temperature == 30.5
    long = spark.createDataFrame([("t1", "a", "value", "1"), ("t1", "a", "site", "x"), ("t2", "a", "value", "2")], "_time string, tag string, _field string, _value string")
    wide = P.pivot_fields(long, tags=["tag", "_start", "table"])
    assert wide.columns == ["_time", "site", "tag", "value"] and wide.count() == 2
