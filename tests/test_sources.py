import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from tremorline.sources import serving, settings, sinks, store


def test_settings(tmp_path):
    (tmp_path / "e").write_text("# c\nINFLUX_URL='http://x'\nINFLUX_TOKEN=t\n\nINFLUX_ORG=o\nINFLUX_VERIFY_SSL=No\n")
    with pytest.raises(ValueError, match="INFLUX_BUCKET"):
        settings.load(env={}, path=str(tmp_path / "e"))
    s = settings.load(env={"INFLUX_BUCKET": "b", "INFLUX_ORG": "other"}, path=str(tmp_path / "e"))
    assert (s.url, s.org, s.bucket, s.verify_tls) == ("http://x", "other", "b", False)
    assert "range(start: -2m)" in settings.flux("b", "-2m")


def test_models_and_exports(spark, tmp_path):
    store.save_models(spark, {"a": {"limit": np.float64(1.5), "centre": np.arange(3)}, "b": {}}, str(tmp_path / "m"))
    assert store.load_models(spark, str(tmp_path / "m"), ["a"]) == {"a": {"limit": 1.5, "centre": [0, 1, 2]}}
    df = spark.range(3)
    assert store.export(df, str(tmp_path / "x")) == 3
    with pytest.raises(ValueError):
        store.export(df.limit(0), str(tmp_path / "x"))
    assert sinks.read_table(spark, str(tmp_path / "x"), "id long").count() == 3


def test_server_keeps_the_last_good_payload():
    state = {"n": 0, "fail": False}

    def build():
        if state["fail"]:
            raise RuntimeError("store is away")
        state["n"] += 1
        return {"n": state["n"]}

    board = serving.Board(build)
    httpd = serving.server(board)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{httpd.server_port}"

    def call(path, method="GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, method=method)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("/api/dashboard")[0] == 503
    assert call("/api/refresh", "POST") == (200, {"ok": True, "error": None})
    state["fail"] = True
    assert call("/api/refresh", "POST")[0] == 500
    assert call("/api/dashboard") == (200, {"n": 1}) and "away" in call("/api/status")[1]["error"]
    assert call("/nope")[0] == 404
    httpd.shutdown()


def test_dashboard_sink(spark, tmp_path):
    seg = spark.createDataFrame([("a", 2), ("b", 0)], "segment string, sessions int")
    rows = spark.createDataFrame([("a", 2, 0.5), ("a", 1, float("nan"))], "segment string, at int, u double")
    ev = spark.createDataFrame([], "segment string, kind string")
    docs = {r.segment: json.loads(r.document) for r in sinks.dashboard(seg, rows, ev).collect()}
    assert [x["at"] for x in docs["a"]["session_rows"]] == [1, 2] and docs["a"]["session_rows"][0].get("u") is None and docs["b"]["session_rows"] == [] and docs["a"]["event_rows"] == []
    sinks.write_table(rows, str(tmp_path / "t"), "csv")
    assert sinks.read_table(spark, str(tmp_path / "t"), "segment string, at int, u double").count() == 2


def test_fetch_replaces_the_file_whole(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    answers = ["result,table,_time,_measurement,device,value\r\n,0,2024-01-01T00:00:00Z,m,RFM,\"a,b\"\r\n\r\nresult,table,_time,_measurement,extra\r\n,1,2024-01-02T00:00:00Z,m,7\r\n", "\r\n"]
    asked = []

    class Store(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answers.pop(0).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    own = settings.StoreSettings(f"http://127.0.0.1:{server.server_port}/", "secret", "my org", "b")
    path = tmp_path / "new" / "raw.csv"
    assert settings.fetch(own, str(path), "-1h") == 2
    text = path.read_text()
    assert text.splitlines() == ["device,extra,measurement,time,value", 'RFM,,m,2024-01-01T00:00:00Z,"a,b"', ",7,m,2024-01-02T00:00:00Z,"]
    with pytest.raises(RuntimeError):
        settings.fetch(own, str(path))
    assert path.read_text() == text and not path.with_suffix(".tmp").exists()
    assert asked[0][0] == "/api/v2/query?org=my%20org" and asked[0][1] == "Token secret" and "-1h" in asked[0][2]
    server.shutdown()


def test_jdbc_load_is_idempotent(spark):
    from pyspark.sql import functions as F

    url, driver = "jdbc:derby:memory:loads;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    sinks.execute(spark, url, 'CREATE TABLE records (id INT GENERATED ALWAYS AS IDENTITY, "time" TIMESTAMP, "measurement" VARCHAR(256), "data" VARCHAR(32000))', driver=driver)
    rows = spark.range(50).select(F.timestamp_seconds(F.col("id") % 40).alias("time"), F.lit("m").alias("measurement"), F.concat(F.lit('{"a":'), (F.col("id") % 40).cast("string"), F.lit("}")).alias("data"))
    assert sinks.load_jdbc(rows.limit(30), url, "records", driver=driver) == 30
    assert sinks.load_jdbc(rows, url, "records", driver=driver) == 10
    assert sinks.load_jdbc(rows.unionByName(rows), url, "records", driver=driver) == 0
    assert spark.read.format("jdbc").options(url=url, dbtable="records", driver=driver).load().count() == 40
