import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers as R
from tidemark.sources import sinks as K


def test_json_slice_and_import(spark, tmp_path):
    bar = {"timestamp": "2024-01-02T00:00:00", "open": 1, "high": 2, "low": 0.5, "close": 1.5, "volume": None}
    (tmp_path / "s.json").write_text(json.dumps({"bars_by_symbol": {"A": [bar], "B": [bar, bar]}, "candidates": [{"symbol": "A"}]}))
    parts = R.json_slice(spark, str(tmp_path / "s.json"))
    assert parts["bars"].count() == 3 and parts["bars"].first().volume == 0 and parts["candidates"].count() == 1
    (tmp_path / "r.csv").write_text("symbol,signal_strength,reference_date,extra\n A ,0.5,2024-01-03,x\nB,bad,nope,y\n")
    got = R.import_rows(spark, str(tmp_path / "r.csv"), defaults={"signal_strength": 0.0}).orderBy("symbol").collect()
    assert [(r.symbol, r.signal_strength, str(r.reference_date)) for r in got] == [("A", 0.5, "2024-01-03"), ("B", 0.0, "None")]
    (tmp_path / "r.jsonl").write_text('{"symbol": "C", "ticker_id": 7}\n{"symbol": "D"}\n')
    assert [r.ticker_id for r in R.import_rows(spark, str(tmp_path / "r.jsonl")).orderBy("symbol").collect()] == [7, None]


def test_fixed_width_zip_and_html(spark, tmp_path):
    (tmp_path / "m.txt").write_text("A0001  Alpha Corp     STKRX 12\nB0002  Beta           ETFRX 07\nshort\n")
    got = R.fixed_width(spark, str(tmp_path / "m.txt"), 8, {"code": (0, 5), "name": (7, 15)}, {"kind": (0, 3), "size": (6, 2)}).collect()
    assert [tuple(r) for r in got] == [("A0001", "Alpha Corp", "STK", "12"), ("B0002", "Beta", "ETF", "07")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("c.xml", "<result><list><code> 1 </code><name>x</name></list><list><code>2</code><name/></list></result>")
    (tmp_path / "c.zip").write_bytes(data.getvalue())
    assert [tuple(r) for r in R.zipped_xml(spark, str(tmp_path / "c.zip"), "list", ["code", "name"]).collect()] == [("1", "x"), ("2", None)]
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th></tr><tr><td> <b>b</b>\n c</td><td>d</td></tr></table>")], "page_id int, html string")
    assert [r.cells for r in R.html_cells(pages).orderBy("row").collect()] == [["a"], ["b c", "d"]]


def test_payloads_and_macro(spark):
    rows = '[{"date":"20240105","open":"1,000","high":"2","low":"1","close":"1,500.5","volume":"3"},{"date":"bad","close":"1"},{"date":"20240106","close":""}]'
    got = R.daily_payload(spark.createDataFrame([("A", rows)], "symbol string, payload string"), "payload", ["symbol"]).collect()
    assert [(r.symbol, str(r.trade_date), r.open, r.close, r.volume) for r in got] == [("A", "2024-01-05", 1000.0, 1500.5, 3)]
    macro = spark.createDataFrame([("CBOE Volatility Index: VIX", "2024-07-01", "13.5"), ("rate", "2024-01-02", "."), ("other", "2024-01-02", "1")], "name string, obs_date string, value string").withColumn("obs_date", F.to_date("obs_date"))
    got = {r.name: r for r in R.macro_observations(macro).collect()}
    assert set(got) == {"vix", "rate"} and got["rate"].is_missing and got["rate"].value is None and got["vix"].source_ts_utc.hour == 20 and got["rate"].source_ts_utc.hour == 21


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, [1, 2]), ("s2", 2, [])], "scenario_id string, n int, a array<int>")
    K.panel(df, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p/csv"), header=True).orderBy("n").first().a == "[1,2]"
    for part in (df, df.where("n = 2").withColumn("n", F.lit(5))):
        K.scenario_snapshot(part, str(tmp_path / "sc"), str(tmp_path / "man"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "sc")).collect()) == [1, 5] and spark.read.parquet(str(tmp_path / "man")).count() == 3
    runs = spark.createDataFrame([("r1", 0.5, "x", True)], "run_id string, score double, note string, ok boolean")
    K.run_tables(runs, runs, runs, str(tmp_path / "res"))
    assert {(r.name, r.value, r.text) for r in spark.read.parquet(str(tmp_path / "res/metrics")).collect()} == {("score", 0.5, None), ("note", None, "x"), ("ok", 1.0, None)}
    K.artifacts(runs.drop("run_id"), str(tmp_path / "art"), "r9")
    assert spark.read.json(str(tmp_path / "art")).first().run_id == "r9"
    with pytest.raises(ValueError):
        R.scenario(spark, str(tmp_path / "none"), "x", "2024-01-01", "2024-01-02") if (df.withColumn("reference_date", F.lit("2024-01-01").cast("date")).withColumn("anchor_date", F.lit(None).cast("date")).write.parquet(str(tmp_path / "none")) is None) else None


def test_mirror_and_guards(spark, tmp_path):
    path = str(tmp_path / "mir")
    src = lambda *rows: spark.createDataFrame(list(rows), "id int, at int, v string")
    assert K.mirror(spark, src((1, 1, "a"), (2, 2, "b")), path, ["id"], cursor="at") == 2
    assert K.mirror(spark, src((1, 1, "a"), (2, 3, "B"), (3, 4, "c")), path, ["id"], cursor="at") == 2
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, 1, "a"), (2, 3, "B"), (3, 4, "c")}
    assert K.mirror(spark, src((1, 1, "a")), path, ["id"], cursor="at") == 0
    assert K.mirror(spark, src((9, 1, "z")), path, ["id"], mode="full") == 1 and spark.read.parquet(path).count() == 1
    assert K.ensure_select("SELECT 'drop' FROM t -- delete") and K.ensure_select("WITH a AS (SELECT 1) SELECT * FROM a;")
    for bad in ("DROP TABLE t", "SELECT 1; DELETE FROM t", "select * from secret_x"):
        with pytest.raises(ValueError):
            K.ensure_select(bad, ["secret_"])
