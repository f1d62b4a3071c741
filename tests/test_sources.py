import hashlib
import json
import zipfile

from pyspark.sql import functions as F

from plumbline.sources import readers, sinks
from plumbline.streaming import panels


def test_text_readers(spark, tmp_path):
    (tmp_path / "a_one.csv").write_bytes("﻿fold,v\n1,2.5\nx_y,NaN\n".encode())
    (tmp_path / "a_two_skip.csv").write_text("fold,v\n3,1\n")
    (tmp_path / "t.tsv").write_text("fold\tv\n1\t2\n")
    got = readers.read_csv(spark, str(tmp_path / "a_one.csv"), "fold string, v double")
    assert [tuple(r) for r in got.collect()] == [("1", 2.5), ("x_y", None)]
    assert readers.read_csv(spark, str(tmp_path / "t.tsv"), "fold string, v double", ["v"], "\t").collect() == [(2.0,)]
    (tmp_path / "turned.csv").write_text("extra,v,fold\nz,2.5,a\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "turned.csv"), "fold string, v double, w int").collect()] == [("a", 2.5, None)]
    glob = readers.read_csv_glob(spark, str(tmp_path), "a_*.csv", ["skip"], "fold string, v double")
    assert {r.source_file for r in glob.collect()} == {"a_one.csv"}
    assert readers.read_csv_text(spark, str(tmp_path / "a_one.csv")).dtypes == [("fold", "string"), ("v", "string")]


def test_preamble_zip_and_units(spark, tmp_path):
    (tmp_path / "p.csv").write_text('made by x\n\nSite,v\nA,1\nB,\n"two\nlines",3\nSite,4\n')
    (tmp_path / "q.csv").write_text("no header\nA,1\n")
    assert [tuple(r) for r in readers.read_csv_with_preamble(spark, str(tmp_path / "p.csv"), "Site", "Site string, v double").collect()] == [("A", 1.0), ("B", None), ("two\nlines", 3.0), ("Site", 4.0)]
    assert readers.read_csv_with_preamble(spark, str(tmp_path / "[pq].csv"), "Site", "Site string, v double").count() == 4
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/one.csv", "k,v\n1,2\n2,bad\n")
        z.writestr("in/readme.txt", "no")
    assert [tuple(r) for r in readers.read_zipped_csv(spark, str(tmp_path / "z.zip"), "one.csv", "k int, v double").orderBy("k").collect()] == [(1, 2.0), (2, None)]
    for u in ("w1", "w2"):
        spark.createDataFrame([(1.0, u)], "v double, junk string").toPandas().to_parquet(tmp_path / f"{u}.parquet")
    units = readers.read_units(spark, str(tmp_path / "w*.parquet"), ["v"])
    assert {r.unit for r in units.collect()} == {"w1", "w2"} and units.columns == ["unit", "v"]


def test_json(spark, tmp_path):
    rec = {"persist": 0.5, "ridge": 0.6, "xgb": None, "n_test": 9}
    (tmp_path / "h.json").write_text(json.dumps({"monthly": [{"well": "a", "h1": rec}], "daily": []}))
    got = readers.read_horizons(spark, str(tmp_path / "h.json"), ["monthly", "daily"], ["h1", "h3"]).collect()
    assert [(r.frequency, r.well, r.horizon, r.ridge) for r in got] == [("monthly", "a", "h1", 0.6)]
    (tmp_path / "t.json").write_text(json.dumps({"a": 1, "b": 0.25}))
    assert {r.key: float(r.value) for r in readers.read_mirror(spark, str(tmp_path / "t.json")).collect()} == {"a": 1.0, "b": 0.25}


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("x")
    (tmp_path / "y.txt").write_text("y")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    m = spark.createDataFrame([("d/x.txt", h("x")), ("y.txt", h("z")), ("gone.txt", h("g"))], "path string, sha256 string")
    assert {r.path: r.status for r in readers.verify_manifest(spark, str(tmp_path), m).collect()} == {"d/x.txt": "ok", "y.txt": "changed", "gone.txt": "missing"}


def test_stores(spark, tmp_path):
    path, df = str(tmp_path / "s"), spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.write_units(df, path, ["k"])
    sinks.write_units(spark.createDataFrame([("b", 3)], "k string, v int"), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == [("a", 1), ("b", 3)]
    sinks.write_table(df.limit(0), path, force=False)
    assert spark.read.parquet(path).count() == 2
    assert sinks.resume(df, path, "k string", ["k"]).count() == 0 and sinks.resume(df, str(tmp_path / "none"), "k string", ["k"]).count() == 2
    old, new = spark.createDataFrame([("a", 1, 1)], "k string, v int, n int"), spark.createDataFrame([("a", 5, 2), ("c", 6, 2)], "k string, v int, n int")
    assert sorted((r.k, r.v) for r in sinks.merge_results(old, new, ["k"], "n").collect()) == [("a", 5), ("c", 6)]


def test_stream_means_equal_batch_means(spark, tmp_path):
    rows = [(u, f"2024-01-0{d} 0{h}:00:00", float(u + d + h)) for u in (1, 2) for d in (1, 2, 3, 9) for h in (1, 2)]
    df = spark.createDataFrame(rows, "unit long, t string, value double").select("unit", F.to_timestamp("t").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = panels.keep_panel(panels.rolling_means(stream, "unit", "ts", "value"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.unit, str(r.period)[:10]): r["mean"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.unit, str(r.d)): r.m for r in df.groupBy("unit", F.to_date("ts").alias("d")).agg(F.avg("value").alias("m")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= 6
