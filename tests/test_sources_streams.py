import json

from pyspark.sql import functions as F

from rungspark.functions import geometry as G
from rungspark.functions import text
from rungspark.operators import sequences
from rungspark.sources import annotations as A
from rungspark.streaming import events as E


def test_pages_round_trip(spark, tmp_path):
    page = {"id": 1, "name": "p", "sheet_no": "ER21211", "symbols": [{"ref": "S2", "class_key": "coil", "attributes": {"k": "v"}, "terminals": [{"name": "1", "tx": 0.5, "ty": 0.1}]}, {"ref": "S1", "class_key": "lamp"}], "connections": [{"ref": "E1", "from_symbol": "S1", "to_symbol": "S2"}]}
    (tmp_path / "in.json").write_text(json.dumps(page) + "\n" + json.dumps({"id": 2, "name": "empty"}))
    flat = A.read_pages(spark, str(tmp_path / "in.json"))
    back = A.nested(**flat).orderBy("id").collect()
    assert [s.ref for s in back[0].symbols] == ["S1", "S2"] and back[0].symbols[1].terminals[0].tx == 0.5 and back[0].symbols[1].attributes == {"k": "v"} and back[1].symbols is None


def test_labels_round_trip_and_bad_lines(spark, tmp_path):
    classes = spark.createDataFrame([(0, "coil"), (1, "lamp")], "yolo_index int, class_key string")
    (tmp_path / "p7_x.txt").write_text("0 0.5 0.5 0.1 0.2 0.9\nbroken\n1 a 0 0 0\n9 0.1 0.1 0.1 0.1\n")
    rows = A.read_labels(spark, str(tmp_path / "*.txt"), classes)
    assert {(r.page_id, r.class_key, r.cx) for r in rows.collect()} == {(7, "coil", 0.5), (7, "other", 0.1)}
    out = A.label_lines(rows.withColumn("ref", F.lit("S1")), classes).collect()
    assert out[0].lines == "0 0.500000 0.500000 0.100000 0.200000"


def test_xml_boxes(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<annotations><image name="a.png" width="100" height="50"><box label="coil" xtl="10" ytl="5" xbr="30" ybr="15"/></image></annotations>')
    r = A.read_boxes_xml(spark, str(tmp_path / "a.xml")).collect()[0]
    assert (r.image, r.class_key, r.cx, r.cy, r.w, r.h) == ("a.png", "coil", 0.2, 0.2, 0.2, 0.2)


def test_blobs_are_stored_once(spark, tmp_path):
    blobs = spark.createDataFrame([(bytearray(b"x"), "png"), (bytearray(b"x"), "png"), (bytearray(b"y"), "png")], "content binary, suffix string")
    assert A.new_blobs(spark, blobs, str(tmp_path / "b")).count() == 2 and A.new_blobs(spark, blobs, str(tmp_path / "b")).count() == 0


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ＲＹ１  (CR) oq", "A=1, B=0, C=?", "er21211-3 rest")], "a string, s string, n string")
    r = df.select(text.squeezed(F.col("a")).alias("sq"), text.normalised(F.col("a")).alias("nf"), text.folded(F.col("a")).alias("fo"), text.device_key(F.col("a")).alias("dk"), text.states(F.col("s")).alias("st"), text.sheet_number(F.lit(None).cast("string"), F.col("n")).alias("sh"),
                  text.first_word_with_letters(F.lit("12 X3 4")).alias("fw"), text.canonical_class(F.lit("Horizontal_Coil"), {"coil": "relay"}).alias("cc")).collect()[0]
    assert r.sq == "RY1 (CR) OQ" == r.nf and r.dk == "ＲＹ１ oq" and r.st == {"A": True, "B": False, "C": None} and r.sh == "ER21211-3" and r.fw == "X3" and r.cc == "relay"
    L = F.lit
    box = (L(0.5), L(0.5), L(0.2), L(0.2))
    g = df.select(G.iou(box, box).alias("same"), G.clips(L(0.0), L(0.5), L(1.0), L(0.5), box).alias("through"), G.clips(L(0.0), L(0.9), L(1.0), L(0.9), box).alias("past"), G.to_segment(L(0.0), L(1.0), L(0.0), L(0.0), L(2.0), L(0.0)).alias("d"), *[c.alias(f"r{i}") for i, c in enumerate(G.rotated(L(0.1), L(0.2), L(0.3), L(0.4), 90))]).collect()[0]
    assert (round(g.same, 9), g.through, g.past, g.d, round(g.r0, 6), g.r1, g.r2, g.r3) == (1.0, True, False, 1.0, 0.8, 0.1, 0.4, 0.3)


def _stream(spark, path, df):
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 00:{i % 60:02d}:00", i % 4 < 2) for i in range(55)] + [(9, "2024-01-02 00:00:00", False)]
    df = spark.createDataFrame(rows, "k int, t string, v boolean").withColumn("ts", F.to_timestamp("t")).drop("t")
    stream = _stream(spark, str(tmp_path / "s"), df)
    batch = sequences.delayed(df.withColumn("s", F.col("ts").cast("double")), ["k"], "s", "v", 400.0).filter("to IS NOT NULL")
    got = _run(E.on_delay(stream, "k", "ts", "v", 400.0, "1 hour"), "timers")
    assert {tuple(r) for r in got.collect()} == {(r.k, r["from"], r.to) for r in batch.collect()}
    counts = {(r.k, str(r.start)): r.n for r in _run(E.tumbling(stream, "ts", ["k"], "10 minutes", "1 minute"), "tumbling").collect()}
    want = {(r.k, str(r.w.start)): r["count"] for r in df.groupBy("k", F.window("ts", "10 minutes").alias("w")).count().collect() if r.k != 9}
    assert counts == want
