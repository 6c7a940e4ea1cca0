"""Payloads, the page store, bundles, correspondence files and timers."""

import random

import pytest
from pyspark.sql import functions as F

from rungspark.operators import bundles, sequences
from rungspark.sources import correspondence as T
from rungspark.streaming import events as E

S = "page_id long, nth int, ref string, class_key string, label string, cx double, cy double, w double, h double, note string, origin string, confidence double, attributes map<string,string>"
ST = "page_id long, symbol_nth int, nth int, ref string, name string, tx double, ty double, origin string"
C = "page_id long, nth int, ref string, from_symbol string, from_terminal string, to_symbol string, to_terminal string, wire_no string, kind string, note string"


def numbered_by_hand(refs):
    used, seq, out = set(), 0, []
    for ref in refs:
        ref = (ref or "").strip()
        if not ref or ref in used:
            seq += 1
            while f"SYM-{seq:04d}" in used:
                seq += 1
            ref = f"SYM-{seq:04d}"
        used.add(ref)
        out.append(ref)
    return out


def wires_by_hand(refs):
    used, kept = set(), []
    for ref in refs:
        ref = (ref or "").strip() or None
        kept.append(ref if ref and ref not in used else None)
        used |= {ref} - {None}
    seq, out = 0, []
    for ref in kept:
        while ref is None:
            seq += 1
            if f"W-{seq:04d}" not in used:
                ref = f"W-{seq:04d}"
        out.append(ref)
    return out


def test_refs_equal_sequential_numbering(spark):
    r = random.Random(1)
    choices = [None, "", " ", "A", "B", "SYM-0001", "SYM-0002", "SYM-0003", "SYM-00004", "SYM-0007", " SYM-0005 ", "W-0001", "W-0002", "W-0004", "W-12", "W-00001"]
    pages = {p: [r.choice(choices) for _ in range(r.randrange(1, 30))] for p in range(25)}
    rows = [(p, i, ref) for p, refs in pages.items() for i, ref in enumerate(refs)]
    df = spark.createDataFrame(rows, "page_id long, nth int, ref string").repartition(4)
    for made, hand in ((bundles.symbol_refs(df), numbered_by_hand), (bundles.wire_refs(df), wires_by_hand)):
        got = {(x.page_id, x.nth): x.ref for x in made.collect()}
        assert got == {(p, i): ref for p, refs in pages.items() for i, ref in enumerate(hand(refs))}
        assert made.limit(0).count() == 0


@pytest.fixture
def payload(spark):
    symbols = [(1, 1, "K1", "Coil", " R1 ", 0.5, 0.5, 0.1, 0.1, None, None, None, {"a": "1", " b ": "", "c": None}), (1, 2, None, "lamp", "", 2.0, -1.0, 0.0, 3.0, "n", "ai", 0.5, None), (2, 1, "K1", "new_kind", None, 0.1, 0.1, 0.1, 0.1, None, None, None, {})]
    stops = [(1, 1, 1, "t1", "13", 0.5, 0.4, None), (1, 1, 2, None, " ", 0.5, 1.6, "ai"), (1, 2, 1, "", "x", 0.0, 0.0, None)]
    wires = [(1, 1, None, "K1", "t1", "SYM-0001", None, "610", None, "a\nb"), (1, 2, "W-0001", "K1", "nowhere", "SYM-0001", "SYM-0001-T1", "", "wire", None), (1, 3, None, "K1", "t1", "K1", "t1", None, None, None),
             (1, 4, None, "K1", None, "gone", None, None, None, None), (1, 5, "", "K1", "t1", "K1", "K1-T2", None, "sheet_ref", None), (2, 1, None, None, None, "K1", None, None, None, None)]
    return spark.createDataFrame(symbols, S), spark.createDataFrame(stops, ST), spark.createDataFrame(wires, C)


def test_replacing_pages_reports_what_leads_nowhere(spark, payload, tmp_path):
    store = bundles.PageStore(spark, str(tmp_path / "store"), 4)
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    skipped = {(x.page_id, x.nth): x.message for x in bundles.replaced_pages(store, pages, *payload).collect()}
    assert skipped == {(1, 3): "K1 -> K1 (self loop)", (1, 4): "K1 -> gone", (2, 1): "None -> K1"}
    symbols = {(x.page_id, x.ref): x for x in store.table("symbols").collect()}
    one, two = symbols[1, "K1"], symbols[1, "SYM-0001"]
    assert set(symbols) == {(1, "K1"), (1, "SYM-0001"), (2, "K1")} and one.label == "R1" and one.attributes == {"a": "1"} and one.class_key == "coil"
    assert (two.cx, two.cy, two.w, two.h, two.label, two.origin) == (1.0, 0.0, 1e-4, 1.0, None, "ai")
    assert {(x.symbol_ref, x.ref, x.name, x.ty) for x in store.table("terminals").collect()} == {("K1", "t1", "13", 0.4), ("K1", "K1-T2", "2", 1.0), ("SYM-0001", "SYM-0001-T1", "x", 0.0)}
    assert {(x.nth, x.ref, x.from_terminal, x.to_terminal, x.kind) for x in store.table("connections").collect()} == {(1, "W-0002", "t1", None, "wire"), (2, "W-0001", None, "SYM-0001-T1", "wire"), (5, "W-0005", "t1", "K1-T2", "sheet_ref")}
    # Page 1 is emptied, page 3 is new, page 2 stays.
    more = [df.withColumn("page_id", F.lit(3).cast("long")) for df in (payload[0].filter("page_id = 2"), payload[1].limit(0), payload[2].limit(0))]
    assert bundles.replaced_pages(store, spark.createDataFrame([(1,), (3,)], "page_id long"), *more).count() == 0
    assert {(x.page_id, x.ref) for x in store.table("symbols").collect()} == {(2, "K1"), (3, "K1")} and store.table("connections").count() == 0


def test_bundles_round_trip_under_new_ids(spark, payload, tmp_path):
    tables = bundles.resolved_payload(*payload)
    pages = spark.createDataFrame([(1, "p1", "ER1", "done", 10, 20, "aa"), (2, "p2", None, "draft", 10, 20, "bb"), (7, "empty", None, None, None, None, None)], bundles.PAGE_FIELDS)
    classes = spark.createDataFrame([("coil", "C", "#1", 0), ("lamp", "L", "#2", 1), ("unused", "U", "#3", 3)], bundles.CLASS_FIELDS)
    folder = str(tmp_path / "bundle")
    bundles.export_bundle(folder, pages, classes, tables, spark.createDataFrame([("aa", bytearray(b"1")), ("zz", bytearray(b"2"))], "sha256 string, content binary"))
    have = spark.createDataFrame([("lamp", "Lampe", "#9", 0), ("x", "X", "#9", 2)], bundles.CLASS_FIELDS)
    got = bundles.import_bundle(bundles.read_bundle(spark, folder), spark.createDataFrame([(40, "old", None, None, 1, 1, None)], bundles.PAGE_FIELDS), have, spark.createDataFrame([("aa",)], "sha256 string"))
    ids = {x.old_id: x.page_id for x in got["mapping"].collect()}
    assert ids == {1: 41, 2: 42, 7: 43} and {x.page_id for x in got["pages"].collect()} == {41, 42, 43}
    for name in ("symbols", "terminals", "connections"):
        plain = lambda df: sorted((repr(x.asDict()) for x in df.collect()))
        moved = tables[name].withColumn("page_id", F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in ids.items() for v in kv]), F.col("page_id")))
        assert plain(got[name].select(*moved.columns)) == plain(moved), name
    assert got["skipped"].count() == 0 and {x.sha256 for x in got["images"].collect()} == {"bb"}
    assert {(x.class_key, x.yolo_index, x.label) for x in got["classes"].collect()} == {("coil", 3, "C"), ("new_kind", 4, "new_kind"), ("unused", 5, "U")}
    assert spark.read.parquet(f"{folder}/images").count() == 1 and spark.read.csv(f"{folder}/connections_csv", header=True).count() == 3


# --- files that people correct ------------------------------------------------------------------------------------------


def test_correspondence_files_round_trip(spark, tmp_path):
    rows = [("set", "ER1", "ER1:K1", "コイル", 'R1 "x", y', None, "接続", "line\nbreak"), ("set", "ER1", "ER1:K2", "", "", "", "", "")]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in T.FIELDS))
    T.write_table(df, str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf" + ",".join(T.COLUMNS).encode())
    (tmp_path / "s").mkdir()
    lines = ["シナリオID,問い,対象・起点,成立条件,入力の状態,期待する判定,影響先,ページ,備考", 'S1,起動条件,Y,A & B,"A=1, B=0、C=?，D=オフ",不成立,,P1、P2,', "S1,,Y,,A=on,成立,,P2,", ",影響,A,,,,\"Y, L\",,", ",,,,,,,,", ",影響,B,,,,,,"]
    (tmp_path / "s" / "a.csv").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "s" / "b.csv").write_text("other,header\n1,2\n", encoding="utf-8")
    (tmp_path / "s" / "c.csv").write_bytes(b"")
    back = T.read_tables(spark, str(tmp_path / "t"))
    assert [tuple(x[f] for f in T.FIELDS) for x in back["table"].orderBy("nth").collect()] == [tuple(v or "" for v in r) for r in rows] and back["scenarios"].count() == 0
    told, cases = T.scenarios_of(T.read_tables(spark, str(tmp_path / "s"))["scenarios"])
    assert {(x.scenario_id, x.question, x.subject, x.condition, tuple(x.affected), tuple(x.pages), x.forward) for x in told.collect()} == {
        ("S1", "起動条件", "Y", "A & B", (), ("P1", "P2"), False), ("S2", "影響", "A", None, ("L", "Y"), (), True), ("S3", "影響", "B", None, (), (), True),
    }
    assert [(x.nth, x.states, x.expected) for x in cases.orderBy("nth").collect()] == [(0, {"A": True, "B": False, "C": None, "D": False}, "不成立"), (1, {"A": True}, "成立")]
    T.write_table(df.limit(0), str(tmp_path / "none"))
    assert T.read_tables(spark, str(tmp_path / "none"))["table"].count() == 0
    same = spark.createDataFrame([('A=1, A=0, "B"=1, A=?',), ("",), (None,)], "t string").select(T.case_states(F.col("t")).alias("m")).collect()
    assert [x.m for x in same] == [{"A": None, "B": True}, {}, None]


# --- timers -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("mode", ["on", "off"])
def test_timers_fire_without_further_events(spark, tmp_path, mode):
    """Out of order within the watermark, several files, against the batch operator; a late event of another key moves the time on."""
    r, delay = random.Random(8), 90.0
    rows = []
    for k in range(4):
        at = 50_000
        for _ in range(40):
            at += r.randrange(5, 200)
            rows.append((k, at, r.random() < 0.5))
    last = max(x[1] for x in rows)
    files = [[] for _ in range(4)]
    for x in sorted(rows, key=lambda x: x[1]):
        files[min(3, max(0, int(4 * (x[1] - 50_000 + r.randrange(-300, 300)) / (last - 50_000))))].append(x)
    schema = "k int, s long, v boolean"
    frame = lambda x: spark.createDataFrame(x, schema).select("k", F.timestamp_seconds("s").alias("ts"), "v")
    for i, x in enumerate([*files, [(9, last + 100_000, False)]]):
        r.shuffle(x)
        frame(x).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema(frame([]).schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = E.timer_changes(stream, "k", "ts", "v", delay, "30 minutes", mode).writeStream.format("memory").queryName(f"changes_{mode}").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((x.key, x.at_s, x.output) for x in spark.table(f"changes_{mode}").collect())
    spans = sequences.delayed(spark.createDataFrame(rows, schema), ["k"], "s", "v", delay, mode).collect()
    want = sorted([(x.k, float(x["from"]), True) for x in spans] + [(x.k, float(x.to), False) for x in spans if x.to is not None])
    assert got == want and {x[0] for x in got} == {0, 1, 2, 3}
