"""Paths, open ends and effects against brute force; empty tables, nulls and ties."""

import random
from collections import defaultdict
from itertools import product

from pyspark.sql import functions as F

from rungspark.operators import wiring as W


def test_shortest_paths_against_brute_force(spark):
    r = random.Random(8)
    edges = sorted({(r.randrange(14), r.randrange(14)) for _ in range(22)})
    through, near = set(range(0, 14, 2)) | {1, 5, 7}, defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)

    def least(left, right, most):
        paths = [[left]]
        for _ in range(most):
            paths = [[*p, n] for p in paths if p[-1] == left or p[-1] in through for n in near[p[-1]] if n not in p]
            done = [p for p in paths if p[-1] == right]
            if done:
                return min(done)
        return None

    pairs = list(product(range(14), range(14))) + [(None, 3), (3, None)]
    want = {(a, b): least(a, b, 4) for a, b in pairs if a != b and None not in (a, b) and least(a, b, 4)}
    df = spark.createDataFrame(edges + [(None, 2)], "a int, b int")
    found = W.shortest_paths(df, spark.createDataFrame(pairs * 2, "left int, right int"), spark.createDataFrame([(n,) for n in through], "node int"), 4)
    assert {(x.left, x.right): x.path for x in found.collect()} == want
    assert W.shortest_paths(df.limit(0), spark.createDataFrame([(1, 2)], "left int, right int"), spark.createDataFrame([(1,)], "node int"), 4).count() == 0


def test_open_ends_do_not_cross_buses(spark):
    edges = spark.createDataFrame([(1, 2), (2, 9), (9, 3), (3, 4), (2, 5)], "a int, b int")
    nodes = lambda *x: spark.createDataFrame([(n,) for n in x], "node int")
    got = W.open_ends(edges, nodes(1, 3, 9, 7, 7), nodes(4, 5, 7, 9), nodes(9))
    assert {tuple(x) for x in got.collect()} == {(1, 5), (3, 4), (7, 7)}
    assert W.open_ends(edges, nodes(1).limit(0), nodes(4), nodes(9)).count() == 0


def test_effects_and_explanations(spark):
    rows = [("C1", 1, "S1"), ("C1", 1, "C1"), ("C1", 2, "S1"), ("C1", 2, "S2"), ("C2", 1, "C1"), ("L", 1, "C2"), ("L", 2, "S1")]
    lits = spark.createDataFrame(rows + rows[:2], "load string, branch int, device string")
    start = spark.createDataFrame([("S1",), ("S2",), ("none",)], "device string")
    got = {tuple(x) for x in W.effects(lits, start).collect()}
    assert got == {
        ("S1", "C1", 1, "S1", "must"), ("S1", "L", 1, "S1", "partial"), ("S1", "C2", 2, "C1", "must"),
        ("S2", "C1", 1, "S2", "partial"), ("S2", "C2", 2, "C1", "must"), ("S2", "L", 3, "C2", "partial"),
    }
    tree = {tuple(x) for x in W.explained(lits, spark.createDataFrame([("L",)], "load string"), 1).collect()}
    assert tree == {("L", "L", 0, "C2", "relay"), ("L", "L", 0, "S1", "input"), ("L", "C2", 1, "C1", "limit")}
    whole = {tuple(x) for x in W.explained(lits, spark.createDataFrame([("L",)], "load string")).collect()}
    assert ("L", "C1", 2, "C1", "seen") in whole and ("L", "C1", 2, "S2", "input") in whole
    assert W.effects(lits.limit(0), start).count() == 0


def test_table_rows_take_one_contact_each(spark):
    rows = spark.createDataFrame([(1, 1, "R1", 3.0, 2.0), (1, 2, "R1", 3.0, 2.0), (1, 3, "R2", 9.0, 9.0), (1, 4, None, None, 1.0)], "page int, row_id int, device string, u double, v double")
    contacts = spark.createDataFrame([(1, 10, "R9", 3.0, 2.5), (1, 11, "R1", 4.0, 3.5), (2, 12, "R2", 9.0, 9.0), (1, 13, None, None, None)], "page int, contact_id int, c_device string, cu double, cv double")
    got = {tuple(x) for x in W.table_matches(rows, contacts, ["page"]).collect()}
    assert got == {(1, 1, 11, True, True), (1, 2, 10, False, False), (1, 3, None, False, False), (1, 4, None, False, False)}
    assert W.table_matches(rows.limit(0), contacts, ["page"]).count() == 0


def test_decisions_from_cues(spark):
    items = spark.createDataFrame([(i, "coil") for i in range(5)], "id int, class_key string")
    cues = spark.createDataFrame([(0, "mark", "lamp"), (1, "near", "lamp"), (2, "near", "lamp"), (2, "inside", "lamp"), (3, "mark", "lamp"), (3, "table", "coil")], "id int, source string, suggests string")
    got = {x.id: (x.class_key, x.status) for x in W.decided(items, cues, ["id"], ["mark", "table"]).collect()}
    review = "review_required"
    assert got == {0: ("lamp", "confirmed"), 1: ("coil", review), 2: ("lamp", "confirmed"), 3: ("coil", review), 4: ("coil", review)}
    assert {x.status for x in W.decided(items, cues.limit(0), ["id"], ["mark"]).collect()} == {review}


def test_devices_come_from_their_worst_contact(spark):
    rows = [("A", True, False, False, None), ("B", False, True, True, "X1"), ("C", False, False, True, None), ("C", False, False, True, "X9"), ("D", False, False, True, "X1"), ("D", False, False, True, "X9"), ("E", False, False, False, "X9")]
    contacts = spark.createDataFrame([(1, *x) for x in rows], "c int, device string, has_coil boolean, external boolean, readable boolean, ref_sheet string")
    got = {x.device: (x.source, x.ref_sheet, x.contacts) for x in W.device_sources(contacts, spark.createDataFrame([(1, "X1"), (2, "X9")], "c int, sheet string"), ["c"]).collect()}
    assert got == {"A": ("RELAY", None, 1), "B": ("INPUT", None, 1), "C": ("MISSING_REFERENCE", "X9", 2), "D": ("UNRESOLVED", "X1", 2), "E": ("UNRESOLVED", None, 1)}


def test_small_functions(spark):
    df = spark.createDataFrame([("33HB", "33HB"), ("830-1", "830-1"), ("143 E", "E"), ("", ""), ("D010(2)", "D010(2)"), ("盤異常", "盤異常")], "label string, token string")
    assert [x[0] for x in df.select(W.doubtful(F.col("label"), F.col("token"))).collect()] == [False, True, True, True, False, True]
    filled = spark.createDataFrame([({"a": "1", "z": "2"},), (None,)], "m map<string,string>").select(W.with_template(F.col("m"), ["a", "b"]).alias("m"))
    assert [x.m for x in filled.collect()] == [{"a": "1", "b": None, "z": "2"}, {"a": None, "b": None}]
    dots = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 50.0, 3.0), (1, 3, 20.0, 0.0), (1, 4, 0.0, -500.0), (1, 5, None, 0.0)], "page int, dot_id int, x double, y double")
    assert {(x.dot_id, x.direction, x.other_id) for x in W.next_ahead(dots, ["page"], 5, 100).collect()} == {(1, "right", 3), (3, "left", 1), (3, "right", 2), (2, "left", 3)}
    nothing = W.evidence(dots.select("page", F.lit(None).cast("int").alias("i")), ["page"], "i", 3)
    assert nothing.count() == 0


def test_dots_drop_weaker_ones_in_order(spark):
    r = random.Random(4)
    rows = [(i % 3, i, float(r.randrange(60)), float(r.randrange(60)), r.randrange(10) / 10, r.randrange(5)) for i in range(90)]
    want = set()
    for page in range(3):
        kept = []
        mine = [x for x in rows if x[0] == page and (x[4] >= 0.6 or (x[4] >= 0.3 and x[5] >= 3))]
        for x in sorted(mine, key=lambda x: (x[4] < 0.6, -x[4], x[1])):
            if all((x[2] - k[2]) ** 2 + (x[3] - k[3]) ** 2 > 81 for k in kept):
                kept.append(x)
        want |= {x[1] for x in kept}
    df = spark.createDataFrame([*rows, (0, 500, None, 1.0, 0.9, 4)], "page int, dot_id int, x double, y double, score double, arms int")
    assert {x.dot_id for x in W.accepted_dots(df, ["page"], 0.6, 0.3, 9.0).collect()} == want | {500}
    assert W.accepted_dots(df.limit(0), ["page"], 0.6, 0.3, 9.0).count() == 0


def test_bridges_links_and_merges(spark):
    ends = spark.createDataFrame([(1, 1, 0.0, 5.0, 1, True), (1, 2, 0.0, 5.0, -1, True), (1, 3, 0.0, 5.0, 1, False), (1, 4, 9.5, 5.0, 1, True), (1, 5, -60.0, 5.0, 1, True)], "page int, end_id int, ex double, ey double, way int, true_end boolean")
    wires = spark.createDataFrame([(1, 7, 10.0, 0.0, 50.0), (1, 8, 40.0, 0.0, 50.0)], "page int, wire_id int, x double, y0 double, y1 double")
    terminals = spark.createDataFrame([(1, 45.0, 8.0)], "page int, tx double, ty double")
    got = {tuple(x) for x in W.perpendicular_bridges(ends, wires, terminals, ["page"]).collect()}
    assert got == {(1, 1, 7, 10.0), (1, 3, 8, 40.0), (1, 4, 8, 30.5)}
    assert W.perpendicular_bridges(ends.limit(0), wires, terminals, ["page"]).count() == 0
    own = spark.createDataFrame([(1, "A", "x"), (1, None, "y")], "s int, name string, extra string")
    new = spark.createDataFrame([(1, "A"), (1, "B"), (1, "B"), (2, "A")], "s int, name string")
    assert {tuple(x) for x in W.merged_terminals(own, new, ["s"], "name").collect()} == {(1, "A", "x", "own"), (1, None, "y", "own"), (1, "B", None, "found"), (2, "A", None, "found")}
    assert {tuple(x) for x in W.reconciled(new, new.filter("s = 1 AND name = 'B'").limit(1).union(spark.createDataFrame([(9, "Z")], "s int, name string")), ["s", "name"]).collect()} == {
        (1, "A", 1, 0, "missing"), (1, "B", 2, 1, "differs"), (2, "A", 1, 0, "missing"), (9, "Z", 0, 1, "extra")}
