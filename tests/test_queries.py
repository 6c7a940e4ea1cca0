"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
from pathlib import Path

import pytest

from rungspark.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if Path(path).is_dir() else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    return round(float(v), 6)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert df.columns
        return
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


def test_greedy_match_equals_sequential(spark):
    import random

    from rungspark.operators.spatial import mutual_best

    r = random.Random(4)
    rows = [(g, f"l{i}", f"r{j}", r.choice([0.2, 0.5, 0.5, 0.9])) for g in range(6) for i in range(6) for j in range(6) if r.random() < 0.6]
    want = set()
    for g in range(6):
        left, right = set(), set()
        for _, a, b, s in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[3], x[1], x[2])):
            if a not in left and b not in right:
                left.add(a), right.add(b), want.add((g, a, b, s))
    df = spark.createDataFrame(rows, "g int, l string, r string, s double")
    assert {tuple(x) for x in mutual_best(df, ["g"], "l", "r", "s").select("g", "l", "r", "s").collect()} == want


def test_components_do_not_depend_on_edge_order(spark):
    from rungspark.operators.graph import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    for rows in (edges, edges[::-1]):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a int, b int")).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_graphs_against_brute_force(spark):
    import random
    from collections import defaultdict

    from rungspark.operators.graph import connected_components, reach

    r = random.Random(3)
    edges, near = [(r.randrange(60), r.randrange(60)) for _ in range(50)] + [(None, 3), (7, 7)], defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b), near[b].add(a)
    depth = {}
    for start in near:
        seen, front = {start: 0}, [start]
        while front:
            front = [n for x in front for n in near[x] if n not in seen and not seen.update({n: seen[x] + 1})]
        depth[start] = seen
    df = spark.createDataFrame(edges, "a int, b int")
    assert {(x.node, x.component) for x in connected_components(df).collect()} == {(n, min(depth[n])) for n in near}
    both = df.unionByName(df.selectExpr("b AS a", "a AS b"))
    got = reach(both, spark.createDataFrame([(n,) for n in near], "a int"), 4, "a", "b")
    assert {tuple(x) for x in got.collect()} == {(a, n, d) for a in near for n, d in depth[a].items() if d <= 4}
    assert connected_components(df.limit(0)).count() == 0


def test_absorption_and_numbers_against_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from rungspark.operators.relational import absorbed, free_numbers, numbered

    r = random.Random(5)
    sets = {i: sorted({r.randrange(12) for _ in range(r.randrange(1, 7))}) for i in range(60)}
    held = lambda i, s, all_: any(j != i and set(u) <= set(s) and (len(u) < len(s) or j < i) for j, u in all_.items())
    for extra in ({}, {70: [], 71: []}):
        every = sets | extra
        df = spark.createDataFrame(list(every.items()), "i int, s array<int>")
        assert {x.i for x in absorbed(df, "i", "s").collect()} == {i for i, s in every.items() if not held(i, s, every)}
    used, wanted = [r.randrange(-3, 40) for _ in range(25)] + [None], [(i, r.randrange(9)) for i in range(30)]
    free = [k for k in range(1, 200) if k not in used]
    df = free_numbers(spark.createDataFrame(wanted, "id int, x int"), spark.createDataFrame([(k,) for k in used], "u int"), "u", [F.col("x"), F.col("id")])
    assert {x.id: x.u for x in df.collect()} == {i: n for (i, _), n in zip(sorted(wanted, key=lambda w: (w[1], w[0])), free)}
    none = spark.createDataFrame([], "u int")
    assert sorted(x.u for x in free_numbers(spark.createDataFrame(wanted, "id int, x int"), none, "u", [F.col("id")]).collect()) == list(range(1, 31))
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(50)], "id int, g int")
    got = {(x.id): x.nth for x in numbered(rows, ["g"], [F.desc("id")], "nth").collect()}
    for g in (None, 0, 1, 2):
        mine = sorted((i for i in range(50) if (None if i % 5 == 0 else i % 3) == g), reverse=True)
        assert [got[i] for i in mine] == list(range(1, len(mine) + 1))
    assert numbered(rows.limit(0), ["g"], [F.col("id")], "nth").count() == 0
