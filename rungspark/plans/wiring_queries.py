"""Queries of operators/wiring.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import wiring as W
from .queries import long, query, seconds, t


@query("""
WITH x AS (SELECT l_suppkey % 50 AS circuit, l_partkey AS device, l_partkey % 7 = 0 AS coil, l_discount = 0 AS ext, l_tax <> 0.08 AS readable, CASE WHEN l_linestatus = 'O' THEN 'S' || l_orderkey % 10 END AS sheet FROM lineitem),
s AS (SELECT DISTINCT s_suppkey % 50 AS circuit, 'S' || s_nationkey % 10 AS sheet, true AS known FROM supplier),
r AS (SELECT x.*, CASE WHEN ext THEN 0 WHEN NOT readable THEN 2 WHEN x.sheet IS NULL THEN 0 WHEN known THEN 2 ELSE 1 END AS k, CASE WHEN NOT ext AND readable THEN x.sheet END AS named FROM x LEFT JOIN s USING (circuit, sheet)),
g AS (SELECT circuit, device, bool_or(coil) AS coil, max(k) AS k, min(named) FILTER (WHERE k = 1) AS s1, min(named) FILTER (WHERE k = 2) AS s2, count(*) AS contacts FROM r GROUP BY 1, 2)
SELECT circuit, device, CASE WHEN coil THEN 'RELAY' WHEN k = 0 THEN 'INPUT' WHEN k = 1 THEN 'MISSING_REFERENCE' ELSE 'UNRESOLVED' END AS source, CASE WHEN coil THEN NULL WHEN k = 1 THEN s1 WHEN k = 2 THEN s2 END AS ref_sheet, contacts FROM g""")
def device_sources(spark, sf):
    c = F.col
    contacts = t(spark, sf, "lineitem").select(
        (c("l_suppkey") % 50).alias("circuit"), c("l_partkey").alias("device"), (c("l_partkey") % 7 == 0).alias("has_coil"), (c("l_discount") == 0).alias("external"),
        (c("l_tax") != 0.08).alias("readable"), F.when(c("l_linestatus") == "O", F.concat(F.lit("S"), (c("l_orderkey") % 10).cast("string"))).alias("ref_sheet"))
    sheets = t(spark, sf, "supplier").select((c("s_suppkey") % 50).alias("circuit"), F.concat(F.lit("S"), (c("s_nationkey") % 10).cast("string")).alias("sheet"))
    return W.device_sources(contacts, sheets, ["circuit"])


@query("""
WITH RECURSIVE x AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber AS n, l_partkey % 3 AS device, l_quantity / 10 AS u, l_suppkey % 4 / 2 AS v FROM lineitem ORDER BY ALL),
p AS (SELECT a.l_orderkey, a.n AS row_id, b.n AS contact_id, a.device = b.device AS same, round(CASE WHEN a.device = b.device THEN 10 ELSE 0 END - abs(b.u - a.u) - 0.5 * abs(b.v - a.v - 0.5), 9) AS score
  FROM x a JOIN x b USING (l_orderkey) WHERE a.n % 2 = 1 AND b.n % 2 = 0 AND abs(b.u - a.u) <= 1 AND b.v - a.v BETWEEN -0.5 AND 1.5),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, row_id, contact_id) AS k FROM p),
g AS (SELECT l_orderkey, 0 AS k, []::BIGINT[] AS lt, []::BIGINT[] AS rt FROM (SELECT DISTINCT l_orderkey FROM p) UNION ALL
  SELECT g.l_orderkey, o.k, CASE WHEN list_contains(lt, row_id) OR list_contains(rt, contact_id) THEN lt ELSE list_append(lt, row_id::BIGINT) END,
  CASE WHEN list_contains(lt, row_id) OR list_contains(rt, contact_id) THEN rt ELSE list_append(rt, contact_id::BIGINT) END FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.k = g.k + 1),
z AS (SELECT l_orderkey, unnest(lt) AS row_id, unnest(rt) AS contact_id FROM (SELECT l_orderkey, arg_max(lt, k) AS lt, arg_max(rt, k) AS rt FROM g GROUP BY 1)),
m AS (SELECT l_orderkey, row_id, count(*) FILTER (WHERE same) AS c FROM p GROUP BY 1, 2)
SELECT x.l_orderkey, x.n AS row_id, z.contact_id, coalesce(p.same, false) AS device_match, coalesce(p.same AND c = 1, false) AS "unique"
FROM x LEFT JOIN z ON z.l_orderkey = x.l_orderkey AND z.row_id = x.n LEFT JOIN p ON p.l_orderkey = x.l_orderkey AND p.row_id = x.n AND p.contact_id = z.contact_id LEFT JOIN m ON m.l_orderkey = x.l_orderkey AND m.row_id = x.n WHERE x.n % 2 = 1""")
def relay_table_matches(spark, sf):
    """An order's odd lines are the rows of a table, its even lines the contacts."""
    c = F.col
    x = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_partkey") % 3).alias("device"), (c("l_quantity") / 10).alias("u"), (c("l_suppkey") % 4 / 2).alias("v"))
    x = x.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("device", "u", "v")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    rows = x.filter("l_linenumber % 2 = 1").withColumnRenamed("l_linenumber", "row_id")
    contacts = x.filter("l_linenumber % 2 = 0").select("l_orderkey", c("l_linenumber").alias("contact_id"), c("device").alias("c_device"), c("u").alias("cu"), c("v").alias("cv"))
    return W.table_matches(rows, contacts, ["l_orderkey"])


@query("""
WITH c AS (SELECT l_orderkey, count(DISTINCT l_linestatus) AS n, count(DISTINCT l_linenumber % 3) AS m, min(l_linestatus) AS one, bool_or(l_linenumber % 3 = 2) AS strong FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_orderkey, CASE WHEN n = 1 AND (m >= 2 OR strong) THEN one ELSE o_orderstatus END AS class_key, CASE WHEN n = 1 AND (m >= 2 OR strong) THEN 'confirmed' ELSE 'review_required' END AS status FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def class_by_cues(spark, sf):
    cues = t(spark, sf, "lineitem").filter("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 3).cast("string").alias("source"), F.col("l_linestatus").alias("suggests"))
    items = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("class_key"))
    return W.decided(items, cues, ["o_orderkey"], ["2"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_partkey % 2 = 0 AND l_tax < 0.02) OR (l_suppkey % 2 = 0 AND l_partkey % 2 <> 0 AND l_discount < 0.02) THEN 'terminal' WHEN l_quantity >= 30 THEN 'junction' ELSE 'review' END AS role FROM lineitem""")
def dot_roles(spark, sf):
    c = F.col
    role = W.dot_role(c("l_partkey") % 2 == 0, c("l_tax") < 0.02, c("l_suppkey") % 2 == 0, c("l_discount") < 0.02, c("l_quantity") / 10)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", role.alias("role"))


_LABELS = """WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || upper(substr(p_type, 1, 2)) WHEN 1 THEN upper(substr(p_name, 1, 3)) || p_size WHEN 2 THEN (p_partkey * 7)::VARCHAR || upper(substr(p_type, 1, 1)) ELSE p_partkey::VARCHAR END AS crop,
upper(substr(p_brand, 1, 1)) || p_size AS page FROM part)"""


def _labels(spark, sf) -> DataFrame:
    c = F.col
    k = c("p_partkey") % 4
    crop = F.when(k == 0, F.concat(c("p_size").cast("string"), F.upper(F.substring("p_type", 1, 2)))).when(k == 1, F.concat(F.upper(F.substring("p_name", 1, 3)), c("p_size").cast("string")))
    crop = crop.when(k == 2, F.concat((c("p_partkey") * 7).cast("string"), F.upper(F.substring("p_type", 1, 1)))).otherwise(c("p_partkey").cast("string"))
    return t(spark, sf, "part").select("p_partkey", crop.alias("crop"), F.concat(F.upper(F.substring("p_brand", 1, 1)), c("p_size").cast("string")).alias("page"))


@query(_LABELS + r""" SELECT p_partkey, crop, regexp_full_match(crop, '\d{3,}') OR NOT regexp_full_match(crop, '\d{1,2}0?[A-Z][A-Z0-9]*(?:-\d{1,2})?|[A-Z]{1,4}\d{0,4}[A-Z]?(?:-\d{1,2})?') AS doubtful FROM x""")
def doubtful_labels(spark, sf):
    return _labels(spark, sf).select("p_partkey", "crop", W.doubtful(F.col("crop"), F.col("crop")).alias("doubtful"))


@query(_LABELS + """, n AS (SELECT w, count(*) AS n FROM (SELECT crop AS w FROM x UNION ALL SELECT page FROM x) GROUP BY 1)
SELECT p_partkey, CASE WHEN a.n - 1 < 2 AND b.n - 1 >= 2 THEN page ELSE crop END AS label FROM x JOIN n a ON a.w = crop JOIN n b ON b.w = page""")
def best_labels(spark, sf):
    """A word's own reading does not count as another one."""
    x = _labels(spark, sf)
    words = x.select(F.col("crop").alias("token")).unionByName(x.select(F.col("page").alias("token"))).groupBy("token").agg((F.count(F.lit(1)) - 1).alias("n"))
    return W.best_labels(x, words, "crop", "page").select("p_partkey", "label")


@query("""
WITH n AS (SELECT p_partkey AS node, p_size % 2 = 0 AS j, p_size % 3 = 0 AS c FROM part), i AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS wire FROM lineitem),
a AS (SELECT o_orderkey AS record, o_orderkey % 1000 AS node, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS preferred FROM orders),
w AS (SELECT record, a.node, coalesce(preferred, wire) AS wire, coalesce(j, false) AS j, coalesce(c, false) AS c FROM a LEFT JOIN n ON n.node = a.node LEFT JOIN i ON i.node = a.node)
SELECT DISTINCT record, CASE WHEN j AND NOT c THEN 'node:' || node || '@' || coalesce(wire::VARCHAR, 'unknown') ELSE 'node:' || node END AS graph_node FROM w""")
def anchor_nodes(spark, sf):
    c = F.col
    nodes = t(spark, sf, "part").select(c("p_partkey").alias("node"), (c("p_size") % 2 == 0).alias("junction"), (c("p_size") % 3 == 0).alias("conducts"))
    anchors = t(spark, sf, "orders").select(c("o_orderkey").alias("record"), (c("o_orderkey") % 1000).alias("node"), F.when(c("o_orderstatus") == "F", c("o_custkey")).alias("preferred"))
    return W.anchored(anchors, nodes, t(spark, sf, "lineitem").select(c("l_partkey").alias("node"), c("l_suppkey").alias("wire")))


_CHAIN = """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT, event_id) AS place FROM events)"""


def _chain(spark, sf) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type", seconds("ts").alias("s"))
    return e.withColumns({"place": F.row_number().over(w), "b": F.lead("event_id").over(w)})


@query(_CHAIN + """, p AS (SELECT *, lead(event_id) OVER w AS r, lead(place) OVER w AS upto FROM e WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY place))
SELECT p.event_id AS "left", r AS "right", string_agg(e.event_id::VARCHAR, '-' ORDER BY e.place) AS path FROM p JOIN e ON e.user_id = p.user_id AND e.place BETWEEN p.place AND upto WHERE upto - p.place <= 6 GROUP BY 1, 2""")
def shortest_paths(spark, sf):
    """From each purchase of a user to the next one, over at most six steps."""
    e = _chain(spark, sf)
    bought = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("left"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("place")).alias("right"))
    through = e.filter("event_type <> 'purchase'").select("event_id")
    found = W.shortest_paths(e.filter("b IS NOT NULL").select(F.col("event_id").alias("a"), "b"), bought.filter("right IS NOT NULL"), through, 6)
    return found.withColumn("path", F.concat_ws("-", F.transform("path", lambda x: x.cast("string"))))


@query(_CHAIN + """, r AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY place) AS run FROM e)
SELECT a.event_id AS start, b.event_id AS "end" FROM r a JOIN r b USING (user_id, run) WHERE a.event_type = 'click' AND b.event_type = 'error'""")
def open_ends(spark, sf):
    """Clicks and the errors that are joined to them with no purchase between."""
    e = _chain(spark, sf)
    of = lambda kind: e.filter(F.col("event_type") == kind).select(F.col("event_id").alias("node"))
    return W.open_ends(e.filter("b IS NOT NULL").select(F.col("event_id").alias("a"), "b"), of("click"), of("error"), of("purchase"))


_LITERALS = """WITH RECURSIVE l AS (SELECT p_partkey AS load, unnest([1, 1, 2]) AS branch, unnest([2 * p_partkey, 3 * p_partkey, 2 * p_partkey]) AS device FROM part WHERE p_partkey > 0),
d AS (SELECT DISTINCT load, device FROM l)"""


def _literals(spark, sf) -> DataFrame:
    p = t(spark, sf, "part").filter("p_partkey > 0")
    pair = lambda b, n: F.struct(F.lit(b).alias("branch"), (F.col("p_partkey") * n).alias("device"))
    return p.select(F.col("p_partkey").alias("load"), F.explode(F.array(pair(1, 2), pair(1, 3), pair(2, 2))).alias("x")).select("load", "x.*")


@query(_LITERALS + """, r AS (SELECT p_partkey AS root, p_partkey AS load, 0 AS depth FROM part WHERE p_partkey > 0 UNION SELECT root, device, depth + 1 FROM r JOIN d USING (load) WHERE device IN (SELECT p_partkey FROM part) AND depth < 3),
a AS (SELECT root, load, min(depth) AS depth FROM r GROUP BY 1, 2)
SELECT a.root, a.load, a.depth, device, CASE WHEN device NOT IN (SELECT p_partkey FROM part) THEN 'input' WHEN n.depth IS NULL THEN 'limit' WHEN n.depth = a.depth + 1 THEN 'relay' ELSE 'seen' END AS kind
FROM a JOIN d USING (load) LEFT JOIN a n ON n.root = a.root AND n.load = device""")
def explained_conditions(spark, sf):
    """A part asks for its double and triple numbers; those that are parts are relays."""
    x = _literals(spark, sf)
    return W.explained(x, x.select("load").distinct(), 3)


@query(_LITERALS + """, r AS (SELECT device AS start, device AS node, 0 AS depth FROM d UNION SELECT start, load, depth + 1 FROM r JOIN d ON device = node WHERE depth < 4),
a AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2), m AS (SELECT a.start, a.node AS target, a.depth, min(v.node) AS via FROM a JOIN d ON d.load = a.node JOIN a v ON v.start = a.start AND v.node = d.device AND v.depth + 1 = a.depth GROUP BY 1, 2, 3)
SELECT m.*, CASE WHEN via = 2 * target THEN 'must' ELSE 'partial' END AS role FROM m""")
def forward_effects(spark, sf):
    x = _literals(spark, sf)
    return W.effects(x, x.select("device").distinct(), 4)


@query("""
SELECT c_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS link_index FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def terminal_records(spark, sf):
    links = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return W.terminal_records(t(spark, sf, "customer").select("c_custkey"), links, ["c_custkey"], ["o_orderkey"]).withColumn("link_index", long("link_index"))


@query("""
WITH x AS (SELECT label, vec_id, floor(embedding[1]::DOUBLE * 1000) AS x, floor(embedding[2]::DOUBLE * 1000) AS y FROM embeddings),
m AS (SELECT a.label, a.vec_id AS dot_id, b.vec_id AS other_id, b.x - a.x AS dx, b.y - a.y AS dy FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id),
w AS (SELECT *, CASE WHEN dx > 0 THEN 'right' ELSE 'left' END AS direction, abs(dx) AS gap FROM m WHERE abs(dy) <= 8 AND dx <> 0 AND abs(dx) <= 60 UNION ALL
SELECT *, CASE WHEN dy > 0 THEN 'down' ELSE 'up' END, abs(dy) FROM m WHERE abs(dx) <= 8 AND dy <> 0 AND abs(dy) <= 60)
SELECT label, dot_id, direction, arg_min(other_id, (gap, other_id)) AS other_id, min(gap) AS gap FROM w GROUP BY 1, 2, 3""")
def dots_ahead(spark, sf):
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 1000).cast("double")
    dots = t(spark, sf, "embeddings").select("label", F.col("vec_id").alias("dot_id"), at(0).alias("x"), at(1).alias("y"))
    return W.next_ahead(dots, ["label"], 8, 60)


_PLACED = """WITH q AS (SELECT label, vec_id, floor(embedding[5]::DOUBLE * 1000) AS px, floor(embedding[6]::DOUBLE * 1000) AS py, floor(embedding[1]::DOUBLE * 1000) AS a, floor(embedding[2]::DOUBLE * 1000) AS b, floor(embedding[3]::DOUBLE * 1000) AS c, floor(embedding[4]::DOUBLE * 1000) AS d FROM embeddings),
s AS (SELECT label, vec_id, least(a, b) AS x0, greatest(a, b) AS x1, least(c, d) AS y0, greatest(c, d) AS y1 FROM q)"""


def _placed(spark, sf) -> tuple[DataFrame, DataFrame]:
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 1000).cast("double")
    e = t(spark, sf, "embeddings").select("label", "vec_id", at(4).alias("px"), at(5).alias("py"), *[at(i).alias(n) for i, n in enumerate("abcd")])
    spans = e.select("label", "vec_id", F.least("a", "b").alias("x0"), F.greatest("a", "b").alias("x1"), F.least("c", "d").alias("y0"), F.greatest("c", "d").alias("y1"))
    return e.select("label", "vec_id", "px", "py"), spans


@query(_PLACED + """, m AS (SELECT q.label, q.vec_id AS terminal_id, s.vec_id AS wire_id, greatest(x0 - px, px - x1, 0) AS away, abs(py - y0) AS off FROM q JOIN s ON s.label = q.label)
SELECT label, terminal_id, arg_min(wire_id, (away + 2 * off, wire_id)) AS wire_id, min(away + 2 * off) AS cost, arg_min(away = 0, (away + 2 * off, wire_id)) AS inside FROM m WHERE away <= 240 AND off <= 28 GROUP BY 1, 2""")
def collinear_bridges(spark, sf):
    points, spans = _placed(spark, sf)
    wires = spans.select("label", F.col("vec_id").alias("wire_id"), "x0", "x1", F.col("y0").alias("y"))
    return W.collinear_bridges(points.withColumnRenamed("vec_id", "terminal_id"), wires, ["label"])


@query(_PLACED + """, w AS (SELECT label, px, py, 'W' || vec_id % 11 AS word FROM q),
m AS (SELECT s.label, s.vec_id, count(DISTINCT word) AS n, bool_or(word IN ('W3', 'W7')) AS has FROM s JOIN w ON w.label = s.label AND px BETWEEN x0 - 30 AND x1 + 30 AND py BETWEEN y0 - 30 AND y1 + 30 AND NOT (px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1) GROUP BY 1, 2)
SELECT s.label, s.vec_id AS box_id, coalesce(n, 0) AS n_texts, coalesce(has, false) AS has_word FROM s LEFT JOIN m USING (label, vec_id)""")
def words_near_boxes(spark, sf):
    points, spans = _placed(spark, sf)
    texts = points.select("label", F.col("px").alias("tx"), F.col("py").alias("ty"), F.concat(F.lit("W"), (F.col("vec_id") % 11).cast("string")).alias("word"))
    return W.words_near(spans.withColumnRenamed("vec_id", "box_id"), texts, ["label"], 30.0, "^(W3|W7)$")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind, CASE WHEN p_size % 3 = 0 THEN p_brand END AS maker FROM part""")
def template_columns(spark, sf):
    c = F.col
    pairs = F.map_from_entries(F.filter(F.array(F.struct(F.lit("kind"), F.when(c("p_size") % 2 == 0, c("p_type"))), F.struct(F.lit("maker"), F.when(c("p_size") % 3 == 0, c("p_brand")))), lambda x: x["col2"].isNotNull()))
    full = t(spark, sf, "part").select("p_partkey", W.with_template(pairs, ["kind", "maker"]).alias("m"))
    return full.select("p_partkey", c("m")["kind"].alias("kind"), c("m")["maker"].alias("maker"))


@query("""
WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM d)
SELECT l_suppkey, count(*) AS total, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) FILTER (WHERE k <= 20) AS items FROM r GROUP BY 1""")
def evidence_lists(spark, sf):
    found = W.evidence(t(spark, sf, "lineitem"), ["l_suppkey"], "l_partkey", 20)
    return found.withColumn("items", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))))


_DOTS = """q AS (SELECT label, vec_id, floor(embedding[1]::DOUBLE * 1000) AS x, floor(embedding[2]::DOUBLE * 1000) AS y, floor(embedding[3]::DOUBLE * 1000) AS s, vec_id % 5 AS arms FROM embeddings)"""


def _xy(spark, sf, *names: str) -> DataFrame:
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 1000).cast("double")
    return t(spark, sf, "embeddings").select("label", "vec_id", *[at(i).alias(n) for i, n in enumerate(names)])


@query("WITH RECURSIVE " + _DOTS + """, c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s < 50, s DESC, vec_id) AS n FROM q WHERE s >= 50 OR (s >= -50 AND arms >= 3)),
x AS (SELECT a.label, a.vec_id, list(b.vec_id) AS near FROM c a JOIN c b ON a.label = b.label AND a.vec_id <> b.vec_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1600 GROUP BY 1, 2),
n AS (SELECT c.label, c.vec_id, c.n, coalesce(near, []) AS near FROM c LEFT JOIN x USING (label, vec_id)),
k AS (SELECT label, 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS vec_id FROM (SELECT DISTINCT label FROM n)
  UNION ALL SELECT n.label, n.n, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, n.vec_id) END, CASE WHEN NOT list_has_any(kept, near) THEN n.vec_id END FROM k JOIN n ON n.label = k.label AND n.n = k.n + 1)
SELECT label, vec_id AS dot_id FROM k WHERE vec_id IS NOT NULL""")
def accepted_dots(spark, sf):
    dots = _xy(spark, sf, "x", "y", "score").withColumn("arms", F.col("vec_id") % 5).withColumnRenamed("vec_id", "dot_id")
    return W.accepted_dots(dots, ["label"], 50.0, -50.0, 40.0).select("label", "dot_id")


@query("""
WITH q AS (SELECT label, vec_id, floor(embedding[1]::DOUBLE * 1000) AS ex, floor(embedding[2]::DOUBLE * 1000) AS ey, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE -1 END AS way, vec_id % 3 = 0 AS true_end,
  floor(embedding[3]::DOUBLE * 1000) AS x, floor(embedding[4]::DOUBLE * 1000) AS a, floor(embedding[5]::DOUBLE * 1000) AS b FROM embeddings),
m AS (SELECT e.label, e.vec_id AS end_id, w.vec_id AS wire_id, (w.x - e.ex) * e.way AS gap, e.true_end, w.x AS px, e.ey AS py FROM q e JOIN q w ON w.label = e.label
  WHERE (w.x - e.ex) * e.way > 1 AND (w.x - e.ex) * e.way <= 80 AND e.ey BETWEEN least(w.a, w.b) - (greatest(w.a, w.b) - least(w.a, w.b)) * 0.02 AND greatest(w.a, w.b) + (greatest(w.a, w.b) - least(w.a, w.b)) * 0.02)
SELECT label, end_id, arg_min(wire_id, (gap, wire_id)) AS wire_id, min(gap) AS gap FROM m
WHERE (true_end AND gap <= 60) OR EXISTS (SELECT 1 FROM q t WHERE t.label = m.label AND (t.x - px) ** 2 + (t.a - py) ** 2 <= 324) GROUP BY 1, 2""")
def perpendicular_bridges(spark, sf):
    x = _xy(spark, sf, "ex", "ey", "x", "a", "b")
    ends = x.select("label", F.col("vec_id").alias("end_id"), "ex", "ey", F.when(F.col("vec_id") % 2 == 0, 1).otherwise(-1).alias("way"), (F.col("vec_id") % 3 == 0).alias("true_end"))
    wires = x.select("label", F.col("vec_id").alias("wire_id"), "x", F.least("a", "b").alias("y0"), F.greatest("a", "b").alias("y1"))
    return W.perpendicular_bridges(ends, wires, x.select("label", F.col("x").alias("tx"), F.col("a").alias("ty")), ["label"])


@query("""
WITH q AS (SELECT label, vec_id, floor(embedding[1]::DOUBLE * 1000) AS px, floor(embedding[2]::DOUBLE * 1000) AS py, floor(embedding[3]::DOUBLE * 1000) AS x0, floor(embedding[4]::DOUBLE * 1000) AS y0, floor(embedding[5]::DOUBLE * 1000) AS x1, floor(embedding[6]::DOUBLE * 1000) AS tx FROM embeddings),
d AS (SELECT p.label, p.vec_id, w.vec_id AS wire, sqrt((p.px - least(greatest(p.px, least(w.x0, w.x1)), greatest(w.x0, w.x1))) ** 2 + (p.py - w.y0) ** 2) AS d FROM q p JOIN q w ON w.label = p.label WHERE p.vec_id % 4 <> 0),
w AS (SELECT label, vec_id, arg_min(wire, (d, wire)) AS wire FROM d WHERE d <= 10 GROUP BY 1, 2),
l AS (SELECT q.label, q.vec_id, px, py, CASE WHEN q.vec_id % 4 = 0 THEN q.vec_id + 1 ELSE wire END AS wire FROM q LEFT JOIN w USING (label, vec_id)),
n AS (SELECT l.label, l.vec_id, arg_min(q.vec_id, (sqrt((q.tx - l.px) ** 2 + (q.y0 - l.py) ** 2), q.vec_id)) AS node FROM l JOIN q ON q.label = l.label AND sqrt((q.tx - l.px) ** 2 + (q.y0 - l.py) ** 2) <= 28 WHERE wire IS NULL GROUP BY 1, 2)
SELECT label, vec_id AS point_id, wire AS wire_id, node AS node_id FROM l LEFT JOIN n USING (label, vec_id)""")
def terminal_links(spark, sf):
    x = _xy(spark, sf, "px", "py", "x0", "y0", "x1", "tx")
    points = x.select("label", F.col("vec_id").alias("point_id"), "px", "py", F.when(F.col("vec_id") % 4 == 0, F.col("vec_id") + 1).alias("hint"))
    wires = x.select("label", F.col("vec_id").alias("segment_id"), "x0", "y0", "x1", F.col("y0").alias("y1"))
    return W.terminal_links(points, wires, x.select("label", F.col("vec_id").alias("node_id"), "tx", F.col("y0").alias("ty")), ["label"])


@query("""
WITH f AS (SELECT l_orderkey, l_suppkey % 5 AS peer, min(l_partkey) AS stop FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber AS record, stop FROM lineitem JOIN f USING (l_orderkey) WHERE peer = l_partkey % 5""")
def peer_stops(spark, sf):
    x, c = t(spark, sf, "lineitem"), F.col
    stops = x.select("l_orderkey", (c("l_suppkey") % 5).alias("symbol"), c("l_partkey").alias("stop"))
    return W.peer_stops(x.select("l_orderkey", c("l_linenumber").alias("record"), (c("l_partkey") % 5).alias("peer")), stops, ["l_orderkey"])


@query("""
WITH o AS (SELECT l_orderkey, l_suppkey % 9 AS name FROM lineitem WHERE l_linestatus = 'O'), f AS (SELECT DISTINCT l_orderkey, l_partkey % 9 AS name FROM lineitem WHERE l_linestatus = 'F')
SELECT *, 'own' AS origin FROM o UNION ALL SELECT *, 'found' FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.l_orderkey = f.l_orderkey AND o.name = f.name)""")
def merged_terminals(spark, sf):
    x, c = t(spark, sf, "lineitem"), F.col
    own, found = x.filter("l_linestatus = 'O'").select("l_orderkey", (c("l_suppkey") % 9).alias("name")), x.filter("l_linestatus = 'F'").select("l_orderkey", (c("l_partkey") % 9).alias("name"))
    return W.merged_terminals(own, found, ["l_orderkey"], "name")


@query("""
WITH a AS (SELECT l_partkey AS k, l_suppkey % 7 AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_partkey AS k, l_suppkey % 7 AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT k, s, coalesce(a.n, 0) AS n_listed, coalesce(b.n, 0) AS n_stored, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n <> b.n THEN 'differs' ELSE 'same' END AS status FROM a FULL JOIN b USING (k, s)""")
def reconciled_sources(spark, sf):
    x = lambda flag: t(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 7).alias("s"))
    return W.reconciled(x("A"), x("R"), ["k", "s"])


@query("""
WITH g AS (SELECT n_nationkey, n_nationkey / 4 AS ca, 10 + n_nationkey / 2 AS cb, n_nationkey % 2 = 0 AS two FROM nation),
p AS (SELECT DISTINCT l_suppkey % 25 AS n_nationkey, l_quantity * 4 AS x, l_linenumber * 8.0 AS y FROM lineitem),
s AS (SELECT *, CASE WHEN two THEN least(1, greatest(0, (x - 20) / 160)) ELSE 0 END AS t FROM p JOIN g USING (n_nationkey))
SELECT n_nationkey, x, y, round((x - ca) / cb, 9) AS u, round((y - (1 + t * 2)) / (4 + t), 9) AS v FROM s""")
def grid_positions(spark, sf):
    c = F.col
    side = lambda x, at, step: F.struct(F.lit(x).alias("x"), F.lit(at).alias("at"), F.lit(step).alias("step"))
    left, right = side(20.0, 1.0, 4.0), side(180.0, 3.0, 5.0)
    sides = F.when(c("n_nationkey") % 2 == 0, F.array(right, left)).otherwise(F.array(left))
    grids = t(spark, sf, "nation").select("n_nationkey", (c("n_nationkey") / 4).alias("col_at"), (c("n_nationkey") / 2 + 10).alias("col_step"), sides.alias("sides"))
    points = t(spark, sf, "lineitem").select((c("l_suppkey") % 25).alias("n_nationkey"), (c("l_quantity") * 4).alias("x"), (c("l_linenumber") * 8.0).alias("y")).distinct()
    found = W.grid_positions(points, grids, ["n_nationkey"])
    return found.withColumns({"u": F.round("u", 9), "v": F.round("v", 9)})
