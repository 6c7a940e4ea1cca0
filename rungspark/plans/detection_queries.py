"""Queries of operators/detections.py, operators/drawing_sets.py and of the names in functions/text.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detections as D, drawing_sets as W
from .queries import _BOXES, _boxes, long, query, t

_CLASSED = _BOXES + ", c AS (SELECT *, 'c' || vec_id % 4 AS class_key, round((vec_id * 37 % 101) / 100.0, 2)::DOUBLE AS confidence FROM b)"
# Overlapping pairs of boxes of one label: intersection i, both areas.
_PAIRS = _CLASSED + """, o AS (SELECT x.label, x.vec_id AS l, y.vec_id AS r, x.class_key AS lc, y.class_key AS rc, x.confidence AS ls, y.confidence AS rs, x.cx AS lx, y.cx AS rx, x.cy AS ly, y.cy AS ry, x.w AS lw, y.w AS rw, x.h AS lh, y.h AS rh,
  greatest(least(x.cx + x.w / 2, y.cx + y.w / 2) - greatest(x.cx - x.w / 2, y.cx - y.w / 2), 0) * greatest(least(x.cy + x.h / 2, y.cy + y.h / 2) - greatest(x.cy - x.h / 2, y.cy - y.h / 2), 0) AS i, x.w * x.h AS la, y.w * y.h AS ra
  FROM c x JOIN c y ON x.label = y.label AND x.vec_id <> y.vec_id)"""


def _classed(spark, sf) -> DataFrame:
    b = _boxes(spark, sf)
    return b.withColumns({"class_key": F.concat(F.lit("c"), (F.col("vec_id") % 4).cast("string")), "confidence": F.round((F.col("vec_id") * 37 % 101) / 100.0, 2)})


@query(f"WITH {_BOXES} SELECT label, CASE WHEN w * h >= 0.04 OR greatest(w, h) >= 0.40 THEN 'region' ELSE 'symbol' END AS kind, count(*) AS n FROM b GROUP BY 1, 2")
def size_kinds(spark, sf):
    return _boxes(spark, sf).groupBy("label", D.size_kind(F.col("w"), F.col("h")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CLASSED} SELECT vec_id FROM c WHERE class_key = 'c3' OR confidence >= CASE class_key WHEN 'c0' THEN 0.7 ELSE 0.4 END")
def class_confidence_filter(spark, sf):
    return D.confident(_classed(spark, sf), 0.4, {"c0": 0.7}, ["c3"]).select("vec_id")


@query(f"WITH {_CLASSED} SELECT vec_id, class_key FROM c WHERE vec_id % 2 = 0 AND class_key NOT IN ('c1', 'c2') UNION ALL SELECT vec_id, class_key FROM c WHERE vec_id % 3 = 0 AND class_key IN ('c1', 'c2')")
def source_override(spark, sf):
    c = _classed(spark, sf)
    return D.overridden(c.filter("vec_id % 2 = 0"), c.filter("vec_id % 3 = 0"), ["c1", "c2"]).select("vec_id", "class_key")


@query(f"""WITH {_CLASSED} SELECT coalesce(CASE WHEN vec_id % 7 = 0 THEN 'suppressed' WHEN vec_id % 5 = 0 THEN 'text zone' WHEN class_key NOT IN ('c0', 'c2') THEN 'unknown class' END, 'taken') AS reason, count(*) AS n FROM c GROUP BY 1""")
def skip_reasons(spark, sf):
    c = _classed(spark, sf).withColumns({"suppressed": F.col("vec_id") % 7 == 0, "text_zone": F.col("vec_id") % 5 == 0})
    known = spark.createDataFrame([("c0",), ("c2",)], "class_key string")
    return D.skip_reasons(c, known).groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE " + _PAIRS + """, x AS (SELECT label, l, list(r) AS against FROM o WHERE i > 0 AND (i / (la + ra - i) >= 0.3 OR i / least(la, ra) >= 0.8) GROUP BY 1, 2),
n AS (SELECT c.label, c.vec_id, coalesce(x.against, []) AS against, row_number() OVER (PARTITION BY c.label ORDER BY c.confidence DESC, c.vec_id) AS n FROM c LEFT JOIN x ON x.label = c.label AND x.l = c.vec_id),
k AS (SELECT label, 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS vec_id FROM (SELECT DISTINCT label FROM n)
  UNION ALL SELECT n.label, n.n, CASE WHEN list_has_any(kept, against) THEN kept ELSE list_append(kept, n.vec_id) END, CASE WHEN NOT list_has_any(kept, against) THEN n.vec_id END FROM k JOIN n ON n.label = k.label AND n.n = k.n + 1)
SELECT label, vec_id FROM k WHERE vec_id IS NOT NULL""")
def suppression(spark, sf):
    return D.suppressed(_classed(spark, sf), ["label"], "vec_id", "confidence", 0.25, 0.3, 0.8).select("label", "vec_id")


@query("WITH " + _PAIRS + " SELECT label, vec_id FROM c WHERE NOT (class_key IN ('c0', 'c1') AND EXISTS (SELECT 1 FROM o WHERE o.label = c.label AND o.l = c.vec_id AND o.rc = 'c3' AND i / la >= 0.5))")
def without_covered(spark, sf):
    c = _classed(spark, sf)
    return D.without_covered(c, ["label"], "vec_id", c.filter("class_key = 'c3'"), 0.5, 0.25, F.col("class_key").isin("c0", "c1")).select("label", "vec_id")


@query("WITH " + _PAIRS + """, s AS (SELECT label, l, r, CASE WHEN lc = 'c0' OR rc = 'c0' THEN CASE WHEN sqrt((lx - rx) ** 2 + (ly - ry) ** 2) <= 0.05 THEN 1 - 0.7 * sqrt((lx - rx) ** 2 + (ly - ry) ** 2) / 0.05 ELSE 0 END ELSE i / (la + ra - i) END AS s FROM o WHERE i > 0 AND l < r)
SELECT label, l, r, round(s, 6) AS score FROM s WHERE s >= 0.3""")
def class_likeness(spark, sf):
    c = _classed(spark, sf)
    return D.alike(c, ["label"], "vec_id", F.col("class_key") == "c0", 0.3, 0.05, 0.25).select("label", "l", "r", F.round("s", 6).alias("score"))


@query(f"""WITH {_CLASSED}, m AS (SELECT vec_id, CASE class_key WHEN 'c1' THEN 'relay' WHEN 'c2' THEN 'lamp' ELSE class_key END AS class_key FROM c) SELECT vec_id, class_key, CASE class_key WHEN 'lamp' THEN 0 WHEN 'relay' THEN 1 ELSE 2 END AS class_id FROM m WHERE class_key IN ('lamp', 'relay', 'c3')""")
def class_remap(spark, sf):
    names = spark.createDataFrame([("c1", "relay"), ("c2", "lamp"), ("c3", None)], "class_key string, target string")
    return D.remapped(_classed(spark, sf), names, ["lamp", "relay", "c3"]).select("vec_id", "class_key", "class_id")


_PIXELS = _BOXES + ", q AS (SELECT vec_id, label, 500 + 1000 * cx AS cx, 500 + 1000 * cy AS cy, 1000 * w AS w, 1000 * h AS h FROM b)"


def _pixels(spark, sf) -> DataFrame:
    b = _boxes(spark, sf)
    return b.select("vec_id", "label", (500 + 1000 * F.col("cx")).alias("cx"), (500 + 1000 * F.col("cy")).alias("cy"), (1000 * F.col("w")).alias("w"), (1000 * F.col("h")).alias("h"))


@query(f"""WITH {_PIXELS}, v AS (SELECT label, unnest([0, 1, 2]) AS win FROM (SELECT DISTINCT label FROM q)), x AS (SELECT q.*, win, 300.0 + 100 * win AS wl, 350.0 AS wt FROM q JOIN v USING (label)),
y AS (SELECT *, greatest(cx - w / 2, wl) AS x0, least(cx + w / 2, wl + 200) AS x1, greatest(cy - h / 2, wt) AS y0, least(cy + h / 2, wt + 250) AS y1 FROM x)
SELECT vec_id, win, round(((x0 + x1) / 2 - wl) / 200, 6) AS cx, round(((y0 + y1) / 2 - wt) / 250, 6) AS cy, round((x1 - x0) / 200, 6) AS w, round((y1 - y0) / 250, 6) AS h FROM y
WHERE x1 > x0 AND y1 > y0 AND ((cx BETWEEN wl AND wl + 200 AND cy BETWEEN wt AND wt + 250) OR (x1 - x0) * (y1 - y0) / greatest(w * h, 1) >= 0.7)""")
def window_crop(spark, sf):
    q = _pixels(spark, sf)
    windows = q.select("label").distinct().withColumn("win", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    windows = windows.select("label", "win", (300.0 + 100 * F.col("win")).alias("left"), F.lit(350.0).alias("top"), F.lit(200.0).alias("width"), F.lit(250.0).alias("height"))
    return D.cropped(q, windows, ["label"]).select("vec_id", "win", *[F.round(c, 6).alias(c) for c in D.BOX])


@query(f"""WITH {_BOXES}, a AS (SELECT vec_id, unnest([-1, -1, 1, 1]) AS sx, unnest([-1, 1, -1, 1]) AS sy, cx, cy, w, h FROM b),
p AS (SELECT vec_id, 0.8 * (cx + sx * w / 2) - 0.3 * (cy + sy * h / 2) + 0.5 AS x, 0.3 * (cx + sx * w / 2) + 0.8 * (cy + sy * h / 2) + 0.4 AS y FROM a),
m AS (SELECT vec_id, least(greatest(min(x), 0), 1) AS x0, least(greatest(max(x), 0), 1) AS x1, least(greatest(min(y), 0), 1) AS y0, least(greatest(max(y), 0), 1) AS y1 FROM p GROUP BY 1)
SELECT vec_id, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM m WHERE x1 > x0 AND y1 > y0""")
def affine_boxes(spark, sf):
    return D.transformed(_boxes(spark, sf), [[0.8, -0.3, 0.5], [0.3, 0.8, 0.4]]).select("vec_id", *[F.round(c, 6).alias(c) for c in D.BOX])


@query(f"""WITH {_CLASSED}, k AS (SELECT unnest(['c0', 'c1', 'c9']) AS class_key), n AS (SELECT class_key, count(*) AS n, count(DISTINCT label) AS pages FROM c GROUP BY 1) SELECT k.class_key, coalesce(n, 0) AS n, coalesce(pages, 0) AS pages FROM k LEFT JOIN n USING (class_key)""")
def class_histogram(spark, sf):
    return D.histogram(_classed(spark, sf).withColumnRenamed("label", "page_id"), spark.createDataFrame([("c0",), ("c1",), ("c9",)], "class_key string"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice / 100 >= 45 AND l_quantity <= 32 AND l_extendedprice / 100 >= 8 * greatest(l_quantity, 1)")
def accepted_lines(spark, sf):
    lines = t(spark, sf, "lineitem").withColumns({"length": F.col("l_extendedprice") / 100, "thickness": F.col("l_quantity")})
    return D.accepted_lines(lines).select("l_orderkey", "l_linenumber", "l_partkey")


_PLACES = """WITH q AS (SELECT vec_id AS point_id, label, embedding[5]::DOUBLE AS px, embedding[6]::DOUBLE AS py FROM embeddings), r AS (SELECT vec_id AS label_id, label, embedding[7]::DOUBLE AS tx, embedding[8]::DOUBLE AS ty, vec_id % 10 / 10.0 AS confidence FROM embeddings),
d AS (SELECT q.label, point_id, label_id, confidence, sqrt((px - tx) ** 2 + (py - ty) ** 2) AS distance, abs(ty - py) + 0.2 * abs(tx - px) AS bus FROM q JOIN r ON q.label = r.label)"""


def _places(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = t(spark, sf, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    points = e.select("label", F.col("vec_id").alias("point_id"), at(4).alias("px"), at(5).alias("py"))
    return points, e.select("label", F.col("vec_id").alias("label_id"), at(6).alias("tx"), at(7).alias("ty"), (F.col("vec_id") % 10 / 10.0).alias("confidence"))


@query(_PLACES + " SELECT * FROM (SELECT label, point_id, label_id, round(distance, 9) AS distance, row_number() OVER (PARTITION BY label, point_id ORDER BY distance, confidence DESC, label_id) AS nth FROM d WHERE distance <= 0.15) WHERE nth <= 8")
def nearest_labels(spark, sf):
    return D.nearest_labels(*_places(spark, sf), ["label"], 0.15).withColumns({"distance": F.round("distance", 9), "nth": long("nth")})


@query(_PLACES + " SELECT label, point_id AS end_id, arg_min(label_id, (bus, label_id)) AS text_id, round(min(bus), 9) AS distance FROM d GROUP BY 1, 2")
def bus_names(spark, sf):
    points, labels = _places(spark, sf)
    out = D.bus_texts(points.withColumnRenamed("point_id", "end_id"), labels.withColumnRenamed("label_id", "text_id"), ["label"])
    return out.withColumn("distance", F.round("distance", 9))


@query("""
WITH w AS (SELECT l_orderkey, l_partkey AS a, l_suppkey AS b, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS confidence FROM lineitem), n AS (SELECT DISTINCT l_orderkey, l_partkey AS node FROM lineitem WHERE l_returnflag = 'A' UNION SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F')
SELECT w.l_orderkey, w.a, w.b, CASE WHEN x.node IS NOT NULL AND y.node IS NOT NULL THEN 'candidate_connection' ELSE 'geometry_edge' END AS kind,
  round(CASE WHEN x.node IS NOT NULL AND y.node IS NOT NULL THEN least(0.98, coalesce(confidence, 0.4) + 0.08) ELSE greatest(0.25, coalesce(confidence, 0.4) - 0.18) END, 3) AS confidence
FROM w LEFT JOIN n x ON x.l_orderkey = w.l_orderkey AND x.node = w.a LEFT JOIN n y ON y.l_orderkey = w.l_orderkey AND y.node = w.b""")
def candidate_connections(spark, sf):
    lines = t(spark, sf, "lineitem")
    edges = lines.select("l_orderkey", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("confidence"))
    named = lines.filter("l_returnflag = 'A'").select("l_orderkey", F.col("l_partkey").alias("node")).unionByName(lines.filter("l_linestatus = 'F'").select("l_orderkey", F.col("l_suppkey").alias("node")))
    return D.candidate_connections(edges, named, ["l_orderkey"])


@query("WITH " + _PAIRS + " SELECT label, l AS a, r AS b FROM o WHERE l < r AND lc = rc AND i > 0 AND abs(lx - rx) <= greatest(lw, rw) / 2 AND abs(ly - ry) <= greatest(lh, rh) / 2")
def same_class_twins(spark, sf):
    return D.twins(_classed(spark, sf), ["label"], "vec_id", "class_key", 0.25)


@query("""
WITH q AS (SELECT vec_id AS point_id, label, embedding[5]::DOUBLE AS px, embedding[6]::DOUBLE AS py FROM embeddings), s AS (SELECT vec_id AS segment_id, label, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[3]::DOUBLE - embedding[1]::DOUBLE AS dx, embedding[4]::DOUBLE - embedding[2]::DOUBLE AS dy FROM embeddings),
u AS (SELECT q.label, point_id, segment_id, px, py, x0, y0, dx, dy, least(greatest(((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy), 0), 1) AS u FROM q JOIN s USING (label)),
d AS (SELECT label, point_id, segment_id, sqrt((px - x0 - u * dx) ** 2 + (py - y0 - u * dy) ** 2) AS d FROM u)
SELECT label, point_id, arg_min(segment_id, (d, segment_id)) AS segment_id, round(min(d), 9) AS distance FROM d WHERE d <= 0.05 GROUP BY 1, 2""")
def nearest_wire(spark, sf):
    e = t(spark, sf, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    segments = e.select("label", F.col("vec_id").alias("segment_id"), at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"))
    return D.nearest_segment(_places(spark, sf)[0], segments, ["label"], 0.05).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {_BOXES}, s AS (SELECT label, max(cx) - min(cx) >= max(cy) - min(cy) AS wide FROM b GROUP BY 1), o AS (SELECT b.label, vec_id AS a, lead(vec_id) OVER (PARTITION BY b.label ORDER BY CASE WHEN wide THEN cx ELSE cy END, vec_id) AS b FROM b JOIN s USING (label)) SELECT label, a, b FROM o WHERE b IS NOT NULL""")
def terminals_on_longer_axis(spark, sf):
    return D.adjacent_on_longer_axis(_boxes(spark, sf), ["label"], "vec_id", "cx", "cy")


# --- drawing sets: pages are orders, their sheets from customers, references from lines -----------------------------------

_DRAWINGS = """p AS (SELECT o_orderkey AS page_id, 'D' || o_orderkey AS name, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'AB' || lpad((10000 + o_orderkey % 9000)::VARCHAR, 5, '0') || CASE WHEN o_orderkey % 4 = 0 THEN '-2' ELSE '' END END AS sheet FROM orders),
r AS (SELECT l_orderkey AS page_id, 'AB' || lpad((10000 + l_partkey)::VARCHAR, 5, '0') || CASE WHEN l_linenumber % 3 = 0 THEN '-1' ELSE '' END AS target FROM lineitem),
m AS (SELECT o_custkey % 200 AS set_id, o_orderkey AS page_id FROM orders), own AS (SELECT DISTINCT set_id, split_part(sheet, '-', 1) AS sheet FROM m JOIN p USING (page_id) WHERE sheet IS NOT NULL),
lacks AS (SELECT set_id, page_id, split_part(target, '-', 1) AS sheet FROM m JOIN r USING (page_id) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.set_id = m.set_id AND own.sheet = split_part(target, '-', 1)))"""


def _drawings(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members, pages, references."""
    orders, c = t(spark, sf, "orders"), F.col
    number = lambda x: F.concat(F.lit("AB"), F.lpad(x.cast("string"), 5, "0"))
    sheet = F.concat(number(10000 + c("o_orderkey") % 9000), F.when(c("o_orderkey") % 4 == 0, "-2").otherwise(""))
    pages = orders.select(c("o_orderkey").alias("page_id"), F.concat(F.lit("D"), c("o_orderkey").cast("string")).alias("name"), F.when(c("o_orderkey") % 11 != 0, sheet).alias("sheet"))
    references = t(spark, sf, "lineitem").select(c("l_orderkey").alias("page_id"), F.concat(number(10000 + c("l_partkey")), F.when(c("l_linenumber") % 3 == 0, "-1").otherwise("")).alias("target"))
    return orders.select((c("o_custkey") % 200).alias("set_id"), c("o_orderkey").alias("page_id")), pages, references


@query(f"""WITH {_DRAWINGS}, x AS (SELECT set_id, sheet, string_agg(DISTINCT page_id::VARCHAR, ',' ORDER BY page_id::VARCHAR) AS referenced_by, count(*) AS n FROM lacks GROUP BY 1, 2), k AS (SELECT split_part(sheet, '-', 1) AS sheet, count(*) AS candidates, min(page_id) AS first_candidate FROM p WHERE sheet IS NOT NULL GROUP BY 1)
SELECT set_id, sheet, referenced_by, n, coalesce(candidates, 0)::INT AS candidates, first_candidate FROM x LEFT JOIN k USING (sheet)""")
def missing_sheets(spark, sf):
    out = W.missing_sheets(*_drawings(spark, sf))
    by_text = F.array_join(F.array_sort(F.transform("referenced_by", lambda x: x.cast("string"))), ",")
    return out.select("set_id", "sheet", by_text.alias("referenced_by"), "n", F.size("candidates").alias("candidates"), F.get("candidates", F.lit(0)).alias("first_candidate"))


@query(f"""WITH {_DRAWINGS}, x AS (SELECT set_id, count(DISTINCT sheet) AS missing FROM lacks GROUP BY 1), c AS (SELECT set_id, count(*) AS n_pages, count(*) FILTER (WHERE sheet IS NULL) AS without_sheet FROM m JOIN p USING (page_id) GROUP BY 1)
SELECT set_id, n_pages, coalesce(missing, 0) AS missing, without_sheet, coalesce(missing, 0) = 0 AND without_sheet = 0 AS complete FROM c LEFT JOIN x USING (set_id)""")
def set_completeness(spark, sf):
    return W.completeness(*_drawings(spark, sf))


@query(f"""WITH {_DRAWINGS}, e AS (SELECT sheet, min(page_id) AS page FROM p WHERE sheet IS NOT NULL GROUP BY 1), b AS (SELECT split_part(sheet, '-', 1) AS sheet, min(page_id) AS page FROM p WHERE sheet IS NOT NULL GROUP BY 1)
SELECT r.page_id, r.target, coalesce(e.page, b.page) AS to_page, CASE WHEN e.page IS NOT NULL THEN 'exact' WHEN b.page IS NOT NULL THEN 'base' END AS how FROM r LEFT JOIN e ON e.sheet = r.target LEFT JOIN b ON b.sheet = split_part(r.target, '-', 1)""")
def resolved_references(spark, sf):
    _, pages, references = _drawings(spark, sf)
    return W.resolved(references, pages)


# Drawings in chains: each user's events, an event naming the next one if it comes within two days; a group is such a run.
@query("""
WITH e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events), m AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 172800 THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT event_id AS page_id, min(event_id) OVER (PARTITION BY user_id, k) AS group_id, count(*) OVER (PARTITION BY user_id, k) AS size FROM g""")
def suggested_groups(spark, sf):
    from pyspark.sql import Window

    from .queries import seconds

    number = lambda c: F.concat(F.lit("AB"), F.lpad(F.col(c).cast("string"), 8, "0"))
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = t(spark, sf, "events").select("user_id", "event_id", seconds("ts").alias("s"))
    e = e.select("event_id", F.lead("event_id").over(w).alias("next"), (F.lead("s").over(w) - F.col("s")).alias("step"))
    pages = e.select(F.col("event_id").alias("page_id"), number("event_id").alias("sheet"))
    return W.groups(pages, e.filter("step <= 172800").select(F.col("event_id").alias("page_id"), number("next").alias("target")))


@query("""
SELECT 'symbol' AS kind, 'P' || p_partkey AS element_id, NULL AS other_id, p_name AS text, NULL AS judgement FROM part UNION ALL SELECT 'terminal', 'S' || s_suppkey, NULL, s_name, NULL FROM supplier
UNION ALL SELECT 'wire', 'P' || l_partkey, 'S' || l_suppkey, NULL, l_returnflag FROM lineitem UNION ALL SELECT 'sheet_ref', 'O' || o_orderkey, 'C' || o_custkey, NULL, o_orderstatus FROM orders""")
def correspondence_table(spark, sf):
    ref = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    part, supplier = t(spark, sf, "part"), t(spark, sf, "supplier")
    elements = part.select(F.lit("symbol").alias("kind"), ref("P", "p_partkey").alias("element_id"), F.col("p_name").alias("text")).unionByName(
        supplier.select(F.lit("terminal").alias("kind"), ref("S", "s_suppkey").alias("element_id"), F.col("s_name").alias("text")))
    wires = t(spark, sf, "lineitem").select(ref("P", "l_partkey").alias("a"), ref("S", "l_suppkey").alias("b"), F.col("l_returnflag").alias("judgement"))
    links = t(spark, sf, "orders").select(ref("O", "o_orderkey").alias("a"), ref("C", "o_custkey").alias("b"), F.col("o_orderstatus").alias("judgement"))
    return W.table_rows(elements, wires, links)


@query("""
WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '') WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END AS t FROM part WHERE p_size > 10)
SELECT p_brand AS kind, count(*) AS gold, count(m.id) AS found, count(m.id) AS compared, count(*) FILTER (WHERE replace(p_name, ' ', '') = replace(t, ' ', '')) AS exact FROM part LEFT JOIN m ON id = p_partkey GROUP BY 1""")
def text_agreement(spark, sf):
    part, name = t(spark, sf, "part"), F.col("p_name")
    read = F.when(F.col("p_partkey") % 3 == 0, F.replace(name, F.lit(" "), F.lit(""))).when(F.col("p_partkey") % 3 == 1, F.upper(name)).otherwise(name)
    gold = part.select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("element_id"), name.alias("text"))
    return W.text_agreement(gold, part.filter("p_size > 10").select(F.col("p_partkey").alias("element_id"), read.alias("text")))


# --- names ----------------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, translate(upper(p_name || ' BOQI'), 'OIB', '018') AS device, translate(replace(upper(p_name || ' BOQI'), ' ', ''), 'OQI', '001') AS key FROM part""")
def canonical_names(spark, sf):
    name = F.concat("p_name", F.lit(" BOQI"))
    return t(spark, sf, "part").select("p_partkey", text.canonical_device(name).alias("device"), text.match_key(name).alias("key"))


_BUTTONS = "['STOP', 'STOPPER', 'RUN', 'RUN OFF', 'E-STOP 1', 'ESTOP', 'ON', 'CON', '非常停止', '起動', 'EMS1', '']"


@query(f"""
WITH x AS (SELECT p_partkey, ({_BUTTONS})[1 + p_partkey % 12] || CASE WHEN p_size % 2 = 0 THEN ' ' || p_size ELSE '' END AS n, CASE p_size % 5 WHEN 0 THEN 'contact_a' WHEN 1 THEN ' B ' END AS given FROM part),
k AS (SELECT p_partkey, given, regexp_matches(n, '(^|[^A-Z])(STOP|EMG|EMS|E-?STOP|OFF)([^A-Z]|$)|停止|非常|切') AS b, regexp_matches(n, '(^|[^A-Z])(START|RUN|ON)([^A-Z]|$)|起動|運転|入') AS a FROM x),
i AS (SELECT p_partkey, given, CASE WHEN b AND NOT a THEN 'b' WHEN a AND NOT b THEN 'a' END AS implied FROM k)
SELECT p_partkey, implied, CASE given WHEN 'contact_a' THEN 'a' WHEN ' B ' THEN 'b' ELSE coalesce(implied, 'a') END AS kind FROM i""")
def contact_kinds(spark, sf):
    names = F.array(*[F.lit(x) for x in ("STOP", "STOPPER", "RUN", "RUN OFF", "E-STOP 1", "ESTOP", "ON", "CON", "非常停止", "起動", "EMS1", "")])
    number = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("")
    name = F.concat(F.get(names, (F.col("p_partkey") % 12).cast("int")), number)
    given = F.when(F.col("p_size") % 5 == 0, "contact_a").when(F.col("p_size") % 5 == 1, " B ")
    return t(spark, sf, "part").select("p_partkey", text.implied_contact(name).alias("implied"), text.contact_kind(given, name).alias("kind"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'P_' || s_suppkey WHEN 1 THEN '0' WHEN 2 THEN 'P' END AS side FROM supplier""")
def bus_sides(spark, sf):
    k, key = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("pe r"), key)).when(k == 1, F.concat(F.lit("NER "), key)).when(k == 2, " PER ").otherwise(F.concat(F.lit("X"), key))
    return t(spark, sf, "supplier").select("s_suppkey", text.bus_side(name).alias("side"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_returnflag = 'A' THEN l_suppkey || ',' || l_partkey WHEN l_returnflag = 'R' THEN l_suppkey || ',' || l_linenumber ELSE '' END AS numbers FROM lineitem""")
def contact_numbers(spark, sf):
    c = F.col
    terminal = F.concat_ws("-", c("l_partkey").cast("string"), c("l_suppkey").cast("string"), F.when(c("l_linenumber") % 3 != 0, c("l_linenumber").cast("string")))
    contact = F.when(c("l_returnflag") == "A", "a").when(c("l_returnflag") == "R", "b").otherwise("c")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(text.table_numbers(terminal, contact), ",").alias("numbers"))


@query(r"""
WITH x AS (SELECT p_partkey, 'AB' || lpad(p_partkey::VARCHAR, 5, '0') AS s, CASE p_size % 11 WHEN 3 THEN 'MCCB ' WHEN 4 THEN 'DIO-3 ' WHEN 5 THEN 'TB(2) ' WHEN 6 THEN '3RPC ' ELSE '' END AS dev, p_name, p_size % 3 AS k FROM part),
y AS (SELECT *, CASE WHEN k <> 2 AND dev = '' AND NOT regexp_matches(upper(p_name), '(^| )\d?R[A-Z]{2,}') AND NOT regexp_matches(upper(p_name), '\b(LOC|LNZ|LMZ)\b') THEN s END AS target, upper(dev || p_name) AS words FROM x),
z AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(words || ' ' || CASE WHEN target IS NULL THEN s ELSE '' END, '[ ()]+')), lambda w: w <> '') AS w FROM y)
SELECT p_partkey, target, array_to_string(list_sort(w), ',') AS idents FROM z""")
def sheet_tags(spark, sf):
    """Parts as labels of tags, some with a device's name before."""
    c, part, k = F.col, t(spark, sf, "part"), F.col("p_size") % 3
    sheet = F.concat(F.lit("AB"), F.lpad(c("p_partkey").cast("string"), 5, "0"))
    device = F.try_element_at(F.create_map(*[F.lit(x) for kv in {3: "MCCB ", 4: "DIO-3 ", 5: "TB(2) ", 6: "3RPC "}.items() for x in kv]), (c("p_size") % 11).cast("int"))
    name = F.concat(F.coalesce(device, F.lit("")), c("p_name"))
    label = F.when(k == 0, F.concat(name, F.lit(" ("), sheet, F.lit(")"))).otherwise(F.concat(name, F.lit(" - "), sheet, F.lit("へ")))
    rows = part.select("p_partkey", F.when(k == 2, "coil").otherwise("other").alias("class_key"), label.alias("label"))
    target = text.tag_target(c("class_key"), c("label"))
    return rows.select("p_partkey", target.alias("target"), F.array_join(text.identifiers(c("label"), target), ",").alias("idents"))
