"""Queries of operators/scoring.py and of the later part of operators/relational.py and sequences.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, relational as R, scoring as C, sequences as S, spatial as P
from .queries import _BOXES, ORACLES, QUERIES, _boxes, long, query, seconds, t

# Gold boxes are those of even ids, found ones those of odd ids; a page is a label. Greedy matching one pair after the other, by recursion.
_MATCHED = f"""WITH RECURSIVE {_BOXES},
pp AS (SELECT x.label, x.vec_id AS l, y.vec_id AS r,
  greatest(least(x.cx + x.w / 2, y.cx + y.w / 2) - greatest(x.cx - x.w / 2, y.cx - y.w / 2), 0) * greatest(least(x.cy + x.h / 2, y.cy + y.h / 2) - greatest(x.cy - x.h / 2, y.cy - y.h / 2), 0) AS i,
  x.w * x.h + y.w * y.h AS s FROM b x JOIN b y ON x.label = y.label AND x.vec_id % 2 = 0 AND y.vec_id % 2 = 1),
p AS (SELECT label, l, r, round(i / (s - i), 6) AS iou, row_number() OVER (PARTITION BY label ORDER BY round(i / (s - i), 6) DESC, l, r) AS n FROM pp WHERE i / (s - i) >= 0.2),
gr AS (SELECT label, 0::BIGINT AS n, []::BIGINT[] AS ul, []::BIGINT[] AS ur, NULL::BIGINT AS l, NULL::BIGINT AS r, NULL::DOUBLE AS iou FROM (SELECT DISTINCT label FROM p)
  UNION ALL SELECT p.label, p.n, CASE WHEN list_contains(ul, p.l) OR list_contains(ur, p.r) THEN ul ELSE list_append(ul, p.l) END, CASE WHEN list_contains(ul, p.l) OR list_contains(ur, p.r) THEN ur ELSE list_append(ur, p.r) END,
  CASE WHEN NOT list_contains(ul, p.l) AND NOT list_contains(ur, p.r) THEN p.l END, CASE WHEN NOT list_contains(ul, p.l) AND NOT list_contains(ur, p.r) THEN p.r END, p.iou FROM gr JOIN p ON p.label = gr.label AND p.n = gr.n + 1),
m AS (SELECT label, l AS g, r AS f, iou FROM gr WHERE l IS NOT NULL),
gold AS (SELECT label, vec_id AS g, 'c' || (vec_id // 2) % 3 AS gold_class, CASE (vec_id // 2) % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'inference' ELSE 'import' END AS origin FROM embeddings WHERE vec_id % 2 = 0),
found AS (SELECT label, vec_id AS f, 'c' || (vec_id // 2) % 3 AS found_class FROM embeddings WHERE vec_id % 2 = 1),
o AS (SELECT gold.label, g, gold_class, origin, f, found_class FROM gold LEFT JOIN m USING (label, g) LEFT JOIN found USING (label, f)
  UNION ALL SELECT label, NULL, NULL, NULL, f, found_class FROM found ANTI JOIN m USING (label, f))"""

ORACLES["greedy_match"] = _MATCHED + " SELECT label, g AS l, f AS r, iou FROM m"


def _sides(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """gold, found, matches."""
    v = t(spark, sf, "embeddings").select("label", "vec_id", F.expr("vec_id div 2").alias("k"))
    kind = F.concat(F.lit("c"), (F.col("k") % 3).cast("string"))
    origin = F.when(F.col("k") % 4 == 0, "manual").when(F.col("k") % 4 == 1, "inference").otherwise("import")
    gold = v.filter("vec_id % 2 = 0").select("label", F.col("vec_id").alias("g"), kind.alias("gold_class"), origin.alias("origin"))
    found = v.filter("vec_id % 2 = 1").select("label", F.col("vec_id").alias("f"), kind.alias("found_class"))
    matches = QUERIES["greedy_match"](spark, sf).select("label", F.col("l").alias("g"), F.col("r").alias("f"))
    return gold, found, matches


@query(_MATCHED + """, x AS (SELECT label, gold_class AS class_key, 1 AS tp, 0 AS fp, 0 AS fn FROM o WHERE gold_class = found_class
  UNION ALL SELECT label, found_class, 0, 1, 0 FROM o WHERE found_class IS NOT NULL AND gold_class IS DISTINCT FROM found_class
  UNION ALL SELECT label, gold_class, 0, 0, 1 FROM o WHERE gold_class IS NOT NULL AND gold_class IS DISTINCT FROM found_class),
y AS (SELECT label, class_key, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x GROUP BY 1, 2)
SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM y""")
def class_scores(spark, sf):
    out = C.class_scores(C.outcomes(*_sides(spark, sf), ["label"]), ["label"])
    return out.withColumns({c: long(c) for c in ("tp", "fp", "fn")})


@query(_MATCHED + " SELECT coalesce(gold_class, '(extra)') AS gold, coalesce(found_class, '(missed)') AS found, count(*) AS n FROM o GROUP BY 1, 2")
def confusion_with_missing(spark, sf):
    return C.confusion(C.outcomes(*_sides(spark, sf), ["label"]))


@query(_MATCHED + """ SELECT label, coalesce(bool_or(origin = 'inference'), FALSE) AS imported, count(*) FILTER (WHERE gold_class = found_class) AS kept, count(*) FILTER (WHERE gold_class <> found_class) AS relabeled,
  CASE WHEN coalesce(bool_or(origin = 'inference'), FALSE) THEN count(*) FILTER (WHERE gold_class IS NULL) ELSE 0 END AS deleted, count(*) FILTER (WHERE found_class IS NULL AND origin = 'manual') AS manual_added FROM o GROUP BY label""")
def review_summary(spark, sf):
    gold, found, matches = _sides(spark, sf)
    return C.review_summary(found, gold, matches, ["label"])


@query(_MATCHED + """, c AS (SELECT label, count(found_class) AS ai_count, count(gold_class) AS gold_count, count(*) FILTER (WHERE gold_class = found_class) AS kept, count(*) FILTER (WHERE gold_class <> found_class) AS relabeled FROM o GROUP BY label)
SELECT label, round(2 * kept / (ai_count + gold_count), 4) AS f1, ai_count, gold_count, gold_count - kept - relabeled AS missed, ai_count - kept - relabeled AS false_detections, relabeled, 2 * kept / (ai_count + gold_count) < 0.9 AS hard
FROM c WHERE ai_count > 0 AND gold_count > 0""")
def drawing_scores(spark, sf):
    return C.drawing_scores(C.outcomes(*_sides(spark, sf), ["label"]), ["label"])


@query("""
WITH x AS (SELECT p_brand, p_name AS g, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '') ELSE split_part(p_name, ' ', 1) || ' x' END AS f FROM part),
c AS (SELECT p_brand, count(*) AS total, count(*) FILTER (WHERE upper(replace(g, ' ', '')) = upper(replace(f, ' ', ''))) AS label_ok,
  count(*) FILTER (WHERE upper(split_part(g, ' ', 1)) = upper(split_part(f, ' ', 1))) AS device_ok FROM x GROUP BY 1)
SELECT *, round(label_ok / total, 4) AS label_rate, round(device_ok / total, 4) AS device_rate FROM c""")
def label_scores(spark, sf):
    name, k = F.col("p_name"), F.col("p_partkey") % 3
    read = F.when(k == 0, F.upper(name)).when(k == 1, F.replace(name, F.lit(" "), F.lit(""))).otherwise(F.concat(F.substring_index(name, " ", 1), F.lit(" x")))
    return C.label_scores(t(spark, sf, "part").select("p_brand", name.alias("g"), read.alias("f")), ["p_brand"], "g", "f")


# Wires between an event and the user's next ones, nets being runs without a gap of over six hours; a page is a tenth of the users.
_NETS = """WITH e AS (SELECT user_id % 10 AS page, user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events),
w AS (SELECT *, lead(event_id) OVER o AS e1, lead(s) OVER o - s AS d1, lead(event_id, 2) OVER o AS e2, lead(s, 2) OVER o - s AS d2, CASE WHEN s - lag(s) OVER o > 21600 THEN 1 ELSE 0 END AS new FROM e WINDOW o AS (PARTITION BY user_id ORDER BY s, event_id)),
n AS (SELECT *, user_id || '-' || sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS net FROM w),
gold AS (SELECT page, least(event_id, e1) AS a, greatest(event_id, e1) AS b FROM n WHERE d1 <= 21600),
found AS (SELECT DISTINCT page, least(event_id, x) AS a, greatest(event_id, x) AS b FROM (SELECT page, event_id, e1 AS x FROM n WHERE d1 <= 43200 AND event_id % 3 <> 0 UNION ALL SELECT page, event_id, e2 FROM n WHERE d2 <= 43200 AND event_id % 4 = 0))"""


def _nets(spark, sf) -> DataFrame:
    """page, user_id, event_id, e1, d1, e2, d2, net, wide (a net of runs without gaps of over twelve hours)."""
    e = t(spark, sf, "events").select((F.col("user_id") % 10).alias("page"), "user_id", "event_id", seconds("ts").alias("s"))
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    ahead = lambda i: [F.lead("event_id", i).over(w).alias(f"e{i}"), (F.lead("s", i).over(w) - F.col("s")).alias(f"d{i}")]
    rows = e.select("*", *ahead(1), *ahead(2))
    rows = S.islands(rows, ["user_id"], F.col("s"), 21600, [F.col("s"), F.col("event_id")]).withColumnRenamed("island", "net")
    rows = S.islands(rows, ["user_id"], F.col("s"), 43200, [F.col("s"), F.col("event_id")]).withColumnRenamed("island", "wide")
    name = lambda c: F.concat_ws("-", F.col("user_id").cast("string"), F.col(c).cast("string"))
    return graph.cut_lineage(rows.withColumns({"net": name("net"), "wide": name("wide")}))  # used several times by its queries


def _wires(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    gold = n.filter("d1 <= 21600").select("page", F.col("event_id").alias("a"), F.col("e1").alias("b"))
    found = n.filter("d1 <= 43200 AND event_id % 3 <> 0").select("page", F.col("event_id").alias("a"), F.col("e1").alias("b"))
    return gold, found.unionByName(n.filter("d2 <= 43200 AND event_id % 4 = 0").select("page", F.col("event_id").alias("a"), F.col("e2").alias("b")))


@query(_NETS + """, x AS (SELECT f.page, f.a, f.b, f.a % 7 = 0 OR f.b % 7 = 0 AS lost, g.a IS NOT NULL AS hit, na.net = nb.net AS same FROM found f LEFT JOIN gold g USING (page, a, b) JOIN n na ON na.event_id = f.a JOIN n nb ON nb.event_id = f.b),
c AS (SELECT page, count(*) FILTER (WHERE hit AND NOT lost) AS tp, count(*) FILTER (WHERE NOT hit AND NOT lost) AS extra, count(*) FILTER (WHERE NOT hit AND NOT lost AND NOT same) AS wrong_connections, count(*) FILTER (WHERE lost) AS unmatched_ends FROM x GROUP BY page),
g AS (SELECT page, count(*) AS n FROM gold GROUP BY page)
SELECT page, tp, extra + unmatched_ends AS fp, n - tp AS fn, round(tp / nullif(tp + extra + unmatched_ends, 0), 4) AS precision, round(tp / nullif(n, 0), 4) AS recall, wrong_connections, extra - wrong_connections AS route_differences, unmatched_ends FROM c JOIN g USING (page)""")
def edge_scores(spark, sf):
    n = _nets(spark, sf)
    mapping = n.filter("event_id % 7 <> 0").select("page", F.col("event_id").alias("f"), F.col("event_id").alias("g"))
    return C.edge_scores(*_wires(n), mapping, ["page"])


@query(_NETS + """, x AS (SELECT f.page, f.a, f.b FROM found f ANTI JOIN gold g USING (page, a, b))
SELECT x.page, x.a, x.b, CASE WHEN na.net = nb.net THEN 'same component' ELSE 'hard' END AS how FROM x JOIN n na ON na.event_id = x.a JOIN n nb ON nb.event_id = x.b""")
def extra_pairs_by_component(spark, sf):
    n = _nets(spark, sf)
    gold, found = (R.undirected(w, "a", "b", ["page"]) for w in _wires(n))
    return C.same_net_or_apart(found.join(gold, ["page", "a", "b"], "left_anti"), n, ["page"], "event_id", "net")


@query(_NETS + """, k AS (SELECT *, user_id || '-' || sum(CASE WHEN g > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS wide FROM (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS g FROM n)),
h AS (SELECT gold.page, count(*) AS wires, count(*) FILTER (WHERE x.wide = y.wide) AS hit FROM gold JOIN k x ON x.event_id = gold.a JOIN k y ON y.event_id = gold.b GROUP BY 1),
z AS (SELECT page, count(*) FILTER (WHERE c > 1) AS wrong FROM (SELECT page, wide, count(DISTINCT net) AS c FROM k GROUP BY 1, 2) GROUP BY 1) SELECT page, wires, hit, wrong FROM h JOIN z USING (page)""")
def node_scores(spark, sf):
    n = _nets(spark, sf)
    of = lambda c: n.select("page", F.col("event_id").alias("member"), F.col(c).alias("node"))
    return C.node_scores(of("net"), of("wide"), _wires(n)[0], ["page"])


@query("""
WITH k AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS k FROM part WHERE p_size > 45), x AS (SELECT DISTINCT p_brand, p_name FROM part WHERE upper(replace(p_name, ' ', '')) IN (SELECT k FROM k) AND p_size <= 45)
SELECT p_brand, string_agg(p_name, ',' ORDER BY p_name) AS pages, count(*) AS n FROM x GROUP BY 1""")
def leakage(spark, sf):
    part = t(spark, sf, "part")
    return C.leakage(part.filter("p_size <= 45"), part.filter("p_size > 45").select("p_name"), "p_brand", "p_name").withColumn("pages", F.array_join("pages", ","))


@query("""
WITH x AS (SELECT l_linestatus AS kind, least('S' || l_suppkey, 'P' || l_partkey % 50) AS a, greatest('S' || l_suppkey, 'P' || l_partkey % 50) AS b, l_linenumber % 2 AS side, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'unknown' ELSE 'no' END AS j FROM lineitem),
g AS (SELECT kind, a, b, max(j) AS g FROM x WHERE side = 1 GROUP BY ALL), k AS (SELECT kind, a, b, max(j) AS m FROM x WHERE side = 0 GROUP BY ALL HAVING max(j) <> 'no'),
o AS (SELECT kind, a, b, coalesce(g, 'none') AS g, m IS NOT NULL AS said FROM g FULL JOIN k USING (kind, a, b)),
c AS (SELECT kind, count(*) FILTER (WHERE g = 'yes') AS gold, count(*) FILTER (WHERE said) AS machine, count(*) FILTER (WHERE said AND g = 'yes') AS tp, count(*) FILTER (WHERE said AND g IN ('no', 'none')) AS fp, count(*) FILTER (WHERE NOT said AND g = 'yes') AS fn,
  count(*) FILTER (WHERE said AND g = 'no') AS wrong_connections, array_to_string((list(a || ' <-> ' || b ORDER BY a || ' <-> ' || b) FILTER (WHERE NOT said AND g = 'yes'))[1:5], ';') AS missed,
  array_to_string((list(a || ' <-> ' || b ORDER BY a || ' <-> ' || b) FILTER (WHERE said AND g IN ('no', 'none')))[1:5], ';') AS extra FROM o GROUP BY kind)
SELECT kind, gold, machine, tp, fp, fn, wrong_connections, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, coalesce(missed, '') AS missed, coalesce(extra, '') AS extra FROM c""")
def relation_scores(spark, sf):
    word = F.when(F.col("l_returnflag") == "A", "接続").when(F.col("l_returnflag") == "N", "不明").otherwise("非接続")
    rows = t(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("kind"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("b"), "l_linenumber", word.alias("word"))
    out = C.relation_scores(rows.filter("l_linenumber % 2 = 1"), rows.filter("l_linenumber % 2 = 0"), "kind", "a", "b", "word", 5)
    return out.withColumns({c: F.array_join(c, ";") for c in ("missed", "extra")})


@query("""
WITH t AS (SELECT l_suppkey, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS base, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS cand, CASE WHEN l_suppkey % 3 = 0 THEN 'train' ELSE 'holdout' END AS mode FROM lineitem GROUP BY 1),
c AS (SELECT l_suppkey, l_linenumber::VARCHAR AS k, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS base, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS cand, count(*) AS n FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_suppkey, string_agg(k, ',' ORDER BY k) AS fallen FROM c WHERE n >= 5 AND round(base - cand, 9) > 0.05 GROUP BY 1)
SELECT l_suppkey, CASE WHEN base IS NULL OR cand IS NULL THEN 'unknown' WHEN round(cand - base, 9) < -0.005 OR fallen IS NOT NULL THEN 'hold' WHEN mode <> 'holdout' THEN 'caution' ELSE 'adopt' END AS verdict, coalesce(fallen, '') AS fallen FROM t LEFT JOIN f USING (l_suppkey)""")
def adoption_review(spark, sf):
    lines = t(spark, sf, "lineitem")
    avg = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_discount")))
    mode = F.when(F.col("l_suppkey") % 3 == 0, "train").otherwise("holdout")
    total = lines.groupBy("l_suppkey").agg(avg("A").alias("baseline"), avg("R").alias("candidate")).withColumn("mode", mode)
    classes = lines.groupBy("l_suppkey", F.col("l_linenumber").cast("string").alias("class_key")).agg(avg("A").alias("baseline"), avg("R").alias("candidate"), F.count(F.lit(1)).alias("instances"))
    return C.adoption(total, classes, ["l_suppkey"]).withColumn("fallen", F.array_join("fallen", ","))


@query("""
WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE l_tax > 0.079 AND l_quantity > 49) AS errors, count(*) FILTER (WHERE l_returnflag <> 'N') AS hit, count(*) AS gold, count(*) FILTER (WHERE l_linestatus = 'F') AS judged, count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity < 3) AS wrong FROM lineitem GROUP BY 1),
x AS (SELECT *, gold + l_suppkey % 2 AS expected FROM c)
SELECT l_suppkey, errors = 0 AND gold = expected AND hit >= ceil(expected * 0.6 - 1e-12) AND coalesce((judged - wrong) / nullif(judged, 0) >= 0.95, FALSE) AS passed,
  concat_ws(',', CASE WHEN errors <> 0 THEN 'evaluation_errors' END, CASE WHEN gold <> expected THEN 'unexpected_gold_count' END, CASE WHEN hit < ceil(expected * 0.6 - 1e-12) THEN 'recall_below_target' END, CASE WHEN coalesce((judged - wrong) / nullif(judged, 0) < 0.95, TRUE) THEN 'precision_below_target' END) AS reasons,
  ceil(expected * 0.6 - 1e-12)::BIGINT AS required_hit, round(hit / gold, 6) AS recall, round((judged - wrong) / nullif(judged, 0), 6) AS precision FROM x""")
def gate_check(spark, sf):
    n = F.count_if
    c = F.col
    counts = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        n((c("l_tax") > 0.079) & (c("l_quantity") > 49)).alias("errors"), n(c("l_returnflag") != "N").alias("hit"), F.count(F.lit(1)).alias("gold"),
        n(c("l_linestatus") == "F").alias("judged"), n((c("l_linestatus") == "F") & (c("l_quantity") < 3)).alias("wrong"))
    out = C.gate(counts, ["l_suppkey"], 0.6, 0.95, c("gold") + c("l_suppkey") % 2)
    return out.withColumn("reasons", F.array_join("reasons", ",")).withColumn("required_hit", long("required_hit"))


@query("""
WITH m AS (SELECT l_suppkey, l_returnflag, unnest(['page.recall', 'page.wrong']) AS metric, unnest([avg(l_discount), avg(l_tax)]) AS value FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey, a.metric, round(a.value, 6) AS baseline, round(r.value, 6) AS now FROM m a JOIN m r ON a.l_suppkey = r.l_suppkey AND a.metric = r.metric AND a.l_returnflag = 'A' AND r.l_returnflag = 'R'
WHERE CASE a.metric WHEN 'page.wrong' THEN round(r.value - a.value, 9) > 0.005 ELSE round(r.value - a.value, 9) < -0.005 END""")
def worse_metrics(spark, sf):
    means = t(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_discount").alias("page.recall"), F.avg("l_tax").alias("page.wrong"))
    m = means.unpivot(["l_suppkey", "l_returnflag"], ["`page.recall`", "`page.wrong`"], "metric", "value")
    out = C.worse(m.filter("l_returnflag = 'R'"), m.filter("l_returnflag = 'A'"), ["wrong"], by=["l_suppkey"])
    return out.withColumns({c: F.round(c, 6) for c in ("baseline", "now")})


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_orderkey, x.l_suppkey AS a, y.l_suppkey AS b FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey""")
def net_pairs(spark, sf):
    return C.clique_pairs(t(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("""
WITH x AS (SELECT o_custkey, l_orderkey, l_partkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT DISTINCT o_custkey, list_sort(list(DISTINCT l_partkey)) AS b FROM x GROUP BY o_custkey, l_orderkey), c AS (SELECT DISTINCT o_custkey, list_sort(list(DISTINCT l_partkey)) AS b FROM x WHERE l_linenumber < 4 GROUP BY o_custkey, l_orderkey),
f AS (SELECT coalesce(a.o_custkey, c.o_custkey) AS o_custkey, a.b IS NULL AS only_right, c.b IS NULL AS only_left FROM a FULL JOIN c ON a.o_custkey = c.o_custkey AND a.b = c.b)
SELECT o_custkey, NOT bool_or(only_right OR only_left) AS equal, count(*) FILTER (WHERE only_left) AS left_only, count(*) FILTER (WHERE only_right) AS right_only FROM f GROUP BY 1""")
def partitions_equal(spark, sf):
    x = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_partkey", "l_linenumber")
    return C.partitions_equal(x, x.filter("l_linenumber < 4"), ["o_custkey"], "l_orderkey", "l_partkey")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS k FROM lineitem),
w AS (SELECT a.l_orderkey, a.k AS a, b.k AS b, a.l_partkey % 10 = 0 OR b.l_partkey % 10 = 0 AS no_symbol, a.l_quantity <= 5 OR b.l_quantity <= 5 AS no_terminal, a.l_suppkey % 3 = b.l_suppkey % 3 AS same FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND b.k = a.k + 1)
SELECT l_orderkey, a, b, CASE WHEN no_symbol THEN 'unmatched symbol' WHEN no_terminal THEN 'unmapped terminal' ELSE 'different nodes' END AS reason FROM w WHERE no_symbol OR no_terminal OR NOT same""")
def miss_reasons(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    x = t(spark, sf, "lineitem").withColumn("k", F.row_number().over(w).cast("long"))
    wires = x.select("l_orderkey", F.col("k").alias("a"), F.lead("k").over(w).alias("b"), F.col("l_partkey").alias("a_symbol"), F.lead("l_partkey").over(w).alias("b_symbol")).filter("b IS NOT NULL")
    terminals = x.filter("l_quantity > 5").select("l_orderkey", F.col("k").alias("end"), F.col("k").alias("mapped"))
    nodes = x.select("l_orderkey", F.col("k").alias("mapped"), (F.col("l_suppkey") % 3).alias("node"))
    symbols = x.filter("l_partkey % 10 <> 0").select("l_orderkey", F.col("l_partkey").alias("symbol"))
    return C.miss_reasons(wires, symbols, terminals, nodes, ["l_orderkey"])


@query("""SELECT o_orderpriority, o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS passed, count(*) AS total FROM orders GROUP BY 1, 2""")
def scenario_pass_counts(spark, sf):
    return C.pass_counts(t(spark, sf, "orders").withColumn("ok", F.col("o_totalprice") > 100000), ["o_orderpriority"], "o_orderstatus", "ok")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 2""")
def largest_of_each(spark, sf):
    return C.first_of_each(t(spark, sf, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")], 2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH c AS (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE left(p_type, len(p_type) - 1) END AS word, max(p_size) AS score FROM part GROUP BY 1, 2)
SELECT c.p_brand, c.word, greatest(c.score, coalesce(s.score, c.score)) AS score FROM c LEFT JOIN c s ON s.p_brand = c.p_brand AND s.word = left(c.word, len(c.word) - 1)
WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.p_brand = c.p_brand AND left(x.word, len(x.word) - 1) = c.word)""")
def prefix_merge(spark, sf):
    word = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.expr("substring(p_type, 1, length(p_type) - 1)"))
    return R.prefix_merged(t(spark, sf, "part").groupBy("p_brand", word.alias("word")).agg(F.max("p_size").alias("score")), ["p_brand"], "word", "score")


@query("""SELECT o_orderkey FROM (SELECT * FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500) WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)""")
def limit_then_filter(spark, sf):
    return R.limited_then(t(spark, sf, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 500, F.col("o_orderstatus") == "F", 20).select("o_orderkey")


@query("""
SELECT 'l_partkey' AS "column", l_partkey::VARCHAR AS value, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 2
UNION ALL SELECT 'l_suppkey', l_suppkey::VARCHAR, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0) GROUP BY 2""")
def unresolved_references(spark, sf):
    tables = {"l_partkey": (t(spark, sf, "part").filter("p_size > 5"), "p_partkey"), "l_suppkey": (t(spark, sf, "supplier").filter("s_suppkey % 7 <> 0"), "s_suppkey")}
    return R.unresolved(t(spark, sf, "lineitem").select(*tables), tables)


@query("""
WITH x AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'P' AS is_active, o_orderstatus = 'F' AND o_orderkey = max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS chosen FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN bool_or(chosen) OVER (PARTITION BY o_custkey) THEN coalesce(chosen, FALSE) ELSE is_active END AS is_active FROM x""")
def one_active(spark, sf):
    done = F.col("o_orderstatus") == "F"
    last = F.max(F.when(done, F.col("o_orderkey"))).over(Window.partitionBy("o_custkey"))
    x = t(spark, sf, "orders").withColumn("is_active", F.col("o_orderstatus") == "P").withColumn("chosen", F.coalesce(done & (F.col("o_orderkey") == last), F.lit(False)))
    return R.one_active(x, ["o_custkey"], F.col("chosen")).select("o_orderkey", "o_custkey", "is_active")


@query("""
WITH w AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT c_name FROM customer UNION SELECT DISTINCT p_type FROM part), a AS (SELECT p_name AS name, min(p_partkey) AS k FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1),
b AS (SELECT c_name AS name, min(c_custkey) AS k FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1)
SELECT w.name, coalesce(a.k, b.k) AS target, CASE WHEN a.k IS NOT NULL THEN 'part' WHEN b.k IS NOT NULL THEN 'customer' END AS how FROM w LEFT JOIN a USING (name) LEFT JOIN b USING (name)""")
def target_resolution(spark, sf):
    part, customer = t(spark, sf, "part"), t(spark, sf, "customer")
    names = part.select(F.col("p_name").alias("name")).unionByName(customer.select(F.col("c_name").alias("name"))).unionByName(part.select(F.col("p_type").alias("name"))).distinct()
    return R.first_resolved(names, "name", [("part", part, "p_name", "p_partkey"), ("customer", customer, "c_name", "c_custkey")])


@query("""
WITH x AS (SELECT a.p_partkey, left(a.p_name, 2 + (a.p_partkey % 9)::INT) AS e, left(b.p_name, 2 + (a.p_partkey % 9)::INT) AS o FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, CASE WHEN len(e) <= 2 THEN levenshtein(e, o) = 0 WHEN len(e) <= 4 THEN levenshtein(e, o) <= 1 ELSE levenshtein(e, o) / greatest(len(e), len(o), 1) <= 0.28 END AS matches FROM x""")
def token_matches(spark, sf):
    part = t(spark, sf, "part")
    x = part.select("p_partkey", F.col("p_name").alias("e")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("o")), "p_partkey")
    cut = lambda c: F.expr(f"substring({c}, 1, 2 + cast(p_partkey % 9 as int))")
    return x.select("p_partkey", R.token_match(cut("e"), cut("o")).alias("matches"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders""")
def numbered_rows(spark, sf):
    return R.numbered(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], "nth").select("o_orderkey", long("nth").alias("nth"))


# Intervals of an hour from each event, against the user's whole span.
_SPANS = """WITH e AS (SELECT user_id, epoch(date_trunc('second', ts))::DOUBLE AS a FROM events), s AS (SELECT user_id, a, a + 3600 * (1 + user_id % 5) AS b, min(a) OVER (PARTITION BY user_id) AS lo, max(a) OVER (PARTITION BY user_id) + 7200 AS hi FROM e),
c AS (SELECT *, greatest(lo, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS cursor FROM s)"""


def _spans(spark, sf) -> DataFrame:
    e = t(spark, sf, "events").select("user_id", seconds("ts").cast("double").alias("a"))
    w = Window.partitionBy("user_id")
    return e.select("user_id", "a", (F.col("a") + 3600 * (1 + F.col("user_id") % 5)).alias("b"), F.min("a").over(w).alias("lo"), (F.max("a").over(w) + 7200).alias("hi"))


@query(_SPANS + " SELECT user_id, greatest(max(greatest(least(a, hi) - cursor, 0)), max(hi) - greatest(max(lo), least(max(hi), max(b))), 0) AS gap FROM c GROUP BY 1")
def longest_gap(spark, sf):
    return S.longest_gap(_spans(spark, sf), ["user_id"], "a", "b", "lo", "hi")


@query(_SPANS + " SELECT user_id, round(sum(greatest(least(b, hi) - greatest(a, cursor), 0)) / (max(hi) - min(lo)), 6) AS share FROM c GROUP BY 1")
def covered_share(spark, sf):
    return S.covered_share(_spans(spark, sf), ["user_id"], "a", "b", "lo", "hi").select("user_id", F.round("share", 6).alias("share"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey IS NOT NULL)""")
def selection_policy(spark, sf):
    """Without ids only finished ones are taken, without those on a list (an anti join: a null on the list excludes nothing)."""
    listed = t(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, sf, "orders").filter("o_orderstatus = 'F'").join(listed, "o_custkey", "left_anti").select("o_orderkey")


@query("""
WITH s AS (SELECT l_orderkey, count(*) AS symbols, count(DISTINCT l_suppkey) AS connections, sum(l_quantity) AS terminals FROM lineitem GROUP BY 1)
SELECT o_orderstatus, count(*) AS pages, coalesce(sum(symbols), 0)::BIGINT AS symbols, coalesce(sum(connections), 0)::BIGINT AS connections, count(*) FILTER (WHERE symbols IS NULL) AS empty_pages FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY 1""")
def page_summary(spark, sf):
    """Sums of the sizes of nested arrays."""
    nested = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("symbols"), F.collect_set("l_suppkey").alias("connections"))
    pages = t(spark, sf, "orders").join(nested, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("long").alias(c)
    return pages.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("pages"), size("symbols"), size("connections"), F.count_if(F.col("symbols").isNull()).alias("empty_pages"))


@query(f"WITH {_BOXES} SELECT label, round(median(w), 6) AS w, round(median(h), 6) AS h, count(*) AS n FROM b GROUP BY label")
def median_sizes(spark, sf):
    return _boxes(spark, sf).groupBy("label").agg(F.round(F.median("w"), 6).alias("w"), F.round(F.median("h"), 6).alias("h"), F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT doc_id % 50 AS page, doc_id, n_chars % 97 AS top, n_chars % 31 AS x FROM documents), m AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY page ORDER BY top, x, doc_id) > 4 THEN 1 ELSE 0 END AS new FROM w),
g AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY top, x, doc_id ROWS UNBOUNDED PRECEDING) AS line FROM m) SELECT doc_id, row_number() OVER (PARTITION BY page ORDER BY line, x, top, doc_id) AS nth FROM g""")
def reading_order(spark, sf):
    w = t(spark, sf, "documents").select((F.col("doc_id") % 50).alias("page"), "doc_id", (F.col("n_chars") % 97).alias("top"), (F.col("n_chars") % 31).alias("x"), F.lit(8.0).alias("height"))
    return S.reading_order(w, ["page"], "top", "x", "height", key="doc_id").select("doc_id", long("nth").alias("nth"))


@query("""
WITH x AS (SELECT p_brand, p_type, round(least(0.5 * (p_size / 50.0) + CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) >= 2 THEN 0.2 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 0.2 ELSE 0 END, 1.0)::DOUBLE, 3) AS s FROM part),
b AS (SELECT p_brand, p_type, max(s) AS score FROM x GROUP BY 1, 2) SELECT p_brand, p_type, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_type) AS n FROM b) WHERE n <= 3""")
def sheet_number_candidates(spark, sf):
    part = t(spark, sf, "part").select("p_brand", "p_type", (F.col("p_size") / 50.0).alias("s"), (F.col("p_partkey") % 3 == 0).alias("title"), (F.col("p_partkey") % 5 == 0).alias("labelled"))
    return R.best_candidates(part, ["p_brand"], "p_type", "s", "title", "labelled")


@query("""
WITH r AS (SELECT s_suppkey, unnest(range(16)) AS i FROM supplier), v AS (SELECT s_suppkey, i, (i & 1) > 0 AS a, (i & 2) > 0 AS b, (i & 4) > 0 AS c, (i & 8) > 0 AS d FROM r),
e AS (SELECT s_suppkey, i, ((a AND b AND NOT d) OR (a AND c)) IS DISTINCT FROM CASE s_suppkey % 3 WHEN 0 THEN (c AND a) OR (NOT d AND b AND a) WHEN 1 THEN (a AND b) OR (a AND c AND d) ELSE (a AND b AND NOT d) OR (a AND c) OR (a AND b AND c AND d) END AS differs FROM v)
SELECT s_suppkey, NOT bool_or(differs) AS equivalent, min(CASE WHEN differs THEN i END) AS counterexample FROM e GROUP BY 1""")
def equivalent_conditions(spark, sf):
    """Conditions as branches: a b !d + a c against three others."""
    tree = lambda *branches: F.array(*[F.array(*[F.lit(x) for x in b.split()]) for b in branches])
    k = F.col("s_suppkey") % 3
    other = F.when(k == 0, tree("c a", "!d b a")).when(k == 1, tree("a b", "a c d")).otherwise(tree("a b !d", "a c", "a b c d"))
    return R.equivalent(t(spark, sf, "supplier").select("s_suppkey", tree("a b !d", "a c").alias("l"), other.alias("r")), ["s_suppkey"], "l", "r").drop("exhaustive")
