"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import logic, text
from ..operators import graph, relational as R, sequences as S, spatial as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def seconds(c: str) -> Column:
    """Whole seconds since 1970 of a naive time."""
    return F.unix_seconds(F.col(c).cast("timestamp"))


# --- lists and statistics -------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_custkey k, count(*) n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') n_done FROM orders GROUP BY 1),
l AS (SELECT o_custkey k, count(*) n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(n_done, 0) AS n_done, coalesce(n_lines, 0) AS n_lines
FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN l ON l.k = c_custkey""")
def list_with_child_counts(spark, sf):
    orders = t(spark, sf, "orders")
    lines = t(spark, sf, "lineitem").select("l_orderkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    children = {"n_orders": (orders, "o_custkey", None), "n_done": (orders, "o_custkey", F.col("o_orderstatus") == "F"), "n_lines": (lines, "o_custkey", None)}
    return R.with_counts(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", children)


@query("""
SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def status_class_origin_stats(spark, sf):
    f, g = "l_returnflag", "l_linestatus"
    rows = t(spark, sf, "lineitem").groupingSets([[f, g], [f], [g], []], f, g)
    return rows.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_brand, count(*) AS n, count(DISTINCT l_orderkey) AS pages, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done,
  count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN l_orderkey END) AS pages_done, count(*) FILTER (WHERE o_orderstatus = 'F') < 30 AS thin
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
def class_stats_done_total(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    # Pages first, so that distinct pages are a plain count: no row is multiplied for the distinct counts.
    pages = rows.groupBy("p_brand", "l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("o_orderstatus") == "F").alias("done"))
    n_done = F.coalesce(F.sum(F.when(F.col("done"), F.col("n"))), F.lit(0)).cast("long")
    return pages.groupBy("p_brand").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages"), n_done.alias("n_done"), F.count_if("done").alias("pages_done"), (n_done < 30).alias("thin"),
    )


@query("""SELECT user_id, count(*) AS n, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS label FROM events GROUP BY user_id""")
def latest_nonempty_label(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), R.latest(F.col("event_type"), F.col("event_id"), F.col("event_type") != "view").alias("label"))


@query("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status FROM orders GROUP BY o_custkey""")
def single_or_null(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(R.single_or_null(F.col("o_orderstatus")).alias("status"))


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys_having(spark, sf):
    return R.repeated_keys(t(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("day")), "o_custkey", "day")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ar%' OR p_type ILIKE '%ar%' UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey = 7""")
def search_id_or_ilike(spark, sf):
    part = t(spark, sf, "part")
    return R.matching(part, "Ar", "p_partkey", "p_name", "p_type").select("p_partkey", "p_name").unionByName(R.matching(part, "7", "p_partkey", "p_name").select("p_partkey", "p_name"))


@query("""SELECT CASE WHEN (l_quantity / 50) * (l_discount * 10) >= 0.4 OR greatest(l_quantity / 50, l_discount * 10) >= 0.9 THEN 'region' ELSE 'symbol' END AS kind, count(*) AS n FROM lineitem GROUP BY 1""")
def size_classify(spark, sf):
    w, h = F.col("l_quantity") / 50, F.col("l_discount") * 10
    kind = F.when((w * h >= 0.4) | (F.greatest(w, h) >= 0.9), "region").otherwise("symbol")
    return t(spark, sf, "lineitem").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH f AS (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 50)
SELECT * FROM f UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM f)""")
def training_runs_page(spark, sf):
    return R.page_with_pending(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), [F.desc("o_orderkey")], 50, F.col("o_orderstatus") == "P")


@query("""
WITH s AS (SELECT p_brand, p_type, max(p_size) + count(*) AS score FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_type) AS nth FROM s) WHERE nth <= 3""")
def topk_scored_candidates(spark, sf):
    scored = t(spark, sf, "part").groupBy("p_brand", "p_type").agg((F.max("p_size") + F.count(F.lit(1))).alias("score"))
    nth = long(F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_type")))
    return scored.withColumn("nth", nth).filter("nth <= 3")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_join_missing(spark, sf):
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("""
SELECT l_orderkey, l_linenumber, 'S' || l_orderkey || '-T' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS ref FROM lineitem""")
def ordinal_in_parent(spark, sf):
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("S"), F.col("l_orderkey").cast("string"), F.lit("-T"), nth.cast("string")).alias("ref"))


# --- numbering, folds, ranks ----------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents),
p AS (SELECT lang, n, unnest(range(10)) AS i FROM (SELECT DISTINCT lang, n FROM d))
SELECT doc_id, lang FROM d WHERE EXISTS (SELECT 1 FROM p WHERE p.lang IS NOT DISTINCT FROM d.lang AND CAST(floor((i + 0.5) * p.n / 10) AS BIGINT) = place)""")
def holdout_even(spark, sf):
    return S.evenly_held_out(t(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], 10, ["lang"]).filter("held_out").drop("held_out")


@query("""SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 AS fold FROM documents""")
def fold_round_robin(spark, sf):
    return S.folds(t(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], 5, ["lang"]).select("doc_id", long("fold").alias("fold"))


@query("""
SELECT p_partkey, round(CASE WHEN n > 1 THEN (r - 1 + (t - 1) / 2.0) / (n - 1) ELSE 0 END, 6) AS percentile FROM (SELECT p_partkey,
  rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, count(*) OVER (PARTITION BY p_brand, p_size) AS t, count(*) OVER (PARTITION BY p_brand) AS n FROM part)""")
def percentile_tie_avg(spark, sf):
    return S.tie_percentile(t(spark, sf, "part"), ["p_brand"], "p_size").select("p_partkey", F.round("percentile", 6).alias("percentile"))


@query("""
WITH used AS (SELECT DISTINCT o_custkey AS u FROM orders), free AS (SELECT x, row_number() OVER (ORDER BY x) AS nth FROM range(1, 1000000) r(x) WHERE x NOT IN (SELECT u FROM used)),
w AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS nth FROM supplier)
SELECT s_suppkey, x AS o_custkey FROM w JOIN free USING (nth)""")
def free_numbering(spark, sf):
    return R.free_numbers(t(spark, sf, "supplier").select("s_suppkey"), t(spark, sf, "orders"), "o_custkey", [F.col("s_suppkey")])


# --- sequences, intervals, time -------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id AS a, lead(event_id) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lead(event_id) OVER w IS NOT NULL""")
def adjacent_pairs(spark, sf):
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, sf, "events").select("user_id", F.col("event_id").alias("a"), nxt.alias("b")).filter("b IS NOT NULL")


@query("""
SELECT user_id, event_id, event_type, before FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE r = 1 OR event_type IS DISTINCT FROM before""")
def change_points(spark, sf):
    return S.change_points(t(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("user_id", "event_id", "event_type", "before")


@query("""
WITH e AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS s, event_id FROM events), m AS (SELECT *, CASE WHEN s - lag(s) OVER w > 21600 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(s) AS first_s, max(s) AS last_s FROM g GROUP BY 1, 2""")
def islands_by_gap(spark, sf):
    e = t(spark, sf, "events").select("user_id", seconds("ts").alias("s"), "event_id")
    return S.islands(e, ["user_id"], F.col("s"), 21600, [F.col("s"), F.col("event_id")]).groupBy("user_id", long("island").alias("island")).agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s")
    )


@query("""
WITH e AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS a, epoch(date_trunc('second', ts))::BIGINT + 14400 AS b FROM events),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, k""")
def interval_union(spark, sf):
    e = t(spark, sf, "events").select("user_id", seconds("ts").alias("a"), (seconds("ts") + 14400).alias("b"))
    return S.interval_union(e, ["user_id"], "a", "b")


@query("""
WITH p AS (SELECT user_id, ts, event_id AS purchase_id, value AS purchase_value FROM events WHERE event_type = 'purchase')
SELECT e.event_id, p.purchase_id, p.purchase_value FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_state(spark, sf):
    e = t(spark, sf, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    return S.asof(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "p_ts", ["purchase_id", "purchase_value"]).select("event_id", "purchase_id", "purchase_value")


@query("""
WITH e AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS s, event_id, event_type IN ('click', 'purchase') AS v FROM events),
c AS (SELECT * FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id) QUALIFY row_number() OVER w = 1 OR v IS DISTINCT FROM lag(v) OVER w),
r AS (SELECT user_id, v, s, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS u FROM c)
SELECT user_id, CAST(s + 1800 AS DOUBLE) AS from_s, CAST(u AS DOUBLE) AS to_s, 'on' AS mode FROM r WHERE v AND (u IS NULL OR s + 1800 < u)
UNION ALL
(WITH o AS (SELECT user_id, s AS a, coalesce(u + 1800, 1e18) AS b FROM r WHERE v),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM o),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, CAST(min(a) AS DOUBLE), CASE WHEN max(b) < 1e18 THEN CAST(max(b) AS DOUBLE) END, 'off' FROM g GROUP BY user_id, k)""")
def on_delay_off_delay(spark, sf):
    e = t(spark, sf, "events").select("user_id", seconds("ts").cast("double").alias("s"), "event_id", F.col("event_type").isin("click", "purchase").alias("v"))
    out = [S.delayed(e, ["user_id"], "s", "v", 1800.0, mode, ["event_id"]).select("user_id", F.col("from").alias("from_s"), F.col("to").alias("to_s"), F.lit(mode).alias("mode")) for mode in ("on", "off")]
    return out[0].unionByName(out[1])


@query("""SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, sf):
    e = t(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "total")


@query("""
WITH e AS (SELECT user_id, ts, event_id FROM events), m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def sessions(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS at FROM events""")
def fixed_offset_time(spark, sf):
    return t(spark, sf, "events").select("event_id", text.japan_time(F.col("ts")).alias("at"))


# --- sets and differences -------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'X' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey,
  CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN a.p_partkey IS NULL OR b.p_partkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'p_brand' END, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END) END AS fields
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey
WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_brand IS DISTINCT FROM b.p_brand OR a.p_size IS DISTINCT FROM b.p_size""")
def snapshot_diff(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    new = part.filter("p_partkey % 11 <> 0").withColumns({"p_brand": F.when(F.col("p_partkey") % 5 == 0, "X").otherwise(F.col("p_brand")), "p_size": F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))})
    return R.snapshot_diff(part.filter("p_partkey % 7 <> 0"), new, "p_partkey", ["p_brand", "p_size"])


@query("""
WITH g AS (SELECT DISTINCT least(l_partkey, l_suppkey) a, greatest(l_partkey, l_suppkey) b, l_returnflag FROM lineitem WHERE l_partkey <> l_suppkey AND l_quantity > 10),
f AS (SELECT DISTINCT least(l_partkey, l_suppkey) a, greatest(l_partkey, l_suppkey) b, l_returnflag FROM lineitem WHERE l_partkey <> l_suppkey AND l_quantity < 40),
j AS (SELECT coalesce(g.l_returnflag, f.l_returnflag) AS l_returnflag, g.a IS NOT NULL AS ing, f.a IS NOT NULL AS inf FROM g FULL JOIN f ON g.a = f.a AND g.b = f.b AND g.l_returnflag = f.l_returnflag),
c AS (SELECT l_returnflag, count(*) FILTER (WHERE ing AND inf) AS tp, count(*) FILTER (WHERE NOT ing) AS fp, count(*) FILTER (WHERE NOT inf) AS fn FROM j GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM c""")
def edge_set_prf(spark, sf):
    lines = t(spark, sf, "lineitem").filter("l_partkey <> l_suppkey").select("l_returnflag", "l_quantity", F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"))
    return R.set_score(lines.filter("l_quantity > 10"), lines.filter("l_quantity < 40"), ["l_returnflag", "a", "b"], ["l_returnflag"])


@query("""SELECT quality, count(*) FILTER (WHERE toxic = 0) AS toxic_0, count(*) FILTER (WHERE toxic = 1) AS toxic_1 FROM labels GROUP BY quality""")
def confusion_pivot(spark, sf):
    out = t(spark, sf, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return out.select("quality", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1"))


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT 'p_brand' AS side, p_brand AS key, count(*) AS partners, arg_min(p_type, (n, p_type)) AS minority FROM c GROUP BY p_brand HAVING count(*) > 1
UNION ALL SELECT 'p_type', p_type, count(*), arg_min(p_brand, (n, p_brand)) FROM c GROUP BY p_type HAVING count(*) > 1""")
def wire_number_conflicts(spark, sf):
    return R.conflicts(t(spark, sf, "part"), "p_brand", "p_type")


@query("""
WITH w AS (SELECT DISTINCT substr(c_name, 10) AS w FROM customer)
SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w AND levenshtein(a.w, b.w) = 1""")
def near_string_pairs(spark, sf):
    return R.near_strings(t(spark, sf, "customer").select(F.expr("substr(c_name, 10)").alias("w")), "w")


@query("""
WITH s AS (SELECT s_suppkey, translate(upper('q' || s_suppkey), 'OQIB', '0018') AS c FROM supplier), p AS (SELECT p_partkey, translate(upper('O' || p_partkey), 'OQIB', '0018') AS c FROM part),
e AS (SELECT s_suppkey, p_partkey, 'exact' AS how FROM s JOIN p USING (c)), r AS (SELECT * FROM s WHERE c NOT IN (SELECT c FROM p))
SELECT * FROM e UNION ALL SELECT s_suppkey, min(p_partkey), 'prefix' FROM r JOIN p ON starts_with(p.c, r.c) GROUP BY s_suppkey HAVING count(*) = 1""")
def canonical_name_join(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("s_dev"))
    p = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("O"), F.col("p_partkey").cast("string")).alias("p_dev"))
    return R.canonical_join(s, "s_dev", p, "p_dev", text.folded).select("s_suppkey", "p_partkey", "how")


@query("""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '[A-Z]{1,3}[0-9]{5}') THEN 'sheet' WHEN regexp_matches(text, '[\\w.]+@[\\w.]+') THEN 'address'
  WHEN regexp_matches(text, 'https?://') THEN 'link' WHEN regexp_matches(text, '[0-9]{3}') THEN 'number' WHEN regexp_matches(text, '[|]') THEN 'table' ELSE 'prose' END AS kind FROM documents) GROUP BY kind""")
def regex_cascade(spark, sf):
    rules = [("sheet", r"[A-Z]{1,3}[0-9]{5}"), ("address", r"[\w.]+@[\w.]+"), ("link", r"https?://"), ("number", r"[0-9]{3}"), ("table", r"[|]")]
    return t(spark, sf, "documents").groupBy(text.first_kind(F.col("text"), rules, "prose").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word""")
def lexicon_counts(spark, sf):
    return t(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT CAST(p_size AS VARCHAR) || chr(CAST(CASE WHEN p_partkey % 9 = 0 THEN 79 WHEN p_partkey % 9 = 1 THEN 81 ELSE 48 END AS INTEGER)) AS word FROM part), c AS (SELECT word, count(*) AS n, translate(word, 'OQIB', '0018') AS k FROM w GROUP BY word)
SELECT a.word, a.n, arg_min(b.word, (-b.n, b.word)) AS replacement FROM c a JOIN c b ON a.k = b.k AND a.word <> b.word AND b.n >= greatest(2, 2 * a.n) GROUP BY a.word, a.n""")
def correct_token(spark, sf):
    last = F.when(F.col("p_partkey") % 9 == 0, "O").when(F.col("p_partkey") % 9 == 1, "Q").otherwise("0")
    words = t(spark, sf, "part").select(F.concat(F.col("p_size").cast("string"), last).alias("word"))
    return R.corrected(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query("""SELECT event_type, count(k) AS n, min(k) AS lo, max(k) AS hi, sum(k)::BIGINT AS total FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def json_attributes(spark, sf):
    k = F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)")
    return t(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("k").alias("total"))


@query("""
WITH s AS (SELECT o_custkey AS i, list_distinct(list(l_partkey % 40)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT i FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.i <> x.i AND list_has_all(x.s, y.s) AND (len(y.s) < len(x.s) OR y.i < x.i))""")
def absorption(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("e")).join(t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("i")), F.col("l_orderkey") == F.col("o_orderkey"))
    # Dealt as numbers: sets that each task has begun are many times as long. Written once, since they are read twice.
    sets = graph.cut_lineage(P.spread(lines.select("i", "e"), ["i"]).groupBy("i").agg(F.collect_set("e").alias("s")))
    return R.absorbed(sets, "i", "s").select("i")


@query("""
WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT user_id, sum(least(a.n, b.n))::BIGINT AS shared FROM a JOIN b USING (user_id, event_type) GROUP BY user_id""")
def multiset_intersection(spark, sf):
    e = t(spark, sf, "events")
    return R.shared_tokens(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_type")


# --- places ---------------------------------------------------------------------------------------------------------


def _boxes(spark, sf) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return t(spark, sf, "embeddings").select("vec_id", "label", e(0).alias("cx"), e(1).alias("cy"), (F.abs(e(2)) + 0.05).alias("w"), (F.abs(e(3)) + 0.05).alias("h"))


_BOXES = "b AS (SELECT vec_id, label, embedding[1]::DOUBLE AS cx, embedding[2]::DOUBLE AS cy, abs(embedding[3]::DOUBLE) + 0.05 AS w, abs(embedding[4]::DOUBLE) + 0.05 AS h FROM embeddings)"


@query(f"""
WITH {_BOXES}, p AS (SELECT x.label, x.vec_id AS l, y.vec_id AS r,
  greatest(least(x.cx + x.w / 2, y.cx + y.w / 2) - greatest(x.cx - x.w / 2, y.cx - y.w / 2), 0) * greatest(least(x.cy + x.h / 2, y.cy + y.h / 2) - greatest(x.cy - x.h / 2, y.cy - y.h / 2), 0) AS i, x.w * x.h + y.w * y.h AS s
  FROM b x JOIN b y ON x.label = y.label AND x.vec_id < y.vec_id)
SELECT label, l, r, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.3""")
def boxes_iou_pairs(spark, sf):
    b = _boxes(spark, sf)
    out = P.box_overlaps(b, b, ["label"], 0.3, 0.25).filter("l.vec_id < r.vec_id")
    return out.select("label", F.col("l.vec_id").alias("l"), F.col("r.vec_id").alias("r"), F.round("iou", 6).alias("iou"))


@query(f"""
WITH {_BOXES}, q AS (SELECT vec_id AS point_id, label, embedding[5]::DOUBLE AS px, embedding[6]::DOUBLE AS py FROM embeddings)
SELECT q.label, point_id, min(b.vec_id) AS vec_id FROM q JOIN b ON q.label = b.label AND abs(px - cx) <= w / 2 AND abs(py - cy) <= h / 2 GROUP BY 1, 2""")
def point_in_box(spark, sf):
    points = t(spark, sf, "embeddings").select("label", F.col("vec_id").alias("point_id"), F.col("embedding")[4].cast("double").alias("px"), F.col("embedding")[5].cast("double").alias("py"))
    return P.owners(points, _boxes(spark, sf), ["label"], ["vec_id"], 0.25, keep=["vec_id"])


@query("""
WITH q AS (SELECT vec_id AS point_id, label, embedding[5]::DOUBLE AS px, embedding[6]::DOUBLE AS py FROM embeddings), r AS (SELECT vec_id AS target_id, label, embedding[7]::DOUBLE AS tx, embedding[8]::DOUBLE AS ty FROM embeddings),
d AS (SELECT q.label, point_id, target_id, sqrt((px - tx) ** 2 + (py - ty) ** 2) AS distance FROM q JOIN r ON q.label = r.label)
SELECT label, point_id, arg_min(target_id, (distance, target_id)) AS target_id, round(min(distance), 9) AS distance FROM d WHERE distance <= 0.1 GROUP BY 1, 2""")
def nearest_1nn(spark, sf):
    e = t(spark, sf, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    points, targets = e.select("label", F.col("vec_id").alias("point_id"), at(4).alias("px"), at(5).alias("py")), e.select("label", F.col("vec_id").alias("target_id"), at(6).alias("tx"), at(7).alias("ty"))
    return P.nearest(points, targets, ["label"], 0.1, "point_id", "target_id").withColumn("distance", F.round("distance", 9))


@query("""
WITH h AS (SELECT vec_id AS h_id, label, embedding[1]::DOUBLE AS x0, embedding[1]::DOUBLE + 0.3 AS x1, embedding[2]::DOUBLE AS y FROM embeddings), v AS (SELECT vec_id AS v_id, label, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y0, embedding[4]::DOUBLE + 0.3 AS y1 FROM embeddings)
SELECT h.label, h_id, v_id, x, y FROM h JOIN v ON h.label = v.label AND x BETWEEN x0 - 0.001 AND x1 + 0.001 AND y BETWEEN y0 - 0.001 AND y1 + 0.001""")
def segment_crossings(spark, sf):
    e = t(spark, sf, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    h = e.select(F.col("vec_id").alias("h_id"), "label", at(0).alias("x0"), (at(0) + 0.3).alias("x1"), at(1).alias("y"))
    v = e.select(F.col("vec_id").alias("v_id"), "label", at(2).alias("x"), at(3).alias("y0"), (at(3) + 0.3).alias("y1"))
    return P.crossings(h, v, ["label"], 0.15, 0.001)


@query("""
WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT a.label, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.label = b.label AND a.x < b.x GROUP BY 1)
SELECT p.label, round(slope, 6) AS slope, round(median(y - slope * x), 6) AS intercept FROM p JOIN s USING (label) GROUP BY p.label, slope""")
def theil_sen(spark, sf):
    p = t(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return P.theil_sen(p, ["label"], "x", "y").select("label", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""
WITH p AS (SELECT o_custkey AS l, l_suppkey AS r, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
m AS (SELECT *, n = max(n) OVER (PARTITION BY l) AS bl, n = max(n) OVER (PARTITION BY r) AS br FROM p),
k AS (SELECT *, count(*) FILTER (WHERE bl) OVER (PARTITION BY l) AS cl, count(*) FILTER (WHERE br) OVER (PARTITION BY r) AS cr FROM m)
SELECT l, r, n FROM k WHERE bl AND br AND cl = 1 AND cr = 1""")
def mutual_unique_links(spark, sf):
    pairs = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("l"), F.col("l_suppkey").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    return P.mutual_unique(pairs, "l", "r", "n")


@query()
def greedy_match(spark, sf):
    b = _boxes(spark, sf)
    return P.matched_boxes(b.filter("vec_id % 2 = 0"), b.filter("vec_id % 2 = 1"), ["label"], "vec_id", 0.2, 0.25)


# --- graphs and logic -----------------------------------------------------------------------------------------------


def _edges(spark, sf) -> DataFrame:
    """Chains of each user's events: an edge to the next one if it comes within two days."""
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = t(spark, sf, "events").select("user_id", "event_id", seconds("ts").alias("s"))
    e = e.select(F.col("event_id").alias("a"), F.lead("event_id").over(w).alias("b"), (F.lead("s").over(w) - F.col("s")).alias("step"))
    return e.filter("step <= 172800").select("a", "b")


# What the chains join, without following them: runs of events, each event's place in its run.
_RUNS = """WITH e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events),
m AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 172800 THEN 1 ELSE 0 END AS new, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS place FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m), r AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, run) AS least, count(*) OVER (PARTITION BY user_id, run) AS n FROM g)"""


@query(_RUNS + " SELECT event_id AS node, least AS component FROM r WHERE n > 1")
def connected_components(spark, sf):
    return graph.connected_components(_edges(spark, sf))


@query(_RUNS + """ SELECT x.event_id AS start, y.event_id AS node, abs(x.place - y.place)::INT AS depth FROM r x JOIN r y ON x.user_id = y.user_id AND x.run = y.run AND abs(x.place - y.place) <= 4 WHERE x.n > 1""")
def bfs_reach_depth(spark, sf):
    e = _edges(spark, sf)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return graph.reach(both, both.select("a").distinct(), 4, "a", "b")


@query("""
WITH x AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN TRUE WHEN event_type = 'click' THEN FALSE END AS v FROM events)
SELECT user_id, CASE WHEN count(*) FILTER (WHERE NOT v) > 0 THEN 'OFF' WHEN count(*) FILTER (WHERE v IS NULL) > 0 THEN 'UNKNOWN' ELSE 'ON' END AS series,
  CASE WHEN count(*) FILTER (WHERE v) > 0 THEN 'ON' WHEN count(*) FILTER (WHERE v IS NULL) > 0 THEN 'UNKNOWN' ELSE 'OFF' END AS parallel FROM x GROUP BY user_id""")
def kleene_eval(spark, sf):
    v = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "click", False)
    x = t(spark, sf, "events").select("user_id", v.alias("v"))
    return x.groupBy("user_id").agg(logic.verdict(logic.all_of(F.col("v"))).alias("series"), logic.verdict(logic.any_of(F.col("v"))).alias("parallel"))


@query("""
WITH r AS (SELECT n_nationkey, unnest(range(16)) AS i FROM nation), v AS (SELECT n_nationkey, i, (i & 1) > 0 AS a, (i & 2) > 0 AS b, (i & 4) > 0 AS c, (i & 8) > 0 AS d FROM r),
e AS (SELECT n_nationkey, i, (a AND (b OR c) AND d) = CASE WHEN n_nationkey % 2 = 0 THEN (a AND b AND d) OR (a AND c AND d) ELSE (a AND b) OR (c AND d) END AS same FROM v)
SELECT n_nationkey, bool_and(same) AS equivalent, min(CASE WHEN NOT same THEN i END) AS counterexample FROM e GROUP BY 1""")
def truth_table_equiv(spark, sf):
    bit = lambda k: F.col("i").bitwiseAND(F.lit(1 << k)) > 0
    a, b, c, d = map(bit, range(4))
    other = F.when(F.col("n_nationkey") % 2 == 0, (a & b & d) | (a & c & d)).otherwise((a & b) | (c & d))
    rows = t(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")).alias("i")).withColumn("same", (a & (b | c) & d) == other)
    return rows.groupBy("n_nationkey").agg(F.bool_and("same").alias("equivalent"), F.min(F.when(~F.col("same"), F.col("i"))).alias("counterexample"))


@query("""
SELECT o_custkey, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 4) AS precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 4) AS recall FROM (
  SELECT o_custkey, o_orderkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS tp, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'F') AS fp,
    count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS fn FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY o_custkey""")
def micro_average(spark, sf):
    rows = t(spark, sf, "orders").select("o_custkey", "o_orderkey").join(t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    found, gold = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    counts = rows.groupBy("o_custkey", "o_orderkey").agg(F.count_if(found & gold).alias("tp"), F.count_if(found & ~gold).alias("fp"), F.count_if(~found & gold).alias("fn"))
    total = counts.groupBy("o_custkey").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision, recall, _ = R.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select("o_custkey", precision, recall)


@query("""
WITH x AS (SELECT l_suppkey, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS base, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS cand FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN base IS NULL OR cand IS NULL THEN 'unknown' WHEN round(cand - base, 9) < -0.005 THEN 'hold' ELSE 'adopt' END AS decision FROM x""")
def adoption_rule(spark, sf):
    avg = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_discount")))
    x = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(avg("A").alias("base"), avg("R").alias("cand"))
    rule = F.when(F.col("base").isNull() | F.col("cand").isNull(), "unknown").when(F.round(F.col("cand") - F.col("base"), 9) < -0.005, "hold").otherwise("adopt")
    return x.select("l_suppkey", rule.alias("decision"))
