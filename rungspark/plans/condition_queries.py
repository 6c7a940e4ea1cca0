"""Queries of operators/conditions.py and functions/formula.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula
from ..operators import conditions as C
from ..operators import scenarios as S
from .queries import query, t

# An order is a circuit, its lines' numbers are relays, a line gives a branch of two contacts: by part and by supplier, of the devices 0 to 8.
_CIRCUITS = """WITH RECURSIVE x AS (SELECT l_orderkey AS c, l_linenumber AS d, l_partkey || '-' || l_suppkey AS br, l_partkey % 9 AS d1, l_returnflag = 'N' AS a1, l_suppkey % 9 AS d2, l_linestatus = 'O' AS a2 FROM lineitem),
l AS MATERIALIZED (SELECT DISTINCT c, d, br, d1 AS dep, a1 AS a FROM x UNION SELECT c, d, br, d2, a2 FROM x),
g AS MATERIALIZED (SELECT o_orderkey AS c, 0 AS dep, o_orderstatus = 'F' AS v FROM orders UNION ALL SELECT o_orderkey, 7, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE true END FROM orders WHERE o_custkey % 3 = 0),
n AS MATERIALIZED (SELECT l.*, g.dep IS NOT NULL AS fixed, g.v AS fv FROM l LEFT JOIN g USING (c, dep) WHERE c IN (SELECT c FROM g)),
s AS (SELECT 0 AS r, c, d, NULL::BOOLEAN AS v FROM (SELECT DISTINCT c, d FROM n) UNION ALL
  SELECT r + 1, c, d, CASE WHEN bool_or(v) THEN true WHEN count(*) FILTER (v IS NULL) > 0 THEN NULL ELSE false END FROM (
    SELECT r, c, d, br, CASE WHEN count(*) FILTER (NOT v) > 0 THEN false WHEN count(*) FILTER (v IS NULL) > 0 THEN NULL ELSE true END AS v FROM (
      SELECT k.r, n.c, n.d, n.br, CASE WHEN n.a THEN CASE WHEN fixed THEN fv ELSE s.v END ELSE NOT CASE WHEN fixed THEN fv ELSE s.v END END AS v
      FROM n JOIN (SELECT DISTINCT r FROM s) k ON true LEFT JOIN s ON s.c = n.c AND s.d = n.dep) GROUP BY r, c, d, br) WHERE r < 9 GROUP BY r, c, d)"""


def _circuits(spark, sf):
    x, o, c = t(spark, sf, "lineitem"), t(spark, sf, "orders"), F.col
    name = lambda k: c(k).cast("string")
    contact = lambda dep, closed: x.select(
        c("l_orderkey").alias("circuit_id"), name("l_linenumber").alias("device"), F.concat_ws("-", name("l_partkey"), name("l_suppkey")).alias("branch"), (c(dep) % 9).cast("string").alias("dep"),
        F.when(closed, "a").otherwise("b").alias("kind"))
    literals = contact("l_partkey", c("l_returnflag") == "N").unionByName(contact("l_suppkey", c("l_linestatus") == "O"))
    state = lambda rows, device, on: rows.select(c("o_orderkey").alias("circuit_id"), F.lit("now").alias("scenario"), F.lit(device).alias("device"), on.alias("on"))
    given = state(o, "0", c("o_orderstatus") == "F").unionByName(state(o.filter("o_custkey % 3 = 0"), "7", F.when(c("o_custkey") % 2 != 0, True)))
    return literals, given, o


@query(_CIRCUITS + """ SELECT c AS circuit_id, d::VARCHAR AS device, CASE WHEN v THEN 'ON' WHEN o_custkey % 10 = 0 THEN 'UNKNOWN' WHEN v IS NULL THEN 'UNKNOWN' ELSE 'OFF' END AS verdict
FROM s JOIN orders ON o_orderkey = c WHERE r = 9""")
def relay_verdicts(spark, sf):
    """Nine rounds are enough for the nine devices of the SQL; the operator goes on until nothing changes."""
    literals, given, o = _circuits(spark, sf)
    unseen = o.filter("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("circuit_id")).join(literals.select("circuit_id", "device").distinct(), "circuit_id")
    return C.evaluated(literals, given, open_ends=unseen).select("circuit_id", "device", "verdict")


_TEXTS = """WITH x AS (SELECT p_partkey, p_partkey % 5 AS k, [CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 7 < 4 END, p_retailprice > 1400] AS s FROM part),
y AS (SELECT p_partkey, k, s[1] AS a, s[2] AS b, s[3] AS c FROM x)"""


@query(_TEXTS + """ SELECT p_partkey, CASE k WHEN 0 THEN a AND (b OR NOT c) WHEN 1 THEN a AND b OR NOT b AND c WHEN 2 THEN NOT (a OR b) AND c WHEN 3 THEN (a OR b) AND (a OR c) END AS "on",
CASE k WHEN 0 THEN 'A & ("B 1" | !C)' WHEN 1 THEN '(A & "B 1") | (!"B 1" & C)' WHEN 2 THEN '!(A | "B 1") & C' WHEN 3 THEN '(A | "B 1") & (A | C)' END AS printed FROM y""")
def formula_values(spark, sf):
    """Formulas as text, read, evaluated with unknown states and printed again; the fifth is none."""
    c = F.col
    texts = ['A ∧ ("B 1" ∨ ¬C)', 'A and "B 1" | !「B 1」 & C', 'NOT(A | "B 1")&C', '((A|"B 1")) & (A | !!C)', "A & (B"]
    text = F.element_at(F.array(*[F.lit(x) for x in texts]), (c("p_partkey") % 5 + 1).cast("int"))
    a, b = F.when(c("p_size") % 3 != 0, c("p_size") % 3 == 1), F.when(c("p_partkey") % 7 != 0, c("p_partkey") % 7 < 4)
    rows = t(spark, sf, "part").select("p_partkey", formula.parsed(text).alias("nodes"), F.create_map(F.lit("A"), a, F.lit("B 1"), b, F.lit("C"), c("p_retailprice") > 1400).alias("states"))
    return rows.select("p_partkey", formula.value(c("nodes"), c("states")).alias("on"), formula.printed(c("nodes")).alias("printed"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey % 6 AS p, l_suppkey % 6 AS s FROM lineitem), a AS (SELECT unnest(range(64)) AS i)
SELECT l_orderkey, sum(CASE WHEN "on" THEN 1 ELSE 0 END)::BIGINT AS assignments FROM (SELECT l_orderkey, i, bool_or((i >> p) & 1 = 1 AND (i >> s) & 1 = 1) AS "on" FROM l, a GROUP BY 1, 2) GROUP BY 1""")
def factored_assignments(spark, sf):
    """The condition of an order, a branch of two contacts for each line, with what branches share taken out: of the 64 states of six devices, how many it holds in."""
    name = lambda k: F.struct((F.col(k) % 6).cast("string").alias("device"), F.lit("a").alias("kind"))
    orders = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.array(name("l_partkey"), name("l_suppkey"))).alias("branches"))
    texts = orders.select("l_orderkey", formula.factored("branches").alias("text"))
    # Few texts differ: each is read once.
    state = lambda i: F.map_from_entries(F.array(*[F.struct(F.lit(str(d)), F.getbit(i, F.lit(d)) == 1) for d in range(6)]))
    nodes = texts.select("text").distinct().select("text", formula.parsed(F.col("text")).alias("nodes")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    held = nodes.groupBy("text").agg(F.count_if(formula.value(F.col("nodes"), state(F.col("i").cast("long")))).alias("assignments"))
    return texts.join(held, "text").select("l_orderkey", "assignments")


@query(_CIRCUITS + """, k AS (SELECT c, d, v FROM s WHERE r = 9), q AS (SELECT o_orderkey AS c, CASE WHEN o_custkey % 4 = 0 THEN 9 ELSE o_custkey % 7 + 1 END AS d, CASE o_orderstatus WHEN 'F' THEN 'ON' WHEN 'O' THEN 'OFF' END AS want FROM orders),
h AS (SELECT DISTINCT c, d FROM l)
SELECT q.c AS circuit_id, CASE WHEN h.d IS NULL THEN 'found' ELSE 'case_1' END AS "check", CASE WHEN h.d IS NULL THEN false ELSE want = CASE WHEN v THEN 'ON' WHEN v IS NULL THEN 'UNKNOWN' ELSE 'OFF' END END AS ok
FROM q LEFT JOIN h USING (c, d) LEFT JOIN k USING (c, d) WHERE h.d IS NULL OR want IS NOT NULL""")
def scenario_checks(spark, sf):
    """Each order expects of one of its relays, or of one that it does not have, what its status says; the states are those of relay_verdicts."""
    literals, given, o = _circuits(spark, sf)
    c, key = F.col, F.col("o_custkey")
    subject = F.when(key % 4 == 0, 9).otherwise(key % 7 + 1).cast("string")
    wanted = o.select(c("o_orderkey").alias("circuit_id"), F.lit("S").alias("scenario_id"), subject.alias("subject"), F.lit(False).alias("forward"), F.lit(None).cast("string").alias("condition"), F.array().cast("array<string>").alias("affected"))
    states = given.groupBy("circuit_id").agg(F.map_from_entries(F.collect_list(F.struct("device", "on"))).alias("states"))
    expected = F.when(c("o_orderstatus") == "F", "on").when(c("o_orderstatus") == "O", "不成立").otherwise("")
    cases = o.select(c("o_orderkey").alias("circuit_id"), F.lit("S").alias("scenario_id"), F.lit(1).alias("nth"), expected.alias("expected")).join(states, "circuit_id")
    return S.checked(wanted, cases, literals).select("circuit_id", "check", "ok")
