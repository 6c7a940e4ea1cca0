"""Scenarios, what people expect of a circuit, held against it: conditions, verdicts of cases, what a device affects.

Defined results: empty tables give empty results; a subject that is no device fails with `not_found`; cases that expect nothing are not checked; repeated
cases are checked each; formulas that cannot be read are no condition and fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formula
from . import conditions as C
from . import graph
from . import wiring

# How people write verdicts.
VERDICTS = {"ON": ("成立", "on", "1", "true"), "OFF": ("不成立", "off", "0", "false"), "UNKNOWN": ("判定不能", "不明", "?", "unknown")}


def verdict_of(expected: Column) -> Column:
    word = F.lower(F.trim(expected))
    out = F.lit(None).cast("string")
    for verdict, words in VERDICTS.items():
        out = F.when(word.isin(*words, verdict.lower()), verdict).otherwise(out)
    return out


def formulas_differ(pairs: DataFrame, by: list[str], left: str, right: str, most: int = 16, samples: int = 4096) -> DataFrame:
    """by, equal, exhaustive, counterexample (map of states) of formulas as nodes (see formula.parsed()). Up to `most` variables all assignments are tried, beyond that `samples`
    drawn by hash; the first one under which they differ is the counterexample. A null formula equals none."""
    names = formula.variables(F.concat(left, right))
    rows = pairs.select(*by, F.col(left).alias("l__"), F.col(right).alias("r__"), names.alias("v__"))
    whole = F.size("v__") <= most
    n = F.when(whole, F.pow(F.lit(2.0), F.size("v__")).cast("int")).otherwise(F.lit(samples))
    tried = rows.withColumn("i__", F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)))
    bit = lambda k: F.col("i__").bitwiseAND(F.pow(F.lit(2.0), F.least(k, F.lit(30))).cast("int")) != 0
    bits = F.transform("v__", lambda x, k: F.when(whole, bit(k)).otherwise(F.pmod(F.xxhash64(F.col("i__"), x), F.lit(2)) == 1))
    tried = tried.withColumn("states__", F.map_from_arrays("v__", bits))
    differ = ~formula.value(F.col("l__"), F.col("states__")).eqNullSafe(formula.value(F.col("r__"), F.col("states__")))
    found = tried.withColumn("d__", F.col("l__").isNull() | F.col("r__").isNull() | differ)
    out = found.groupBy(*by).agg((F.count_if("d__") == 0).alias("equal"), F.first(whole).alias("exhaustive"), F.min_by("states__", F.when(F.col("d__"), F.col("i__"))).alias("counterexample"))
    return out.withColumn("exhaustive", F.coalesce("exhaustive", F.lit(True)))


def condition_texts(literals: DataFrame) -> DataFrame:
    """circuit_id, device, text of each device's condition, with what branches share taken out. literals: see conditions.py; a device's branches are by nature few."""
    contact = F.when(F.col("dep").isNotNull(), F.struct(F.col("dep").alias("device"), "kind"))
    branches = literals.groupBy("circuit_id", "device", "branch").agg(F.collect_set(contact).alias("b"))
    return branches.groupBy("circuit_id", "device").agg(F.collect_set("b").alias("bs")).select("circuit_id", "device", formula.factored("bs").alias("text"))


def checked(scenarios: DataFrame, cases: DataFrame, literals: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """circuit_id, scenario_id, check (found, condition, case_n, affected), ok, expected, actual.

    scenarios: circuit_id, scenario_id, subject, forward, condition (text), affected (array); cases: circuit_id, scenario_id, nth, states (map), expected. A backward scenario asks
    for the condition of its subject and for verdicts, a forward one for the devices that its subject affects through relays."""
    key = ["circuit_id", "scenario_id"]
    devices = literals.select("circuit_id", F.col("device").alias("subject")).distinct()
    every = devices.unionByName(literals.select("circuit_id", F.col("dep").alias("subject")).filter("subject IS NOT NULL")).distinct()
    backward, forward = scenarios.filter("NOT forward"), scenarios.filter("forward")
    row = lambda df, check, ok, expected, actual: df.select(*key, check.alias("check"), ok.alias("ok"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))
    lost = backward.join(devices, ["circuit_id", "subject"], "left_anti").unionByName(forward.join(every, ["circuit_id", "subject"], "left_anti"))
    out = row(lost, F.lit("found"), F.lit(False), F.col("subject"), F.lit("not_found"))

    written = backward.filter("condition IS NOT NULL")
    if not written.isEmpty():  # literals are gathered only for those who ask
        own = written.join(condition_texts(literals).withColumnRenamed("device", "subject"), ["circuit_id", "subject"])
        own = graph.cut_lineage(own.select(*key, "condition", "text", formula.parsed(F.col("condition")).alias("l"), formula.parsed(F.col("text")).alias("r")))
        same = formulas_differ(own, key, "l", "r")
        out = out.unionByName(row(own.join(same, key), F.lit("condition"), F.col("equal"), F.col("condition"), F.col("text")))

    asked = cases.join(backward.join(devices, ["circuit_id", "subject"]).select(*key, "subject"), key).withColumn("want", verdict_of(F.col("expected"))).filter("want IS NOT NULL")
    asked = graph.cut_lineage(asked.withColumn("scenario", F.concat_ws("#", "scenario_id", F.col("nth").cast("string"))))
    # Every case is a scenario of the evaluation, also one that gives no states.
    given = asked.select("circuit_id", "scenario", F.explode_outer("states").alias("device", "on"))
    if before is not None:
        before = before.join(asked.select("circuit_id", "scenario_id", "scenario"), key).select("circuit_id", "scenario", "device", "on")
    found = C.evaluated(literals, given, before).select("circuit_id", "scenario", F.col("device").alias("subject"), "verdict")
    met = asked.join(found, ["circuit_id", "scenario", "subject"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNKNOWN")))
    out = out.unionByName(row(met, F.concat(F.lit("case_"), F.col("nth").cast("string")), F.col("verdict") == F.col("want"), F.col("want"), F.col("verdict")))

    if forward.isEmpty():
        return out
    scoped = literals.select(F.concat_ws("|", F.col("circuit_id").cast("string"), "device").alias("load"), "branch", F.concat_ws("|", F.col("circuit_id").cast("string"), "dep").alias("device"))
    starts = forward.join(every, ["circuit_id", "subject"]).select(*key, "affected", F.concat_ws("|", F.col("circuit_id").cast("string"), "subject").alias("start"))
    reached = wiring.effects(scoped, starts.select("start").distinct()).groupBy("start").agg(F.array_sort(F.collect_set(F.regexp_replace("target", r"^[^|]*\|", ""))).alias("got"))
    met = starts.join(reached, "start", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>"))).withColumn("want", F.array_sort(F.array_distinct("affected")))
    return out.unionByName(row(met, F.lit("affected"), F.col("got") == F.col("want"), F.array_join("want", ","), F.array_join("got", ",")))
