"""Consistency checks: independent sources that must agree. Every check gives issues of one shape: check, severity, circuit_id, subject, message.

Defined results: empty tables give no issues; null labels and numbers are not compared; repeated rows raise an issue once after roll_up(); further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import relational as R, spatial
from .circuit import Circuit


def _issues(df: DataFrame, check: str, severity: str, subject, message) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "circuit_id", subject.cast("string").alias("subject"), message.alias("message"))


def wire_numbers(nodes: DataFrame, connections: DataFrame) -> DataFrame:
    """A number on two nodes, or two numbers on one node. connections: page_id, from_symbol, from_terminal, wire_no."""
    ends = connections.filter("wire_no <> ''").select("page_id", F.col("from_symbol").alias("symbol_ref"), F.col("from_terminal").alias("terminal"), "wire_no")
    placed = ends.join(nodes, ["page_id", "symbol_ref", "terminal"]).withColumn("node", F.concat_ws("|", "circuit_id", "node")).withColumn("wire_no", F.concat_ws("|", "circuit_id", "wire_no"))
    found = R.conflicts(placed, "node", "wire_no").withColumn("circuit_id", F.substring_index("key", "|", 1))
    return _issues(found, "wire_numbers", "warning", F.substring_index("key", "|", -1), F.format_string("%d partners, least seen: %s", "partners", F.substring_index("minority", "|", -1)))


def open_terminals(circuit: Circuit) -> DataFrame:
    return _issues(circuit.diagnostics.filter("check = 'open'"), "open_terminals", "warning", F.col("subject"), F.lit("nothing else on its node"))


def input_names(circuit: Circuit) -> DataFrame:
    """The kind that a push button's name implies against the kind drawn; a name that implies both or none says nothing."""
    implied = text.implied_contact(F.col("device"))
    rows = circuit.elements.filter("kind IN ('a', 'b') AND NOT has_coil").withColumn("implied", implied).filter("implied <> kind")
    return _issues(rows, "input_names", "info", F.col("ref"), F.format_string("%s suggests %s, drawn as %s", "device", "implied", "kind"))


def near_names(circuit: Circuit) -> DataFrame:
    """Inputs whose name is one edit away from a coil's: likely misread contacts."""
    coils, inputs = circuit.elements.filter("class_key = 'coil'").select("circuit_id", F.col("device").alias("coil")).distinct(), circuit.inputs
    names = inputs.select("circuit_id", F.col("device").alias("w")).unionByName(coils.select("circuit_id", F.col("coil").alias("w")))
    pairs = R.near_strings(names, "w")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = inputs.join(both, F.col("device") == F.col("a")).join(coils.withColumnRenamed("circuit_id", "c__"), (F.col("b") == F.col("coil")) & (F.col("circuit_id") == F.col("c__")))
    return _issues(rows, "near_names", "info", F.col("device"), F.format_string("one edit from coil %s", "coil"))


def sheet_links(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facing tags of two pages. tags: circuit_id, page_id, ref, sheet (of the page), target (sheet named), idents (array).
    Pairs that are each other's only strongest partner (2: a common ident, 1: one side without idents); issues for the rest."""
    side = lambda s: tags.select("circuit_id", *[F.col(c).alias(f"{c}_{s}") for c in ("page_id", "ref", "sheet", "target", "idents")], F.concat_ws("|", "page_id", "ref").alias(s))
    met = side("a").join(side("b"), "circuit_id").filter("target_a = sheet_b AND target_b = sheet_a AND page_id_a <> page_id_b")
    strength = F.when(F.arrays_overlap("idents_a", "idents_b"), 2).when((F.size("idents_a") == 0) | (F.size("idents_b") == 0), 1)
    pairs = spatial.mutual_unique(met.withColumn("strength", strength).filter("strength IS NOT NULL"), "a", "b", "strength").filter("a < b")
    linked = pairs.select(F.explode(F.array("a", "b")).alias("t"))
    alone = tags.withColumn("t", F.concat_ws("|", "page_id", "ref")).join(linked, "t", "left_anti")
    links = pairs.select("circuit_id", F.col("page_id_a").alias("page_a"), F.col("ref_a").alias("ref_a"), F.col("page_id_b").alias("page_b"), F.col("ref_b").alias("ref_b"))
    return links, _issues(alone, "sheet_links", "warning", F.col("ref"), F.concat(F.lit("no partner on "), F.coalesce("target", F.lit("?"))))


def table_rows(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """A relay table against the symbols drawn. rows: circuit_id, device, contact (a, b); symbols: circuit_id, device, kind (a, b, coil)."""
    key = lambda df: df.withColumn("k", text.folded(F.col("device")))
    table, drawn = key(rows), key(symbols)
    coil = table.select("circuit_id", "k", "device").distinct().join(drawn.filter("kind = 'coil'").select("circuit_id", "k").distinct(), ["circuit_id", "k"], "left_anti")
    listed = table.groupBy("circuit_id", "k", F.col("contact").alias("kind")).agg(F.count(F.lit(1)).alias("listed"), F.min("device").alias("device"))
    there = drawn.filter("kind IN ('a', 'b')").groupBy("circuit_id", "k", "kind").agg(F.count(F.lit(1)).alias("drawn"), F.min("device").alias("d"))
    differ = listed.join(there, ["circuit_id", "k", "kind"], "full").withColumns({"listed": F.coalesce("listed", F.lit(0)), "drawn": F.coalesce("drawn", F.lit(0)), "device": F.coalesce("device", "d")}).filter("listed <> drawn")
    return _issues(coil, "relay_table", "error", F.col("device"), F.lit("listed, but no coil is drawn")).unionByName(
        _issues(differ, "relay_table", "warning", F.col("device"), F.format_string("%d %s contacts listed, %d drawn", "listed", "kind", "drawn"))
    )


def stability(states: DataFrame) -> DataFrame:
    """Scenarios that do not settle. states: as settled() gives them."""
    return _issues(states.filter("oscillates").select("circuit_id", "scenario").distinct(), "stability", "error", F.col("scenario"), F.lit("the relays do not settle"))


def impact_bound(changes: DataFrame, reach: DataFrame) -> DataFrame:
    """What-if changes outside the static reach of what was changed. changes: circuit_id, source, device; reach: start, node."""
    rows = changes.withColumn("start", F.concat_ws("|", "circuit_id", "source")).withColumn("node", F.concat_ws("|", "circuit_id", "device")).join(reach.select("start", "node"), ["start", "node"], "left_anti")
    return _issues(rows, "impact", "error", F.col("device"), F.concat(F.lit("changed by "), F.col("source"), F.lit(" but not in its reach")))


def roll_up(issues: DataFrame) -> DataFrame:
    """check, severity, number of distinct issues; the gravest first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.distinct().groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy(rank, "check")
