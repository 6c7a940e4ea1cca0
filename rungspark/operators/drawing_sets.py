"""Sets of drawings: which sheets their tags name, what a set lacks, and how all drawings fall into groups.

pages: page_id, name, sheet (its number or null); references: page_id, target (a sheet number); members: set_id, page_id.
Defined results: a page without a sheet number has no references resolved to it; null targets are no references; a page in no set takes part only
in candidates and groups; repeated references of a page count once in groups and each in the lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .graph import connected_components
from .relational import numbered


def resolved(references: DataFrame, pages: DataFrame) -> DataFrame:
    """references with to_page and how: the page of exactly that sheet, else of its base number (the first by id), else nulls."""
    exact = pages.filter("sheet IS NOT NULL").groupBy(F.col("sheet").alias("s__")).agg(F.min("page_id").alias("exact__"))
    base = pages.filter("sheet IS NOT NULL").groupBy(text.base_sheet(F.col("sheet")).alias("b__")).agg(F.min("page_id").alias("base__"))
    out = references.join(exact, F.col("target") == F.col("s__"), "left").join(base, text.base_sheet(F.col("target")) == F.col("b__"), "left")
    how = F.when(F.col("exact__").isNotNull(), "exact").when(F.col("base__").isNotNull(), "base")
    return out.select(*references.columns, F.coalesce("exact__", "base__").alias("to_page"), how.alias("how"))


def missing_sheets(members: DataFrame, pages: DataFrame, references: DataFrame) -> DataFrame:
    """set_id, sheet, referenced_by (pages), n, candidates (pages outside the set with that sheet) of the sheets that a set's pages name and it lacks."""
    placed = members.join(pages, "page_id")
    own = placed.filter("sheet IS NOT NULL").select("set_id", text.base_sheet(F.col("sheet")).alias("sheet")).distinct()
    named = members.join(references.filter("target IS NOT NULL"), "page_id").select("set_id", "page_id", text.base_sheet(F.col("target")).alias("sheet"))
    lacks = named.join(own, ["set_id", "sheet"], "left_anti")
    rows = lacks.groupBy("set_id", "sheet").agg(F.array_sort(F.collect_set("page_id")).alias("referenced_by"), F.count(F.lit(1)).alias("n"))
    # A set that lacks a sheet has no page of it, so all pages of that sheet are candidates.
    others = pages.filter("sheet IS NOT NULL").groupBy(text.base_sheet(F.col("sheet")).alias("sheet")).agg(F.array_sort(F.collect_set("page_id")).alias("candidates"))
    return rows.join(others, "sheet", "left").select("set_id", "sheet", "referenced_by", "n", F.coalesce("candidates", F.array().cast("array<bigint>")).alias("candidates"))


def completeness(members: DataFrame, pages: DataFrame, references: DataFrame) -> DataFrame:
    """set_id, n_pages, missing, without_sheet, complete."""
    lacks = missing_sheets(members, pages, references).groupBy("set_id").agg(F.count(F.lit(1)).alias("missing"))
    counts = members.join(pages, "page_id").groupBy("set_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("sheet").isNull()).alias("without_sheet"))
    out = counts.join(lacks, "set_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0).cast("long")))
    return out.select("set_id", "n_pages", "missing", "without_sheet", ((F.col("missing") == 0) & (F.col("without_sheet") == 0)).alias("complete"))


def groups(pages: DataFrame, references: DataFrame) -> DataFrame:
    """page_id, group_id (the least page of the group), size: pages connected by what their tags name; single pages too."""
    sheets = pages.filter("sheet IS NOT NULL").select(F.col("page_id").alias("to_page"), text.base_sheet(F.col("sheet")).alias("base"))
    edges = references.select("page_id", text.base_sheet(F.col("target")).alias("base")).join(sheets, "base").select("page_id", "to_page")
    named = pages.select("page_id").join(connected_components(edges, "page_id", "to_page").withColumnRenamed("node", "page_id"), "page_id", "left")
    named = named.withColumn("group_id", F.coalesce("component", "page_id"))
    return named.join(named.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")), "group_id").select("page_id", "group_id", "size")


def suggested(pages: DataFrame, references: DataFrame) -> DataFrame:
    """place, name, page_ids, sheets, missing_sheets: the groups of pages, the largest first, then by name (the first of their sheets, or their first page's name), and the base sheets that
    their tags name but no page has. pages: page_id, name, sheet; references: page_id, target."""
    c = F.col
    of = groups(pages, references).select("page_id", "group_id")
    have = pages.filter("sheet IS NOT NULL").select(text.base_sheet(c("sheet")).alias("base")).distinct()
    lost = references.select("page_id", text.base_sheet(c("target")).alias("base")).distinct().join(have, "base", "left_anti").join(of, "page_id")
    lost = lost.groupBy("group_id").agg(F.array_sort(F.collect_set("base")).alias("missing_sheets"))
    members = pages.join(of, "page_id").groupBy("group_id").agg(F.array_sort(F.collect_list("page_id")).alias("page_ids"), F.array_sort(F.collect_set("sheet")).alias("sheets"), F.min_by("name", "page_id").alias("first"))
    rows = members.join(lost, "group_id", "left").withColumn("missing_sheets", F.coalesce("missing_sheets", F.array().cast("array<string>"))).withColumn("name", F.coalesce(F.try_element_at("sheets", F.lit(1)), c("first")))
    return numbered(rows, [], [F.desc(F.size("page_ids")), F.asc("name"), F.asc("group_id")], "place").select("place", "name", "page_ids", "sheets", "missing_sheets")


def table_rows(elements: DataFrame, wires: DataFrame, links: DataFrame) -> DataFrame:
    """The correspondence table: kind, element_id, other_id, text, judgement; elements without a partner have nulls there."""
    rows = elements.select(F.col("kind"), "element_id", "text")
    for kind, df in (("wire", wires), ("sheet_ref", links)):
        rows = rows.unionByName(df.select(F.lit(kind).alias("kind"), F.col("a").alias("element_id"), F.col("b").alias("other_id"), "judgement"), allowMissingColumns=True)
    return rows.select("kind", "element_id", "other_id", "text", "judgement")


def text_agreement(gold: DataFrame, machine: DataFrame) -> DataFrame:
    """kind, gold, found, compared, exact: elements of gold by kind, those the machine has, and of those with a text the equal ones (spaces aside)."""
    plain = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(" "), F.lit(""))
    mine = machine.groupBy("element_id").agg(F.max("text").alias("m__")).withColumn("there__", F.lit(True))
    rows = gold.join(mine, "element_id", "left")
    said = F.coalesce("text", F.lit("")) != ""
    there = F.coalesce("there__", F.lit(False))
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("gold"), F.count_if(there).alias("found"), F.count_if(there & said).alias("compared"), F.count_if(there & said & (plain("text") == plain("m__"))).alias("exact")
    )
