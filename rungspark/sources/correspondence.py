"""The tables that people correct and send back: correspondence rows and scenarios, as CSV files that open well in spreadsheets.

Files are parsed one by one inside tasks (they are made by hand, a file is small; there may be many), read through Spark, so from any store.

Defined results: a file's header says what it is, files with another header are left out; cells are trimmed, rows without any text dropped; missing columns
are empty, further ones ignored; a file without rows gives none; a folder without files is an error, as for any source.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed format: the columns of both tables, and the words for forward questions and for states.
COLUMNS = ("図面セットID", "ページID", "要素ID", "種別", "原文", "参照・接続先ID", "判定", "根拠・備考")
SCENARIO_COLUMNS = ("シナリオID", "問い", "対象・起点", "成立条件", "入力の状態", "期待する判定", "影響先", "ページ", "備考")
FORWARD = ("影響", "順引き", "影響確認", "forward")
ON_WORDS, UNKNOWN_WORDS = ("1", "true", "on", "動作", "閉"), ("?", "？", "不明", "")
#: The same columns in DataFrames.
FIELDS = ("set_id", "page_id", "element_id", "kind", "text", "other_id", "judgement", "note")
SCENARIO_FIELDS = ("scenario_id", "question", "subject", "condition", "states", "expected", "affected", "pages", "note")
BOM = "﻿"


def write_table(rows: DataFrame, path: str, fields: tuple[str, ...] = FIELDS, columns: tuple[str, ...] = COLUMNS, files: int = 1) -> None:
    """CSV files, each with the header and a byte order mark; nulls are empty cells. rows: the columns `fields`."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for b in batches:
            out = io.StringIO()
            w = csv.writer(out, lineterminator="\n")
            if first:
                w.writerow(columns)
            w.writerows(b.fillna("").itertuples(index=False))
            yield pd.DataFrame({"value": [(BOM if first else "") + out.getvalue().removesuffix("\n")]})
            first = False
        if first:
            yield pd.DataFrame({"value": [BOM + ",".join(columns)]})

    rows.select(*[F.col(f).cast("string").alias(f) for f in fields]).coalesce(files).mapInPandas(lines, "value string").write.text(path)


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """table and scenarios: the rows of all files, with their file and place (nth). A scenario without an id gets the next S number of its file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = list(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline="")))
                header = [h.strip() for h in rows[0]] if rows else []
                scenario = "シナリオID" in header
                if not scenario and "要素ID" not in header:
                    continue
                out, ids = [], {}
                for row in rows[1:]:
                    cells = {h: v.strip() for h, v in zip(header, row, strict=False) if h}
                    if not any(cells.values()):
                        continue
                    if scenario:
                        cells["シナリオID"] = cells.get("シナリオID") or f"S{len(ids) + 1}"
                        ids.setdefault(cells["シナリオID"])
                    out.append([cells.get(c, "") for c in (SCENARIO_COLUMNS if scenario else COLUMNS)])
                yield pd.DataFrame({"file": file, "nth": range(len(out)), "scenario": scenario, "cells": out})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, nth int, scenario boolean, cells array<string>")
    named = lambda df, fields: df.select("file", "nth", *[F.get("cells", F.lit(i)).alias(f) for i, f in enumerate(fields)])
    return {"table": named(rows.filter("NOT scenario"), FIELDS), "scenarios": named(rows.filter("scenario"), SCENARIO_FIELDS)}


def case_states(text: Column) -> Column:
    """`A=1, B=0, C=?` as a map from name to true, false or null (unknown); commas of any width, quoted names; the last of several counts."""
    parts = F.filter(F.split(text, "[,、，]"), lambda x: x.contains("="))
    name = lambda x: F.regexp_replace(F.trim(F.substring_index(x, "=", 1)), '^"+|"+$', "")
    word = lambda x: F.trim(F.regexp_replace(x, "^[^=]*=", ""))
    value = lambda x: F.when(~word(x).isin(*UNKNOWN_WORDS), F.lower(word(x)).isin(*ON_WORDS))
    entries = F.transform(parts, lambda x: F.struct(name(x).alias("k"), value(x).alias("v")))
    kept = F.filter(entries, lambda e: ~F.exists(F.slice(entries, F.array_position(entries, e).cast("int") + 1, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(kept, lambda e: e["k"])), lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])))


def scenarios_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scenarios (file, scenario_id, question, subject, condition, affected, pages) and cases (file, scenario_id, nth, states, expected), from the rows of read_tables().
    Rows of one id belong together: the first question and subject count, the last condition, all affected ones and pages."""
    words = lambda c: F.filter(F.transform(F.split(c, "[,、]"), lambda x: F.trim(x)), lambda x: x != "")
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    grouped = rows.groupBy("file", "scenario_id").agg(
        F.coalesce(F.min_by(said("question"), F.when(said("question").isNotNull(), F.col("nth"))), F.lit("起動条件")).alias("question"),
        F.min_by("subject", "nth").alias("subject"),
        F.max_by(said("condition"), F.when(said("condition").isNotNull(), F.col("nth"))).alias("condition"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(words(F.col("affected")))))).alias("affected"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(words(F.col("pages")))))).alias("pages"),
    )
    forward = F.col("question").isin(*FORWARD)
    cases = rows.filter((F.col("states") != "") | (F.col("expected") != "")).join(grouped.filter(~forward).select("file", "scenario_id"), ["file", "scenario_id"], "left_semi")
    return grouped.withColumn("forward", forward), cases.select("file", "scenario_id", "nth", case_states(F.col("states")).alias("states"), "expected")
