"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing to target weights, sharding.

Every stage works on all that its predecessor kept and returns the columns of `documents` (the last one the shards):
`language` drops what it rejects (null texts, texts without a letter, languages that tie), `near_duplicates` keeps the document with
the least id of each group (ids of null last) and one of rows that are repeated as a whole, `decontaminate` drops documents that hold a
benchmark item, `mix` emits each document as often as its source's repetition rate says, `shard` places every emitted row.

Inside a stage a row goes by a hash of id and text, so null ids and ids with several texts are decided row by row. Texts
without words are nobody's near duplicate. A null source is a source of its own. Empty tables give empty results; further columns, also
of clashing names, are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungspark.llm import decontaminate, jaccard, langid, mixing, sharding
from rungspark.llm.common import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FEW_KEYS = 200_000  # up to which a list of row keys is broadcast


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))


def _listed(keys: DataFrame, tag: str) -> DataFrame:
    keys = stored(keys.select("row_key").distinct(), tag)
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = langid.classify(docs, langid.fit(docs), keep=tuple(COLUMNS[1:]))
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    classes = stored(jaccard.classes_of(rows, "row_key").select("row_key", "component_id").distinct(), "near-duplicate-classes")
    several = classes.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    ids = rows.select("row_key", "doc_id").distinct()
    groups = stored(classes.join(several, "component_id").join(ids, "row_key"), "near-duplicate-groups")
    stays = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"].alias("row_key"))
    kept = rows.join(_listed(groups.join(stays, "row_key", "left_anti"), "near-duplicates"), "row_key", "left_anti")
    # A row that is there several times as a whole is a copy too.
    twice = _listed(kept.groupBy("row_key").count().filter("count > 1"), "repeated-rows")
    once = kept.join(twice, "row_key", "left_anti").select(*COLUMNS)
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy("doc_id"))
    return once.unionByName(kept.join(twice, "row_key", "left_semi").withColumn("nth", nth).filter("nth = 1").select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    found = decontaminate.matches(rows, read(spark, sf_dir, "benchmark"), "row_key")
    return rows.join(_listed(found, "contaminated"), "row_key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emitted(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs).select("doc_id", "size", "text_crc32", "shard", "slot", "vslot")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mix", mix), ("shard", shard)]

#: SQL cannot express the classifiers and the similarity search; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
