"""Sharding by fixed virtual slots.

Every record hashes into one of some thousands of virtual slots; the slots' bytes are summed; a versioned table says
which shard holds each slot. A record's shard is then one lookup in that small table, and rebalancing edits the table
(moves whole slots), not the records' hashes. Only DataFrame functions are used.

Defined results: a null text has no bytes (size 1, checksum 0); a null id is placed by its text; repeated rows go to the
same slot and differ only in position; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from .common import stored

N_SLOTS = 8192
N_SHARDS = 16
TOLERANCE = 0.05  # by which the fullest shard may exceed an equal share before the map is edited


def virtual_slot(id_col: Column, text_col: Column, n_slots: int = N_SLOTS) -> Column:
    key = F.when(id_col.isNull(), F.xxhash64(text_col, F.lit("no id"))).otherwise(F.xxhash64(id_col.cast("string")))
    return F.pmod(key, F.lit(n_slots)).cast("int")


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size, text_crc32, vslot of each record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(id_col), F.col(text_col), n_slots).alias("vslot"),
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """vslot, bytes, records: at most as many rows as there are virtual slots."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def _placed(slots: DataFrame, n_shards: int) -> DataFrame:
    """slots: vslot, bytes, shard (null: to be placed), version. Places the largest unplaced slot on the least loaded shard, again and again.

    The slots are a table of bounded size (one row for each virtual slot); a higher-order function folds them in one row.
    """
    row = slots.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot", "shard"))).alias("slots"), F.max("version").alias("version")
    )
    fixed, todo = F.filter("slots", lambda x: x["shard"].isNotNull()), F.filter("slots", lambda x: x["shard"].isNull())
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda s: F.aggregate(fixed, F.lit(0).cast("long"), lambda a, x: F.when(x["shard"] == s, a - x["minus"]).otherwise(a)),
    )
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("chosen"))

    def step(state: Column, slot: Column) -> Column:
        best = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        grown = F.transform(state["loads"], lambda x, i: F.when(i == best, x - slot["minus"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.array_append(state["chosen"], best).alias("chosen"))

    placed = row.select(
        "version",
        fixed.alias("fixed"),
        F.zip_with(todo, F.aggregate(todo, start, step)["chosen"], lambda x, s: F.struct(x["minus"].alias("minus"), x["vslot"].alias("vslot"), s.alias("shard"))).alias("new"),
    )
    return placed.select("version", F.explode(F.concat("fixed", "new")).alias("x")).select("version", "x.vslot", "x.shard")


def slot_map(sizes: DataFrame, n_shards: int = N_SHARDS, version: int = 0) -> DataFrame:
    """A first map (version, vslot, shard) whose shards hold near equal bytes."""
    return _placed(sizes.select("vslot", "bytes", F.lit(None).cast("int").alias("shard"), F.lit(version).alias("version")), n_shards)


def rebalanced(current: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map: only slots beyond their shard's equal share, or of shards that are gone, move."""
    known = sizes.select("vslot", "bytes").join(F.broadcast(current.select("vslot", "shard", "version")), "vslot", "left")
    everything = Window.partitionBy(F.lit(1))  # the map's rows: one for each virtual slot
    so_far = Window.partitionBy("shard").orderBy("bytes", "vslot")
    held = known.withColumn("share", F.sum("bytes").over(everything) / n_shards).withColumn("upto", F.sum("bytes").over(so_far))
    kept = F.when((F.col("shard") < n_shards) & (F.col("upto") <= F.col("share")), F.col("shard"))
    version = F.coalesce(F.max("version").over(everything), F.lit(-1)) + 1
    return _placed(held.select("vslot", "bytes", kept.alias("shard"), version.alias("version")), n_shards)


def save_map(the_map: DataFrame, path: str) -> None:
    """Adds a version to the stored map; versions are kept side by side."""
    the_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The given version of a stored map, the last if none is given; nothing if there is none."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version)


def unevenness(the_map: DataFrame, sizes: DataFrame, n_shards: int) -> float:
    """The fullest shard's bytes over an equal share, less 1; slots that the map does not know, or of shards that are gone, count as a whole shard."""
    placed = sizes.join(F.broadcast(the_map.select("vslot", "shard")), "vslot", "left")
    shard = F.when(F.col("shard") < n_shards, F.col("shard")).otherwise(-1)
    loads = placed.groupBy(shard.alias("shard")).agg(F.sum("bytes").alias("bytes"))
    most, total, lost = loads.agg(F.max("bytes"), F.sum("bytes"), F.count_if(F.col("shard") < 0)).first()
    return float("inf") if lost else (most or 0) * n_shards / (total or 1) - 1


def current_map(sizes: DataFrame, n_shards: int, path: str, tolerance: float = TOLERANCE) -> DataFrame:
    """The stored map at `path`: the first version is made if there is none, a next one if the last is uneven by more than `tolerance` and an edit helps."""
    spark = sizes.sparkSession
    last = load_map(spark, path)
    if last is None:
        save_map(slot_map(sizes, n_shards), path)
    elif (off := unevenness(last, sizes, n_shards)) <= tolerance:
        return last
    else:
        edited = stored(rebalanced(last, sizes, n_shards), "slot-map", N_SLOTS)
        if unevenness(edited, sizes, n_shards) >= off:  # a few large slots may leave nothing to gain
            return last
        save_map(edited, path)
    made = load_map(spark, path)
    return sizes.select("vslot", F.lit(0).alias("shard"), F.lit(0).alias("version")) if made is None else made  # no slots, no files


def assign(records: DataFrame, the_map: DataFrame, sizes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds shard and slot (the record's position in its shard, gapless from 0).

    Positions: records are numbered inside their virtual slot (thousands of small partitions), and each virtual slot
    starts where the slots before it in its shard end; no task ever sorts a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        the_map.select("vslot", "shard", "version").join(F.broadcast(sizes), "vslot")
        .withColumn("start", F.coalesce(F.sum("records").over(before), F.lit(0)))
        .select("vslot", "shard", "version", "start")
    )
    inside = Window.partitionBy("vslot").orderBy(id_col, "text_crc32", "size")
    numbered = records.withColumn("nth", F.row_number().over(inside))
    return numbered.join(F.broadcast(starts), "vslot").withColumn("slot", F.col("start") + F.col("nth") - 1).drop("start", "nth")


def sharded(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Each record's id, size, text_crc32, vslot, version of the map, shard and slot under the law `bytes`.

    path: of the stored map; a new one in the shared folder, if none is given.
    """
    records = with_slots(docs, id_col, text_col, n_slots)
    sizes = stored(slot_bytes(records), "slot-bytes", n_slots)
    the_map = current_map(sizes, n_shards, path or f"{shared_folder(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}")
    return assign(records, the_map, sizes, id_col)
