"""Iterative graph operators: connected components and bounded breadth-first reach, as DataFrame loops.

Defined results: edges with a null end and loops join nothing; nodes without edges are not listed by connected_components(), and reach() lists a start by itself at
depth 0; repeated edges change nothing; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 200_000  # rows of a few numbers up to which a table is sent to every task
ROWS_A_PART = 500_000  # rows that dealt() gives a task
ROWS_A_FILE = 200_000  # small tables are written by so few tasks


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session gets a temporary one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, rows: int | None = None, name: str = "step") -> DataFrame:
    """`df` as a table in the shared folder: written once, readable by every executor, so loops neither grow their plans nor
    depend on one machine. rows: a bound of its rows, if known, by which small tables get few files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = df if rows is None else df.coalesce(rows // ROWS_A_FILE + 1)
    out.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._written_to = path
    return kept


def forget(df: DataFrame | None) -> None:
    """Removes the table that cut_lineage() wrote, once what was made of it is written itself. A session without a JVM of its own (Spark Connect) leaves it to the folder's owner."""
    path = getattr(df, "_written_to", None)
    if path and hasattr(df.sparkSession, "_jvm"):
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def dealt(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """`df` dealt by keys into as many parts as its rows ask for (ROWS_A_PART each; never fewer than shuffle partitions), so that what a task
    gathers by these keys does not grow with the table. rows: their number, if known; else they are counted."""
    n = df.count() if rows is None else rows
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS_A_PART + 1), *keys)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node that can be reached. Minimum labels travel along edges and then jump to their label's label,
    so that rounds grow with the logarithm of the longest path; each round is two equi-joins and a partial aggregation."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    both = cut_lineage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    # Labels are no more than edge ends: of few, every task gets a copy; of more, both sides are shuffled.
    n = both.count()
    sent = F.broadcast if n <= FEW else lambda x: x
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), n)
    while True:
        near = both.join(sent(labels.select(F.col("node").alias("v"), "label")), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("best"))
        moved = near.join(sent(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "best").alias("label"))
        step = cut_lineage(moved, n)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = step.join(sent(jump), "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        before, labels = labels, cut_lineage(jumped, n)
        forget(before), forget(step)
        if labels.filter("old <> label").isEmpty():
            forget(both)
            return labels.select("node", F.col("label").alias("component"))


def reach(edges: DataFrame, starts: DataFrame, max_depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """start, node, depth: the nodes within `max_depth` steps of each start at their least depth; the frontier never revisits."""
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    frontier = starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumn("node", F.col("start")).withColumn("depth", F.lit(0))
    seen = cut_lineage(frontier)
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = frontier.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = cut_lineage(new.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
