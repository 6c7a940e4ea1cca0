"""Mixing sources to target weights.

Words are counted per source; each source has a target number of words; its repetition rate is target / words; each
document is emitted floor(rate) times, plus one more time with probability equal to the fraction. The draw is a hash of
the id and a seed, so reruns agree. Of `n_seeds` seeds a source uses the one whose total comes nearest to its target.

Defined results: a null or empty text has size 0 and takes no words; a null source is a source of its own, last in
order; repeated rows with the same id draw alike; sources without words get target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS = (5, 2, 1)
CAP = 3.0
N_SEEDS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("size").alias("source_size"))


def targets(totals: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target. The weights repeat over the sources in code point order, null last.

    A target above cap * source_size stops there and the rest is shared again by weight. In closed form: with the sources
    by rising cap / weight, the first k are capped, k being the least number at which the common level (what is left
    by weight) does not exceed the next source's cap / weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    table = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    table = (
        table.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left_weight"))
    )
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    table = table.withColumn("final", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return table.select("source", "source_size", F.least("most", F.col("weight") * F.col("final")).alias("target"))


def uniform(id_col: Column, seed: Column | int) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5 of id and seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("#"), seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _drawn(docs: DataFrame, weights: tuple, cap: float, n_seeds: int) -> tuple[DataFrame, str]:
    """The documents with a struct column of size, source_size, target, rate and copies; and that column's name."""
    mix = "mix"
    while mix in docs.columns:
        mix += "_"
    sized = docs.withColumn(mix, F.struct(word_count(F.col("text")).alias("size")))
    plan = targets(source_totals(docs.select("source", word_count(F.col("text")).alias("size"))), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))
    plan = plan.withColumn("rate", rate)
    whole, fraction = F.floor("rate"), F.col("rate") - F.floor("rate")
    # As many rows as there are sources; Spark broadcasts it if its measured size allows, else shuffles both sides.
    sizes = docs.select("doc_id", F.col("source").alias("of"), word_count(F.col("text")).alias("size"))
    totals = sizes.join(plan, F.col("of").eqNullSafe(F.col("source"))).groupBy("of").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "rate")],
        *[F.sum(F.col("size") * (whole + (uniform(F.col("doc_id"), k) < fraction).cast("long"))).alias(f"t{k}") for k in range(n_seeds)],
    )
    off = [F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(n_seeds)]
    plan = totals.select(F.struct("of", "source_size", "target", "rate", F.array_min(F.array(*off))["seed"].alias("seed")).alias(f"{mix}plan"))
    joined = sized.join(plan, sized["source"].eqNullSafe(F.col(f"{mix}plan.of")))
    of = lambda c: F.col(f"{mix}plan.{c}")
    extra = (uniform(F.col("doc_id"), of("seed")) < of("rate") - F.floor(of("rate"))).cast("long")
    copies = (F.floor(of("rate")) + extra).cast("long").alias("copies")
    return joined.select(*docs.columns, F.struct(F.col(f"{mix}.size").alias("size"), of("source_size").alias("source_size"), of("target").alias("target"), of("rate").alias("rate"), copies).alias(mix)), mix


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, n_seeds: int = N_SEEDS) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of each document."""
    drawn, mix = _drawn(docs.select("doc_id", "text", "source"), weights, cap, n_seeds)
    return drawn.select("doc_id", "source", f"{mix}.*")


def emitted(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, n_seeds: int = N_SEEDS) -> DataFrame:
    """The mix itself: the documents' own columns, each row as many times as it is drawn."""
    drawn, mix = _drawn(docs, weights, cap, n_seeds)
    times = F.sequence(F.lit(1), F.col(f"{mix}.copies").cast("int"))
    return drawn.filter(F.col(f"{mix}.copies") > 0).withColumn(mix, F.explode(times)).select(*docs.columns)
