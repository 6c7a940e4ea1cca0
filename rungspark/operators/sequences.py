"""Orders, runs, intervals and states over time.

Defined results: empty tables give empty results; null times come first in their group and begin nothing; ties of time go by the further order columns; repeated rows count each;
a group of one has percentile 0; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import numbered


def islands(df: DataFrame, by: list[str], at: Column, gap: float | Column, order: list[Column]) -> DataFrame:
    """Adds island: a new one starts where the step from the row before exceeds `gap`."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(at - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("new__", new).withColumn("island", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new__")


def interval_union(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The maximal intervals covered (touching ones join): by, start, end."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new__", F.when(F.col(start) <= reach, 0).otherwise(1))
    grouped = marked.withColumn("g__", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "g__").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("g__")


def change_points(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value is not the one before (nulls are equal); the first row of a group is one."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("before", F.lag(value).over(w)).withColumn("changed__", changed).filter("changed__").drop("changed__")


def asof(left: DataFrame, right: DataFrame, by: list[str], l_time: str, r_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time: one shuffle of the union, no pair is built."""
    held = F.struct(*values)
    a = left.select(F.struct(*left.columns).alias("l"), *by, F.col(l_time).alias("t__"), F.lit(1).alias("side__"), F.lit(None).cast(right.select(held.alias("v")).schema["v"].dataType).alias("v"))
    b = right.select(F.lit(None).cast(a.schema["l"].dataType).alias("l"), *by, F.col(r_time).alias("t__"), F.lit(0).alias("side__"), held.alias("v"))
    w = Window.partitionBy(*by).orderBy("t__", "side__").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("side__ = 1").select("l.*", *[F.col(f"v.{c}").alias(c) for c in values])


def delayed(df: DataFrame, by: list[str], at: str, on: str, delay: float, mode: str = "on", order: list[str] = []) -> DataFrame:  # noqa: B006
    """Timer output for runs of an input. on-delay: true from `delay` after the input rose until it falls, if it lasts that long;
    off-delay: true while the input is, and `delay` longer unless it rises again. by, from, to (null: open) of the output's true spans."""
    runs = change_points(df.select(*by, at, on, *order), by, [F.col(at), *map(F.col, order)], on)
    w = Window.partitionBy(*by).orderBy(at, *order)
    spans = runs.withColumn("until", F.lead(at).over(w)).filter(on).select(*by, F.col(at).alias("from"), F.col("until").alias("to"))
    if mode == "on":
        return spans.withColumn("from", F.col("from") + delay).filter("to IS NULL OR from < to")
    far = spans.withColumn("to", F.coalesce(F.col("to") + delay, F.lit(float("inf"))))
    merged = interval_union(far, by, "from", "to")
    return merged.withColumn("to", F.when(F.col("to") < float("inf"), F.col("to")))


def tie_percentile(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds percentile: the rank from 0 to 1, tied rows at the mean of their ranks; 0 in groups of one."""
    w = Window.partitionBy(*by)
    rank, ties, n = F.rank().over(w.orderBy(value)), F.count(F.lit(1)).over(Window.partitionBy(*by, value)), F.count(F.lit(1)).over(w)
    return df.withColumn("percentile", F.when(n > 1, (rank - 1 + (ties - 1) / 2) / (n - 1)).otherwise(F.lit(0.0)))


def evenly_held_out(df: DataFrame, order: list[str], k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds held_out for k evenly spaced rows of each group: places floor((i + 1/2) n / k)."""
    placed = numbered(df, by, [F.col(c) for c in order], "place__").withColumn("place__", F.col("place__") - 1)
    sizes = df.groupBy(*[F.col(c).alias(f"{c}__") for c in by]).agg(F.count(F.lit(1)).alias("n__"))  # a row for each group
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    placed = placed.join(sizes, same) if by else placed.crossJoin(F.broadcast(sizes))
    place, n = F.col("place__"), F.col("n__")
    i = F.ceil((place * k) / n - 0.5)
    at = lambda j: F.floor((j + 0.5) * n / k)
    hit = F.when(n <= k, True).otherwise(((i >= 0) & (i < k) & (at(i) == place)) | ((i + 1 < k) & (at(i + 1) == place)) | ((i - 1 >= 0) & (at(i - 1) == place)))
    return placed.select(*df.columns, hit.alias("held_out"))


def folds(df: DataFrame, order: list[str], k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds fold: rows dealt out in turn."""
    return numbered(df, by, [F.col(c) for c in order], "fold").withColumn("fold", F.pmod(F.col("fold") - 1, F.lit(k)))


def longest_gap(df: DataFrame, by: list[str], start: str, end: str, lo: str, hi: str) -> DataFrame:
    """by, gap: the longest part of [lo, hi] that no interval covers. A row with null start and end stands for a span without intervals."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.greatest(F.col(lo), F.coalesce(F.max(end).over(w), F.col(lo)))
    rows = df.withColumn("free__", F.greatest(F.least(F.col(start), F.col(hi)) - cursor, F.lit(0.0)))
    return rows.groupBy(*by).agg(F.greatest(F.coalesce(F.max("free__"), F.lit(0.0)), F.max(hi) - F.greatest(F.max(lo), F.least(F.max(hi), F.coalesce(F.max(end), F.max(lo))))).alias("gap"))


def covered_share(df: DataFrame, by: list[str], start: str, end: str, lo: str, hi: str) -> DataFrame:
    """by, share: the part of [lo, hi] that intervals cover."""
    clipped = df.withColumn(start, F.greatest(start, lo)).withColumn(end, F.least(end, hi)).filter(F.col(start) < F.col(end))
    merged = interval_union(clipped.select(*by, start, end), by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("sum__"))
    spans = df.groupBy(*by).agg((F.max(hi) - F.min(lo)).alias("span__"))
    return spans.join(merged, by, "left").select(*by, F.coalesce(F.try_divide("sum__", "span__"), F.lit(0.0)).alias("share"))


def reading_order(df: DataFrame, by: list[str], top: str, left: str, height: str, key: str, name: str = "nth") -> DataFrame:
    """Adds the place of a word: lines from the top (a line starts where the step down exceeds half the height), words from the left; ties by key."""
    lines = islands(df, by, F.col(top), F.col(height) / 2, [F.col(top), F.col(left), F.col(key)])
    return lines.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("island", left, top, key))).drop("island")
