"""Three-valued logic over rows. Spark's own AND and OR are Kleene's; its aggregates bool_and and bool_or pass over nulls, these do not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(x: Column) -> Column:
    """Aggregate: false if any is false, else null if any is null, else true."""
    return F.when(F.count_if(~x) > 0, F.lit(False)).when(F.count_if(x.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def any_of(x: Column) -> Column:
    """Aggregate: true if any is true, else null if any is null, else false."""
    return F.when(F.count_if(x) > 0, F.lit(True)).when(F.count_if(x.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def verdict(x: Column) -> Column:
    return F.when(x, "ON").when(~x, "OFF").otherwise("UNKNOWN")


def holds(branches: Column, states: Column) -> Column:
    """Whether a condition (an array of branches, each an array of names, `!` before a negated one) is true in states (a map of all its names). No branch is false,
    an empty branch is true."""
    literal = lambda x: F.when(x.startswith("!"), ~F.element_at(states, F.substring(x, 2, 1_000_000))).otherwise(F.element_at(states, x))
    return F.exists(branches, lambda b: F.forall(b, literal))
