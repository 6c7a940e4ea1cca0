"""Edits of a circuit's tables as sets of operations, with a preview, a log, optimistic concurrency and undo.

ops: seq, op, page_id, ref, value, other and, if there are such operations, key. Verbs: set_label, set_class, set_attribute (key, value; a null value takes it away),
set_wire_no (ref is a connection), remove_component (its connections go too), add_component (value: class), connect (ref to other), disconnect (ref: a connection),
insert_in_series (between ref and other; value: class, key: label): the wires between the two give way to a new component and a wire on either side, the
first of which keeps their number. At most MAX_OPS at a time. All or nothing: any operation that names something absent makes the whole set fail. Of several
settings of one field the last counts.

Defined results: empty ops change nothing; repeated rows of ops are errors where they add a ref; null values clear a field; empty tables are tables without rows;
further columns of the tables stay, null for what is added.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph

SYMBOL_FIELDS = {"set_label": "label", "set_class": "class_key"}
MAX_OPS = 200
MAX_SCENARIOS = 24


def _dealt(df: DataFrame, keys: list, n: int) -> DataFrame:
    """`df`, of tables of about n rows, dealt by keys to as many tasks as there are rows for; few rows stay as they are."""
    return df if n <= graph.FEW else graph.dealt(df, keys, n)


def content_hash(symbols: DataFrame, connections: DataFrame) -> str:
    """A hash of both tables that does not depend on row order: sums of row hashes."""
    part = lambda df: df.agg(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).cast("string")).first()[0]
    return f"{part(symbols)}:{part(connections)}"


def problems(symbols: DataFrame, connections: DataFrame, ops: DataFrame, most: int | None = MAX_OPS) -> DataFrame:
    """seq, message of operations that cannot be applied."""
    rows = symbols.count() + connections.count() + ops.count()
    a, b = F.least("from_symbol", "to_symbol"), F.greatest("from_symbol", "to_symbol")
    added = ops.filter("op = 'add_component'").select("page_id", "ref")
    have = _dealt(symbols.select("page_id", "ref").unionByName(added), ["page_id", "ref"], rows).distinct()
    verbs = [*SYMBOL_FIELDS, "set_attribute", "insert_in_series", "set_wire_no", "remove_component", "add_component", "connect", "disconnect"]
    say = lambda df, text: df.select("seq", F.lit(text).alias("message"))
    on_symbols = ops.filter(F.col("op").isin(*SYMBOL_FIELDS, "set_attribute", "remove_component", "connect", "insert_in_series"))
    out = say(ops.filter(~F.col("op").isin(*verbs)), "unknown operation")
    out = out.unionByName(say(on_symbols.join(have, ["page_id", "ref"], "left_anti"), "no such symbol"))
    out = out.unionByName(say(ops.filter("op IN ('connect', 'insert_in_series')").join(have.withColumnRenamed("ref", "other"), ["page_id", "other"], "left_anti"), "no such symbol"))
    out = out.unionByName(say(ops.filter("op IN ('set_wire_no', 'disconnect')").join(_dealt(connections.select("page_id", "ref"), ["page_id", "ref"], rows), ["page_id", "ref"], "left_anti"), "no such connection"))
    ends = _dealt(connections.select("page_id", a.alias("a"), b.alias("b")), ["page_id", "a", "b"], rows).distinct()
    inserts = ops.filter("op = 'insert_in_series'").withColumns({"a": F.least("ref", "other"), "b": F.greatest("ref", "other")})
    out = out.unionByName(say(inserts.join(ends, ["page_id", "a", "b"], "left_anti"), "no wire between the two"))
    out = out.unionByName(say(_dealt(inserts, ["page_id", "a", "b"], rows).withColumn("n", F.row_number().over(Window.partitionBy("page_id", "a", "b").orderBy("seq"))).filter("n > 1"), "no wire between the two"))
    n = ops.count() if most is not None else 0
    if most is not None and n > most:
        out = out.unionByName(ops.agg(F.max("seq").alias("seq")).select("seq", F.lit(f"at most {most} operations").alias("message")))
    return out.unionByName(say(added.join(_dealt(symbols, ["page_id", "ref"], rows), ["page_id", "ref"], "left_semi").join(ops.filter("op = 'add_component'"), ["page_id", "ref"]), "the ref is taken"))


def applied(symbols: DataFrame, connections: DataFrame, ops: DataFrame, most: int | None = MAX_OPS) -> tuple[DataFrame, DataFrame]:
    """symbols (page_id, ref, class_key, label, ...), connections (page_id, ref, from_symbol, to_symbol, wire_no, ...) after the operations."""
    wrong = problems(symbols, connections, ops, most).orderBy("seq").limit(20).collect()  # shown to the user
    if wrong:
        raise ValueError("; ".join(f"{r.seq}: {r.message}" for r in wrong))
    rows = symbols.count() + connections.count() + ops.count()
    last = lambda op: _dealt(ops.filter(F.col("op") == op), ["page_id", "ref"], rows).groupBy(F.col("page_id").alias("p__"), F.col("ref").alias("r__")).agg(F.max_by("value", "seq").alias("v__"))
    named = lambda op: _dealt(ops.filter(F.col("op") == op).select("page_id", "ref"), ["page_id", "ref"], rows).distinct()
    gone = named("remove_component")
    new = ops.filter("op = 'add_component'").select("page_id", "ref", F.col("value").alias("class_key"))
    given = ops if "key" in ops.columns else ops.withColumn("key", F.lit(None).cast("string"))
    inserts = _inserted(symbols, connections, given.filter("op = 'insert_in_series'"), rows)
    symbols = symbols.unionByName(new, allowMissingColumns=True).unionByName(inserts.select("page_id", F.col("new").alias("ref"), F.col("value").alias("class_key"), F.col("key").alias("label")), allowMissingColumns=True)
    symbols = _dealt(symbols, ["page_id", "ref"], rows)
    if "attributes" in symbols.columns:
        symbols = _with_attributes(symbols, given.filter("op = 'set_attribute'"))
    for op, field in SYMBOL_FIELDS.items():
        symbols = _set(symbols, last(op), field)
    symbols = symbols.join(gone, ["page_id", "ref"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))
    wires = ops.filter("op = 'connect'").select("page_id", F.concat(F.lit("E"), F.col("seq").cast("string"), F.lit("-"), nth.cast("string")).alias("ref"), F.col("ref").alias("from_symbol"), F.col("other").alias("to_symbol"), F.col("value").alias("wire_no"))
    connections = _set(_dealt(connections, ["page_id", "ref"], rows), last("set_wire_no"), "wire_no").join(named("disconnect"), ["page_id", "ref"], "left_anti")
    # An anti join is moved to below what deals its left side, so the other one is dealt, here and in named().
    cut = _dealt(inserts.select("page_id", F.least("ref", "other").alias("a__"), F.greatest("ref", "other").alias("b__")), ["page_id", "a__", "b__"], rows)
    met = (F.least("from_symbol", "to_symbol") == F.col("a__")) & (F.greatest("from_symbol", "to_symbol") == F.col("b__"))
    connections = connections.withColumnRenamed("page_id", "p__").join(cut, (F.col("p__") == F.col("page_id")) & met, "left_anti").withColumnRenamed("p__", "page_id")
    number = F.col("seq").cast("string")
    sides = inserts.select("page_id", F.concat(F.lit("E"), number, F.lit("-a")).alias("ref"), F.col("ref").alias("from_symbol"), F.col("new").alias("to_symbol"), "wire_no").unionByName(
        inserts.select("page_id", F.concat(F.lit("E"), number, F.lit("-b")).alias("ref"), F.col("new").alias("from_symbol"), F.col("other").alias("to_symbol"), F.lit(None).cast("string").alias("wire_no"))
    )
    connections = connections.unionByName(wires, allowMissingColumns=True).unionByName(sides, allowMissingColumns=True)
    for end in ("from_symbol", "to_symbol"):
        connections = connections.join(gone.withColumnRenamed("ref", end), ["page_id", end], "left_anti")
    return symbols, connections


def _inserted(symbols: DataFrame, connections: DataFrame, inserts: DataFrame, n: int) -> DataFrame:
    """inserts with new (the ref of the component, EDIT-0001 and on, free on the page) and wire_no (of the first wire it replaces). n: about the rows of all three."""
    from .bundles import wire_refs

    # Every ref on the page is taken, though only those of the same form (and none at all) matter; what is inserted has none yet.
    ref, pages = F.col("ref"), _dealt(inserts.select("page_id"), ["page_id"], n).distinct()
    taken = symbols.filter(ref.isNull() | ref.contains("EDIT-") | ~ref.rlike("[!-~]")).select("page_id", F.lit(-1).alias("nth"), "ref")
    taken = _dealt(taken, ["page_id"], n).distinct()
    rows = taken.withColumn("nth", -F.row_number().over(Window.partitionBy("page_id").orderBy("ref"))).unionByName(inserts.select("page_id", F.col("seq").alias("nth"), F.lit(None).cast("string").alias("ref")))
    refs = wire_refs(_dealt(rows, ["page_id"], n).join(pages, "page_id", "left_semi"), "EDIT-", n).filter("nth >= 0").select("page_id", F.col("nth").alias("seq"), F.col("ref").alias("new"))
    first = connections.select("page_id", F.least("from_symbol", "to_symbol").alias("a__"), F.greatest("from_symbol", "to_symbol").alias("b__"), "wire_no", "ref")
    first = _dealt(first, ["page_id", "a__", "b__"], n).groupBy("page_id", "a__", "b__").agg(F.min_by("wire_no", "ref").alias("wire_no"))
    ends = inserts.withColumns({"a__": F.least("ref", "other"), "b__": F.greatest("ref", "other")})
    return _dealt(ends, ["page_id", "seq"], n).join(refs, ["page_id", "seq"]).join(first, ["page_id", "a__", "b__"], "left").select("seq", "page_id", "ref", "other", "value", "key", "new", "wire_no")


def _with_attributes(symbols: DataFrame, ops: DataFrame) -> DataFrame:
    last = ops.groupBy(F.col("page_id").alias("p__"), F.col("ref").alias("r__"), "key").agg(F.max_by(F.struct("value"), "seq")["value"].alias("value"))
    changes = last.groupBy("p__", "r__").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("new__"))
    joined = symbols.join(changes, (F.col("page_id") == F.col("p__")) & (F.col("ref") == F.col("r__")), "left")
    old = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    kept = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("new__", k)), F.map_filter("new__", lambda k, v: v.isNotNull()))
    return joined.withColumn("attributes", F.when(F.col("new__").isNotNull(), F.when(F.size(kept) > 0, kept)).otherwise(F.col("attributes"))).drop("p__", "r__", "new__")


def differences(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], fields: tuple[str, ...] = ("class_key", "label")) -> DataFrame:
    """page_id, kind (symbol, wire), name, change (added, removed, changed), fields: what an edit changes. Wires are known by their ends and number, not by refs."""
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("page_id", "ref", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(s))

    n = before[0].count() + before[1].count()
    both = _dealt(side(before[0], "o"), ["page_id", "ref"], n).join(side(after[0], "n"), ["page_id", "ref"], "full")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields]))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(differs) > 0, "changed")
    out = both.select("page_id", F.lit("symbol").alias("kind"), F.col("ref").alias("name"), change.alias("change"), F.when(change == "changed", F.array_join(differs, ",")).otherwise("").alias("fields"))
    name = F.concat_ws(" ", "from_symbol", F.lit("-"), "to_symbol", F.coalesce("wire_no", F.lit("")))
    wires = lambda df, s: _dealt(df.select("page_id", name.alias("name")), ["page_id", "name"], n).distinct().withColumn(s, F.lit(True))
    ends = wires(before[1], "o").join(wires(after[1], "n"), ["page_id", "name"], "full")
    ends = ends.select("page_id", F.lit("wire").alias("kind"), "name", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").alias("change"), F.lit("").alias("fields"))
    return out.unionByName(ends).filter("change IS NOT NULL")


def trial_states(inputs: DataFrame, most: int = MAX_SCENARIOS) -> DataFrame:
    """circuit_id, scenario, device, on: states to try a circuit with: none on, each input alone, all of them, and, up to `most` in all, combinations drawn by hash. Rows
    are inputs times scenarios: as many again as a circuit has inputs."""
    inputs = inputs.select("circuit_id", "device").distinct()
    n = inputs.groupBy("circuit_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    plain = n.select("circuit_id", F.explode(F.array(F.lit("none"), F.lit("all"))).alias("scenario"))
    alone = inputs.select("circuit_id", F.concat(F.lit("only "), "device").alias("scenario"))
    drawn = n.filter(F.col("n") + 2 < most).select("circuit_id", F.explode(F.sequence(F.lit(1), F.lit(most) - F.col("n") - 2)).alias("k")).select("circuit_id", F.concat(F.lit("drawn "), F.col("k").cast("string")).alias("scenario"))
    rows = plain.unionByName(alone).unionByName(drawn).join(inputs, "circuit_id")
    chance = F.pmod(F.xxhash64("circuit_id", "scenario", "device"), F.lit(2)) == 1
    on = F.when(F.col("scenario") == "all", True).when(F.col("scenario").startswith("drawn "), chance).otherwise(F.col("scenario") == F.concat(F.lit("only "), "device"))
    return rows.select("circuit_id", "scenario", "device", on.alias("on"))


def behaviour_changes(before: DataFrame, after: DataFrame, most: int = MAX_SCENARIOS) -> DataFrame:
    """circuit_id, scenario, device, before, after: verdicts that an edit changes, in states to try the inputs of both with; null where a device is not there.
    before, after: literals (see conditions.py)."""
    from . import conditions

    def inputs(lits: DataFrame) -> DataFrame:
        return lits.select("circuit_id", F.col("dep").alias("device")).filter("device IS NOT NULL").distinct().join(lits.select("circuit_id", "device").distinct(), ["circuit_id", "device"], "left_anti")

    states = trial_states(inputs(before).unionByName(inputs(after)).distinct(), most)
    # A device that one circuit drives and the other takes as an input stays driven where it is.
    given = lambda lits: states.join(lits.select("circuit_id", "device").distinct(), ["circuit_id", "device"], "left_anti")
    found = lambda lits, s: conditions.evaluated(lits, given(lits)).select("circuit_id", "scenario", "device", F.col("verdict").alias(s))
    both = found(before, "before").join(found(after, "after"), ["circuit_id", "scenario", "device"], "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def _set(df: DataFrame, values: DataFrame, field: str) -> DataFrame:
    joined = df.join(values.withColumn("hit__", F.lit(True)), (F.col("page_id") == F.col("p__")) & (F.col("ref") == F.col("r__")), "left")
    return joined.withColumn(field, F.when(F.col("hit__"), F.col("v__")).otherwise(F.col(field))).drop("p__", "r__", "v__", "hit__")


class ChangeLog:
    """Versions of both tables under a folder, with a table of the versions' hashes beside them, so that any session sees them.
    apply() fails if the base is no longer current; undo() goes back a version unless others came after. Two writers of one version
    fail at its folder, which the second finds taken."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    @property
    def versions(self) -> list[str]:
        """The hashes in order: one short row a version."""
        try:
            rows = self.spark.read.schema("n int, hash string").json(f"{self.path}/versions").orderBy("n").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return [r.hash for r in rows]

    def save(self, symbols: DataFrame, connections: DataFrame) -> str:
        n = len(self.versions)
        for name, df in (("symbols", symbols), ("connections", connections)):
            df.write.mode("error").parquet(f"{self.path}/v{n}/{name}")
        name = content_hash(*self._read(n))
        self.spark.createDataFrame([(n, name)], "n int, hash string").coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return name

    def _read(self, n: int) -> tuple[DataFrame, DataFrame]:
        return tuple(self.spark.read.parquet(f"{self.path}/v{n}/{name}") for name in ("symbols", "connections"))

    def tables(self, n: int = -1) -> tuple[DataFrame, DataFrame]:
        return self._read(n % (len(self.versions) or 1) if n < 0 else n)

    def apply(self, ops: DataFrame, base: str) -> str:
        if base != self.versions[-1]:
            raise ValueError("the tables have changed meanwhile")
        return self.save(*applied(*self.tables(), ops))

    def undo(self, after: str, force: bool = False) -> str:
        versions = self.versions
        at = len(versions) - 1 - versions[::-1].index(after)
        if at != len(versions) - 1 and not force:
            raise ValueError("later changes exist")
        return self.save(*self.tables(at - 1))
