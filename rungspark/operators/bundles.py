"""Whole pages in and out: numbering what came without a name, dropping what leads nowhere with a report, replacing pages in a store, bundles.

A payload is what a client sends for pages: symbols (page_id, nth, ref, class_key, label, cx, cy, w, h, note, origin, confidence, attributes map), terminals
(page_id, symbol_nth, nth, ref, name, tx, ty, origin), connections (page_id, nth, ref, from_symbol, from_terminal, to_symbol, to_terminal, wire_no, kind,
note); nth: the order in which they were sent, symbols and terminals are named by refs.

Defined results: blank refs are none; of equal refs on a page the first keeps it; null attributes are none; a page in `pages` without rows becomes empty;
empty tables give empty results; further columns are dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import graph
from . import relational as R

SYMBOL = "page_id long, nth int, ref string, class_key string, label string, cx double, cy double, w double, h double, note string, origin string, confidence double, attributes map<string,string>"
TERMINAL = "page_id long, symbol_ref string, nth int, ref string, name string, tx double, ty double, origin string"
CONNECTION = "page_id long, nth int, ref string, from_symbol string, from_terminal string, to_symbol string, to_terminal string, wire_no string, kind string, note string"
TABLES = {"symbols": SYMBOL, "terminals": TERMINAL, "connections": CONNECTION}


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def symbol_refs(symbols: DataFrame, prefix: str = "SYM-") -> DataFrame:
    """page_id, nth, ref: the given ref, if no symbol before has it, else the next number that none before has taken; numbers only go up.

    Only symbols without a ref of their own, and those whose ref looks like a number, depend on the order; of these a page's task sees the numbers alone."""
    given = symbols.select("page_id", "nth", _blank("ref").alias("given"))
    first = F.row_number().over(Window.partitionBy("page_id", "given").orderBy("nth")) == 1
    own = given.withColumn("own", F.col("given").isNotNull() & first)
    number = F.expr(f"try_cast(nullif(regexp_extract(given, '^{prefix}([0-9]{{4,}})$', 1), '') AS BIGINT)")
    # SYM-00012 is no number that would be given out.
    own = own.withColumn("number", F.when(F.col("given") == F.concat(F.lit(prefix), F.lpad(number.cast("string"), 4, "0")), number).when(F.col("given") == F.concat(F.lit(prefix), number.cast("string")), number))
    loose = own.filter(~F.col("own") | F.col("number").isNotNull()).select("page_id", "nth", F.when(F.col("own"), F.col("number")).alias("number"))

    def dealt(page: pd.DataFrame) -> pd.DataFrame:
        used, last, out = set(), 0, []
        for n in page.sort_values("nth")["number"]:
            if pd.isna(n) or int(n) in used:
                last += 1
                while last in used:
                    last += 1
                n = last
            used.add(int(n))
            out.append(int(n))
        return page.sort_values("nth")[["page_id", "nth"]].assign(number=out)

    kinds = {f.name: f.dataType.simpleString() for f in symbols.schema}
    numbers = loose.groupBy("page_id").applyInPandas(dealt, f"page_id {kinds['page_id']}, nth {kinds['nth']}, number long").withColumnRenamed("number", "dealt")
    name = F.format_string(f"{prefix}%04d", "dealt")
    return own.join(numbers, ["page_id", "nth"], "left").select("page_id", "nth", F.when(F.col("dealt").isNull(), F.col("given")).otherwise(name).alias("ref"))


def wire_refs(connections: DataFrame, prefix: str = "W-", rows: int = 0) -> DataFrame:
    """page_id, nth, ref: the given ref of the first that has it, else the lowest numbers that nobody on the page was given, in order.
    rows: a bound of the rows, if known, for as many tasks."""
    deal = lambda df, keys: df if rows <= graph.FEW else graph.dealt(df, keys, rows)
    given = connections.select("page_id", "nth", _blank("ref").alias("given"))
    own = given.withColumn("own", F.col("given").isNotNull() & (F.row_number().over(Window.partitionBy("page_id", "given").orderBy("nth")) == 1))
    number = F.expr(f"try_cast(nullif(regexp_extract(given, '^{prefix}([0-9]{{4,}})$', 1), '') AS BIGINT)")
    taken = own.filter("own").select("page_id", "given", number.alias("n")).filter(F.col("n").isNotNull() & (F.col("given") == F.format_string(f"{prefix}%04d", F.col("n")))).select("page_id", "n").distinct()
    # After the number n, in its place k among those taken, n - k numbers are free: the j-th free one lies beyond all with n - k < j.
    gaps = taken.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("n"))).select("page_id", (F.col("n") - F.col("k")).alias("free"), F.lit(1).alias("shift"))
    want = own.filter("NOT own").select("page_id", "nth", F.row_number().over(Window.partitionBy("page_id").orderBy("nth")).alias("j"))
    both = want.select("page_id", F.col("j").cast("long").alias("at"), F.lit(0).alias("shift"), "nth").unionByName(gaps.select("page_id", (F.col("free") + 1).alias("at"), "shift", F.lit(None).cast("int").alias("nth")))
    # Shifts at j and before count for j.
    shifted = deal(both, ["page_id"]).withColumn("over", F.sum("shift").over(Window.partitionBy("page_id").orderBy("at", F.desc("shift")).rowsBetween(Window.unboundedPreceding, 0)))
    numbers = shifted.filter("nth IS NOT NULL").select("page_id", "nth", F.format_string(f"{prefix}%04d", F.col("at") + F.col("over")).alias("dealt"))
    return deal(own, ["page_id", "nth"]).join(numbers, ["page_id", "nth"], "left").select("page_id", "nth", F.coalesce("dealt", "given").alias("ref"))


def kept_attributes(attributes: Column) -> Column:
    """Without empty values, keys trimmed; null if nothing is left."""
    kept = F.map_filter(F.transform_keys(attributes, lambda k, v: F.trim(k)), lambda k, v: v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, kept)


def resolved_payload(symbols: DataFrame, terminals: DataFrame, connections: DataFrame) -> dict[str, DataFrame]:
    """symbols, terminals, connections as they are stored, and skipped (page_id, nth, message): connections with an end that is no symbol, and those from a terminal to
    itself. Boxes and terminals are clamped to the page; a terminal without a name has its number; connections name terminals by ref, unknown ones become null."""
    c = F.col
    refs = graph.cut_lineage(symbol_refs(symbols))
    cx, cy, w, h = G.clamped(c("cx"), c("cy"), c("w"), c("h"))
    stored = symbols.drop("ref").join(refs, ["page_id", "nth"]).select(
        "page_id", "nth", "ref", F.lower(F.trim("class_key")).alias("class_key"), _blank("label").alias("label"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), _blank("note").alias("note"),
        F.coalesce(_blank("origin"), F.lit("manual")).alias("origin"), "confidence", kept_attributes(c("attributes")).alias("attributes"),
    )
    unit = lambda x: F.least(F.greatest(c(x).cast("double"), F.lit(0.0)), F.lit(1.0)).alias(x)
    owners = refs.select("page_id", c("nth").alias("symbol_nth"), c("ref").alias("symbol_ref"))
    place = F.row_number().over(Window.partitionBy("page_id", "symbol_nth").orderBy("nth")).cast("string")
    stops = terminals.drop("symbol_ref").join(owners, ["page_id", "symbol_nth"]).withColumn("place", place)
    stops = stops.select(
        "page_id", "symbol_ref", "nth", F.coalesce(_blank("ref"), F.concat("symbol_ref", F.lit("-T"), "place")).alias("ref"), F.coalesce(_blank("name"), c("place")).alias("name"), unit("tx"), unit("ty"),
        F.coalesce(_blank("origin"), F.lit("manual")).alias("origin"),
    )
    named = connections.drop("ref").join(wire_refs(connections), ["page_id", "nth"])
    have = lambda end: refs.select("page_id", c("ref").alias(f"{end}_symbol"), F.lit(True).alias(f"{end}__"))
    # A terminal's ref may be there twice: the last one counts, here only that there is one.
    known = stops.select("page_id", "ref").distinct()
    stop = lambda end: known.select("page_id", c("ref").alias(f"{end}_terminal"), F.lit(True).alias(f"{end}_t__"))
    for end in ("from", "to"):
        named = named.join(have(end), ["page_id", f"{end}_symbol"], "left").join(stop(end), ["page_id", f"{end}_terminal"], "left")
    lost = c("from__").isNull() | c("to__").isNull()
    loop = (c("from_symbol") == c("to_symbol")) & (F.coalesce("from_terminal", F.lit("")) == F.coalesce("to_terminal", F.lit("")))
    named = graph.cut_lineage(named.withColumn("why", F.when(lost, "missing").when(loop, "loop")))
    message = F.concat(F.coalesce("from_symbol", F.lit("None")), F.lit(" -> "), F.coalesce("to_symbol", F.lit("None")), F.when(c("why") == "loop", " (self loop)").otherwise(""))
    wires = named.filter("why IS NULL").select(
        "page_id", "nth", "ref", "from_symbol", F.when(c("from_t__"), c("from_terminal")).alias("from_terminal"), "to_symbol", F.when(c("to_t__"), c("to_terminal")).alias("to_terminal"), _blank("wire_no").alias("wire_no"),
        F.coalesce(_blank("kind"), F.lit("wire")).alias("kind"), _blank("note").alias("note"),
    )
    return {"symbols": stored, "terminals": stops, "connections": wires, "skipped": named.filter("why IS NOT NULL").select("page_id", "nth", message.alias("message"))}


def new_classes(symbols: DataFrame, classes: DataFrame) -> DataFrame:
    """class_key, yolo_index of the classes of symbols that are not there yet: numbers from how many there are on, free ones, in order of key. classes: class_key, yolo_index."""
    fresh = symbols.select("class_key").distinct().join(classes.select("class_key"), "class_key", "left_anti").filter("class_key <> ''")
    n = classes.count()
    used = classes.select((F.col("yolo_index") - n + 1).alias("yolo_index")).filter("yolo_index >= 1")
    return R.free_numbers(fresh, used, "yolo_index", [F.col("class_key")]).select("class_key", (F.col("yolo_index") + n - 1).cast("int").alias("yolo_index"))


class PageStore:
    """The stored tables of pages, in parts by a hash of the page. Replacing pages writes the parts that hold them anew, each table in one overwrite of just these parts."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _part(self, page: Column) -> Column:
        return F.pmod(F.xxhash64(page.cast("long")), F.lit(self.parts)).cast("int")

    def table(self, name: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            # A part that has become empty still has a row without a page.
            rows = self.spark.read.schema(f"{TABLES[name]}, part int").parquet(f"{self.folder}/{name}").filter("page_id IS NOT NULL")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TABLES[name])
        return rows.drop("part")

    def replace(self, pages: DataFrame, tables: dict[str, DataFrame]) -> None:
        """pages: page_id. All rows of these pages give way to those in `tables`; other pages keep theirs."""
        pages = graph.cut_lineage(pages.select(F.col("page_id").cast("long").alias("page_id")).distinct())
        parts = pages.select(self._part(F.col("page_id")).alias("part")).distinct()
        for name, ddl in TABLES.items():
            fields = self.spark.createDataFrame([], ddl).columns
            stays = self.table(name).withColumn("part", self._part(F.col("page_id"))).join(parts, "part", "left_semi").join(pages, "page_id", "left_anti")
            new = tables[name].select(*fields).withColumn("part", self._part(F.col("page_id"))).join(pages, "page_id", "left_semi")
            mark = parts.select(*[F.lit(None).alias(f) for f in fields], "part")
            rows = stays.select(*fields, "part").unionByName(new.select(*fields, "part")).unionByName(mark)
            rows = graph.cut_lineage(self.spark.createDataFrame([], f"{ddl}, part int").unionByName(rows))  # read whole before what it is read from is written
            rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(f"{self.folder}/{name}")
            graph.forget(rows)


def replaced_pages(store: PageStore, pages: DataFrame, symbols: DataFrame, terminals: DataFrame, connections: DataFrame) -> DataFrame:
    """Stores a payload in the place of what the pages have; what was skipped: page_id, nth, message."""
    found = resolved_payload(symbols, terminals, connections)
    skipped = graph.cut_lineage(found.pop("skipped"))
    store.replace(pages, found)
    return skipped


# --- bundles ------------------------------------------------------------------------------------------------------------

PAGE_FIELDS = "page_id long, name string, sheet_no string, status string, image_width int, image_height int, sha256 string"
CLASS_FIELDS = "class_key string, label string, color string, yolo_index int"


def export_bundle(folder: str, pages: DataFrame, classes: DataFrame, tables: dict[str, DataFrame], blobs: DataFrame | None = None) -> None:
    """Writes a bundle: pages, classes and the tables of TABLES as JSON lines, the connections as CSV for people too, images (sha256, content) by content."""
    c = F.col
    names = lambda ddl: [x.split()[0] for x in ddl.split(", ")]
    pages.select(*names(PAGE_FIELDS)).write.json(f"{folder}/pages", ignoreNullFields=False)
    classes.select(*names(CLASS_FIELDS)).write.json(f"{folder}/classes", ignoreNullFields=False)
    for name, ddl in TABLES.items():
        tables[name].select(*names(ddl)).join(pages.select("page_id"), "page_id", "left_semi").write.json(f"{folder}/{name}", ignoreNullFields=False)
    side = lambda s: tables["symbols"].select("page_id", c("ref").alias(f"{s}_symbol"), c("class_key").alias(f"{s}_class"), c("label").alias(f"{s}_label"))
    rows = tables["connections"].join(pages.select("page_id", "sheet_no"), "page_id").join(side("from"), ["page_id", "from_symbol"], "left").join(side("to"), ["page_id", "to_symbol"], "left")
    order = ["page_id", "sheet_no", "from_symbol", "from_class", "from_label", "from_terminal", "to_symbol", "to_class", "to_label", "to_terminal", "wire_no", "kind", "note"]
    rows.withColumn("note", F.regexp_replace("note", r"[\r\n]+", " ")).select(*order).write.csv(f"{folder}/connections_csv", header=True)
    if blobs is not None:
        blobs.join(pages.select("sha256"), "sha256", "left_semi").dropDuplicates(["sha256"]).write.parquet(f"{folder}/images")


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    ddl = {"pages": PAGE_FIELDS, "classes": CLASS_FIELDS, **TABLES}
    return {name: spark.read.schema(fields).json(f"{folder}/{name}") for name, fields in ddl.items()}


def import_bundle(bundle: dict[str, DataFrame], pages: DataFrame, classes: DataFrame, blobs: DataFrame) -> dict[str, DataFrame]:
    """What a bundle adds to pages, classes and blobs (sha256): pages under new ids (from the greatest one on, in the bundle's order), their tables under these, classes whose key
    is new, under free numbers, hashes of images not there yet, mapping (old_id, page_id) and skipped connections. Pages are added even if they are there already."""
    last = pages.agg(F.max("page_id")).first()[0] or 0
    old = bundle["pages"].select("page_id").distinct()
    mapping = graph.cut_lineage(R.numbered(old, [], [F.col("page_id")], "k").select(F.col("page_id").alias("old_id"), (F.col("k") + last).cast("long").alias("new_id")))
    moved = lambda df: df.join(mapping, F.col("page_id") == F.col("old_id")).withColumn("page_id", F.col("new_id")).select(*df.columns)
    symbols = moved(bundle["symbols"])
    places = symbols.select("page_id", F.col("nth").alias("symbol_nth"), F.col("ref").alias("symbol_ref"))
    terminals = moved(bundle["terminals"]).join(places, ["page_id", "symbol_ref"])
    found = resolved_payload(symbols, terminals, moved(bundle["connections"]))
    unknown = bundle["classes"].select("class_key", "label", "color").filter("class_key <> ''").dropDuplicates(["class_key"])
    numbers = new_classes(symbols.select("class_key").unionByName(unknown.select("class_key")), classes)
    added = numbers.join(unknown, "class_key", "left").select("class_key", F.coalesce("label", "class_key").alias("label"), F.coalesce("color", F.lit("#84b0d8")).alias("color"), "yolo_index")
    images = bundle["pages"].select("sha256").filter("sha256 IS NOT NULL").distinct().join(blobs.select("sha256"), "sha256", "left_anti")
    return {"pages": moved(bundle["pages"]), "classes": added, "images": images, "mapping": mapping.select("old_id", F.col("new_id").alias("page_id")), **found}
