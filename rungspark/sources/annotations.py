"""Sources and sinks of annotations: label text, nested pages, tables of connections, XML, content-addressed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed format: the nested page document.
PAGE_DDL = (
    "id BIGINT, name STRING, sheet_no STRING, image_width INT, image_height INT, status STRING, "
    "symbols ARRAY<STRUCT<ref: STRING, class_key: STRING, label: STRING, cx: DOUBLE, cy: DOUBLE, w: DOUBLE, h: DOUBLE, note: STRING, origin: STRING, confidence: DOUBLE, attributes: MAP<STRING, STRING>, "
    "terminals: ARRAY<STRUCT<name: STRING, tx: DOUBLE, ty: DOUBLE, origin: STRING>>>>, "
    "connections: ARRAY<STRUCT<ref: STRING, from_symbol: STRING, from_terminal: STRING, to_symbol: STRING, to_terminal: STRING, wire_no: STRING, kind: STRING, note: STRING>>"
)


def page_schema() -> T.StructType:
    return T.StructType.fromDDL(PAGE_DDL)


def read_pages(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nested page documents (JSON) as flat tables pages, symbols, terminals, connections; missing keys are null."""
    pages = spark.read.schema(page_schema()).json(path, multiLine=False)
    symbols = pages.select(F.col("id").alias("page_id"), F.explode("symbols").alias("s"))
    return {
        "pages": pages.drop("symbols", "connections"),
        "symbols": symbols.select("page_id", "s.*").drop("terminals"),
        "terminals": symbols.select("page_id", F.col("s.ref").alias("symbol_ref"), F.explode("s.terminals").alias("t")).select("page_id", "symbol_ref", "t.*"),
        "connections": pages.select(F.col("id").alias("page_id"), F.explode("connections").alias("c")).select("page_id", "c.*"),
    }


def nested(pages: DataFrame, symbols: DataFrame, terminals: DataFrame, connections: DataFrame) -> DataFrame:
    """The inverse of read_pages: symbols by ref, terminals by name, connections by ref. Children are grouped before the joins."""
    stops = terminals.groupBy(F.col("page_id").alias("p__"), F.col("symbol_ref").alias("r__")).agg(F.array_sort(F.collect_list(F.struct("name", "tx", "ty", "origin"))).alias("terminals"))
    full = symbols.join(stops, (F.col("page_id") == F.col("p__")) & (F.col("ref") == F.col("r__")), "left").drop("p__", "r__")
    schema = page_schema()
    kinds = [f.name for f in schema["symbols"].dataType.elementType.fields]
    wires = [f.name for f in schema["connections"].dataType.elementType.fields]
    # Maps have no order, so symbols are sorted by a comparable first field and the struct is put together afterwards.
    by_ref = F.transform(F.array_sort(F.collect_list(F.struct("ref", F.to_json(F.struct(*kinds)).alias("j")))), lambda x: F.from_json(x["j"], schema["symbols"].dataType.elementType))
    parts = full.groupBy("page_id").agg(by_ref.alias("symbols")), connections.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*wires))).alias("connections"))
    out = pages
    for part in parts:
        out = out.join(part.withColumnRenamed("page_id", "p__"), F.col("id") == F.col("p__"), "left").drop("p__")
    return out.select(*schema.names)


def read_labels(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    """Lines `class cx cy w h [confidence]` of files p<id>_*.txt: page_id (null if the name has none), file, class_key, box, confidence.
    Lines with fewer than five fields or with a field that is no number are passed over. classes: yolo_index, class_key."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"), F.col("_metadata.file_name").alias("file"), F.expr("try_cast(nullif(regexp_extract(_metadata.file_name, '^p([0-9]+)_', 1), '') AS BIGINT)").alias("page_id"))
    number = lambda i: F.expr(f"try_cast(get(f, {i}) AS DOUBLE)")
    cols = rows.select("page_id", "file", F.expr("try_cast(get(f, 0) AS INT)").alias("yolo_index"), *[number(i).alias(c) for i, c in enumerate(("cx", "cy", "w", "h", "confidence"), 1)])
    kept = cols.dropna(subset=["yolo_index", "cx", "cy", "w", "h"])
    return kept.join(F.broadcast(classes.select("yolo_index", "class_key")) if classes.count() <= 10_000 else classes, "yolo_index", "left").withColumn("class_key", F.coalesce("class_key", F.lit("other")))


def label_lines(symbols: DataFrame, classes: DataFrame) -> DataFrame:
    """page_id, lines: the label file of each page, six decimals, in order of ref."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "yolo_index", "cx", "cy", "w", "h")
    rows = symbols.drop("yolo_index").join(classes.select("class_key", "yolo_index"), "class_key").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ref", line.alias("line")))).alias("x"))
    return rows.select("page_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("lines"))


def connection_rows(connections: DataFrame, symbols: DataFrame) -> DataFrame:
    """Connections with the classes and labels of both ends, for a CSV sink; line ends in notes become spaces. Connections with a missing end are left out."""
    side = lambda s: symbols.select("page_id", F.col("ref").alias(f"{s}_symbol"), F.col("class_key").alias(f"{s}_class"), F.col("label").alias(f"{s}_label"))
    both = connections.join(side("from"), ["page_id", "from_symbol"]).join(side("to"), ["page_id", "to_symbol"])
    return both.withColumn("note", F.regexp_replace("note", r"[\r\n]+", " "))


def read_boxes_xml(spark: SparkSession, path: str, image_tag: str = "image") -> DataFrame:
    """Boxes of an XML annotation file: image, class, corners in pixels and the image's size, as unit boxes."""
    schema = "_name STRING, _width DOUBLE, _height DOUBLE, box ARRAY<STRUCT<_label: STRING, _xtl: DOUBLE, _ytl: DOUBLE, _xbr: DOUBLE, _ybr: DOUBLE>>"
    rows = spark.read.format("xml").option("rowTag", image_tag).schema(schema).load(path).select("_name", "_width", "_height", F.explode("box").alias("b"))
    c = F.col
    return rows.select(
        c("_name").alias("image"), c("b._label").alias("class_key"), ((c("b._xtl") + c("b._xbr")) / 2 / c("_width")).alias("cx"), ((c("b._ytl") + c("b._ybr")) / 2 / c("_height")).alias("cy"),
        ((c("b._xbr") - c("b._xtl")) / c("_width")).alias("w"), ((c("b._ybr") - c("b._ytl")) / c("_height")).alias("h"),
    )


def new_blobs(spark: SparkSession, blobs: DataFrame, path: str) -> DataFrame:
    """Content-addressed sink: appends blobs (content, suffix) whose sha256 is not stored yet; returns what was added."""
    keyed = blobs.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    try:
        keyed = keyed.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    from ..operators.graph import cut_lineage

    added = cut_lineage(keyed)
    added.write.mode("append").parquet(path)
    return added


def aligned(gold: DataFrame, found: DataFrame, key) -> DataFrame:
    """Pages of two sets by key(sheet_no, name), the first of several; gold_id, found_id (null: missing)."""
    def first(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("k").orderBy("id")
        return df.withColumn("k", key(F.col("sheet_no"), F.col("name"))).filter("k IS NOT NULL").withColumn("n", F.row_number().over(w)).filter("n = 1").select("k", F.col("id").alias(name))

    return first(gold, "gold_id").join(first(found, "found_id"), "k", "left")
