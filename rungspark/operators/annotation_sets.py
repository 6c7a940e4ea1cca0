"""Annotations as sets: importing candidates, replacing and correcting rows, exchanging attributes, splits and schema changes.

Defined results: empty tables give empty results; a null key names nothing and is reported as not found; of several rows that set one
value, the last by the given order counts; repeated rows of one key are reported as duplicates where a result per row is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, relational as R


def import_plan(candidates: DataFrame, existing: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """by, f, ref, action (kept, added): what becomes of candidates on a page. candidates: by, f; existing: by, g, ref; matches: by, f, g.
    New ones get SYM- numbers in order of f: the free numbers above how many the page has."""
    placed = candidates.select(*by, "f").join(matches.select(*by, "f", "g"), [*by, "f"], "left").join(existing.select(*by, "g", "ref"), [*by, "g"], "left")
    number = F.expr("try_cast(nullif(regexp_extract(ref, '^SYM-([0-9]{4,})$', 1), '') AS INT)")
    have = existing.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("have__"))
    new = F.col("ref").isNull()
    rows = placed.withColumn("at__", F.sum(new.cast("int")).over(Window.partitionBy(*by).orderBy("f")))
    # Above the page's number of rows, in its place k among those used, the number have + n leaves n - k free: the j-th free one lies beyond all with n - k < j.
    used = existing.select(*by, number.alias("n__")).distinct().join(have, by).filter("n__ > have__")
    gaps = used.select(*by, (F.col("n__") - F.col("have__") - F.row_number().over(Window.partitionBy(*by).orderBy("n__")) + 1).cast("long").alias("at__"), F.lit(1).alias("shift__"))
    both = rows.withColumn("shift__", F.lit(0)).unionByName(gaps, allowMissingColumns=True)
    over = F.sum("shift__").over(Window.partitionBy(*by).orderBy("at__", F.desc("shift__")).rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("over__", over).filter("shift__ = 0").join(have, by, "left")
    ref = F.when(new, F.format_string("SYM-%04d", F.coalesce("have__", F.lit(0)) + F.col("at__") + F.col("over__"))).otherwise(F.col("ref"))
    return rows.select(*by, "f", ref.alias("ref"), F.when(new, "added").otherwise("kept").alias("action"))


def new_connections(links: DataFrame, connections: DataFrame, by: list[str]) -> DataFrame:
    """by, a, at, b, bt, action of links between ends (symbol a, terminal at): kept if both ends are one, or if a connection has these ends, or
    one of them, or both, without a terminal; of equal links one is added. connections: the same columns, terminals may be null."""
    end = lambda s, t: F.concat_ws("\x01", s, F.coalesce(F.col(t), F.lit("\x02")))
    bare = lambda s: F.concat_ws("\x01", s, F.lit("\x02"))
    keyed = lambda x, y: F.concat_ws("\x03", F.least(x, y), F.greatest(x, y))
    have = connections.select(*by, keyed(end("a", "at"), end("b", "bt")).alias("k__")).distinct().withColumn("hit__", F.lit(True))
    rows = links.withColumn("key__", keyed(end("a", "at"), end("b", "bt")))
    rows = rows.withColumn("nth__", F.row_number().over(Window.partitionBy(*by, "key__").orderBy("a", "at", "b", "bt")))
    forms = F.array_distinct(F.array(*[keyed(x, y) for x in (end("a", "at"), bare("a")) for y in (end("b", "bt"), bare("b"))]))
    met = rows.withColumn("k__", F.explode(forms)).join(have, [*by, "k__"], "left").groupBy(*by, "a", "at", "b", "bt", "key__", "nth__").agg(F.max("hit__").alias("hit__"))
    kept = (end("a", "at") == end("b", "bt")) | F.coalesce("hit__", F.lit(False))
    return met.select(*by, "a", "at", "b", "bt", F.when(kept, "kept").when(F.col("nth__") > 1, "repeated").otherwise("added").alias("action"))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys that occur in `new` give way to its rows; the other keys keep theirs."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)


def upserted(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """old with the fields of `new` by key, null fields of new leaving the old value; unknown keys are added."""
    fresh = new.select(F.col(key).alias("k__"), *[F.col(f).alias(f"{f}__") for f in fields])
    both = old.select(key, *fields).join(fresh, F.col(key) == F.col("k__"), "full")
    return both.select(F.coalesce(key, "k__").alias(key), *[F.coalesce(f"{f}__", f).alias(f) for f in fields])


def key_results(given: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is known, and the keys that name nothing (null: rows without a key) with their number of rows."""
    names = known.select(key).filter(F.col(key).isNotNull()).distinct()
    return given.join(names, key, "left_semi"), given.join(names, key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def safe_members(listing: DataFrame, most_files: int = 20_000, most_bytes: int = 2 << 30, ratio: float = 25.0) -> DataFrame:
    """listing (archive, path, size, packed) with problem: null for members that may be read. Names that leave the folder, system files, and all
    of an archive with too many files, too many bytes or too good a compression."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    away = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike(r"^[A-Za-z]:")
    junk = path.rlike(r"(^|/)(__MACOSX|\.DS_Store|Thumbs\.db)(/|$)")
    total = listing.groupBy("archive").agg(F.count(F.lit(1)).alias("n__"), F.sum("size").alias("s__"), F.sum("packed").alias("p__"))
    problem = (
        F.when(away, "leaves the folder").when(F.col("n__") > most_files, "too many files").when(F.col("s__") > most_bytes, "too large")
        .when(F.col("s__") > ratio * F.greatest("p__", F.lit(1)), "too well compressed").when(junk, "system file")
    )
    return listing.join(total, "archive").withColumn("problem", problem).drop("n__", "s__", "p__")


def image_pages(images: DataFrame, pages: DataFrame) -> DataFrame:
    """images (file, width, height) with page_id, how (id, name, sheet) and differs (sizes over 2 pixels apart). By a leading p<id>_, else by the
    file's stem if exactly one page has that name, else that sheet. pages: page_id, name, sheet_no, image_width, image_height."""
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    rows = images.withColumn("stem__", stem).withColumn("id__", F.expr("try_cast(nullif(regexp_extract(stem__, '^p([0-9]+)_', 1), '') AS BIGINT)"))
    only = lambda c: pages.groupBy(F.col(c).alias("stem__")).agg(F.when(F.count(F.lit(1)) == 1, F.min("page_id")).alias(f"{c}__")).filter(F.col("stem__").isNotNull())
    rows = rows.join(only("name"), "stem__", "left").join(only("sheet_no"), "stem__", "left")
    rows = rows.join(pages.select(F.col("page_id").alias("id__"), F.lit(True).alias("there__")), "id__", "left")
    by_id = F.when(F.col("there__"), F.col("id__"))
    rows = rows.withColumn("page_id", F.coalesce(by_id, F.col("name__"), F.col("sheet_no__")))
    how = F.when(by_id.isNotNull(), "id").when(F.col("name__").isNotNull(), "name").when(F.col("sheet_no__").isNotNull(), "sheet")
    sized = rows.join(pages.select("page_id", "image_width", "image_height"), "page_id", "left")
    differs = (F.abs(F.col("width") - F.col("image_width")) > 2) | (F.abs(F.col("height") - F.col("image_height")) > 2)
    return sized.select("file", "page_id", how.alias("how"), F.coalesce(differs, F.lit(False)).alias("differs"))


def attribute_rows(objects: DataFrame, sheets: DataFrame) -> DataFrame:
    """object_id (sheet/ref, with #page where several pages have that sheet) and attributes of objects (page_id, ref, attributes)."""
    many = sheets.withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy("sheet")))
    name = F.when(F.col("n__") > 1, F.concat("sheet", F.lit("#"), F.col("page_id").cast("string"))).otherwise(F.col("sheet"))
    return objects.join(many, "page_id").select(F.concat(name, F.lit("/"), F.col("ref")).alias("object_id"), "page_id", "ref", "attributes")


def attribute_results(given: DataFrame, rows: DataFrame, numeric: list[str]) -> DataFrame:
    """object_id, key, value, result of given attributes (object_id, key, value) against attribute_rows(): updated, unchanged, not_found,
    duplicate (a key given twice with different values) or type_mismatch (a numeric key without a number)."""
    known = rows.select("object_id", F.col("attributes").alias("a__"), F.lit(True).alias("there__"))
    twice = F.count_distinct("value")
    many = given.groupBy("object_id", "key").agg((twice > 1).alias("many__"))
    old = F.try_element_at("a__", F.col("key"))
    result = (
        F.when(F.col("there__").isNull(), "not_found").when(F.col("many__"), "duplicate")
        .when(F.col("key").isin(*numeric) & F.expr("try_cast(value AS DOUBLE)").isNull(), "type_mismatch").when(old.eqNullSafe(F.col("value")), "unchanged").otherwise("updated")
    )
    return given.distinct().join(many, ["object_id", "key"]).join(known, "object_id", "left").select("object_id", "key", "value", result.alias("result"))


def corrected_rows(rows: DataFrame, corrections: DataFrame, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """Applies corrections (key, was, becomes) where the field still has the value it had, so that a second run changes nothing.
    The rows after it, and a result for each correction: applied, already, conflict, not_found."""
    fix = corrections.select(F.col(key).alias("k__"), "was", "becomes")
    now = F.col(field)
    hit = now.eqNullSafe(F.col("was")) & F.col("k__").isNotNull()
    after = rows.join(fix, F.col(key) == F.col("k__"), "left").withColumn(field, F.when(hit, F.col("becomes")).otherwise(now)).select(*rows.columns)
    seen = fix.join(rows.select(F.col(key).alias("k2__"), now.alias("now__"), F.lit(True).alias("there__")), F.col("k__") == F.col("k2__"), "left")
    result = (
        F.when(F.col("there__").isNull(), "not_found").when(F.col("now__").eqNullSafe(F.col("becomes")), "already")
        .when(F.col("now__").eqNullSafe(F.col("was")), "applied").otherwise("conflict")
    )
    return after, seen.select(F.col("k__").alias(key), "was", "becomes", result.alias("result"))


def overlaid(drafts: DataFrame, checked: DataFrame, matches: DataFrame, by: list[str], field: str) -> DataFrame:
    """Drafts (by, f, field) with the checked value of what they match; checked: by, g, field."""
    said = matches.select(*by, "f", "g").join(checked.select(*by, "g", F.col(field).alias("said__")), [*by, "g"]).select(*by, "f", "said__")
    return drafts.join(said, [*by, "f"], "left").withColumn(field, F.coalesce("said__", field)).select(*drafts.columns)


def split_rows(rows: DataFrame, key: str, shares: dict[str, float], seed: int, explicit: DataFrame | None = None) -> DataFrame:
    """Adds split: as listed (key, split), else by a hash of key and seed with these shares. A key that is listed in two splits is an error."""
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    upto, rule = 0.0, None
    for name, share in shares.items():
        upto += share
        rule = F.when(place < upto - 1e-12, name) if rule is None else rule.when(place < upto - 1e-12, name)
    drawn = rule.otherwise(list(shares)[-1])
    if explicit is None:
        return rows.withColumn("split", drawn)
    listed = explicit.groupBy(F.col(key).alias("k__")).agg(
        F.when(F.count_distinct("split") > 1, F.raise_error(F.concat(F.lit("listed in two splits: "), F.first(key).cast("string"))).cast("string")).otherwise(F.min("split")).alias("split"))
    return rows.join(listed, F.col(key) == F.col("k__"), "left").withColumn("split", F.coalesce("split", drawn)).drop("k__")


def evolved(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds missing columns, and fills nulls of present ones, with the given values."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in columns.items()})


def without_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def contracted(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """a, b: edges after the ends that `inner` edges (a, b) join are made one (their least); edges inside one are gone."""
    alias = graph.connected_components(inner)
    of = lambda s: alias.select(F.col("node").alias(s), F.col("component").alias(f"{s}__"))
    rows = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a__", "a").alias("a"), F.coalesce("b__", "b").alias("b"))
    return R.undirected(rows, "a", "b")


def first_reached(edges: DataFrame, starts: DataFrame, stops: DataFrame, through: DataFrame) -> DataFrame:
    """start, stop: the stops that paths from a start meet first, going on only through nodes of `through`. starts, stops, through: node.
    edges: a, b, both ways. A path ends at its first stop, however long it is. As edges go both ways, what a step comes back to lies in the two steps before it; a stop that is met
    again changes nothing."""
    deal = lambda df, keys, n: df if n <= graph.FEW else graph.dealt(df, keys, n).hint("merge")
    marked = lambda df, stop: df.select(F.col("node").alias("b"), F.lit(stop).alias("stop__"), F.lit(not stop).alias("go__"))
    marks, ways = marked(stops, True).unionByName(marked(through, False)), edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = max(marks.count(), ways.count())
    marks = deal(marks, ["b"], n).groupBy("b").agg(F.bool_or("stop__").alias("stop__"), F.bool_or("go__").alias("go__"))
    # Edges know what they lead to, so that a step is one join; those to other nodes lead nowhere.
    both = graph.cut_lineage(deal(ways, ["b"], n).distinct().join(marks, "b").select("a", "b", "stop__", "go__"))
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at"))
    before = front = graph.cut_lineage(deal(front, ["start"], front.count()).distinct())
    edge_rows, rows, rows_before, found, rounds, made = both.count(), front.count(), 0, None, 0, 0
    while rows:
        # Few are sent to all edges, more are dealt with them: by as many tasks as there are rows for.
        near = F.broadcast(front) if rows <= graph.FEW else graph.dealt(front, ["at"], max(rows, edge_rows)).hint("merge")
        ways = both if rows <= graph.FEW else graph.dealt(both, ["a"], max(rows, edge_rows)).hint("merge")
        step = graph.cut_lineage(near.join(ways, F.col("at") == F.col("a")).select("start", F.col("b").alias("at"), "stop__", "go__", F.lit(False).alias("old__")))
        met = step.count()
        if not met:
            break
        for old in (front, before):
            step = step.unionByName(old.select("start", "at", *[F.lit(x).alias(c) for c, x in (("stop__", False), ("go__", False), ("old__", True))]))
        new = deal(step, ["start", "at"], met + rows + rows_before).groupBy("start", "at").agg(*[F.bool_or(c).alias(c) for c in ("stop__", "go__", "old__")])
        step = graph.cut_lineage(new.filter("NOT old__").drop("old__"))
        hit = step.filter("stop__").select("start", F.col("at").alias("stop"))
        found, rounds, made = hit if found is None else found.unionByName(hit), rounds + 1, made + met
        if rounds % 16 == 0:  # keeps the plan short
            found = graph.cut_lineage(deal(found, ["start", "stop"], made).distinct())
        before, front, rows_before = front, step.filter("go__ AND NOT stop__").select("start", "at"), rows
        rows = front.count()
    if found is None:
        return front.select("start", F.col("at").alias("stop")).limit(0)
    # A way round may lead back to where it began.
    return deal(found, ["start", "stop"], made).distinct().filter(F.col("start") != F.col("stop"))


def upstream(edges: DataFrame, loads: DataFrame, sources: str, target: str) -> DataFrame:
    """load, sources: what directly feeds each load, in order."""
    fed = edges.groupBy(F.col(target).alias("load")).agg(F.array_sort(F.collect_set(sources)).alias("sources"))
    return loads.select(F.col(loads.columns[0]).alias("load")).join(fed, "load", "left").withColumn("sources", F.coalesce("sources", F.array().cast(fed.schema["sources"].dataType)))


def stops_in_order(stops: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """by, a, b: an edge split at its stops: neighbours along it are joined."""
    w = Window.partitionBy(*by).orderBy(at, key)
    return stops.withColumn("b", F.lead(key).over(w)).filter("b IS NOT NULL").select(*by, F.col(key).alias("a"), "b")


def claimed(claims: DataFrame, by: list[str], dot: str, owner: str, score: str) -> DataFrame:
    """Claims with duplicate_of: of several that claim a dot the surest (ties: the least owner) keeps it, null; the others name that one."""
    w = Window.partitionBy(*by, dot).orderBy(F.desc(score), owner)
    first = F.first(owner).over(w)
    return claims.withColumn("duplicate_of", F.when(F.row_number().over(w) > 1, first))


def character_boxes(lines: DataFrame, word: str, left: str, right: str) -> DataFrame:
    """A line's box shared out among its characters, full-width ones counting twice: pos, char, x0, x1."""
    chars = F.filter(F.split(F.col(word), ""), lambda c: c != "")
    wide = lambda c: F.when(F.octet_length(c) >= 3, 2).otherwise(1)
    weights = F.transform(chars, wide)
    rows = lines.withColumns({"c__": chars, "w__": weights}).withColumn("t__", F.aggregate("w__", F.lit(0), lambda a, x: a + x))
    rows = rows.select("*", F.posexplode("c__").alias("pos", "char"))
    before = F.aggregate(F.slice("w__", F.lit(1), F.col("pos")), F.lit(0), lambda a, x: a + x)
    step = (F.col(right) - F.col(left)) / F.col("t__")
    x0 = F.col(left) + before * step
    return rows.withColumn("x0", x0).withColumn("x1", F.col("x0") + F.get("w__", F.col("pos")) * step).drop("c__", "w__", "t__")
