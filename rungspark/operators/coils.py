"""Coils and their wires: wires that run through a coil, coils cut into them, contacts that name the sheet of their coil.

symbols: page_id, ref, class_key, label, cx, cy, w, h (shares of the page); terminals: page_id, symbol_ref, ref, name, tx, ty; connections: page_id, ref, from_symbol,
from_terminal, to_symbol, to_terminal, kind and more; pages: page_id, width, height.

Defined results: empty tables give empty results; ends that are not on the page make a wire be passed over; null terminals stand for the symbol's centre; repeated
rows of one ref are the caller's error; further columns of connections stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph
from . import spatial as P

COILS = ("coil", "relay_coil", "lamp")
CENTRE, INSET = 0.3, 1.0  # how near the centre a wire must pass, of the shorter side; how much smaller than drawn a box counts, in pixels


def _clip(px: Column, py: Column, qx: Column, qy: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column]:
    """Whether a segment gets inside a box, and from which share of it to which. Each axis occurs once in the shares: an axis that the segment does not move along has none (greatest and least pass over nulls)."""
    d = [F.nullif(q - p, F.lit(0.0)) for p, q in ((px, qx), (py, qy))]
    at = [((lo - p) / dd, (hi - p) / dd) for p, lo, hi, dd in ((px, x0, x1, d[0]), (py, y0, y1, d[1]))]
    low = F.greatest(F.lit(0.0), *[F.least(a, b) for a, b in at])
    high = F.least(F.lit(1.0), *[F.greatest(a, b) for a, b in at])
    between = [(q != p) | ((lo < p) & (p < hi)) for p, q, lo, hi in ((px, qx, x0, x1), (py, qy, y0, y1))]
    return between[0] & between[1] & (low < high), low, high


def clip_range(px: Column, py: Column, qx: Column, qy: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(t0, t1): the part of a segment inside a box, as shares of it; null if it does not get in. A segment along a side of the box is outside."""
    inside, low, high = _clip(px, py, qx, qy, x0, y0, x1, y1)
    return F.when(inside, F.struct(low.alias("t0"), high.alias("t1")))


def through_wires(symbols: DataFrame, terminals: DataFrame, connections: DataFrame, pages: DataFrame, cell: float = 16.0) -> DataFrame:
    """page_id, symbol_ref, wire_ref, t0, t1, px, py, qx, qy: wires that enter and leave a coil that is not one of their ends, near its centre."""
    c = F.col
    size = pages.select("page_id", "width", "height")
    placed = symbols.join(size, "page_id")
    centres = placed.select("page_id", c("ref").alias("s"), F.lit(None).cast("string").alias("t"), (c("cx") * c("width")).alias("x"), (c("cy") * c("height")).alias("y"))
    stops = terminals.join(size, "page_id").select("page_id", c("symbol_ref").alias("s"), c("ref").alias("t"), (c("tx") * c("width")).alias("x"), (c("ty") * c("height")).alias("y"))
    ends = graph.cut_lineage(centres.unionByName(stops))
    side = lambda e, x, y: ends.select(c("page_id").alias(f"{e}_page"), c("s").alias(f"{e}_s"), c("t").alias(f"{e}_t"), c("x").alias(x), c("y").alias(y))
    wires = connections.filter((F.coalesce("kind", F.lit("wire")) == "wire") & (c("from_symbol") != c("to_symbol"))).select("page_id", c("ref").alias("wire_ref"), "from_symbol", "from_terminal", "to_symbol", "to_terminal")
    for e, x, y in (("from", "px", "py"), ("to", "qx", "qy")):
        same = (c("page_id") == c(f"{e}_page")) & (c(f"{e}_symbol") == c(f"{e}_s")) & c(f"{e}_terminal").eqNullSafe(c(f"{e}_t"))
        wires = wires.join(side(e, x, y), same).drop(f"{e}_page", f"{e}_s", f"{e}_t")
    wires = wires.filter((c("px") != c("qx")) | (c("py") != c("qy")))
    w, h = c("w") * c("width"), c("h") * c("height")
    x, y = c("cx") * c("width"), c("cy") * c("height")
    coils = placed.filter(c("class_key").isin(*COILS)).select("page_id", c("ref").alias("symbol_ref"), (x - w / 2 + INSET).alias("x0"), (y - h / 2 + INSET).alias("y0"), (x + w / 2 - INSET).alias("x1"), (y + h / 2 - INSET).alias("y1"))
    coils = coils.filter("x0 <= x1 AND y0 <= y1")
    # A wire passes near enough the centre if it meets a small square around it. A pair meets in several cells: it counts in the one of the wire's point nearest to the centre.
    mx, my = (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    core = CENTRE * F.least(c("x1") - c("x0"), c("y1") - c("y0")) + cell * 1e-6
    dx, dy = c("qx") - c("px"), c("qy") - c("py")
    spread = P.segment_cells(wires, c("px"), c("py"), c("qx"), c("qy"), 0.0, cell)
    boxes = P.gridded(coils, mx - core, mx + core, my - core, my + core, cell)
    # What a wire or a coil has by itself is worked out before they meet, and a pair's costly part comes last.
    spread = P.spread(spread.withColumns({"dx": dx, "dy": dy, "square": dx * dx + dy * dy, "long": F.sqrt(dx * dx + dy * dy)}), ["page_id", "gx", "gy"])
    boxes = P.spread(boxes.withColumns({"mx": mx, "my": my, "core": CENTRE * F.least(c("x1") - c("x0"), c("y1") - c("y0"))}), ["page_id", "gx", "gy"])
    foot = ((c("mx") - c("px")) * c("dx") + (c("my") - c("py")) * c("dy")) / c("square")
    corner = (F.floor((c("px") + foot * c("dx")) / cell) == c("gx")) & (F.floor((c("py") + foot * c("dy")) / cell) == c("gy"))
    near = F.abs(c("dx") * (c("py") - c("my")) - (c("px") - c("mx")) * c("dy")) / c("long") <= c("core")
    inside, t0, t1 = _clip(c("px"), c("py"), c("qx"), c("qy"), c("x0"), c("y0"), c("x1"), c("y1"))
    other = (c("symbol_ref") != c("from_symbol")) & (c("symbol_ref") != c("to_symbol"))
    met = P.in_cells(spread, boxes, ["page_id", "gx", "gy"]).filter(near & corner & other)
    # Explode keeps the clipping out of the join's condition: code of that length is run uncompiled, at a hundred times the cost.
    met = met.select("page_id", "symbol_ref", "wire_ref", "px", "py", "qx", "qy", F.explode(F.array(F.struct(t0.alias("t0"), t1.alias("t1"), inside.alias("inside")))).alias("r"))
    return met.filter("r.inside AND r.t0 > 0 AND r.t1 < 1").select("page_id", "symbol_ref", "wire_ref", "r.t0", "r.t1", "px", "py", "qx", "qy")


def coil_issues(symbols: DataFrame, terminals: DataFrame, connections: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, symbol_ref, issue (through, terminals, unwired), detail: coils that are not drawn as agreed: a wire runs through, there are not two terminals, one of them has no wire."""
    c = F.col
    coils = symbols.filter(c("class_key").isin(*COILS)).select("page_id", c("ref").alias("symbol_ref"))
    through = through_wires(symbols, terminals, connections, pages).select("page_id", "symbol_ref").distinct().withColumn("through", F.lit(True))
    wires = connections.filter((F.coalesce("kind", F.lit("wire")) == "wire") & (c("from_symbol") != c("to_symbol")))
    ends = wires.select("page_id", c("from_symbol").alias("symbol_ref"), c("from_terminal").alias("ref")).unionByName(wires.select("page_id", c("to_symbol").alias("symbol_ref"), c("to_terminal").alias("ref"))).distinct()
    stops = terminals.join(ends.withColumn("wired", F.lit(True)), ["page_id", "symbol_ref", "ref"], "left")
    have = stops.groupBy("page_id", "symbol_ref").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(c("wired").isNull(), c("ref")))).alias("bare"))
    rows = coils.join(have, ["page_id", "symbol_ref"], "left").join(through, ["page_id", "symbol_ref"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    issue = F.when(c("through"), "through").when(c("n") != 2, "terminals").when(F.size("bare") > 0, "unwired")
    detail = F.when(issue == "terminals", c("n").cast("string")).when(issue == "unwired", F.array_join("bare", ",")).otherwise("")
    return rows.select("page_id", "symbol_ref", issue.alias("issue"), detail.alias("detail")).filter("issue IS NOT NULL")


def split_through_wires(symbols: DataFrame, terminals: DataFrame, connections: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """terminals, connections and outcomes (page_id, symbol_ref, outcome: split, multiple, none, has_terminals). A coil without terminals that one wire runs through gets two where
    the wire enters and leaves, and the wire is cut there: the first part keeps its ref and attributes. A wire through several such coils is cut at the one with the least ref only;
    the others wait for the next pass."""
    c = F.col
    found = graph.cut_lineage(through_wires(symbols, terminals, connections, pages))
    have = terminals.select("page_id", "symbol_ref").distinct().withColumn("has", F.lit(True))
    coils = symbols.filter(c("class_key").isin(*COILS)).select("page_id", c("ref").alias("symbol_ref")).join(have, ["page_id", "symbol_ref"], "left")
    bare = found.join(coils.filter("has IS NULL"), ["page_id", "symbol_ref"], "left_semi")
    single = bare.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("page_id", "symbol_ref"))).filter("n = 1")
    cut = graph.cut_lineage(single.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "wire_ref").orderBy("symbol_ref"))).filter("k = 1"))
    many = bare.groupBy("page_id", "symbol_ref").agg(F.lit(True).alias("many"))
    outcome = F.when(c("has"), "has_terminals").when(c("done"), "split").when(c("many"), "multiple").otherwise("none")
    outcomes = coils.join(many, ["page_id", "symbol_ref"], "left").join(cut.select("page_id", "symbol_ref", F.lit(True).alias("done")), ["page_id", "symbol_ref"], "left").select("page_id", "symbol_ref", outcome.alias("outcome"))
    point = lambda t: F.struct((c("px") + (c("qx") - c("px")) * c(t)).alias("x"), (c("py") + (c("qy") - c("py")) * c(t)).alias("y"))
    stops = cut.join(pages.select("page_id", "width", "height"), "page_id").select("page_id", "symbol_ref", F.posexplode(F.array(point("t0"), point("t1"))).alias("i", "p"), "width", "height")
    name = (c("i") + 1).cast("string")
    stops = stops.select("page_id", "symbol_ref", F.concat("symbol_ref", F.lit("-T"), name).alias("ref"), name.alias("name"), (c("p.x") / c("width")).alias("tx"), (c("p.y") / c("height")).alias("ty"))
    old = connections.join(cut.select("page_id", c("wire_ref").alias("ref"), "symbol_ref"), ["page_id", "ref"])
    upper = old.withColumns({"to_symbol": c("symbol_ref"), "to_terminal": F.concat("symbol_ref", F.lit("-T1"))}).select(*connections.columns)
    lower = old.withColumns({"from_symbol": c("symbol_ref"), "from_terminal": F.concat("symbol_ref", F.lit("-T2")), "ref": F.lit(None).cast("string")})
    if "attributes" in connections.columns:
        lower = lower.withColumn("attributes", F.lit(None).cast(connections.schema["attributes"].dataType))
    kept = connections.join(cut.select("page_id", c("wire_ref").alias("ref")).distinct(), ["page_id", "ref"], "left_anti").select(*connections.columns)
    return terminals.unionByName(stops, allowMissingColumns=True), kept.unionByName(upper).unionByName(lower.select(*connections.columns)), outcomes


def first_number(label: Column) -> Column:
    """The device number of a label: its first word that is not only digits (the last one if all are), without sheet numbers, folded as names are compared."""
    words = F.filter(F.split(F.trim(F.regexp_replace(T.normalised(F.coalesce(label, F.lit(""))), rf"\(?{T.SHEET}\)?", " ")), r"\s+"), lambda w: w != "")
    word = F.coalesce(F.try_element_at(F.filter(words, lambda w: ~w.rlike(r"^\d+$")), F.lit(1)), F.try_element_at(words, F.lit(-1)))
    return F.coalesce(T.folded(word), F.lit(""))


def coil_sheets(symbols: DataFrame, sheets: DataFrame, support: DataFrame | None = None, contacts: tuple[str, ...] = ("contact_a", "contact_b"), coils: tuple[str, ...] = ("coil", "relay_coil")) -> DataFrame:
    """page_id, ref, severity, fix (coil_label, contact_label, contact_sheet, null), fix_page, fix_ref, fix_value: contacts whose label names the sheet of their coil where that
    sheet, one of those at hand, has no such coil.

    If the sheet has one coil whose number is one edit away and the contact's number has no coil elsewhere: the coil is misread if other contacts or tables (support: number, n)
    have the contact's number too, else the contact. If exactly one other page has the coil and there is no such near one, the sheet is. sheets: page_id, sheet."""
    c = F.col
    base = sheets.filter("sheet IS NOT NULL").select(c("page_id").alias("target"), T.base_sheet(c("sheet")).alias("base"), c("sheet").alias("target_sheet"))
    base = base.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("target"))).filter("k = 1").drop("k")
    label = T.normalised(F.coalesce("label", F.lit("")))
    named = symbols.filter(c("class_key").isin(*contacts)).select("page_id", "ref", label.alias("label"), first_number(c("label")).alias("number"), F.nullif(F.regexp_extract(T.compact(c("label")), f"({T.SHEET})", 1), F.lit("")).alias("named"))
    has = symbols.filter(c("class_key").isin(*coils)).select(c("page_id").alias("coil_page"), c("ref").alias("coil_ref"), label.alias("coil_label"), first_number(c("label")).alias("coil_number")).filter("coil_number <> ''")
    has = graph.cut_lineage(has)
    asked = named.filter("named IS NOT NULL").withColumn("base", T.base_sheet(c("named"))).join(base, "base")
    where = has.groupBy(c("coil_number").alias("number")).agg(F.collect_set("coil_page").alias("where"))
    asked = asked.join(where, "number", "left").withColumn("where", F.coalesce("where", F.array().cast(where.schema["where"].dataType)))
    wrong = graph.cut_lineage(asked.filter(~F.array_contains("where", c("target"))))
    # Near numbers meet by what is left of them without one character.
    part = lambda n: F.explode(F.array_distinct(F.concat(F.array(n), F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n)))))))
    left = wrong.filter("number <> ''").select("page_id", "ref", "target", "number", part(c("number")).alias("part"))
    right = has.select(c("coil_page").alias("target"), "coil_ref", "coil_label", "coil_number", part(c("coil_number")).alias("part"))
    near = left.join(right, ["target", "part"]).filter(F.levenshtein("number", "coil_number") == 1).select("page_id", "ref", "coil_ref", "coil_label").distinct()
    near = near.groupBy("page_id", "ref").agg(F.count(F.lit(1)).alias("near"), F.min(F.struct("coil_ref", "coil_label")).alias("one"))
    others = named.groupBy("number").agg((F.count(F.lit(1)) - 1).alias("others"))
    more = support.groupBy("number").agg(F.sum("n").alias("more")) if support is not None else others.select("number", F.lit(0).alias("more"))
    rows = wrong.join(near, ["page_id", "ref"], "left").join(others, "number", "left").join(more, "number", "left").withColumn("near", F.coalesce("near", F.lit(0)))
    backed = F.coalesce("others", F.lit(0)) + F.coalesce("more", F.lit(0)) > 0
    lone = (c("near") == 1) & (F.size("where") == 0)
    elsewhere = (F.size("where") == 1) & (c("near") == 0)
    there = sheets.select(c("page_id").alias("other_page"), c("sheet").alias("other_sheet"))
    rows = rows.join(there, F.when(elsewhere, F.get("where", F.lit(0))) == c("other_page"), "left")
    fix = F.when(lone & backed, "coil_label").when(lone, "contact_label").when(elsewhere & c("other_sheet").isNotNull(), "contact_sheet")
    word, coil_word = F.substring_index("label", " ", 1), F.substring_index("one.coil_label", " ", 1)
    swapped = lambda text, old, new: F.concat(new, F.substring(text, F.length(old) + 1, F.length(text)))
    value = F.when(fix == "coil_label", swapped(c("one.coil_label"), coil_word, c("number"))).when(fix == "contact_label", swapped(c("label"), word, coil_word))
    value = value.when(fix == "contact_sheet", F.replace("label", "named", "other_sheet"))
    severity = F.when(fix.isNotNull() | (F.size("where") > 0), "error").otherwise("warning")
    return rows.select("page_id", "ref", severity.alias("severity"), fix.alias("fix"), F.when(fix == "coil_label", c("target")).when(fix.isNotNull(), c("page_id")).alias("fix_page"), F.when(fix == "coil_label", c("one.coil_ref")).when(fix.isNotNull(), c("ref")).alias("fix_ref"), value.alias("fix_value"))
