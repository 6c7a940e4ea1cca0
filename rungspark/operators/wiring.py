"""Paths between terminals, gaps between wires, what feeds what, and the decisions taken from several cues.

Defined results: empty tables give empty results; a null key or coordinate meets nothing; repeated rows count once where
a result names keys; ties go to the lesser key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import detections as D
from . import graph
from . import spatial as P

# The provenance of a device, from sure to doubtful; the worst of its contacts counts.
RELAY, INPUT, MISSING, UNRESOLVED = "RELAY", "INPUT", "MISSING_REFERENCE", "UNRESOLVED"
# Fixed format: a device number (two digits at most and letters, or letters and digits).
DEVICE_SHAPE = r"^(?:\d{1,2}0?[A-Z][A-Z0-9]*(?:-\d{1,2})?|[A-Z]{1,4}\d{0,4}[A-Z]?(?:-\d{1,2})?)$"


def device_sources(contacts: DataFrame, sheets: DataFrame, by: list[str]) -> DataFrame:
    """by, device, source, ref_sheet, contacts: where each device of a contact comes from. contacts: by, device, has_coil, external,
    readable, ref_sheet (null: names none); sheets: by, sheet. ref_sheet is the least that the worst contacts name."""
    known = sheets.select(*by, F.col("sheet").alias("ref_sheet")).distinct().withColumn("known__", F.lit(True))
    rows = contacts.join(known, [*by, "ref_sheet"], "left")
    rank = F.when(F.col("external"), 0).when(~F.col("readable"), 2).when(F.col("ref_sheet").isNull(), 0).when(F.col("known__"), 2).otherwise(1)
    named = F.when(~F.col("external") & F.col("readable"), F.col("ref_sheet"))
    rows = rows.withColumns({"rank__": rank, "named__": named})
    out = rows.groupBy(*by, "device").agg(
        F.max("has_coil").alias("coil__"), F.max("rank__").alias("rank__"),
        *[F.min(F.when(F.col("rank__") == k, F.col("named__"))).alias(f"s{k}__") for k in (1, 2)], F.count(F.lit(1)).alias("contacts"),
    )
    source = F.when(F.col("coil__"), RELAY).when(F.col("rank__") == 0, INPUT).when(F.col("rank__") == 1, MISSING).otherwise(UNRESOLVED)
    sheet = F.when(F.col("coil__"), None).when(F.col("rank__") == 1, F.col("s1__")).when(F.col("rank__") == 2, F.col("s2__"))
    return out.select(*by, "device", source.alias("source"), sheet.alias("ref_sheet"), "contacts")


def table_matches(rows: DataFrame, contacts: DataFrame, by: list[str]) -> DataFrame:
    """by, row_id, contact_id, device_match, unique: one contact for each table row within its window of the grid, same device first,
    then the nearer. rows: by, row_id, device, u, v; contacts: by, contact_id, c_device, cu, cv. unique: the only one of that device there."""
    cells = rows.withColumn("gu", F.explode(F.sequence(F.floor(F.col("u") - 1), F.floor(F.col("u") + 1))))
    placed = contacts.withColumn("gu", F.floor("cu"))
    du, dv = F.abs(F.col("cu") - F.col("u")), F.col("cv") - F.col("v")
    met = P.in_cells(cells, placed, [*by, "gu"]).filter((du <= 1) & dv.between(-0.5, 1.5))
    same = F.coalesce(F.col("device") == F.col("c_device"), F.lit(False))
    met = graph.cut_lineage(met.select(*by, "row_id", "contact_id", same.alias("same"), F.round(F.when(same, 10.0).otherwise(0.0) - du - 0.5 * F.abs(dv - 0.5), 9).alias("score")))
    # Small files of many rows: joins are shuffled, so that none is sent through the driver.
    taken = P.mutual_best(met, by, "row_id", "contact_id", "score").hint("merge").join(met.select(*by, "row_id", "contact_id", "same").hint("merge"), [*by, "row_id", "contact_id"])
    counted = met.groupBy(*by, "row_id").agg(F.count_if("same").alias("n__"))
    out = rows.select(*by, "row_id").hint("merge").join(taken.hint("merge"), [*by, "row_id"], "left").join(counted.hint("merge"), [*by, "row_id"], "left")
    match = F.coalesce("same", F.lit(False))
    return out.select(*by, "row_id", "contact_id", match.alias("device_match"), (match & F.coalesce(F.col("n__") == 1, F.lit(False))).alias("unique"))


def decided(items: DataFrame, cues: DataFrame, by: list[str], strong: list[str], class_col: str = "class_key") -> DataFrame:
    """Items with status `confirmed` if all their cues (by, source, suggests) agree, from two sources or with a strong one, and then with the class they
    suggest; else `review_required` with the class they have."""
    votes = cues.groupBy(*by).agg(
        F.count_distinct("suggests").alias("n__"), F.count_distinct("source").alias("from__"), F.min("suggests").alias("one__"), F.max(F.col("source").isin(*strong)).alias("strong__")
    )
    agreed = F.coalesce(F.col("n__") == 1, F.lit(False))
    sure = agreed & ((F.col("from__") >= 2) | F.col("strong__"))
    out = items.join(votes, by, "left").withColumn("sure__", F.coalesce(sure, F.lit(False)))
    out = out.withColumn(class_col, F.when(F.col("sure__"), F.col("one__")).otherwise(F.col(class_col)))
    return out.withColumn("status", F.when(F.col("sure__"), "confirmed").otherwise("review_required")).drop("n__", "from__", "one__", "strong__", "sure__")


def dot_role(vertical: Column, text_beside_vertical: Column, horizontal: Column, text_beside_horizontal: Column, arms: Column) -> Column:
    """terminal (text on both sides of its wire), junction (three arms or more), review."""
    named = (vertical & text_beside_vertical) | (horizontal & ~vertical & text_beside_horizontal)
    return F.when(named, "terminal").when(arms >= 3, "junction").otherwise("review")


def doubtful(label: Column, token: Column) -> Column:
    """The label is none, starts with a number of three digits or more, or its device token has not the shape of one."""
    first = F.regexp_extract(label, r"^\s*(\S+)", 1)
    return (first == "") | first.rlike(r"^\d{3,}$") | ~F.split_part(token, F.lit("("), F.lit(1)).rlike(DEVICE_SHAPE)


def best_labels(rows: DataFrame, lexicon: DataFrame, crop: str, page: str) -> DataFrame:
    """Adds label: the crop's word, or the page's where the crop's is read less than twice and the page's twice or more. lexicon: token, n."""
    of = lambda c, n: lexicon.select(F.col("token").alias(c), F.col("n").alias(n))
    both = rows.join(of(crop, "cn__"), crop, "left").join(of(page, "pn__"), page, "left")
    swap = (F.coalesce("cn__", F.lit(0)) < 2) & (F.coalesce("pn__", F.lit(0)) >= 2)
    return both.withColumn("label", F.when(swap, F.col(page)).otherwise(F.col(crop))).drop("cn__", "pn__")


def graph_node(node: Column, wire: Column, junction: Column, conducts: Column) -> Column:
    """The node of the wire graph: a junction that does not conduct is one for each wire."""
    return F.when(junction & ~conducts, F.concat(F.lit("node:"), node, F.lit("@"), F.coalesce(wire, F.lit("unknown")))).otherwise(F.concat(F.lit("node:"), node))


def anchored(anchors: DataFrame, nodes: DataFrame, incident: DataFrame) -> DataFrame:
    """record, graph_node: the graph nodes of an anchor's node: one for each incident wire, or the preferred wire's only.
    anchors: record, node, preferred (null: all); nodes: node, junction, conducts; incident: node, wire."""
    wires = anchors.join(nodes, "node", "left").join(incident.select("node", "wire").distinct(), "node", "left")
    wires = wires.withColumn("wire", F.coalesce("preferred", "wire"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return wires.select("record", graph_node(F.col("node").cast("string"), F.col("wire").cast("string"), flag("junction"), flag("conducts")).alias("graph_node")).distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, through: DataFrame, most: int) -> DataFrame:
    """left, right, path: a shortest path of at most `most` edges (a, b, both ways) whose inner nodes are of `through`, of several the
    least. Pairs without one are left out. Each round is a join; a pair's search ends with its path."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    inner = through.select(F.col(through.columns[0]).alias("at")).distinct()
    front = graph.cut_lineage(pairs.select("left", "right").distinct().filter(F.col("left") != F.col("right")).withColumn("at", F.col("left")).withColumn("path", F.array("left")))
    seen, found = front.drop("path"), front.limit(0)
    for _ in range(most):
        grown = front.join(both, F.col("at") == F.col("a")).select("left", "right", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
        step = graph.cut_lineage(grown.join(seen, ["left", "right", "at"], "left_anti").groupBy("left", "right", "at").agg(F.min("path").alias("path")))
        if step.isEmpty():
            break
        hit = step.filter(F.col("at") == F.col("right"))
        found, seen = found.unionByName(hit), seen.unionByName(step.drop("path"))
        front = step.join(hit.select("left", "right"), ["left", "right"], "left_anti").join(inner, "at", "left_semi")
    return found.select("left", "right", "path")


def open_ends(edges: DataFrame, starts: DataFrame, ends: DataFrame, buses: DataFrame) -> DataFrame:
    """start, end: the open ends joined to each start without crossing a bus. starts, ends, buses: node."""
    bus = buses.select("node").distinct()
    free = edges.join(bus.withColumnRenamed("node", "a"), "a", "left_anti").join(bus.withColumnRenamed("node", "b"), "b", "left_anti")
    nets = graph.connected_components(free)
    of = lambda df, name: df.join(bus, "node", "left_anti").distinct().join(nets, "node", "left").select(F.col("node").alias(name), F.coalesce("component", "node").alias("net"))
    return of(starts.select("node"), "start").join(of(ends.select("node"), "end"), "net").select("start", "end")


def explained(literals: DataFrame, roots: DataFrame, depth: int = 12) -> DataFrame:
    """root, load, depth, device, kind: what the loads that a root depends on ask for. literals: load, device; a device that is a load is a
    relay (explained at its least depth, `seen` elsewhere, `limit` where it would be too deep), any other an input."""
    lits = graph.cut_lineage(literals.select("load", "device").distinct())
    relays = lits.select(F.col("load").alias("device")).distinct()
    links = lits.join(relays, "device", "left_semi").select(F.col("load").alias("src"), F.col("device").alias("dst"))
    at = graph.cut_lineage(graph.reach(links, roots, depth).select(F.col("start").alias("root"), F.col("node").alias("load"), "depth"))
    rows = at.join(lits, "load").join(relays.withColumn("relay__", F.lit(True)), "device", "left")
    deeper = at.select("root", F.col("load").alias("device"), F.col("depth").alias("next__"))
    rows = rows.join(deeper, ["root", "device"], "left")
    kind = F.when(F.col("relay__").isNull(), "input").when(F.col("next__").isNull(), "limit").when(F.col("next__") == F.col("depth") + 1, "relay").otherwise("seen")
    return rows.select("root", "load", "depth", "device", kind.alias("kind"))


def effects(literals: DataFrame, starts: DataFrame, depth: int = 20) -> DataFrame:
    """start, target, depth, via, role: the loads a device can affect, through the relays it affects; must if `via` (the least one of the step
    before) is in all branches of the target, else partial. literals: load, branch, device."""
    lits = graph.cut_lineage(literals.select("load", "branch", "device").distinct())
    size = lits.groupBy("load").agg(F.count_distinct("branch").alias("n__"))
    hits = graph.cut_lineage(lits.groupBy("load", "device").agg(F.count(F.lit(1)).alias("hits__")).join(size, "load"))
    links = hits.select(F.col("device").alias("src"), F.col("load").alias("dst"))
    at = graph.cut_lineage(graph.reach(links, starts, depth))
    before = at.select("start", F.col("node").alias("via"), (F.col("depth") + 1).alias("depth"))
    met = at.filter("depth > 0").join(hits.select(F.col("load").alias("node"), F.col("device").alias("via"), (F.col("hits__") == F.col("n__")).alias("all__")), "node")
    met = met.join(before, ["start", "via", "depth"]).groupBy("start", F.col("node").alias("target"), "depth").agg(F.min(F.struct("via", "all__")).alias("m"))
    return met.select("start", "target", "depth", "m.via", F.when(F.col("m.all__"), "must").otherwise("partial").alias("role"))


def terminal_records(terminals: DataFrame, links: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each link of a terminal, numbered, or one without a link."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return terminals.join(links, by, "left").withColumn("link_index", nth)


def next_ahead(dots: DataFrame, by: list[str], align: float, reach: float) -> DataFrame:
    """by, dot_id, direction, other_id, gap: the nearest aligned dot to the left, right, up and down (dot_id, x, y)."""
    size = F.lit(max(reach, align))
    cell = lambda c: F.floor(F.col(c) / size)
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    here = dots.select(*by, "dot_id", "x", "y").withColumn("gx", near("x")).withColumn("gy", near("y"))
    there = dots.select(*by, F.col("dot_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("gx"), cell("y").alias("gy"))
    dx, dy = F.col("ox") - F.col("x"), F.col("oy") - F.col("y")
    along = lambda d, off, plus, minus: F.when((F.abs(off) <= align) & (d != 0) & (F.abs(d) <= reach), F.struct(F.when(d > 0, plus).otherwise(minus).alias("direction"), F.abs(d).alias("gap")))
    met = P.in_cells(here, there, [*by, "gx", "gy"]).filter("dot_id <> other_id").withColumn("way", F.explode(F.array(along(dx, dy, "right", "left"), along(dy, dx, "down", "up")))).filter("way IS NOT NULL")
    best = met.groupBy(*by, "dot_id", F.col("way.direction").alias("direction")).agg(F.min(F.struct("way.gap", "other_id")).alias("b"))
    return best.select(*by, "dot_id", "direction", "b.other_id", "b.gap")


def collinear_bridges(terminals: DataFrame, wires: DataFrame, by: list[str], align: float = 28, gap: float = 240) -> DataFrame:
    """by, terminal_id, wire_id, cost, inside: each terminal's horizontal wire (y, x0 <= x1) of the least gap + 2 * offset; inside: it meets the
    wire between its ends. Turn the axes for vertical wires. terminals: by, terminal_id, px, py."""
    # Where many wires lie at one height, those of little cost are looked for first: what costs at most `reach` lies within that along and half of it across.
    most, wires, parts = gap + 2 * align, graph.cut_lineage(wires.select(*by, "wire_id", "x0", "x1", "y")), []
    left = terminals.select(*by, "terminal_id", "px", "py")
    reach = P.first_reach(wires, by, ("y", "y"), (1.0, 1.0), most, 4 * P.CROWD)
    while reach < most:
        found = graph.cut_lineage(_bridges(left, wires, by, min(align, reach / 2), min(gap, reach), gap, reach))
        parts.append(found)
        left = graph.cut_lineage(left.join(found.select(*by, "terminal_id"), [*by, "terminal_id"], "left_anti"))
        reach *= 3
    out = _bridges(left, wires, by, align, gap, gap, most)
    for found in parts:
        out = out.unionByName(found)
    return out


def _bridges(terminals: DataFrame, wires: DataFrame, by: list[str], align: float, gap: float, wide: float, reach: float) -> DataFrame:
    """The best bridges of a cost of at most `reach`; cells are `wide` along the wires, twice `align` across."""
    keys, high = [*by, "gx", "gy"], 2 * align
    x, y = (lambda c: F.explode(P._cells(F.col("x0") - gap, F.col("x1") + gap, c))), (lambda c: F.explode(P._cells(F.col("y") - align, F.col("y") + align, c)))
    laid = wires.withColumn("gx", x(wide)).withColumn("gy", y(high))
    placed = terminals.withColumn("gx", F.floor(F.col("px") / wide)).withColumn("gy", F.floor(F.col("py") / high))
    away, off = F.greatest(F.col("x0") - F.col("px"), F.col("px") - F.col("x1"), F.lit(0.0)), F.abs(F.col("py") - F.col("y"))
    cost = F.col("away") + 2 * F.col("off")
    met = P.in_cells(P.spread(placed, keys), P.spread(laid, keys), keys).withColumns({"away": away, "off": off}).filter((F.col("off") <= align) & (F.col("away") <= gap) & (cost <= reach))
    best = F.min(F.struct(cost.alias("cost"), "wire_id", (F.col("away") == 0).alias("inside"))).alias("b")
    return met.groupBy(*by, "terminal_id").agg(best).select(*by, "terminal_id", "b.wire_id", "b.cost", "b.inside")


def words_near(boxes: DataFrame, texts: DataFrame, by: list[str], margin: float, words: str) -> DataFrame:
    """by, box_id, n_texts, has_word: texts (tx, ty, word) around each box (x0, y0, x1, y1) but not in it, and whether one matches the pattern `words`."""
    size = 4 * margin
    spread = P.gridded(boxes, F.col("x0") - margin, F.col("x1") + margin, F.col("y0") - margin, F.col("y1") + margin, size)
    placed = texts.select(*by, "tx", "ty", "word", F.floor(F.col("tx") / size).alias("gx"), F.floor(F.col("ty") / size).alias("gy"))
    within = lambda m: F.col("tx").between(F.col("x0") - m, F.col("x1") + m) & F.col("ty").between(F.col("y0") - m, F.col("y1") + m)
    met = P.in_cells(spread, placed, [*by, "gx", "gy"]).filter(within(margin) & ~within(0.0) & (F.col("word") != ""))
    found = met.groupBy(*by, "box_id").agg(F.count_distinct("word").alias("n_texts"), F.max(F.col("word").rlike(words)).alias("has_word"))
    out = boxes.select(*by, "box_id").join(found, [*by, "box_id"], "left")
    return out.withColumns({"n_texts": F.coalesce("n_texts", F.lit(0)), "has_word": F.coalesce("has_word", F.lit(False))})


def with_template(attributes: Column, template: list[str]) -> Column:
    """A map that has every key of the template, null where the attributes have none."""
    blank = F.create_map(*[x for k in template for x in (F.lit(k), F.lit(None).cast("string"))])
    own = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(blank, lambda k, v: ~F.map_contains_key(own, k)), own)


def evidence(rows: DataFrame, by: list[str], item: str, n: int) -> DataFrame:
    """by, total, items: how many different items there are, and the first n; ranked before they are gathered."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(item))
    ranked = rows.select(*by, item).filter(F.col(item).isNotNull()).distinct().withColumn("nth__", nth)
    return ranked.groupBy(*by).agg(F.count(item).alias("total"), F.array_sort(F.collect_list(F.when(F.col("nth__") <= n, F.col(item)))).alias("items"))


def accepted_dots(dots: DataFrame, by: list[str], sure: float, least: float, same: float) -> DataFrame:
    """Dots (dot_id, x, y, score, arms) of score >= sure, and those from `least` on with three arms: the sure ones first, then by score, each
    drops others within `same` of it."""
    rows = dots.filter((F.col("score") >= sure) | ((F.col("score") >= least) & (F.col("arms") >= 3)))
    rank = F.struct((F.col("score") < sure).alias("p"), (-F.col("score")).alias("s"), F.col("dot_id").alias("k"))
    own = rows.select(*by, "dot_id", "x", "y", rank.alias("rank"), F.floor(F.col("x") / same).alias("gx"), F.floor(F.col("y") / same).alias("gy"))
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    other = own.select(*by, F.col("dot_id").alias("worse"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("rank").alias("lower"), near("gx").alias("gx"), "gy")
    other = other.withColumn("gy", near("gy"))
    apart = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
    pairs = P.in_cells(own, other, [*by, "gx", "gy"]).filter((F.col("rank") < F.col("lower")) & (apart <= same * same))
    return D.left_over(rows, by, "dot_id", graph.cut_lineage(pairs.select(*by, F.col("dot_id").alias("better"), "worse").distinct()))


def perpendicular_bridges(ends: DataFrame, wires: DataFrame, terminals: DataFrame, by: list[str], most: float = 80, free: float = 60, near: float = 18) -> DataFrame:
    """by, end_id, wire_id, gap: the vertical wire (x, y0 <= y1) that a horizontal wire's end (x, y, way: 1 to the right, -1 to the left, true_end) points
    at, at least gap in (1, most]; one beyond needs a terminal (tx, ty) within `near` of the point it would meet, or a true end and gap <= free."""
    # Where many wires lie side by side, those of a small gap are looked for first; only ends that none of them takes go on.
    ends, wires, parts = graph.cut_lineage(ends.select(*by, "end_id", "ex", "ey", "way", "true_end")), graph.cut_lineage(wires.select(*by, "wire_id", "x", "y0", "y1")), []
    stops = graph.cut_lineage(terminals.select(*by, "tx", "ty").distinct())
    reach, least = 1.0 + P.first_reach(wires, by, ("x", "x"), (1.0, 1.0), most, 4 * P.CROWD), 1.0
    while reach < most:
        found = graph.cut_lineage(_perpendicular(ends, wires, stops, by, least, reach, free, near))
        parts.append(found)
        ends, least, reach = graph.cut_lineage(ends.hint("merge").join(found.select(*by, "end_id").hint("merge"), [*by, "end_id"], "left_anti")), reach, reach * 3
    out = _perpendicular(ends, wires, stops, by, least, most, free, near)
    for found in parts:
        out = out.unionByName(found)
    return out


def _perpendicular(ends: DataFrame, wires: DataFrame, stops: DataFrame, by: list[str], least: float, most: float, free: float, near: float) -> DataFrame:
    """The bridges of perpendicular_bridges() of a gap in (least, most]."""
    c, tall = F.col, 80.0
    # An end looks only the way it points.
    from_x, to_x = c("ex") + c("way") * least, c("ex") + c("way") * most
    reach = ends.withColumn("gx", F.explode(P._cells(F.least(from_x, to_x), F.greatest(from_x, to_x), most))).withColumn("gy", F.floor(c("ey") / tall))
    slack, keys = (c("y1") - c("y0")) * 0.02, [*by, "gx", "gy"]
    spread = wires.withColumn("gx", F.floor(c("x") / most)).withColumn("gy", F.explode(P._cells(c("y0") - slack, c("y1") + slack, tall)))
    met = P.in_cells(P.spread(reach, keys), P.spread(spread, keys), keys).withColumn("gap", (c("x") - c("ex")) * c("way"))
    met = met.filter((c("gap") > least) & (c("gap") <= most) & c("ey").between(c("y0") - slack, c("y1") + slack))
    met = graph.cut_lineage(met.select(*by, "end_id", "wire_id", "gap", "true_end", c("x").alias("px"), c("ey").alias("py")))
    # A place is left at the first terminal that holds it: no pairs are made.
    around = lambda p: F.explode(F.sequence(F.floor(c(p) / near) - 1, F.floor(c(p) / near) + 1))
    cell = [*by, "hx", "hy"]
    places = met.select(*by, "px", "py").distinct().withColumn("hx", around("px")).withColumn("hy", around("py"))
    posts = stops.select(*[c(k).alias(f"{k}__") for k in by], "tx", "ty", F.floor(c("tx") / near).alias("hx__"), F.floor(c("ty") / near).alias("hy__"))
    same = (c("tx") - c("px")) ** 2 + (c("ty") - c("py")) ** 2 <= near * near
    for k in cell:
        same = same & (c(k) == c(f"{k}__"))
    held = P.spread(places, cell).hint("merge").join(P.spread(posts, [f"{k}__" for k in cell]).hint("merge"), same, "left_semi").select(*by, "px", "py").distinct().withColumn("held", F.lit(True))
    met = met.hint("merge").join(held.hint("merge"), [*by, "px", "py"], "left").filter(c("held").isNotNull() | (c("true_end") & (c("gap") <= free)))
    return met.groupBy(*by, "end_id").agg(F.min(F.struct("gap", "wire_id")).alias("b")).select(*by, "end_id", "b.wire_id", "b.gap")


def terminal_links(terminals: DataFrame, wires: DataFrame, nodes: DataFrame, by: list[str], wire_within: float = 10, node_within: float = 28) -> DataFrame:
    """by, point_id, wire_id, node_id: a terminal's wire (its hint, or the nearest one close enough), else its nearest node.
    terminals: by, point_id, px, py, hint; wires: by, segment_id, x0, y0, x1, y1; nodes: by, node_id, tx, ty."""
    wire = D.nearest_segment(terminals.filter("hint IS NULL"), wires, by, wire_within).select(*by, "point_id", F.col("segment_id").alias("near__"))
    out = terminals.join(wire, [*by, "point_id"], "left").withColumn("wire_id", F.coalesce("hint", "near__"))
    node = P.nearest(out.filter("wire_id IS NULL"), nodes, by, node_within, "point_id", "node_id").select(*by, "point_id", "node_id")
    return out.join(node, [*by, "point_id"], "left").select(*by, "point_id", "wire_id", "node_id")


def peer_stops(records: DataFrame, stops: DataFrame, by: list[str]) -> DataFrame:
    """by, record, stop: the first stop of the symbol that a record names as its peer. records: by, record, peer; stops: by, symbol, stop."""
    first = stops.groupBy(*by, F.col("symbol").alias("peer")).agg(F.min("stop").alias("stop"))
    return records.join(first, [*by, "peer"]).select(*by, "record", "stop")


def merged_terminals(own: DataFrame, found: DataFrame, by: list[str], name: str) -> DataFrame:
    """Own terminals and, of found ones, those of names that their symbol (by) lacks; origin tells which."""
    new = found.join(own.select(*by, name).distinct(), [*by, name], "left_anti").dropDuplicates([*by, name])
    return own.withColumn("origin", F.lit("own")).unionByName(new.withColumn("origin", F.lit("found")), allowMissingColumns=True)


def reconciled(listed: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_listed, n_stored, status: how often each key occurs in two sources, and whether one lacks it (missing: not stored, extra: not listed)."""
    of = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = of(listed, "n_listed").join(of(stored, "n_stored"), keys, "full").na.fill(0, ["n_listed", "n_stored"])
    status = F.when(F.col("n_stored") == 0, "missing").when(F.col("n_listed") == 0, "extra").when(F.col("n_listed") != F.col("n_stored"), "differs").otherwise("same")
    return both.withColumn("status", status)


def grid_positions(points: DataFrame, grids: DataFrame, by: list[str]) -> DataFrame:
    """Points (by, x, y) with their column u and row v in the drawing's grid, both fractional; points of pages without a grid are left out.
    grids: by, col_at, col_step (x of column 0, width of one), sides: one or two structs (x, at, step) of the rows as written down the
    left and the right; between two sides the rows' place and height change in proportion, beyond them they stay."""
    c = F.col
    both = points.join(grids, by).withColumn("s__", F.array_sort("sides"))
    part = lambda i, k: F.get(F.col("s__"), F.lit(i))[k]
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(c("x") - part(0, "x"), part(1, "x") - part(0, "x")), F.lit(0.0))))
    at = lambda k: part(0, k) + share * (F.coalesce(part(1, k), part(0, k)) - part(0, k))
    out = both.withColumns({"u": F.try_divide(c("x") - c("col_at"), c("col_step")), "v": F.try_divide(c("y") - at("at"), at("step"))})
    return out.select(*points.columns, "u", "v")
