"""Detected boxes on pages: acceptance, suppression, matching by class, and preparation of training boxes. Boxes are cx, cy, w, h.

Defined results: empty tables give empty results; rows with a null coordinate meet nothing and are kept where the rule only drops what it meets;
equal scores go by the key; repeated rows of one key count as rows.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import spatial as P
from .graph import cut_lineage

BOX = ("cx", "cy", "w", "h")
MOST_CELLS = 64  # over which a segment of common length is spread along an axis


def size_kind(w: Column, h: Column, area: float = 0.04, side: float = 0.40) -> Column:
    """`region` for large boxes, else `symbol`."""
    return F.when((w * h >= area) | (F.greatest(w, h) >= side), "region").otherwise("symbol")


def confident(df: DataFrame, least: float, floors: dict[str, float], exempt: list[str], class_col: str = "class_key", score: str = "confidence") -> DataFrame:
    """Rows at least as sure as their class asks; exempt classes stay, they are chosen later."""
    floor = F.lit(least)
    for name, value in floors.items():
        floor = F.when(F.col(class_col) == name, value).otherwise(floor)
    return df.filter(F.col(class_col).isin(*exempt) | (F.col(score) >= floor))


def overridden(main: DataFrame, other: DataFrame, classes: list[str], class_col: str = "class_key") -> DataFrame:
    """Listed classes come from the other source, the rest from the main one."""
    listed = F.col(class_col).isin(*classes)
    return main.filter(~listed).unionByName(other.filter(listed))


def skip_reasons(df: DataFrame, known: DataFrame, class_col: str = "class_key") -> DataFrame:
    """Adds reason: why a detection is passed over (suppressed, in the text zone, of an unknown class), null if it is taken. Flags: suppressed, text_zone."""
    joined = df.join(known.select(F.col(class_col).alias("k__")).distinct(), F.col(class_col) == F.col("k__"), "left")
    reason = F.when(F.coalesce("suppressed", F.lit(False)), "suppressed").when(F.coalesce("text_zone", F.lit(False)), "text zone").when(F.col("k__").isNull(), "unknown class")
    return joined.withColumn("reason", reason).drop("k__")


def overlap_of_smaller(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over the smaller area."""
    side = lambda c1, s1, c2, s2: F.greatest(F.least(c1 + s1 / 2, c2 + s2 / 2) - F.greatest(c1 - s1 / 2, c2 - s2 / 2), F.lit(0.0))
    return F.coalesce(F.try_divide(side(a[0], a[2], b[0], b[2]) * side(a[1], a[3], b[1], b[3]), F.least(a[2] * a[3], b[2] * b[3])), F.lit(0.0))


def suppressed(df: DataFrame, by: list[str], key: str, score: str, cell: float, iou: float, share: float) -> DataFrame:
    """The boxes left when, from the surest on, each drops what overlaps it by IoU >= iou or by share of the smaller area.

    A page's boxes are ranked in Spark and go by in that order: each is held against the kept ones of its cells only, which hardly overlap and so
    stay few; no pairs are stored.
    """
    numbers = [f"{b}__" for b in BOX]
    ranked = df.select(*by, key, score, *[F.col(b).cast("double").alias(n) for b, n in zip(BOX, numbers)]).withColumn("n__", F.row_number().over(Window.partitionBy(*by).orderBy((-F.col(score)).asc_nulls_first(), key)))
    rows = ranked.select(*by, key, "n__", *numbers)

    def fold(page: pa.Table) -> pa.Table:
        page = page.sort_by("n__")
        stays, kept, keys = [], {}, page[key].to_pylist()
        for k, box in zip(keys, zip(*(page[n].to_pylist() for n in numbers))):
            if None in box or any(v != v for v in box):
                stays.append(True)  # meets nothing
                continue
            cx, cy, w, h = box
            x0, x1, y0, y1, area = cx - w / 2, cx + w / 2, cy - h / 2, cy + h / 2, w * h
            cells = [(i, j) for i in range(math.floor(x0 / cell), math.floor(x1 / cell) + 1) for j in range(math.floor(y0 / cell), math.floor(y1 / cell) + 1)]

            def drops(other: tuple) -> bool:
                both = max(min(other[1], x1) - max(other[0], x0), 0.0) * max(min(other[3], y1) - max(other[2], y0), 0.0)
                union = other[4] + area - both
                if other[5] == k or union <= 0 or both / union < 1e-12:
                    return False
                return both / union >= iou or (min(other[4], area) > 0 and both / min(other[4], area) >= share)

            stay = not any(drops(o) for at in cells for o in kept.get(at, ()))
            stays.append(stay)
            if stay:
                for at in cells:
                    kept.setdefault(at, []).append((x0, x1, y0, y1, area, k))
        # A key of several rows goes with all of them.
        gone = {k for k, s in zip(keys, stays) if not s}
        lost = sorted(gone)
        return pa.table({**{b: pa.array([page[b][0].as_py()] * len(lost), page.schema.field(b).type) for b in by}, key: pa.array(lost, page.schema.field(key).type)})

    gone = rows.groupBy(*by).applyInArrow(fold, rows.select(*by, key).schema)
    return df.join(gone, [*by, key], "left_anti")


def left_over(df: DataFrame, by: list[str], key: str, pairs: DataFrame) -> DataFrame:
    """The rows left when each, from the best on, drops those it is `better` than in pairs (by, better, worse), unless it was dropped itself."""
    gone = None
    while not pairs.isEmpty():
        top = pairs.select(*by, "better").distinct().join(pairs.select(*by, F.col("worse").alias("better")).distinct(), [*by, "better"], "left_anti")
        fell = cut_lineage(pairs.join(top, [*by, "better"], "left_semi").select(*by, F.col("worse").alias(key)).distinct())
        gone = fell if gone is None else gone.unionByName(fell)
        lost = fell.withColumnRenamed(key, "worse")
        pairs = pairs.join(lost, [*by, "worse"], "left_anti").join(lost.withColumnRenamed("worse", "better"), [*by, "better"], "left_anti")
        pairs = cut_lineage(pairs)
    return df if gone is None else df.join(gone, [*by, key], "left_anti")


def without_covered(df: DataFrame, by: list[str], key: str, covers: DataFrame, most: float, cell: float, only: Column) -> DataFrame:
    """Drops boxes (of those that `only` marks) of which some cover takes at least the share `most`."""
    of = lambda s: tuple(F.col(f"{s}.{c}") for c in BOX)
    a, b = of("l"), of("r")
    side = lambda i: F.greatest(F.least(a[i] + a[i + 2] / 2, b[i] + b[i + 2] / 2) - F.greatest(a[i] - a[i + 2] / 2, b[i] - b[i + 2] / 2), F.lit(0.0))
    share = F.try_divide(side(0) * side(1), a[2] * a[3])
    met = P.box_overlaps(df.filter(only), covers, by, 1e-12, cell).withColumn("share", share)
    hit = met.groupBy(*by, F.col(f"l.{key}").alias(key)).agg(F.max("share").alias("share")).filter(F.col("share") >= most)
    return df.join(hit.select(*by, key), [*by, key], "left_anti")


def likeness(a: tuple[Column, ...], b: tuple[Column, ...], dots: Column, match: float, reach: float) -> Column:
    """How alike two boxes are: IoU; for dots falling from 1 with the distance of the centres, to `match` at `reach`, 0 beyond."""
    d = F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)
    return F.when(dots, F.when(d <= reach, 1 - (1 - match) * d / reach).otherwise(F.lit(0.0))).otherwise(G.iou(a, b))


def alike(boxes: DataFrame, by: list[str], key: str, dot: Column, match: float, reach: float, cell: float) -> DataFrame:
    """by, l, r (l < r), s: overlapping boxes of a page with a likeness() of at least `match`; a pair with a dot in it counts as dots. Pairs of dots are looked for around
    the dots, the others by their IoU; what is not alike is hardly met."""
    rows = boxes.select(*by, key, *BOX, F.coalesce(dot, F.lit(False)).alias("dot__"))
    a, b = (tuple(F.col(f"{s}.{x}") for x in BOX) for s in "lr")
    plain = rows.filter("NOT dot__")
    met = P.box_overlaps(plain, plain, by, match, cell).filter(F.col(f"l.{key}") < F.col(f"r.{key}"))
    met = met.select(*by, F.col(f"l.{key}").alias("l"), F.col(f"r.{key}").alias("r"), F.col("iou").alias("s"))

    keys = [*by, "gx", "gy"]
    x, y = F.col("cx"), F.col("cy")
    wide = reach * (1 + 1e-9) + (F.abs(x) + F.abs(y)) * 1e-9
    dots = P.gridded(rows.filter("dot__"), x - wide, x + wide, y - wide, y + wide, reach).select(*keys, F.struct(key, *BOX).alias("l"))
    others = rows.select(*keys[:-2], F.floor(x / reach).alias("gx"), F.floor(y / reach).alias("gy"), F.struct(key, *BOX, "dot__").alias("r"))
    one, other = F.col(f"l.{key}"), F.col(f"r.{key}")
    once = (one < other) | (~F.col("r.dot__") & (one != other))
    near = P.in_cells(P.spread(dots, keys), P.spread(others, keys), keys).filter(once & (G.iou(a, b) >= 1e-12))
    near = near.select(*by, F.least(one, other).alias("l"), F.greatest(one, other).alias("r"), likeness(a, b, F.lit(True), match, reach).alias("s"))
    return met.unionByName(near).filter(F.col("s") >= match)


def remapped(df: DataFrame, classes: DataFrame, keep: list[str], class_col: str = "class_key", strict: bool = False) -> DataFrame:
    """Boxes of kept classes, renamed by a table (class_key, target; no target: as it is), with dense new numbers in the order of `keep`. strict: a class that
    is in the table, or has no place there, is passed over only if it is known; one that is neither in the table nor kept is an error."""
    target = F.coalesce("target", F.col(class_col))
    joined = df.join(classes.select(F.col("class_key").alias("k__"), "target"), F.col(class_col) == F.col("k__"), "left").withColumn(class_col, target)
    number = F.array_position(F.array(*[F.lit(k) for k in keep]), F.col(class_col)).cast("int") - 1
    if strict:
        unknown = F.col("k__").isNull() & (number < 0)
        number = F.when(unknown, F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(class_col), F.lit("null")))).cast("int")).otherwise(number)
    return joined.withColumn("class_id", number).filter("class_id >= 0").drop("k__", "target")


def cropped(df: DataFrame, windows: DataFrame, by: list[str], least_visible: float = 0.7) -> DataFrame:
    """Boxes (pixels) cut to each window of their page and given in its units. A box stays if its centre is inside or enough of it is visible.
    windows: by, window, left, top, width, height."""
    c = F.col
    rows = df.join(windows, by)
    x0, x1 = F.greatest(c("cx") - c("w") / 2, c("left")), F.least(c("cx") + c("w") / 2, c("left") + c("width"))
    y0, y1 = F.greatest(c("cy") - c("h") / 2, c("top")), F.least(c("cy") + c("h") / 2, c("top") + c("height"))
    visible = (x1 - x0) * (y1 - y0) / F.greatest(c("w") * c("h"), F.lit(1.0))
    inside = c("cx").between(c("left"), c("left") + c("width")) & c("cy").between(c("top"), c("top") + c("height"))
    rows = rows.filter((x1 > x0) & (y1 > y0) & (inside | (visible >= least_visible)))
    box = {"cx": ((x0 + x1) / 2 - c("left")) / c("width"), "cy": ((y0 + y1) / 2 - c("top")) / c("height"), "w": (x1 - x0) / c("width"), "h": (y1 - y0) / c("height")}
    return rows.withColumns(box).drop("left", "top", "width", "height")


def transformed(df: DataFrame, m: list[list[float]]) -> DataFrame:
    """Boxes after an affine map (two rows of three numbers): the upright box around the four corners, cut to the unit square."""
    corners = [(F.col("cx") + sx * F.col("w") / 2, F.col("cy") + sy * F.col("h") / 2) for sx in (-1, 1) for sy in (-1, 1)]
    xs, ys = ([m[i][0] * x + m[i][1] * y + m[i][2] for x, y in corners] for i in (0, 1))
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    x0, x1, y0, y1 = unit(F.least(*xs)), unit(F.greatest(*xs)), unit(F.least(*ys)), unit(F.greatest(*ys))
    out = df.withColumns({"x0__": x0, "x1__": x1, "y0__": y0, "y1__": y1})
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    out = out.withColumns({"cx": mid("x0__", "x1__"), "cy": mid("y0__", "y1__"), "w": F.col("x1__") - F.col("x0__"), "h": F.col("y1__") - F.col("y0__")})
    return out.drop("x0__", "x1__", "y0__", "y1__").filter("w > 0 AND h > 0")


def histogram(df: DataFrame, classes: DataFrame, class_col: str = "class_key") -> DataFrame:
    """class_key, n, pages: also of classes without boxes. classes: class_key."""
    n = df.groupBy(F.col(class_col).alias("k__")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return classes.select(F.col("class_key").alias(class_col)).join(n, F.col(class_col) == F.col("k__"), "left").select(class_col, zero("n"), zero("pages"))


def accepted_lines(df: DataFrame, least: float = 45, thick: float = 32, aspect: float = 8) -> DataFrame:
    """Line candidates (length, thickness) that are long, thin and slender enough."""
    return df.filter((F.col("length") >= least) & (F.col("thickness") <= thick) & (F.col("length") >= aspect * F.greatest("thickness", F.lit(1.0))))


def nearest_labels(points: DataFrame, labels: DataFrame, by: list[str], within: float, n: int = 8) -> DataFrame:
    """by, point_id, label_id, distance, nth: the n nearest labels of each point, the surer first of equally near ones.
    points: by, point_id, px, py; labels: by, label_id, tx, ty, confidence."""
    labels = cut_lineage(labels.select(*by, "label_id", "tx", "ty", "confidence"))
    left, parts = points.select(*by, "point_id", "px", "py"), []
    reach = P.first_reach(labels, by, ("tx", "ty"), (1.0, 1.0), within, 2.0 * n)
    order = Window.partitionBy(*by, "point_id").orderBy("distance", F.desc("confidence"), "label_id")

    def found(reach: float) -> DataFrame:
        nth = P.near_pairs(left, labels, by, reach).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)
        return nth.select(*by, "point_id", "label_id", "distance", "nth")

    # Points look nearby first; those that find n labels there need not look farther.
    while reach < within:
        done = cut_lineage(found(reach).withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy(*by, "point_id"))).filter(F.col("n__") == n).drop("n__"))
        parts.append(done)
        left = cut_lineage(left.join(done.filter("nth = 1").select(*by, "point_id"), [*by, "point_id"], "left_anti"))
        reach *= 3
    return reduce(DataFrame.unionByName, parts, found(within))


def candidate_connections(edges: DataFrame, labelled: DataFrame, by: list[str]) -> DataFrame:
    """Edges (by, a, b, confidence) with kind and the confidence raised if both ends have labels, lowered if not. labelled: by, node."""
    of = lambda s: labelled.select(*by, F.col("node").alias(s)).distinct().withColumn(f"{s}__", F.lit(True))
    rows = edges.join(of("a"), [*by, "a"], "left").join(of("b"), [*by, "b"], "left")
    both = F.col("a__").isNotNull() & F.col("b__").isNotNull()
    sure = F.coalesce("confidence", F.lit(0.4))
    return rows.select(
        *by, "a", "b", F.when(both, "candidate_connection").otherwise("geometry_edge").alias("kind"),
        F.round(F.when(both, F.least(F.lit(0.98), sure + 0.08)).otherwise(F.greatest(F.lit(0.25), sure - 0.18)), 3).alias("confidence"),
    )


def twins(df: DataFrame, by: list[str], key: str, class_col: str, cell: float) -> DataFrame:
    """by, a, b: boxes of one class whose centre lies within half a size of the other's."""
    met = P.box_overlaps(df, df, [*by, class_col], 1e-12, cell).filter(F.col(f"l.{key}") < F.col(f"r.{key}"))
    near = lambda s, w: F.abs(F.col(f"l.{s}") - F.col(f"r.{s}")) <= F.greatest(F.col(f"l.{w}"), F.col(f"r.{w}")) / 2
    return met.filter(near("cx", "w") & near("cy", "h")).select(*by, F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))


def nearest_segment(points: DataFrame, segments: DataFrame, by: list[str], within: float) -> DataFrame:
    """by, point_id, segment_id, distance: each point's nearest segment (x0, y0, x1, y1), ties to the lesser id."""
    c = F.col
    ends = (c("x0"), c("y0"), c("x1"), c("y1"))
    segments = cut_lineage(segments.select(*by, "segment_id", "x0", "y0", "x1", "y1"))
    left, parts = points.select(*by, "point_id", "px", "py").distinct(), []
    # Points look nearby first. A finer grid meets fewer segments but spreads each over more cells: about the square root of their number, at most MOST_CELLS.
    crowd = segments.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.max(F.greatest("x0", "x1")) - F.min(F.least("x0", "x1")), F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1")), F.avg(F.greatest(F.abs(c("x1") - c("x0")), F.abs(c("y1") - c("y0")))))
    size = crowd.toDF(*by, "n", "w", "h", "long").agg(F.min(F.greatest(F.greatest("w", "h") / (2 * F.sqrt("n")), c("long") / MOST_CELLS))).first()[0]
    reach = min(within, size / 4) if size else within

    def found(reach: float) -> DataFrame:
        spread, placed = P.segment_cells(segments, *ends, reach, 4 * reach), left.withColumn("gx", F.floor(c("px") / (4 * reach))).withColumn("gy", F.floor(c("py") / (4 * reach)))
        met = P.in_cells(placed, spread, [*by, "gx", "gy"]).withColumn("distance", G.to_segment(c("px"), c("py"), *ends)).filter(c("distance") <= reach)
        return met.groupBy(*by, "point_id").agg(F.min(F.struct("distance", "segment_id")).alias("b")).select(*by, "point_id", "b.segment_id", "b.distance")

    while reach < within:
        done = cut_lineage(found(reach))
        parts.append(done)
        left = cut_lineage(left.join(done.select(*by, "point_id"), [*by, "point_id"], "left_anti"))
        reach *= 3
    return reduce(DataFrame.unionByName, parts, found(within))


def adjacent_on_longer_axis(terminals: DataFrame, by: list[str], key: str, x: str, y: str) -> DataFrame:
    """by, a, b: neighbouring terminals of a device along the axis on which they spread further (x if both are equal)."""
    spans = terminals.groupBy(*by).agg((F.max(x) - F.min(x) >= F.max(y) - F.min(y)).alias("wide__"))
    rows = terminals.join(spans, by).withColumn("at__", F.when(F.col("wide__"), F.col(x)).otherwise(F.col(y)))
    w = Window.partitionBy(*by).orderBy("at__", key)
    return rows.withColumn("b", F.lead(key).over(w)).filter("b IS NOT NULL").select(*by, F.col(key).alias("a"), "b")


def bus_texts(ends: DataFrame, texts: DataFrame, by: list[str], weight: float = 0.2) -> DataFrame:
    """by, end_id, text_id, distance: the text beside each bus end: least abs(dy) + weight * abs(dx), however far.
    ends: by, end_id, px, py; texts: by, text_id, tx, ty."""
    d = F.abs(F.col("ty") - F.col("py")) + weight * F.abs(F.col("tx") - F.col("px"))
    return P.nearest(ends, texts, by, None, "end_id", "text_id", weights=(weight, 1.0), distance=d)
