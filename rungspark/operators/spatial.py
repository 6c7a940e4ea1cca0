"""Joins by place. A grid cell makes each an equi-join; a residual condition decides.

Defined results: empty tables give empty results; null coordinates meet nothing; ties go to the lesser key; repeated rows meet each; boxes and segments of no extent are points; further columns
are ignored unless they are asked for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.slopes import median_slope


FIRST = 64  # boxes of a cell that owners() tries first
CROWD = 8.0  # targets in a cell from which on a smaller reach is tried first


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def gridded(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> DataFrame:
    return df.withColumn("gx", F.explode(_cells(x0, x1, size))).withColumn("gy", F.explode(_cells(y0, y1, size)))


def segment_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, reach: float, size: float) -> DataFrame:
    """`df` with gx, gy: the cells along each segment that come within `reach` of it, column by column, not those of the whole box around it."""
    wide = reach + size * 1e-6
    low, high, dx = F.least(x0, x1), F.greatest(x0, x1), x1 - x0
    out = df.withColumn("gx", F.explode(_cells(low - wide, high + wide, size)))
    y = lambda x: y0 + F.coalesce((F.least(F.greatest(x, low), high) - x0) / F.nullif(dx, F.lit(0.0)), F.lit(0.0)) * (y1 - y0)
    a, b = y(F.col("gx") * size - wide), y((F.col("gx") + 1) * size + wide)
    bottom, top = F.when(dx == 0, F.least(y0, y1)).otherwise(F.least(a, b)), F.when(dx == 0, F.greatest(y0, y1)).otherwise(F.greatest(a, b))
    return out.withColumn("gy", F.explode(_cells(bottom - wide, top + wide, size)))


def in_cells(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join of two gridded tables. Spark judges them by what they were made from, so it would send spread rows to the driver and every task: both are shuffled instead."""
    return left.hint("merge").join(right.hint("merge"), keys)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` dealt by its keys over all shuffle partitions: tables of few bytes can make many pairs, so adaptive execution must not gather them into a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


LIKE = 0.1  # IoU from which on the place of a box's centre tells what it can meet


def box_overlaps(left: DataFrame, right: DataFrame, by: list[str], least: float, cell: float, box: tuple = ("cx", "cy", "w", "h")) -> DataFrame:
    """Pairs (l, r: structs) of boxes of one page with IoU >= least > 0, each once. From LIKE on the centre of the right one lies in one cell, and the left one looks at
    the cells that centres of boxes so like it can lie in; below that boxes meet in the cell of their intersection's lower corner."""
    x, y, w, h = (F.col(c) for c in box)
    keys, of = [*by, "gx", "gy"], lambda s: tuple(F.col(f"{s}.{c}") for c in box)
    a, b = of("l"), of("r")
    if least >= LIKE:
        size = cell / 2
        # The common width is at least `least` of the wider one, so the centres are (1 / least - 1) / 2 of a width apart at most; a little more for rounding.
        far = lambda c: c * ((1 / least - 1) / 2) + (c + F.abs(x) + F.abs(y)) * 1e-9
        looking = gridded(left, x - far(w), x + far(w), y - far(h), y + far(h), size).select(*keys, F.struct(*left.columns).alias("l"))
        placed = right.select(*by, F.floor(x / size).alias("gx"), F.floor(y / size).alias("gy"), F.struct(*right.columns).alias("r"))
        met = in_cells(spread(looking, keys), spread(placed, keys), keys)
    else:
        side = lambda df, name: gridded(df, x - w / 2, x + w / 2, y - h / 2, y + h / 2, cell).select(*keys, F.struct(*df.columns).alias(name))
        corner = lambda i: F.floor(F.greatest(a[i] - a[i + 2] / 2, b[i] - b[i + 2] / 2) / cell)
        met = in_cells(side(left, "l"), side(right, "r"), keys).filter((corner(0) == F.col("gx")) & (corner(1) == F.col("gy")))
    return met.select(*by, "l", "r", G.iou(a, b).alias("iou")).filter(F.col("iou") >= least)


def owners(points: DataFrame, boxes: DataFrame, by: list[str], order: list[str], cell: float, margin: float = 0.0, box: tuple = ("cx", "cy", "w", "h"), point: tuple = ("px", "py"), keep: list[str] = [], point_key: str = "point_id") -> DataFrame:  # noqa: B006
    """Each point's first box, in `order`, among those it lies in: by, point_key and the box columns in `keep`. In each cell points meet the first boxes, then, those that lie in
    none of these, the next ones: no more pairs are made than it takes to find the first."""
    from .graph import cut_lineage

    x, y, w, h = (F.col(c) for c in box)
    keys = [*by, "gx", "gy"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    boxes_in = gridded(boxes, x - w / 2 - margin, x + w / 2 + margin, y - h / 2 - margin, y + h / 2 + margin, cell)
    boxes_in = cut_lineage(boxes_in.select(*dict.fromkeys([*keys, *box, *order, *keep])).withColumn("nth__", nth))
    left = points.withColumn("gx", F.floor(F.col(point[0]) / cell)).withColumn("gy", F.floor(F.col(point[1]) / cell))
    left = left.select(*keys, F.col(point_key).alias("p__"), F.col(point[0]).alias("px__"), F.col(point[1]).alias("py__")).distinct()
    last, upto, begin, parts = boxes_in.agg(F.max("nth__")).first()[0] or 0, FIRST, 0, []
    inside = G.inside(F.col("px__"), F.col("py__"), (x, y, w, h), margin)
    while True:
        some = boxes_in.filter((F.col("nth__") > begin) & (F.col("nth__") <= upto)).drop("nth__")
        met = in_cells(spread(left, keys), spread(some, keys), keys).filter(inside)
        at = ["p__", "px__", "py__"]
        parts.append(cut_lineage(met.groupBy(*keys, *at).agg(F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([*order, *keep])])).alias("o"))))
        if upto >= last:
            break
        left = cut_lineage(left.join(parts[-1].select(*keys, *at), [*keys, *at], "left_anti"))
        begin, upto = upto, upto * 8
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    # A key at several places has several first boxes.
    best = found.groupBy(*by, F.col("p__").alias(point_key)).agg(F.min("o").alias("o"))
    return best.select(*by, point_key, *[F.col(f"o.o{len(order) + i}").alias(c) for i, c in enumerate(keep)])


def first_reach(targets: DataFrame, by: list[str], target: tuple, weights: tuple, within: float, wanted: float) -> float:
    """The reach, at most `within`, of which a cell in a crowd has about `wanted` targets, or not many more than are at one place."""
    x, y = (F.col(c) * w for c, w in zip(target, weights))
    crowd = lambda x, y: targets.groupBy(*by, x.alias("x__"), y.alias("y__")).count().agg(F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).first()[0] or 0.0
    reach, most = within, max(2 * wanted, 1.5 * crowd(x, y))
    while reach > within * 1e-9:
        full = crowd(F.floor(x / reach), F.floor(y / reach))
        if full <= most:
            break
        reach /= (full / wanted) ** 0.5
    return reach


def nearest(points: DataFrame, targets: DataFrame, by: list[str], within: float | None, point_key: str, target_key: str, point: tuple = ("px", "py"), target: tuple = ("tx", "ty"), weights: tuple = (1.0, 1.0), distance: Column | None = None) -> DataFrame:
    """Each point's nearest target at most `within` (None: however far) away (ties to the lesser key): by, point_key, target_key, distance. Weights stretch
    the axes. distance: of the columns in point and target, if it is not the Euclidean one; no less than either of the stretched axes' differences.

    Targets at one place count as the one with the least key. Where many share a cell, points look for a target nearby first, and only those without one farther away."""
    from .graph import cut_lineage

    at = [*by, *target]
    targets = cut_lineage(targets.groupBy(*at).agg(F.min(target_key).alias(target_key)))
    if within is None:
        both = points.select(*[F.col(c) * w for c, w in zip(point, weights)]).union(targets.select(*[F.col(c) * w for c, w in zip(target, weights)])).toDF("x", "y")
        # By the city block, in which no two of them are farther apart.
        within = both.agg((F.max("x") - F.min("x") + F.max("y") - F.min("y")) * 1.001).first()[0] or 1.0
    reach, parts, left = first_reach(targets, by, target, weights, within, CROWD), [], points.select(*by, point_key, *point).distinct()
    args = (point_key, target_key, point, target, weights, distance)
    while reach < within:
        found = cut_lineage(_nearest(left, targets, by, reach, *args))
        parts.append(found)
        left = cut_lineage(left.join(found.select(*by, point_key), [*by, point_key], "left_anti"))
        reach *= 3
    out = _nearest(left, targets, by, within, *args)
    for found in parts:
        out = out.unionByName(found)
    return out


def near_pairs(points: DataFrame, targets: DataFrame, by: list[str], within: float, point: tuple = ("px", "py"), target: tuple = ("tx", "ty"), weights: tuple = (1.0, 1.0), distance: Column | None = None) -> DataFrame:
    """Pairs of a point and a target at most `within` apart, with their distance."""
    px, py, tx, ty = F.col(point[0]) * weights[0], F.col(point[1]) * weights[1], F.col(target[0]) * weights[0], F.col(target[1]) * weights[1]
    spread = gridded(points, px - within, px + within, py - within, py + within, within)
    placed = targets.withColumn("gx", F.floor(tx / within)).withColumn("gy", F.floor(ty / within))
    d = F.sqrt((px - tx) ** 2 + (py - ty) ** 2) if distance is None else distance
    return in_cells(spread, placed, [*by, "gx", "gy"]).withColumn("distance", d).filter(F.col("distance") <= within)


def _nearest(points: DataFrame, targets: DataFrame, by: list[str], within: float, point_key: str, target_key: str, point: tuple, target: tuple, weights: tuple, distance: Column | None) -> DataFrame:
    best = F.min(F.struct("distance", target_key)).alias("b")
    return near_pairs(points, targets, by, within, point, target, weights, distance).groupBy(*by, point_key).agg(best).select(*by, point_key, f"b.{target_key}", "b.distance")


def crossings(horizontal: DataFrame, vertical: DataFrame, by: list[str], cell: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of a horizontal (h_id, y, x0, x1) and a vertical (v_id, x, y0, y1) segment that meet within the tolerance."""
    h = horizontal.withColumn("gx", F.explode(_cells(F.col("x0") - tolerance, F.col("x1") + tolerance, cell))).withColumn("gy", F.floor(F.col("y") / cell))
    v = vertical.withColumn("gy", F.explode(_cells(F.col("y0") - tolerance, F.col("y1") + tolerance, cell))).withColumn("gx", F.floor(F.col("x") / cell))
    hit = F.col("x").between(F.col("x0") - tolerance, F.col("x1") + tolerance) & F.col("y").between(F.col("y0") - tolerance, F.col("y1") + tolerance)
    return in_cells(h, v, [*by, "gx", "gy"]).filter(hit).select(*by, "h_id", "v_id", "x", "y")


def median_slopes(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, slope: the median slope over the pairs of a group with different x. A task holds the x and y of a group, never its pairs; groups without such pairs are left out."""
    rows = df.select(*by, F.col(x).cast("double").alias("x__"), F.col(y).cast("double").alias("y__")).filter("x__ IS NOT NULL AND y__ IS NOT NULL")

    def slope(part: pa.Table) -> pa.Table:
        found = median_slope(part["x__"].to_numpy(), part["y__"].to_numpy())
        return part.select(by).slice(0, int(found is not None)).append_column("slope", pa.array([found] * (found is not None), pa.float64()))

    return rows.groupBy(*by).applyInArrow(slope, rows.select(*by, F.lit(0.0).alias("slope")).schema)


def theil_sen(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, slope, intercept: the median slope over pairs of a group, the median rest."""
    slopes = median_slopes(df, by, x, y)
    return df.join(slopes, by).groupBy(*by, "slope").agg(F.median(F.col(y) - F.col("slope") * F.col(x)).alias("intercept"))


def mutual_best(pairs: DataFrame, by: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one matching: the pair of the greatest score first, then the greatest of what is left, ties by left, then right.

    A pair that is the best of both its ends would be taken by the greedy order too, so rounds of taking all such pairs at once
    give the same matching. Tables of many rows can be small files: joins are shuffled, so that none is sent through the driver.
    """
    from .graph import cut_lineage

    rank = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    rest, taken = cut_lineage(pairs.select(*by, left, right, score)), None
    while not rest.isEmpty():
        top = lambda side: rest.groupBy(*by, side).agg(F.min(rank).alias("k")).select(*by, "k").hint("merge")
        both = top(left).join(top(right), [*by, "k"])
        best = cut_lineage(both.select(*by, F.col("k.l").alias(left), F.col("k.r").alias(right), (-F.col("k.s")).alias(score)))
        taken = best if taken is None else taken.unionByName(best)
        without = lambda df, side: df.hint("merge").join(best.select(*by, side).hint("merge"), [*by, side], "left_anti")
        rest = cut_lineage(without(without(rest, left), right))
    return taken if taken is not None else rest


TIERS, FEW_BOXES = (0.95, 0.9, 0.8, 0.6, 0.4), 50_000  # IoU, rounded, from which on pairs are matched first; of so few boxes all pairs are matched at once


def matched_boxes(left: DataFrame, right: DataFrame, by: list[str], key: str, least: float, cell: float, digits: int = 6) -> DataFrame:
    """by, l, r, iou: the one-to-one matching (mutual_best()) of boxes by their rounded IoU >= least. Of many boxes the likest are matched first, as the
    greedy order does, and only those left over meet in less like pairs, so that a crowd of boxes does not store all its pairs."""
    from .graph import cut_lineage

    left, right = cut_lineage(left), cut_lineage(right)
    taken, n = None, left.count() + right.count()
    # The denser the boxes, the more alike are the first pairs, so that a box has no more of them.
    tiers = [x for x in TIERS if n > FEW_BOXES and n * (1 - x) ** 3 > FEW_BOXES * (1 - 0.801) ** 3]
    for tier in [*tiers, None]:
        # Centres of like boxes are near each other: smaller cells hold fewer that are not.
        near = cell * min(1.0, 1 / tier - 1) if tier else cell
        pairs = box_overlaps(left, right, by, least if tier is None else max(least, tier - 10.0**-digits), near)
        pairs = pairs.select(*by, F.col(f"l.{key}").alias("l"), F.col(f"r.{key}").alias("r"), F.round("iou", digits).alias("iou"))
        found = mutual_best(pairs if tier is None else pairs.filter(F.col("iou") >= tier), by, "l", "r", "iou")
        taken = found if taken is None else taken.unionByName(found)
        if tier is not None:
            free = lambda df, side: cut_lineage(df.hint("merge").join(found.select(*by, F.col(side).alias(key)).hint("merge"), [*by, key], "left_anti"))
            left, right = free(left, "l"), free(right, "r")
    return taken


def mutual_unique(pairs: DataFrame, left: str, right: str, strength: str) -> DataFrame:
    """Pairs that are the only strongest one of both their ends."""
    counted = pairs
    for side in (left, right):
        counted = counted.withColumn("m_" + side, F.max(strength).over(Window.partitionBy(side)))
        counted = counted.withColumn("n_" + side, F.sum((F.col(strength) == F.col("m_" + side)).cast("int")).over(Window.partitionBy(side)))
    keep = (F.col(strength) == F.col("m_" + left)) & (F.col(strength) == F.col("m_" + right)) & (F.col("n_" + left) == 1) & (F.col("n_" + right) == 1)
    return counted.filter(keep).select(*pairs.columns)
