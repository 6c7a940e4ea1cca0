"""Crossings of many lines: what conducts and which nets there are, without a table of the crossings.

A page's crossings grow with the square of its lines, so they are only made row by row, in cells, and never shuffled, sorted or written: what is said of them is worked
out before, for the lines' parts in each cell.

horizontal: by, h_id, y, x0 <= x1; vertical: by, v_id, x, y0 <= y1; dots: by, x, y. Ids are strings; those of horizontal lines hold no x. A crossing is called by its lines' ids with an x between.

Defined results: as in crossings.py; a line that is given twice crosses twice.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, relational as R
from . import spatial as P
from .crossings import ACROSS, ALONG

CELL, FINE = 64.0, 32.0
EDGES = 500_000  # links that forest() keeps before it joins them
ROWS = 50_000  # lines that a task of foremost() passes over


@dataclass
class Lines:
    """Lines in cells (gx, gy). parts: the horizontal ones, cut where it changes whether an end is near: lo, hi (in the part if tee, else not), tee, dots (the v_ids of its crossings with a dot)."""

    by: list[str]
    whole: DataFrame
    parts: DataFrame
    across: DataFrame

    def met(self, parts: DataFrame | None = None, across: DataFrame | None = None) -> DataFrame:
        """The crossings, with conducts if they are of the parts; parts and across: the lines with further columns."""
        c, cut = F.col, parts is None or "lo" in parts.columns
        keys = [*self.by, "gx", "gy"]
        hit = c("x").between(c("x0"), c("x1")) & c("y").between(c("y0"), c("y1"))
        if cut:
            hit = hit & F.when(c("tee"), c("x").between(c("lo"), c("hi"))).otherwise((c("x") > c("lo")) & (c("x") < c("hi")))
        pairs = P.in_cells(P.spread(self.parts if parts is None else parts, keys), P.spread(self.across if across is None else across, keys), keys).filter(hit)
        return pairs.withColumn("conducts", c("tee") | F.coalesce(F.array_contains("dots", c("v_id")), F.lit(False))) if cut else pairs


def in_lines(horizontal: DataFrame, vertical: DataFrame, dots: DataFrame, by: list[str], within: float = 24.0, dots_only: bool = False) -> Lines:
    """The lines in cells, ready to tell which of their crossings conduct: those with a dot (the crossing nearest to it, at most `within` away, the least of several) and, unless dots_only,
    those where a line ends."""
    c = F.col
    h, v = horizontal.select(*by, "h_id", "y", "x0", "x1"), vertical.select(*by, "v_id", "x", "y0", "y1")
    laid = h.withColumn("gx", F.explode(P._cells(c("x0"), c("x1"), CELL))).withColumn("gy", F.floor(c("y") / CELL))
    across = v.withColumn("gy", F.explode(P._cells(c("y0"), c("y1"), CELL))).withColumn("gx", F.floor(c("x") / CELL))
    cut = laid.withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "tee": F.lit(False)})
    if not dots_only:
        row = [*by, "gx", "gy", "y"]
        cut = laid.hint("merge").join(_ends_along(laid, h, v, by).hint("merge"), row, "left")
        cut = cut.withColumns({"lo": F.coalesce("lo", F.lit(float("-inf"))), "hi": F.coalesce("hi", F.lit(float("inf"))), "tee": F.coalesce("tee", F.lit(False))})
        cut = cut.filter(F.greatest(c("lo"), c("x0"), c("gx") * CELL) <= F.least(c("hi"), c("x1"), (c("gx") + 1) * CELL))
    marked = _dotted(h, v, dots, by, within).groupBy(*by, "h_id", F.floor(c("x") / CELL).alias("gx")).agg(F.collect_set("v_id").alias("marks"))
    key = [*by, "h_id", "gx"]
    cut = cut.hint("merge").join(marked.hint("merge"), key, "left").withColumn("dots", F.when(~c("tee"), c("marks"))).drop("marks")
    return Lines(by, laid, graph.cut_lineage(cut), graph.cut_lineage(across))


def _ends_along(laid: DataFrame, h: DataFrame, v: DataFrame, by: list[str]) -> DataFrame:
    """by, gx, gy, y, lo, hi, tee: each row of a cell on which lines lie, cut into what is near an end of some line (tee; with lo and hi) and what is not (without them)."""
    c = F.col
    end = lambda df, a, b, across, flat: df.select(*by, F.explode(F.array(a, b)).alias("e"), c(across).alias("a")).select(*by, *[(c("e") if flat else c("a")).alias("ex"), (c("a") if flat else c("e")).alias("ey"), F.lit(ALONG if flat else ACROSS).alias("wide"), F.lit(ACROSS if flat else ALONG).alias("high")])
    ends = end(h, "x0", "x1", "y", True).unionByName(end(v, "y0", "y1", "x", False)).distinct()
    row, cell = [*by, "gx", "gy", "y"], [*by, "gx", "gy"]
    boxes = P.gridded(ends, c("ex") - c("wide"), c("ex") + c("wide"), c("ey") - c("high"), c("ey") + c("high"), CELL)
    near = P.in_cells(P.spread(laid.select(*row).distinct(), cell), P.spread(boxes, cell), cell).filter(F.abs(c("y") - c("ey")) <= c("high"))
    # Ends of one step are near enough for what they reach to hang together.
    spans = near.groupBy(*row, "wide", F.floor(c("ex") / (2 * c("wide"))).alias("step")).agg((F.min("ex") - F.first("wide")).alias("lo"), (F.max("ex") + F.first("wide")).alias("hi"))
    w = Window.partitionBy(*row).orderBy("lo", "hi")
    upto = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("upto", upto).withColumn("nth", F.sum(F.when(c("lo") <= c("upto"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*row, "nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    after = F.coalesce(F.lead("lo").over(Window.partitionBy(*row).orderBy("nth")), F.lit(float("inf")))
    part = lambda lo, hi, tee: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(tee).alias("tee"))
    first = F.when(c("nth") == 1, part(F.lit(float("-inf")), c("lo"), False))
    return spans.withColumn("after", after).select(*row, F.explode(F.array(part(c("lo"), c("hi"), True), part(c("hi"), c("after"), False), first)).alias("p")).filter("p IS NOT NULL").select(*row, "p.*")


def foremost(lines: DataFrame, by: list[str], at: str, lo: str, hi: str, name: str, ending: str = "") -> DataFrame:
    """by, at, lo, hi, name: what is seen of lines that lie over each other if the one with the least name (with `ending`) is in front; two may share a point. Lines pass in order of place, and
    only those that are still open are held."""
    rows = lines.select(*by, at, lo, hi, name).filter(_given(by + [at, lo, hi, name]))
    keys = [*by, at]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, start, heap, out = None, None, [], []

        def seen(upto):
            """Ends what is in front before `upto` (None: the row's end)."""
            nonlocal start
            while heap and (upto is None or heap[0][1] < upto):
                key, end, row = heapq.heappop(heap)
                out.append((*place, start, end, row))
                start = end
                while heap and heap[0][1] <= end:
                    heapq.heappop(heap)

        schema = None
        for batch in batches:
            schema = batch.schema
            for *here, a, b, label in zip(*(col.to_pylist() for col in batch.columns)):
                if here != place:
                    if place is not None:
                        seen(None)
                    place, heap = here, []
                seen(a)
                key = label + ending
                if not heap:
                    start = a
                    heapq.heappush(heap, (key, b, label))
                elif key < heap[0][0]:
                    out.append((*place, start, a, heap[0][2]))
                    start = a
                    heapq.heappush(heap, (key, b, label))
                elif b > heap[0][1]:
                    heapq.heappush(heap, (key, b, label))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        if place is not None:
            seen(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out), schema)], schema=schema)

    # A task of Python takes long to begin, so there are no more of them than there are lines for.
    return rows.repartition(rows.count() // ROWS + 1, *keys).sortWithinPartitions(*keys, lo).mapInArrow(sweep, rows.schema)


def _given(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def _dotted(h: DataFrame, v: DataFrame, dots: DataFrame, by: list[str], within: float) -> DataFrame:
    """by, h_id, v_id, x: the crossings nearest to dots, the one of the least name at a place."""
    c = F.col
    points = graph.cut_lineage(dots.select(*by, "x", "y").filter(_given([*by, "x", "y"])).distinct())
    front = graph.cut_lineage(foremost(h, by, "y", "x0", "x1", "h_id", "x"))
    up = graph.cut_lineage(foremost(v, by, "x", "y0", "y1", "v_id"))
    node = F.struct(F.concat("h_id", F.lit("x"), "v_id").alias("name"), "h_id", "v_id", c("x").alias("at")).alias("node")
    # Most dots of a crowded page lie on a crossing.
    row, column = [*by, "y", "g"], [*by, "x", "g"]
    level = front.withColumn("g", F.explode(P._cells(c("x0"), c("x1"), FINE)))
    upright = up.withColumn("g", F.explode(P._cells(c("y0"), c("y1"), FINE)))
    on = P.in_cells(P.spread(points.withColumn("g", F.floor(c("x") / FINE)), row), P.spread(level, row), row).filter(c("x").between(c("x0"), c("x1"))).select(*by, "x", "y", "h_id")
    on = P.in_cells(P.spread(on.withColumn("g", F.floor(c("y") / FINE)), column), P.spread(upright, column), column).filter(c("y").between(c("y0"), c("y1")))
    on = graph.cut_lineage(on.groupBy(*by, "x", "y").agg(F.min(node).alias("node")))
    rest = graph.cut_lineage(points.hint("merge").join(on.select(*by, "x", "y").hint("merge"), [*by, "x", "y"], "left_anti"))
    found = on.select(*by, "node")
    if not rest.isEmpty():
        cell = [*by, "gx", "gy"]
        around = P.gridded(rest, c("x") - within, c("x") + within, c("y") - within, c("y") + within, FINE).select(*cell).distinct()
        level = front.withColumn("gx", F.explode(P._cells(c("x0"), c("x1"), FINE))).withColumn("gy", F.floor(c("y") / FINE))
        upright = up.withColumn("gy", F.explode(P._cells(c("y0"), c("y1"), FINE))).withColumn("gx", F.floor(c("x") / FINE)).hint("merge").join(around.hint("merge"), cell, "left_semi")
        met = P.in_cells(P.spread(level, cell), P.spread(upright, cell), cell).filter(c("x").between(c("x0"), c("x1")) & c("y").between(c("y0"), c("y1")))
        targets = met.select(*by, node, c("x").alias("tx"), c("y").alias("ty"))
        nearest = P.nearest(rest.select(*by, F.struct("x", "y").alias("dot"), c("x").alias("px"), c("y").alias("py")), targets, by, within, "dot", "node")
        found = found.unionByName(nearest.select(*by, "node"))
    return found.select(*by, "node.h_id", "node.v_id", c("node.at").alias("x"))


def conducting(lines: Lines) -> DataFrame:
    """by, node_id, conducts: of each crossing."""
    parts = lines.parts.withColumn("head", F.concat("h_id", F.lit("x")))
    return lines.met(parts).select(*lines.by, F.concat("head", "v_id").alias("node_id"), "conducts")


def forest(links: DataFrame, a: str, b: str) -> DataFrame:
    """a, b: links that join the same numbers (from 0) as all of the links do; each task leaves out those that join nothing new."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, waiting, n = np.arange(0), [], 0

        def join():
            nonlocal label, waiting, n
            u, v = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            waiting, n = [], 0
            while len(u):
                low, high = np.minimum(u, v), np.maximum(u, v)
                np.minimum.at(label, high, low)
                while True:  # labels become those of their roots
                    further = label[label]
                    if np.array_equal(further, label):
                        break
                    label = further
                u, v = label[u], label[v]
                u, v = u[u != v], v[u != v]

        for batch in batches:
            u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if len(u) == 0:
                continue
            most = int(max(u.max(), v.max())) + 1
            if most > len(label):
                label = np.concatenate([label, np.arange(len(label), max(most, 2 * len(label)))])
            u, v = label[u], label[v]
            new = u != v
            if new.any():
                waiting.append((u[new], v[new]))
                n += int(new.sum())
            if n >= EDGES:
                join()
        if n:
            join()
        own = np.flatnonzero(label != np.arange(len(label)))
        for i in range(0, len(own), 50_000):
            part = own[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(label[part], pa.int64())], names=[a, b])

    return links.select(F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b)).filter(_given([a, b])).mapInArrow(kept, f"{a} long, {b} long")


def nets(lines: Lines) -> DataFrame:
    """by, node_id, wire_id, net: of each crossing on each of its wires (h or v and the line's id) that has more than one. Neighbours on a wire are joined, so a wire is one net all along, and its crossings that
    conduct join it to others. A crossing that does not conduct is a node of its own for each wire; the net's name is the least of its nodes' names."""
    c, by = F.col, lines.by
    # Names are compared as numbers in their order: of horizontal lines before the x; of vertical ones as they end, or go on with the wire that they are a node of.
    front = graph.cut_lineage(R.numbered(lines.parts.select(*by, "h_id").distinct(), [], [F.concat("h_id", F.lit("x")), *map(c, by)], "h_no"))
    ways = lines.across.select(*by, "v_id").distinct().select(*by, "v_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("apart"))
    codes = graph.cut_lineage(R.numbered(ways, [], [F.concat("v_id", F.when(c("apart"), "@").otherwise("")), *map(c, by)], "code"))
    up = codes.groupBy(*by, "v_id").agg(F.min("code").alias("v_no"), F.max("code").alias("v_apart"))
    parts = lines.parts.hint("merge").join(front.hint("merge"), [*by, "h_id"])
    across = graph.cut_lineage(lines.across.hint("merge").join(up.hint("merge"), [*by, "v_id"]))
    met = lines.met(parts, across)
    own = lambda text: F.concat_ws("|", *[c(x).cast("string") for x in by], text)
    # The least name of a horizontal wire's nodes is by the vertical line, that of a vertical one's by the horizontal.
    level = met.groupBy("h_no").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(c("conducts"), c("v_no")).otherwise(c("v_apart"))).alias("code")).filter("n > 1")
    level = level.hint("merge").join(front.hint("merge"), "h_no").join(codes.select("code", "v_id", "apart").hint("merge"), "code")
    level = level.select((c("h_no") * 2).alias("node"), own(F.concat("h_id", F.lit("x"), "v_id", F.when(c("apart"), F.concat(F.lit("@h"), "h_id")).otherwise(""))).alias("name"))
    upright = met.groupBy("v_no").agg(F.count(F.lit(1)).alias("n"), F.min(c("h_no") * 2 + F.when(c("conducts"), 0).otherwise(1)).alias("code")).filter("n > 1")
    upright = upright.withColumns({"h_no": F.floor(c("code") / 2), "apart": c("code") % 2 == 1}).hint("merge").join(front.hint("merge"), "h_no").join(up.select("v_no", "v_id").hint("merge"), "v_no")
    upright = upright.select((c("v_no") * 2 + 1).alias("node"), own(F.concat("h_id", F.lit("x"), "v_id", F.when(c("apart"), F.concat(F.lit("@v"), "v_id")).otherwise(""))).alias("name"))
    wires = graph.cut_lineage(level.unionByName(upright))
    links = forest(met.filter("conducts").select((c("h_no") * 2).alias("a"), (c("v_no") * 2 + 1).alias("b")), "a", "b")
    joined = graph.connected_components(links)
    wires = wires.hint("merge").join(joined.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    called = wires.groupBy("component").agg(F.min("name").alias("net"))
    wires = graph.cut_lineage(wires.hint("merge").join(called.hint("merge"), "component").select("node", "net"))
    side = lambda df, node: df.withColumn("node", node).hint("merge").join(wires.hint("merge"), "node")
    whole = lines.whole.hint("merge").join(front.hint("merge"), [*by, "h_id"]).withColumn("head", F.concat("h_id", F.lit("x")))
    node = F.concat("head", "v_id").alias("node_id")
    a = lines.met(side(whole, c("h_no") * 2).withColumn("wire_id", F.concat(F.lit("h"), "h_id")), across).select(*by, node, "wire_id", "net")
    return a.unionByName(lines.met(whole, side(across, c("v_no") * 2 + 1).withColumn("wire_id", F.concat(F.lit("v"), "v_id"))).select(*by, node, "wire_id", "net"))
