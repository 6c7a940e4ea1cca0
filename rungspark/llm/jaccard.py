"""Exact Jaccard join of word-shingle sets in metric space.

Jaccard distance 1 - |x n y| / |x u y| is a metric, and the size of the symmetric difference |x \\ y| + |y \\ x| is one too.
Both are used:

1. Voronoi regions of shingle pivots. Every shingle g is the pivot {g}, pivots being ranked by one global order. In the
   symmetric-difference metric a set is nearest to the pivots it holds; its region is that of its lowest ranked one. A
   partner within Jaccard distance 0.2 lacks at most a fifth of the set's shingles, so by the triangle inequality its region's
   pivot lies in the window of the set's lowest ranked fifth (plus one): a set is replicated to the regions of that window
   and no others. If g, at places i and j of two windows, is the first shingle shared, at most |x| - i and |y| - j are shared: a
   member stays in a region only if a partner is there for which both suffice. Shingles that many sets share come last in
   the order (any order gives exact results), so that shared passages do not make regions.
2. Voronoi regions of document pivots. Inside a region of more than two sets, pivot sets are chosen and all members'
   Jaccard distances to them computed. Members within 0.2 of one pivot are linked through it and need no distances among
   each other. The others go to the region of their nearest pivot (at most 0.4 away, else to a region of the far), and a
   member of another region is replicated where |d(x, p) - d(y, p)| <= 0.2 leaves a link possible. Regions that links join by
   now are done, equal ones are one. A region of at most SWEEP members is then closed: members of different components meet, but
   for those of the largest component among each other, where sizes and parity sketches (see parity()) leave a link possible.
   Larger ones are joined recursively, with more pivots each time. No link is lost and none is guessed.

Exact distances are computed for pairs that sketches (see sketch()) do not put beyond every window. Rows move through Spark's joins
and aggregations only: no region meets in one task as a whole, and a shingle that very many sets have in their windows is
dealt by set.

Equal sets are one node from the start, so copies cost one row each. Only links through pivots are kept: enough for components.

Defined results: null, empty and white-space texts have an empty set, link with nothing and are components of their own; a
text of fewer words than a shingle has its whole sequence as its only shingle; documents with a null id link like others, but their
ids name no component: one that reaches no other id has a null component; repeated rows, and rows of one id with several texts,
are documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components, forget
from .common import WordIds, give_back, groups_for, mix64, stored, text_bytes, words_of
from .ngram import _keys, _pack, _planes, _unpack, _owner

WORDS = 5
NUM, DEN = 4, 5  # the least similarity, 0.8, as a fraction
REACH = 3 * (1 - NUM / DEN) + 1e-9  # no window reaches further than three times the links' distance
HOT = 16  # sets that share a shingle, from which on it is ordered last
MOST_HOT = 200_000  # shingles so ordered: the bound of the broadcast list; the order is free, so results do not depend on it
WIDE = 100_000  # sets that share a shingle, from which on its region is dealt by set
FEW_NODES = 200_000  # candidate nodes or pairs up to which their list is broadcast; beyond, the join is shuffled
SWEEP = 8192  # members up to which a region is closed by a sweep
PARITY = 16  # words of 64 bits
_P = np.uint64(0x9E3779B97F4A7C15)
_ids = WordIds()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = _ids.of(words_of(text))
    if len(w) == 0:
        return w
    n = max(1, len(w) - words + 1)
    g = np.zeros(n, np.uint64)
    for j in range(min(words, len(w))):
        g = g * _P + w[j : j + n]
    return np.unique(mix64(g + np.uint64(min(len(w), words))))


def node_of(grams: np.ndarray) -> int:
    """A set's 64-bit name, as a signed number; equal sets have equal names."""
    return int(mix64(np.array([mix64(grams ^ _P).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """id, h, n, node of each document; and, in rows without a node, shingles that several sets of one task share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, size, seen = [], 0, set()

        def shared() -> pd.DataFrame:
            grams, counts = np.unique(np.concatenate(pending), return_counts=True)
            often = counts > 1
            return pd.DataFrame({"id": [None], "h": [0], "n": [0], "node": [None], "grams": [_planes(grams[often])], "counts": [_pack(counts[often].astype(np.int32))]})

        for b in batches:
            ns, names = [], []
            for text in b["text"]:
                g = shingles(text, words)
                name = node_of(g) if len(g) else None
                ns.append(len(g)), names.append(name)
                if name is not None and name not in seen:
                    seen.add(name), pending.append(g)
                    size += len(g)
            yield pd.DataFrame({"id": b["id"], "h": b["h"], "n": ns, "node": pd.array(names, "Int64"), "grams": None, "counts": None})
            if size > 3_000_000:
                yield shared()
                pending, size, seen = [], 0, set()
        if pending:
            yield shared()
        pending.clear()
        give_back()

    return docs.mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, h long, n long, node long, grams binary, counts binary")


def _hot(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many sets share (a bounded list) and how many, by shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, c in zip(b["grams"], b["counts"], strict=True):
                yield pd.DataFrame({"gram": _keys(g).view(np.int64), "c": _unpack(c, np.int32)})

    rows = nodes.filter("grams IS NOT NULL").select("grams", "counts").mapInPandas(run, "gram long, c int")
    top = rows.groupBy("gram").agg(F.sum("c").alias("c")).filter(F.col("c") >= HOT).orderBy(F.desc("c"), "gram").limit(MOST_HOT)
    found = top.toPandas()
    grams, counts = found["gram"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.argsort(grams)
    return grams[order], counts[order]


def _prefix(grams: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's window of pivots in the global order; and for each place in it the size of the largest partner whose first shared
    shingle can be there: intersection >= NUM / (NUM + DEN) * (both sizes) must fit into what is left of the set."""
    n = len(grams)
    take = n - -(-NUM * n // DEN) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        late = hot[at] == grams
        last = grams[late][np.argsort(counts[at[late]], kind="stable")]  # the most frequent at the end
        grams = np.concatenate([grams[~late], last])
    return grams[:take], (NUM + DEN) * (n - np.arange(take)) // NUM - n


def _fitting(size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which members of a region have a partner there, by sizes and the partners' largest sizes."""
    least, most = -(-size * NUM // DEN), np.minimum(most, size * DEN // NUM)
    if len(size) <= 512:
        ok = (size[None, :] >= least[:, None]) & (size[None, :] <= most[:, None])
        ok &= ok.T
        np.fill_diagonal(ok, False)
        return ok.any(1)
    ordered = np.sort(size)
    others = np.searchsorted(ordered, most, "right") - np.searchsorted(ordered, least, "left") - ((least <= size) & (size <= most))
    return others > 0


def _regions(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], words: int, owners: int) -> DataFrame:
    """region, node: the members of each shingle pivot's region that holds more than one set; equal regions once."""
    of = docs.sparkSession.sparkContext.broadcast((*hot, hot[0][hot[1] >= WIDE]))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, info, size, seen = [], [], 0, set()
        hot, counts, wide = of.value

        def flush() -> pd.DataFrame:
            key, node, tag = np.concatenate(grams), np.repeat(np.array([x[0] for x in info], np.int64), [len(g) for g in grams]), np.concatenate([x[1] for x in info])
            to = _owner(key, owners)
            many = np.isin(key, wide)
            to[many] = _owner(mix64(key[many] ^ node[many].view(np.uint64)), owners)
            order = np.lexsort((key, to))
            key, node, tag, to = key[order], node[order], tag[order], to[order]
            cuts = [*np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to)]
            return pd.DataFrame({
                "owner": to[cuts[:-1]], "keys": [_planes(key[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)],
                "nodes": [_pack(node[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], "tags": [_pack(tag[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)],
            })

        for b in batches:
            for text in b["text"]:
                g = shingles(text, words)
                if not len(g) or (name := node_of(g)) in seen:
                    continue
                seen.add(name)
                window, most = _prefix(g, hot, counts)
                grams.append(window), info.append((name, len(g) << 32 | most))
                size += len(window)
                if size > 1_500_000:
                    yield flush()
                    grams, info, size, seen = [], [], 0, set()
        if grams:
            yield flush()
        grams.clear()
        give_back()

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([_keys(k) for k in part["keys"]])
        node = np.concatenate([_unpack(x, np.int64) for x in part["nodes"]])
        tag = np.concatenate([_unpack(x, np.int64) for x in part["tags"]])
        order = np.lexsort((node, key))
        key, node, tag = key[order], node[order], tag[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, tag = key[new], node[new], tag[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        many = np.isin(key[starts], of.value[2])
        regions, members = [], []
        for s, e in zip(starts[many], ends[many], strict=True):  # a part of a region
            members.append(node[s:e])
            regions.append(np.full(e - s, int(mix64(key[s : s + 1]).view(np.int64)[0])))
        some = np.flatnonzero((ends - starts > 1) & ~many)
        for s, e in zip(starts[some], ends[some], strict=True):
            keep = _fitting(tag[s:e] >> 32, tag[s:e] & 0xFFFFFFFF)
            if keep.sum() > 1:
                kept = node[s:e][keep]
                members.append(kept)
                regions.append(np.full(len(kept), int(mix64(np.array([mix64(kept.view(np.uint64)).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])))
        if not regions:
            return pd.DataFrame({"region": np.empty(0, np.int64), "node": np.empty(0, np.int64)})
        return pd.DataFrame({"region": np.concatenate(regions), "node": np.concatenate(members)}).drop_duplicates()

    sent = docs.select("text").mapInPandas(send, "owner int, keys binary, nodes binary, tags binary")
    return sent.repartition(owners, "owner").groupBy("owner").applyInPandas(meet, "region long, node long").distinct()


def _bits(n: int) -> int:
    return max(3, int(n - 1).bit_length())


def sketch(grams: np.ndarray) -> np.ndarray:
    """How many shingles fall in each of 2^b >= n equal ranges of the hash. The L1 distance of two sketches is no larger than
    the sets' symmetric difference, so it bounds their Jaccard distance from below."""
    b = _bits(len(grams))
    return np.minimum(np.bincount((grams >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b), 255).astype(np.uint8)


def least_distance(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> float:
    """A lower bound of the Jaccard distance from two sketches and the sets' sizes."""
    if len(x) < len(y):
        x, y = y, x
    differ = np.abs(x.astype(np.int64).reshape(len(y), -1).sum(1) - y).sum() if x.max() < 255 and y.max() < 255 else abs(nx - ny)
    return 2 * differ / (nx + ny + differ)


def parity(grams: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY equal ranges of the hash whether it holds an odd number of the shingles, as bits. Two sets'
    sketches differ in no more bits than the sets in shingles, so this bounds the symmetric difference from below."""
    odd = np.bincount((grams >> np.uint64(64 - (64 * PARITY - 1).bit_length())).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n, sketch, parity and grams (packed, their upper 48 bits) of the given nodes, each from its first document."""
    wanted = stored(nodes.join(classes, "node").select(F.col("f.id").alias("w_id"), F.col("f.h").alias("w_h"), "node"), "jaccard-wanted")
    if wanted.count() <= FEW_NODES:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, (F.col("h") == F.col("w_h")) & F.col("id").eqNullSafe(F.col("w_id"))).select("node", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, words) for t in b["text"]]
            same = np.array([node_of(g) == n for g, n in zip(sets, b["node"], strict=True)], bool)
            yield pd.DataFrame({
                "node": b["node"], "n": [len(g) for g in sets], "sketch": [_pack(sketch(g)) for g in sets], "parity": [parity(g) for g in sets], "grams": [_planes(g >> np.uint64(16)) for g in sets],
            })[same]

    return found.mapInPandas(run, "node long, n long, sketch binary, parity array<long>, grams binary").dropDuplicates(["node"])


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, p, least: a lower bound of the distance from sizes and sketches; 1 where it is beyond every window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["sx"], b["nx"], b["sp"], b["np"], strict=True)
            yield pd.DataFrame({"x": b["x"], "p": b["p"], "least": [least_distance(_unpack(sx, np.uint8), nx, _unpack(sp, np.uint8), n_p) for sx, nx, sp, n_p in rows]})

    of = lambda c, s, n: sets.select(F.col("node").alias(c), F.col("sketch").alias(s), F.col("n").alias(n))
    joined = pairs.join(of("p", "sp", "np"), "p").join(of("x", "sx", "nx"), "x")
    out_of_size = 1 - F.least("nx", "np") / F.greatest("nx", "np") > REACH
    sized = joined.filter(~out_of_size).select("x", "p", "sx", "nx", "sp", "np")
    return sized.mapInPandas(run, "x long, p long, least double").filter(F.col("least") <= REACH)


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, p, inter, uni of each pair: the exact sizes of intersection and union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inter, uni = [], []
            for a, c in zip(b["gx"], b["gp"], strict=True):
                a, c = _keys(a), _keys(c)
                both = len(np.intersect1d(a, c, assume_unique=True))
                inter.append(both), uni.append(len(a) + len(c) - both)
            yield pd.DataFrame({"x": b["x"], "p": b["p"], "inter": inter, "uni": uni})

    pivots = pairs.select("p").distinct()
    if pairs.count() <= FEW_NODES:  # then sets stay where they are, and only those of pairs travel
        pairs, pivots = F.broadcast(pairs), F.broadcast(pivots)
    of_pivots = sets.join(pivots.withColumnRenamed("p", "node"), "node", "left_semi").select(F.col("node").alias("p"), F.col("grams").alias("gp"))
    of_members = sets.select(F.col("node").alias("x"), F.col("grams").alias("gx")).join(pairs, "x")
    return of_members.join(of_pivots, "p").select("x", "p", "gx", "gp").mapInPandas(run, "x long, p long, inter long, uni long")


def _links(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """x, p: links, enough to connect every pair of linked sets of a region. Joins the regions recursively over document pivots."""
    near, edges, pivots, slack = 1 - NUM / DEN, None, 2, 1e-9
    # The most central sets come first as pivots: those in most regions (what a family's members share, they share with these).
    degree = stored(regions.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "jaccard-degrees")
    regions = regions.join(degree, "node").withColumn("kin", F.lit(0).cast("long")).withColumn("main", F.lit(False))
    while True:
        # Later on, those of a region's components but the largest one: once they are tested, what is left is joined already.
        by = Window.partitionBy("region").orderBy("kin", F.desc("degree"), "node")
        chosen = regions.filter("NOT main").withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= pivots).select("region", F.col("node").alias("p"))
        tested = stored(regions.join(chosen, "region").filter(F.col("node") != F.col("p")).select("region", F.col("node").alias("x"), "p"), "jaccard-tested")
        # A pair of pivots is tested once: distances are symmetric.
        pairs = tested.select(F.least("x", "p").alias("x"), F.greatest("x", "p").alias("p")).distinct()
        close = stored(_bounded(pairs, sets), "jaccard-bounded")
        found = stored(_distances(close.select("x", "p"), sets), "jaccard-distances")
        linked = found.filter(DEN * F.col("inter") >= NUM * F.col("uni")).select("x", "p")
        edges = linked if edges is None else edges.unionByName(linked)
        known = found.select(F.col("x").alias("a"), F.col("p").alias("b"), (1 - F.col("inter") / F.col("uni")).alias("d"))
        pair = (F.least("x", "p") == F.col("a")) & (F.greatest("x", "p") == F.col("b"))
        measured = tested.join(known, pair, "left").select("region", "x", "p", F.coalesce("d", F.lit(1.0)).alias("d"))
        measured = measured.join(chosen.select("region", F.col("p").alias("x")), ["region", "x"], "left_anti")
        best = measured.groupBy("region", "x").agg(F.min(F.struct("d", "p")).alias("best"))
        far = best.filter(F.col("best.d") > 2 * near + slack).select("region", F.lit(None).cast("long").alias("cell"), "x")
        home = best.filter(F.col("best.d") <= 2 * near + slack).select("region", F.col("best.p").alias("p"), F.col("best.d").alias("d"))
        span = home.groupBy("region", "p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        cells = measured.join(span, ["region", "p"]).filter((F.col("d") <= F.col("hi") + near + slack) & (F.col("d") >= F.col("lo") - near - slack))
        # In a cell, members near the pivot are linked through it; only those in the window of a member that is not stay.
        rest = cells.filter(F.col("d") > near + slack).groupBy("region", "p").agg(F.min("d").alias("least"))
        stay = (F.col("d") > near + slack) | (F.col("d") >= F.col("least") - near - slack)
        both = cells.join(rest, ["region", "p"]).filter(stay).select("region", F.col("p").alias("cell"), "x").unionByName(far)
        left = stored(both.select(F.xxhash64("region", "cell").alias("region"), F.col("x").alias("node")), "jaccard-left")
        if left.isEmpty():
            return edges
        regions = stored(_open(left, connected_components(edges, "x", "p")).join(degree, "node"), "jaccard-open")
        forget(left), forget(tested)
        size = regions.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
        small = regions.join(size.filter(F.col("size") <= SWEEP).select("region"), "region", "left_semi")
        edges = edges.unionByName(stored(_swept(small, sets), "jaccard-swept"))
        regions = regions.join(size.filter(F.col("size") > SWEEP).select("region"), "region", "left_semi")
        if regions.isEmpty():
            return edges
        pivots = min(4 * pivots, 512)


def _open(left: DataFrame, joined: DataFrame) -> DataFrame:
    """region, node, component, kin (members of its component), main (its component is the region's largest) of the regions
    that links do not join yet, equal regions (of several shingles of one family) once. All by partial aggregation."""
    named = left.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    name = F.sum(F.xxhash64("node").cast("decimal(38,0)")).cast("string")
    of = named.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"), name.alias("sum"), F.count(F.lit(1)).alias("size"))
    first = of.filter("least <> most").groupBy("sum", "size").agg(F.min("region").alias("region")).select("region")
    kept = named.join(first, "region")
    kin = kept.groupBy("region", "component").agg(F.count(F.lit(1)).alias("kin"))
    main = kin.groupBy("region").agg(F.max(F.struct("kin", "component"))["component"].alias("main"))
    return kept.join(kin.join(main, "region").withColumn("main", F.col("component") == F.col("main")), ["region", "component"])


def _swept(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """x, p: the links between different components of each region."""
    of = lambda s: regions.join(sets.select("node", "n", "parity"), "node").select("region", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "main", "n", "parity")])
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY)), F.lit(0))
    other = (F.col("component_a") != F.col("component_b")) & (F.col("main_b") | (F.col("node_a") < F.col("node_b")))
    sizes = (F.col("n_a") * DEN >= F.col("n_b") * NUM) & (F.col("n_b") * DEN >= F.col("n_a") * NUM)
    # intersection >= NUM / (NUM + DEN) of both sizes together, so the symmetric difference is at most the rest
    close = differ * (NUM + DEN) <= (DEN - NUM) * (F.col("n_a") + F.col("n_b"))
    a, b = of("a").filter("NOT main_a"), of("b").withColumnRenamed("region", "region_b")
    met = a.join(b, (F.col("region") == F.col("region_b")) & other & sizes & close)
    pairs = stored(met.select(F.least("node_a", "node_b").alias("x"), F.greatest("node_a", "node_b").alias("p")).distinct(), "jaccard-met")
    return _distances(pairs, sets).filter(DEN * F.col("inter") >= NUM * F.col("uni")).select("x", "p")


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, n_shingles, component_id (the least id reachable by links) and node (the set's name) of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    nodes = stored(_nodes(rows, words), "jaccard-nodes")
    members = nodes.filter("grams IS NULL").select("id", "h", "n", "node")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("f")  # an id, if the class has one
    classes = members.filter("node IS NOT NULL").groupBy("node").agg(first)
    regions = stored(_regions(rows, _hot(nodes), words, groups_for(docs.sparkSession, text_bytes(docs, text_col))), "jaccard-regions")
    sets = stored(_sets(rows, classes, regions.select("node").distinct(), words), "jaccard-sets")
    joined = connected_components(_links(regions, sets), "x", "p")
    named = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("f.id").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    # One class may hold a third of all documents: its documents are dealt over several tasks.
    salts = 16
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))).withColumnRenamed("node", "c_node")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    out = salted.join(spread, (F.col("node") == F.col("c_node")) & (salted["salt"] == spread["salt"]), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "node")
