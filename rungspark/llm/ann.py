"""Approximate nearest neighbours by collision-counting hashing.

Vectors are dealt into blocks of bounded size, each of vectors whose lengths differ by a factor of two at most. A block's index holds, for each of a number of directions, the block's
projections as one sorted array. The directions are random orthonormal bases, so that collisions in all of a basis speak of the whole
distance. A query looks at a window around its own projection in every array; the windows widen step by step (virtual
rehashing: a wider window is a coarser bucket centred on the query) and a vector counts one collision for each array in whose
window it lies. Vectors that reach the collision threshold are verified with their exact inner products; widening stops once a
block has given `wanted` of its vectors, or `least` * k in small blocks. Largest inner products become nearest points by
the usual extra coordinate sqrt(M^2 - |x|^2), M being the block's largest norm, which queries have as 0. As a block's lengths are alike, a few very long
vectors elsewhere do not drown the rest in that coordinate. An index works on components divided by the block's largest, queries by their length, so
that no size of numbers overflows; scores are of the vectors as they are.

All rows are indexed and every block is searched. Measured recall: see the tests and README.

Defined results: vectors that are null, zero, of another length than most (the longest of several such lengths), or hold null or
non-finite components take no part; a score beyond the range of doubles is infinite, one that is no number comes last; ties go to the smaller id; repeated ids are separate candidates except for the query's own id;
rows with a null id are neither queries nor candidates; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = 2  # orthonormal bases of directions
THRESHOLD = 0.92  # share of the projections that must collide
WIDEN = 1.06
WANTED = 0.05  # of a block's vectors verified before widening stops, and at least LEAST * k
LEAST = 12
BLOCK = 16384
QUERIES = 16384  # searched by one task at most
SEED = 20


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    x = F.transform(vec_col, lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select(F.col(id_col).alias("id"), x.alias("x"))
        .filter(F.col("x").isNotNull() & (F.size("x") > 0))
        .filter(~bad & F.exists("x", lambda v: v != 0) & F.col("id").isNotNull())
    )


def length_class(x: Column) -> Column:
    """The power of two below a vector's length."""
    largest = F.array_max(F.transform(x, lambda v: F.abs(v)))
    rest = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v / largest) * (v / largest))
    return F.floor(F.log2(largest) + F.log2(rest) / 2).cast("int")


def _matrix(xs: pd.Series) -> np.ndarray:
    return np.array(xs.tolist(), dtype=np.float64).reshape(len(xs), -1)


class BlockIndex:
    """The sorted projections of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bases: int, seed: int):
        self.ids, self.x, self.verified = ids, x, 0
        scaled = x / np.abs(x).max()
        norms = np.einsum("ij,ij->i", scaled, scaled)
        self.longest = float(np.sqrt(norms.max()))
        lifted = np.hstack([scaled, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]])
        draw = np.random.default_rng(seed)
        self.dirs = np.hstack([np.linalg.qr(draw.standard_normal((lifted.shape[1],) * 2))[0] for _ in range(bases)])
        p = (lifted @ self.dirs).T
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(p, self.order, axis=1)
        self.spread = float(p.std()) or 1.0

    def search(self, q: np.ndarray, own: np.ndarray, k: int, threshold: float, wanted: float, widen: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its number, the places of its k nearest verified vectors, their inner products."""
        n, m = len(self.ids), len(self.sorted)
        least, need = int(np.ceil(threshold * m)), min(n, max(LEAST * k, int(np.ceil(wanted * n))))
        # A query's length is free, its order of inner products stays: it is made that of the longest vector.
        shape = q / np.abs(q).max(axis=1, keepdims=True)
        shape *= self.longest / np.sqrt((shape**2).sum(1, keepdims=True))
        qp = (shape @ self.dirs[:-1]).T
        rungs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def windows(rung: int) -> tuple[np.ndarray, np.ndarray]:
            """All queries' windows in all arrays at a width of the ladder."""
            if rung not in rungs:
                width = 0.25 * self.spread * widen**rung
                rungs[rung] = tuple(
                    np.array([np.searchsorted(a, c + sign * width, side) for a, c in zip(self.sorted, qp, strict=True)]) for sign, side in ((-1, "left"), (1, "right"))
                )
            return rungs[rung]

        rung = 12
        for i in range(len(q)):
            rung = max(0, rung - 3)  # from just below where the query before ended; a wider first window only adds candidates
            while True:
                lo, hi = (w[:, i] for w in windows(rung))
                # What lies outside the windows is less: collisions are the arrays without it.
                outside = [part for o, x, y in zip(self.order, lo, hi, strict=True) for part in (o[:x], o[y:])]
                hits = m - np.bincount(np.concatenate(outside), minlength=n)
                found = np.flatnonzero(hits >= least)
                if len(found) >= need:
                    break
                rung += 1
            self.verified += len(found)
            with np.errstate(over="ignore", invalid="ignore"):
                score = self.x[found] @ q[i]
            keep = self.ids[found] != own[i]
            found, score = found[keep], score[keep]
            best = np.lexsort((self.ids[found], -score))[:k]
            yield i, found[best], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, bases: int = BASES, threshold: float = THRESHOLD, wanted: float = WANTED, widen: float = WIDEN, seed: int = SEED) -> DataFrame:
    """vectors, queries: id, x (see usable()). query_id, rank, vec_id, score of the k nearest found."""
    spark = vectors.sparkSession
    # The usual length and the counts of the classes of length: numbers that size the blocks. Doubles have some 2,100 such classes, not more.
    sizes = vectors.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "dim")).alias("m")).first().m
    dim, nq = most.dim if most else 0, queries.count()
    counts = vectors.filter(F.size("x") == F.lit(dim)).groupBy(length_class(F.col("x")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    places, blocks = [], 0
    for row in sorted(counts, key=lambda r: r.c):
        parts = -(-row.n // block)
        places.append((row.c, blocks, parts))
        blocks += parts
    blocks = max(blocks, 1)
    # The queries are dealt too: into as many groups as keep all cores busy, and at most QUERIES in one.
    groups = max(1, min(nq, max(-(-nq // QUERIES), -(-spark.sparkContext.defaultParallelism * 2 // blocks))))
    mixed = F.xxhash64("id", "x", F.lit(seed))
    usual = lambda df: df.filter(F.size("x") == F.lit(dim))
    table = F.broadcast(spark.createDataFrame(places, "c int, first int, parts int"))
    placed = usual(vectors).withColumn("c", length_class(F.col("x"))).join(table, "c").withColumn("b", F.col("first") + F.pmod(mixed, F.col("parts"))).drop("c", "first", "parts")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))
    # Each group of queries goes to each block of vectors: the stated query set against all rows, block by block.
    asked = queries.select(F.col("id").alias("id"), F.col("x").alias("x"))  # names of its own, as queries are mostly rows of vectors
    left, right = placed.withColumn("g", every(groups)), usual(asked).withColumn("g", F.pmod(mixed, F.lit(groups))).withColumn("b", every(blocks))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values("id", kind="stable")
            ids = left["id"].to_numpy()
            index = BlockIndex(ids, _matrix(left["x"]), bases, seed)
            q, own = _matrix(right["x"]), right["id"].to_numpy()
            for a in range(0, len(q), 256):  # windows of so many queries are held at once
                for i, found, score in index.search(q[a : a + 256], own[a : a + 256], k, threshold, wanted, widen):
                    columns["query_id"].append(np.full(len(found), own[a + i]))
                    columns["vec_id"].append(ids[found])
                    columns["score"].append(score)
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in columns.items()})

    id_type = vectors.schema["id"].dataType.simpleString()
    part = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(search, f"query_id {id_type}, vec_id {id_type}, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
