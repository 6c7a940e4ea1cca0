"""Vector codes: a codebook for each part of the vectors, learned and applied in exact integers.

Components become floor(scale * x). A vector is cut into equal consecutive parts; each part position has a codebook that starts as that
part of the vectors with the least ids and is improved by rounds of assignment and floored means. A part's nearest entry is found by
segment-mean lower bounds: at each level of ever finer segments, the distance of two parts is at least

    sum over segments of length * (mean - mean')^2  +  (norm of what the means leave - that of the other)^2

The coarsest level names a likely entry, whose exact distance is the mark; entries whose bound lies above it fall out, level by level, and
what is left gets exact integer distances. Bounds are taken with a margin for rounding, so no entry that could win is lost.

In each round tasks add up the parts of their vectors by entry, Spark adds those sums (as many rows as there are entries) and the driver
holds the codebooks alone: parts * entries * width numbers, a bound set by parameters. Every vector is read in every round.

Defined results: vectors that are null, empty, of another length than most (the longest of several such lengths) or hold null or
non-finite components take no part; a length that parts do not divide is filled up with zeros; integer components beyond
+-isqrt(2^62 / length) / 2 (2^27 for 64) count as that bound, so that squared distances fit 64 bits; with fewer vectors than entries
each is an entry; null ids come last and equal ids go by their vectors; repeated rows count each; equal distances go to the lower
entry; a sum of a label's errors beyond 64 bits is 2^63 - 1; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import FEW
from .common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MARGIN = 1e-6  # of norms, for what rounding can do to the norm of a remainder


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, x, label of the rows that take part, whatever their length."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), x.alias("x"), F.col(label_col).alias("label")).filter(F.col("x").isNotNull() & (F.size("x") > 0)).filter(~bad)


@dataclass(frozen=True)
class Codebooks:
    length: int  # of a vector
    scale: int
    entries: np.ndarray  # parts x entries x width

    def integers(self, xs: pd.Series) -> np.ndarray:
        """vectors x parts x width; huge components become the bound."""
        most = isqrt(2**62 // max(self.length, 1)) // 2
        parts, _, width = self.entries.shape
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(np.array(xs.tolist(), np.float64).reshape(len(xs), self.length) * self.scale), -most, most).astype(np.int64)
        return np.pad(whole, ((0, 0), (0, parts * width - self.length))).reshape(len(xs), parts, width)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class SegmentMeans:
    """Coarse-to-fine segment means and remainder norms of rows of integers."""

    def __init__(self, x: np.ndarray):
        self.x, width = x, x.shape[1]
        squares = (x.astype(np.float64) ** 2).sum(1)
        self.norm, self.levels, n = np.sqrt(squares), [], 1
        while n < width:
            at = np.arange(n) * width // n
            lengths = np.diff(np.append(at, width)).astype(np.float64)
            scaled = np.add.reduceat(x, at, axis=1) / np.sqrt(lengths)  # squared differences of these are length * (mean - mean')^2
            self.levels.append((scaled, np.sqrt(np.maximum(squares - (scaled**2).sum(1), 0))))
            n *= 2


def _bound(a: SegmentMeans, b: SegmentMeans, level: int, i, j) -> np.ndarray:
    """No more than the squared distance of row i of a and row j of b."""
    (ma, ra), (mb, rb) = a.levels[level], b.levels[level]
    apart = np.maximum(np.abs(ra[i] - rb[j]) - MARGIN * (a.norm[i] + b.norm[j]), 0)
    return (((ma[i] - mb[j]) ** 2).sum(-1) + apart**2) * (1 - 1e-9)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, its exact squared distance, and how many exact distances that took."""
    exact = lambda i, j: ((x[i] - book[j]) ** 2).sum(1)
    a, b, every = SegmentMeans(x), SegmentMeans(book), np.arange(len(x))
    i, j = np.divmod(np.arange(len(x) * len(book)), len(book))
    if a.levels:
        coarse = _bound(a, b, 0, i, j)
        mark = exact(every, coarse.reshape(len(x), -1).argmin(1)).astype(np.float64)
        stays = coarse <= mark[i]
        i, j = i[stays], j[stays]
        for level in range(1, len(a.levels)):
            stays = _bound(a, b, level, i, j) <= mark[i]
            i, j = i[stays], j[stays]
    found = np.full((len(x), len(book)), np.iinfo(np.int64).max)
    found[i, j] = exact(i, j)
    code = found.argmin(1)  # the first of equals
    return code, found[every, code], len(i)


def _chunks(batches: Iterator[pd.DataFrame], rows: int = 8192) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def of_usual_length(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the length that most have, and that length (0: there are none)."""
    most = vectors.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "length")).alias("m")).first().m
    length = most.length if most else 0
    return vectors.filter(F.size("x") == F.lit(length)), length


def fit(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """vectors: id, x, all of one length (see usable(), of_usual_length())."""
    width = -(-length // parts)
    books = Codebooks(length, scale, np.zeros((parts, 0, width), np.int64))
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).toPandas()["x"]
    books = Codebooks(length, scale, books.integers(first).transpose(1, 0, 2).copy())
    held = books.entries.shape[1]
    names = ["n", *[f"s{i}" for i in range(width)]]
    for _ in range(rounds if held else 0):

        def added(batches: Iterator[pd.DataFrame], books: Codebooks = books) -> Iterator[pd.DataFrame]:
            total = np.zeros((parts * held, width + 1), np.int64)
            for b in _chunks(batches):
                x = books.integers(b["x"])
                for p in range(parts):
                    code, _, _ = nearest_entries(x[:, p], books.entries[p])
                    np.add.at(total, p * held + code, np.column_stack([np.ones(len(x), np.int64), x[:, p]]))
            there = np.flatnonzero(total[:, 0])
            yield pd.DataFrame(total[there], columns=names).assign(entry=there)

        sums = vectors.select("x").mapInPandas(added, ", ".join(f"{c} long" for c in names) + ", entry long")
        sums = sums.groupBy("entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names])
        improved = books.entries.copy()
        for row in sums.collect():  # parts * entries rows at most
            improved[divmod(row.entry, held)] = [int(row[c]) // int(row.n) for c in names[1:]]
        books = Codebooks(length, scale, improved)
    return books


def encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code (an entry's number for each part), error (the squared distances, summed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _chunks(batches):
            x = books.integers(b["x"])
            found = [nearest_entries(x[:, p], book) for p, book in enumerate(books.entries)]
            codes = np.column_stack([code for code, _, _ in found]).astype(np.int32)
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "code": list(codes), "error": sum(d for _, d, _ in found)})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("id", "label", "x").mapInPandas(run, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """encoded() with label_error, the errors of all rows of the same label (nulls together)."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = stored(codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= FEW else sums  # more labels: both sides are shuffled, hot labels split
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).drop("of")


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """id, label, code, error, label_error of every vector that usable() gives, and the codebooks."""
    vectors, length = of_usual_length(vectors)
    books = fit(vectors, length, parts, entries, rounds, scale)
    return with_label_errors(stored(encoded(vectors, books), "vector-codes")), books
