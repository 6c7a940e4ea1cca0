"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Random indexing: every text has a sparse random vector that follows from a hash of it; a word's vector is the sum of the
vectors of the texts it occurs in, over the whole corpus. Words are hashed to a fixed number of rows (WORD_ROWS: so many at any
corpus size, words that meet in a row share its vector), so the table has a known size. A word counts as two: its lower-case letters,
and its shape (runs of capitals, small letters, digits and punctuation), which has rows of its own. A document's features are the
idf-weighted mean of its words' unit vectors; a tanh layer and a logistic unit turn them into a score, whose
temperature is fitted on labelled rows that the network was not trained on.

Defined results: null and empty texts have all-zero features and get the score these give; unlabelled documents count
in the word vectors, not in the training; with no usable labels, or one class only, every score is the share of label 1
(0.5 if none). Repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64, summed

WORD_ROWS, SHAPE_ROWS = 28 * 1024, 4 * 1024
ROWS = WORD_ROWS + SHAPE_ROWS
DIM = 64
NONZERO = 4
HIDDEN = 32
SAMPLE = 20_000  # labelled documents the network is fitted on, at most: the bound of the training sample
SEED = 7


def _shape(word: str) -> str:
    out, last = [], ""
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


class Rows(dict):
    """Word -> its two rows, packed in one integer; remembered up to a bounded number of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        core = "".join(c for c in word.lower() if c.isalnum())
        a = xxhash.xxh64_intdigest(core.encode("utf-8", "surrogatepass"), 1) % WORD_ROWS
        b = WORD_ROWS + xxhash.xxh64_intdigest(_shape(word).encode("utf-8", "surrogatepass"), 2) % SHAPE_ROWS
        value = a * ROWS + b
        if len(self) < 400_000:
            self[word] = value
        return value


_rows = Rows()


def _batch_rows(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all words of all texts, one after the other, and each text's number of rows."""
    packed, lengths = [], []
    for text in texts:
        words = text.split() if text else []
        packed.append(np.fromiter(map(_rows.__getitem__, words), np.int64, len(words)))
        lengths.append(2 * len(words))
    flat = np.concatenate(packed) if packed else np.empty(0, np.int64)
    return np.stack([flat // ROWS, flat % ROWS], axis=1).ravel(), np.array(lengths, np.int64)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and idf weights of all rows, summed over the whole corpus. ROWS x (DIM + 1) numbers reach the driver."""

    def partial(b: pd.DataFrame) -> np.ndarray:
        import xxhash

        rows, lengths = _batch_rows(b["text"])
        number = np.repeat(np.arange(len(b)), lengths)
        pairs = np.unique(number * ROWS + rows)  # a word counts once in a text
        number, rows = pairs // ROWS, pairs % ROWS
        seeds = np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), SEED) for t in b["text"]], np.uint64)
        total = np.zeros(ROWS * (DIM + 1))
        for j in range(NONZERO):
            draws = mix64(seeds + np.uint64(j))
            dims, signs = (draws % np.uint64(DIM)).astype(np.int64), np.where(draws >> np.uint64(63), 1.0, -1.0)
            total += np.bincount(rows * (DIM + 1) + dims[number], weights=signs[number], minlength=len(total))
        total[DIM :: DIM + 1] += np.bincount(rows, minlength=ROWS)
        return total.reshape(ROWS, DIM + 1)

    table = summed(docs.select("text"), partial, ROWS, DIM + 1, 65)
    seen = table[:, DIM]
    vectors = table[:, :DIM] / np.maximum(np.linalg.norm(table[:, :DIM], axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32), np.log((1 + seen.max()) / (1 + seen)).astype(np.float32)


def features(texts: pd.Series, vectors: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows, lengths = _batch_rows(texts)
    out = np.zeros((len(lengths), DIM + 1), np.float32)
    weighted = vectors * (0.2 + idf)[:, None]
    ends = np.cumsum(lengths)
    for i, (end, n) in enumerate(zip(ends, lengths, strict=True)):
        if n:
            # counts first: a long text repeats its words
            here = np.bincount(rows[end - n : end], minlength=ROWS) if n > 4096 else None
            out[i, :DIM] = (here @ weighted if here is not None else weighted[rows[end - n : end]].sum(axis=0)) / n
            out[i, DIM] = np.log1p(n) / 10
    return out


class Network:
    """tanh layer + logistic unit + temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = SEED):
        self.share = float(y.mean()) if len(y) else 0.5
        self.parts, self.temperature = None, 1.0
        if len(y) < 10 or self.share in (0.0, 1.0):
            return
        r = np.random.default_rng(seed)
        order = r.permutation(len(y))
        check, fit = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.std = x[fit].mean(0), x[fit].std(0) + 1e-6
        z = (x - self.mean) / self.std
        p = [r.standard_normal((z.shape[1], hidden)) / np.sqrt(z.shape[1]), np.zeros(hidden), r.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            r.shuffle(fit)
            for k in range(0, len(fit), 128):
                xb, yb = z[fit[k : k + 128]], y[fit[k : k + 128]]
                h = np.tanh(xb @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - yb) / len(yb)
                dh = np.outer(d, p[2]) * (1 - h**2)
                t += 1
                for i, g in enumerate((xb.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.parts = p
        logit = self.logit(x[check])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, -np.where(y[check] > 0, 1, -1) * logit / c)) for c in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.tanh(((x - self.mean) / self.std) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, idf: np.ndarray, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> Network:
    """labels: id and label of the rows to learn from; the first `sample` of the labelled texts by hash are used, each text and label once."""
    spark = docs.sparkSession
    picked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y"))
    table = spark.sparkContext.broadcast((vectors, idf))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "x": list(features(b["text"], *table.value))})

    # Labels meet documents by id and hash; only texts that are chosen move, found again by their hash.
    met = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("h")).join(picked.distinct(), F.col("id") == F.col("l_id")).select("h", "y")
    chosen = met.distinct().orderBy("h", "y").limit(sample)  # at most `sample` pairs of numbers go to every task
    found = docs.select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(chosen), "h").groupBy("h", "y").agg(F.min("text").alias("text"))
    rows = found.mapInPandas(run, "h long, y int, x array<float>").toPandas().sort_values(["h", "y"], kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), DIM + 1)
    return Network(x, rows["y"].to_numpy().astype(float))


def scored(docs: DataFrame, network: Network, vectors: np.ndarray, idf: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """id and score (0 to 1) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast((network, vectors, idf))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, v, w = model.value
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "score": net.score(features(b["text"], v, w).astype(np.float64))})
        give_back()

    return docs.select(id_col, "text").mapInPandas(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
