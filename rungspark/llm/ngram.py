"""Language-model scoring by deleted interpolation.

The score of a token w after v is l2(b) c(v w)/c(v) + l1(b) c(w)/N + l0(b)/(V+1), b being the bucket of c(v) (by powers of
two). The weights l come from expectation-maximisation on held-out counts: every training token in turn is held out of the
counts it contributed to (c - 1), and these events, gathered over the whole corpus as a histogram of known size, are what
the weights are fitted to. A text begins after an end token and closes with one.

How the counts travel: documents are packed into chunks of bounded size; a chunk sends each of its distinct words and
word pairs once, as sorted 64-bit hashes with counts, to the partition that owns the hash; owners add up and answer each
chunk in its own order. Nothing is kept per key in the JVM, no key's occurrences meet in one task except as one number
from each chunk, and the driver gets three totals and the histogram.

Defined results: a null text is an empty text, which is one end token; documents with a null id are scored; with no
training document every count is 0 and the base is uniform. Repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, give_back, groups_for, mix64, stored, text_bytes, words_of

END = np.uint64(0x9D5F1A3B7C2E4D61)  # the end token's hash
CHUNK_TOKENS = 2_000_000
MAX_BUCKET = 40
LEVELS = 4  # histogram levels for each factor of two
_ids = WordIds()


def _pack(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _planes(sorted_keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane: the upper planes compress to nothing."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0))
    return _pack(steps.view(np.uint8).reshape(-1, 8).T)


def _keys(b: bytes) -> np.ndarray:
    planes = _unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(mix64(v) + w * np.uint64(0x9E3779B97F4A7C15))


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """Documents packed into chunks: chunk id, ids, train flags, token counts, the distinct words' hashes, the tokens as places among these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        ids, train, tokens, size = [], [], [], 0

        def flush() -> pd.DataFrame:
            flat = np.concatenate(tokens)
            words, at = np.unique(flat, return_inverse=True)
            return pd.DataFrame({
                "chunk": [task * 1_000_000 + nth], "ids": [np.array(ids, object)], "train": [np.array(train, bool)], "lengths": [_pack(np.array([len(t) for t in tokens], np.int64))],
                "words": [_planes(words)], "tokens": [_pack(at.astype(np.int32))],
            })

        for b in batches:
            for i, t, text in zip(b["id"], b["train"], b["text"], strict=True):
                doc = np.append(_ids.of(words_of(text)), END)
                if size and size + len(doc) > chunk_tokens:
                    yield flush()
                    ids, train, tokens, size, nth = [], [], [], 0, nth + 1
                ids.append(None if pd.isna(i) else i), train.append(bool(t)), tokens.append(doc)
                size += len(doc)
        if tokens:
            yield flush()
        tokens.clear()
        give_back()

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInPandas(run, f"chunk long, ids array<{id_type}>, train array<boolean>, lengths binary, words binary, tokens binary")


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, token places, history places, distinct pairs' keys (sorted), each token's place among them, train flag of each token, lengths."""
    words, at, lengths = _keys(row.words), _unpack(row.tokens, np.int32).astype(np.int64), _unpack(row.lengths, np.int64)
    end = int(np.searchsorted(words, END))
    before = np.concatenate([[end], at[:-1]])  # what stands before a text's first token is the end of the text before it
    local, pair = np.unique(before * len(words) + at, return_inverse=True)
    keys = pair_key(words[local // len(words)], words[local % len(words)])
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return words, at, before, keys[order], place[pair], np.repeat(np.asarray(row.train, bool), lengths), lengths


def _owner(keys: np.ndarray, n: int) -> np.ndarray:
    """The owner of a key, rising with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _sent(chunks: DataFrame, owners: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                words, at, _, pairs, pair, train, _ = _opened(row)
                for order, keys, place in ((1, words, at), (2, pairs, pair)):
                    counts = np.bincount(place[train], minlength=len(keys)).astype(np.uint32)
                    cuts = np.searchsorted(_owner(keys, owners), np.arange(owners + 1))
                    parts = [k for k in range(owners) if cuts[k] < cuts[k + 1]]
                    yield pd.DataFrame({
                        "owner": parts, "chunk": row.chunk, "order": order,
                        "keys": [_planes(keys[cuts[k] : cuts[k + 1]]) for k in parts], "counts": [_pack(counts[cuts[k] : cuts[k + 1]]) for k in parts],
                    })

    return chunks.mapInPandas(run, "owner int, chunk long, order int, keys binary, counts binary")


def _answered(sent: DataFrame, owners: int) -> DataFrame:
    """For each chunk, owner and order the corpus totals of its keys; in rows of chunk -1 the owner's number of tokens and of distinct words in training."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for order, rows in part.groupby("order"):
            keys = [_keys(k) for k in rows["keys"]]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(at, weights=np.concatenate([_unpack(c, np.uint32) for c in rows["counts"]]), minlength=len(distinct)).astype(np.int64)
            if order == 1:
                out.append((-1, part["owner"].iloc[0], 0, b"", int(totals.sum()), int((totals > 0).sum())))
            ends = np.cumsum([0, *map(len, keys)])
            out += [(c, o, order, _pack(totals[at[s:e]]), 0, 0) for c, o, s, e in zip(rows["chunk"], rows["owner"], ends, ends[1:])]
        return pd.DataFrame(out, columns=["chunk", "owner", "order", "totals", "n", "v"])

    return sent.repartition(owners, "owner").groupBy("owner").applyInPandas(run, "chunk long, owner int, order int, totals binary, n long, v long")


def _with_totals(chunks: DataFrame, answers: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(row, opened, c(w), c(v), c(v w) of each token) for each chunk."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples())
        opened = _opened(row)
        by = {}
        for order in (1, 2):
            rows = right[right["order"] == order].sort_values("owner")
            by[order] = np.concatenate([_unpack(t, np.int64) for t in rows["totals"]])
        return work(row, opened, by[1][opened[1]], by[1][opened[2]], by[2][opened[4]])

    return chunks.groupBy("chunk").cogroup(answers.filter("chunk >= 0").groupBy("chunk")).applyInPandas(run, schema)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(c + 1.0)), MAX_BUCKET).astype(np.int64)


def _weights(events: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation for each bucket. events: bucket, level of p2, level of p1 (0: probability 0), number."""
    lam = np.full((MAX_BUCKET + 1, 3), [0.4, 0.5, 0.1])
    if len(events):
        b, n = events["b"].to_numpy(), events["n"].to_numpy().astype(float)
        p = np.stack([np.where(events[c] > 0, 2.0 ** (-(events[c] - 1) / LEVELS), 0.0) for c in ("l2", "l1")] + [np.full(len(b), uniform)], axis=1)
        for _ in range(rounds):
            share = lam[b] * p
            share *= (n / share.sum(1))[:, None]
            total = np.stack([np.bincount(b, weights=share[:, i], minlength=MAX_BUCKET + 1) for i in range(3)], axis=1) + [0.01, 0.01, 0.01]
            lam = total / total.sum(1, keepdims=True)
    return lam


def _level(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    ok = (num > 0) & (den > 0)
    return np.where(ok, 1 + np.round(-np.log2(np.where(ok, num, 1) / np.where(ok, den, 1)) * LEVELS), 0).astype(np.int64)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every whole text; learns from rows whose `train_col` is true."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train_col, F.lit(False)).alias("train"))
    chunks = stored(_chunks(rows, chunk_tokens), "lm-chunks")
    owners = groups_for(spark, text_bytes(docs, text_col))
    answers = stored(_answered(_sent(chunks, owners), owners), "lm-totals")
    n, v = (x or 0 for x in answers.filter("chunk < 0").agg(F.sum("n"), F.sum("v")).first())

    def events(row, opened, cw, cv, cvw) -> pd.DataFrame:
        train = opened[5]
        cw, cv, cvw = cw[train] - 1, cv[train] - 1, cvw[train] - 1  # this token itself is held out
        code = (_bucket(cv) * 1024 + _level(cvw, cv)) * 1024 + _level(cw, np.full(len(cw), max(n - 1, 1)))
        code, number = np.unique(code, return_counts=True)
        return pd.DataFrame({"code": code, "n": number})

    histogram = _with_totals(chunks, answers, events, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    code = histogram["code"].to_numpy(np.int64)
    uniform = 1.0 / (v + 1)
    lam = _weights(pd.DataFrame({"b": code >> 20, "l2": code >> 10 & 1023, "l1": code & 1023, "n": histogram["n"]}), uniform)

    def final(row, opened, cw, cv, cvw) -> pd.DataFrame:
        lengths, weight = opened[6], lam[_bucket(cv)]
        p = weight[:, 0] * cvw / np.maximum(cv, 1) + weight[:, 1] * cw / max(n, 1) + weight[:, 2] * uniform
        starts = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has a token at least
        return pd.DataFrame({
            id_col: list(row.ids), "n_tokens": lengths, "n_known": add((cw > 0).astype(np.int64)), "train_tokens": n,
            "base_score": add(np.log10((cw + 1.0) / (n + v + 1.0))), "score": add(np.log10(p)),
        })

    return _with_totals(chunks, answers, final, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
