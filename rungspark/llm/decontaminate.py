"""Benchmark decontamination by latent semantic retrieval.

1. TF-IDF (tf * idf^2, which favours rare terms): passages of the corpus (blocks of `PASSAGE` words of every text) over the terms of the benchmark; document
   frequencies are counted over the whole corpus.
2. Distributed randomised SVD of that matrix A: every task adds A_i' (A_i G) for a fixed random G; the sum Y is terms x
   rank, and the leading singular directions follow from Y and G' Y (Nystroem) on the driver.
3. Candidate search: windows of a text, in sizes that follow the items' lengths, are compared by their cosine in the latent
   space. Windows that cannot pass the verification with an item are passed over: at most a share of 1 - LCS of an item's words
   may be missing, so of any so many and k more of its words, k are there. The rarest are taken, and an index from terms to
   items gives the windows where k of them lie close enough; an item that verification would accept is never lost by this.
4. Verification: longest common subsequence of the item's words and the words around the window, and the answer check: the
   item's last words must be there too. Items of fewer than `LEAST_WORDS` words have no latent vector to speak of: all their words
   must be there, one after the other.

There is one latent space for all items, whose terms are the distinct words of the benchmark, as long as these are no more than `MOST_TERMS`: what is broadcast has a
bound. A larger benchmark is halved by hash, and its halves again, until each part keeps to that bound (or is a single item), and every part is searched for in
a space of its own, in blocks of a bounded number of items. Texts are read whole.

Defined results: null and empty texts and items match nothing; words are compared in lower case without ASCII punctuation;
repeated rows match alike (an id is listed once for each item); null ids are reported as they are; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored, summed

PASSAGE = 64
PASSAGES = 1024  # multiplied at once
BLOCK = 6  # words; windows are made of blocks, whose vectors are computed once for all sizes
PIECE = 170_000  # words looked at together
RANK, OVERSAMPLE = 128, 8
ITEMS_A_BLOCK = 20_000  # searched for together
MOST_TERMS = 500_000
LEAST_WORDS = 5
COSINE = 0.25  # low: the verification decides, and few windows are left by then
LCS = 0.6  # of the item's words, in order
ANSWER = 0.5  # of the item's last quarter
SEED = 5
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER, _PUNCTUATION).split() if text else []


def _numbered(rows: DataFrame, terms) -> DataFrame:
    """rows (id, text) as id, ids: the term numbers of a text's words as 32-bit integers, -1 for words that the benchmark does not have. terms: broadcast. Texts are split once;
    frequencies, products and matches read this table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = terms.value.get
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [np.array([get(w, -1) for w in _words(t)], np.int32).tobytes() for t in b["text"]]})
        give_back()

    return stored(rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary"), "benchmark-terms")


class _Terms:
    """Texts of a batch as term numbers (see _numbered())."""

    def __init__(self, texts):
        parts = [np.frombuffer(t, np.int32) for t in texts]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def passages(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Term and passage of each word that is a term; the number of passages."""
        within = np.arange(len(self.ids)) - np.repeat(self.starts, self.lengths)
        per = -(-self.lengths // PASSAGE)
        number = np.repeat(np.cumsum(per) - per, self.lengths) + within // PASSAGE
        known = self.ids >= 0
        return self.ids[known].astype(np.int64), number[known], int(per.sum())

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block of each word, each text's first block and number of blocks (of BLOCK words)."""
        within = np.arange(len(self.ids)) - np.repeat(self.starts, self.lengths)
        per = -(-self.lengths // BLOCK)
        first = np.cumsum(per) - per
        return np.repeat(first, self.lengths) + within // BLOCK, first, per


def _pieces(texts: pd.Series) -> Iterator[pd.Series]:
    """A batch in pieces of about PIECE words."""
    size = (texts.map(len) // 4).cumsum().to_numpy() // PIECE
    cuts = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1]])) if len(texts) else []
    for k, end in zip(cuts, [*cuts[1:], len(texts)], strict=True):
        yield texts.iloc[k:end]


def _sum_over(docs: DataFrame, per_piece, rows: int, columns: int) -> np.ndarray:
    return summed(docs.select("ids"), lambda b: sum(per_piece(piece) for piece in _pieces(b["ids"])), rows, columns)


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each element of `a`."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := at.get(y):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Latent:
    """A block of the benchmark's items in the latent space of the corpus."""

    def __init__(self, terms: dict, items: list[tuple[object, list[bytes]]], idf: np.ndarray, basis: np.ndarray):
        self.terms, self.idf, self.items = terms, idf, items
        self.term_vectors = (basis * (idf**2)[:, None]).astype(np.float32)
        ids = [np.array([terms[w] for w in words]) for _, words in items]
        self.vectors = np.array([self.term_vectors[i].sum(0) for i in ids]).reshape(len(items), -1)
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)
        self.lengths = np.array([len(words) for _, words in items])
        self.must = np.array([n if n < LEAST_WORDS else next(m for m in range(n + 1) if m / n >= LCS) for n in self.lengths.tolist()], np.int64)
        self.sizes = []  # window size in blocks, how many of the terms that count must be there, from each term to the items it counts for
        low, high = (self.lengths.min(), self.lengths.max()) if len(items) else (1, 0)
        while low <= high:
            of = np.flatnonzero((self.lengths >= low) & (self.lengths < np.ceil(low * 1.5)))
            if len(of):
                k = max(1, min(self.must[of]) // 2)
                pairs = [(np.unique(ids[i][np.argsort(-idf[ids[i]], kind="stable")[: self.lengths[i] - self.must[i] + k]]), i) for i in of]
                term, item = np.concatenate([t for t, _ in pairs]), np.repeat(of, [len(t) for t, _ in pairs])
                order = np.argsort(term, kind="stable")
                starts = np.searchsorted(term[order], np.arange(len(idf) + 1))
                self.sizes.append((-(-int(np.ceil(low * 1.5)) // BLOCK), k, starts, item[order]))
            low = int(np.ceil(low * 1.5))

    def _spots(self, t: _Terms, text_of: np.ndarray, per: np.ndarray, m: int, k: int, starts: np.ndarray, listed: np.ndarray) -> np.ndarray:
        """Rows of text, number of the window's first block, item: the windows around which k of an item's counted words lie."""
        stride = max(1, m // 4)
        word = np.flatnonzero(t.ids >= 0)
        n = starts[t.ids[word] + 1] - starts[t.ids[word]]
        word, n = word[n > 0], n[n > 0]
        item = listed[np.repeat(starts[t.ids[word]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        word = np.repeat(word, n)
        order = np.argsort(item, kind="stable")
        item, word = item[order], word[order]
        first, last = word[: max(0, len(word) - k + 1)], word[k - 1 :]
        reach = self.lengths[item[: len(first)]] // 3
        near = (item[: len(first)] == item[k - 1 :]) & (text_of[first] == text_of[last]) & (last - first < m * BLOCK + 2 * reach)
        item, first, last, reach = item[: len(first)][near], first[near], last[near], reach[near]
        text = text_of[first]
        # Windows start at multiples of the stride; what verification reads of them reaches from before the first word to after the last.
        low = -(-(last - t.starts[text] - reach - m * BLOCK + 1) // (BLOCK * stride))
        high = (first - t.starts[text] + reach) // (BLOCK * stride)
        most = -(-np.maximum(per[text] - m, 0) // stride)
        low, high = np.clip(low, 0, most), np.clip(high, 0, most)
        n = np.maximum(high - low + 1, 0)
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.stack([np.repeat(text, n), at * stride, np.repeat(item, n)], axis=1), axis=0)

    def matches(self, texts: pd.Series) -> Iterator[tuple[int, object, float, float]]:
        """Number of the text, item id, share of the item's words in order, cosine."""
        t = _Terms(texts)
        if not len(t.ids):
            return
        known = t.ids >= 0
        block, text_first, per = t.blocks()
        text_of = np.repeat(np.arange(len(t.lengths)), t.lengths)
        word_at = np.searchsorted(block, np.arange(int(per.sum()) + 1))  # the first word of each block
        looked, needed = [], np.zeros(len(word_at), np.int64)
        for m, k, starts, listed in self.sizes:
            spots = self._spots(t, text_of, per, m, k, starts, listed)
            if len(spots):
                text, first, item = spots.T
                end = text_first[text] + np.minimum(first + m, per[text])
                first = text_first[text] + first
                looked.append((text, first, end, item))
                np.add.at(needed, first, 1)
                np.add.at(needed, end, -1)
        needed = np.cumsum(needed[:-1]) > 0
        sums = np.zeros((int(needed.sum()) + 1, self.term_vectors.shape[1]))  # running sums over the needed blocks
        place = np.cumsum(needed) - 1
        words = np.flatnonzero(known & needed[block])
        for k in range(0, len(words), 100_000):
            w = words[k : k + 100_000]
            row = place[block[w]]
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sums[row[starts] + 1] += np.add.reduceat(self.term_vectors[t.ids[w]], starts, axis=0)
        np.cumsum(sums, axis=0, out=sums)
        found: dict[tuple[int, int], list] = {}
        for text, first, end, item in looked:
            for k in range(0, len(text), 8192):
                f, e, i = first[k : k + 8192], end[k : k + 8192], item[k : k + 8192]
                v = (sums[place[e - 1] + 1] - sums[place[f]]).astype(np.float32)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                cosine = np.einsum("ij,ij->i", v, self.vectors[i])
                for w in np.flatnonzero((cosine >= COSINE) | (self.lengths[i] < LEAST_WORDS)):
                    found.setdefault((int(text[k + w]), int(i[w])), []).append((float(cosine[w]), int(word_at[f[w]]), int(word_at[e[w]])))
        for (n, i), spots in sorted(found.items()):
            item_id, words = self.items[i]
            item = [self.terms[w] for w in words]
            tail = item[-max(3, len(item) // 4) :]
            start, stop = t.starts[n], t.starts[n] + t.lengths[n]
            best = (0.0, 0.0)
            for cosine, a, b in sorted(spots, reverse=True):
                around = t.ids[max(start, a - len(item) // 3) : min(stop, b + len(item) // 3)].tolist()
                share = _lcs(item, around) / len(item) if len(item) >= LEAST_WORDS else float(any(around[x : x + len(item)] == item for x in range(len(around))))
                there = set(around)
                if share >= LCS and sum(x in there for x in tail) >= ANSWER * len(tail):
                    best = max(best, (share, cosine))
                    if share == 1:
                        break
            if best[0]:
                yield n, item_id, *best


def _space(docs: DataFrame, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """idf of the terms and their coordinates in the latent space of the corpus. docs: see _numbered()."""

    def frequencies(texts: pd.Series) -> np.ndarray:
        ids, passage, n = _Terms(texts).passages()
        pairs = np.unique(passage * n_terms + ids)
        return np.append(np.bincount(pairs % n_terms, minlength=n_terms), n).astype(float)[:, None]

    df = _sum_over(docs, frequencies, n_terms + 1, 1)[:, 0]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-3
    rank = min(RANK + OVERSAMPLE, n_terms)
    probe = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n_terms, rank)))[0]

    weighted = (probe * (idf**2)[:, None]).astype(np.float32)

    def products(texts: pd.Series) -> np.ndarray:
        ids, passage, n = _Terms(texts).passages()
        out = np.zeros((n_terms, rank))
        cuts = np.searchsorted(passage, np.arange(0, n + PASSAGES, PASSAGES))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            i, p = ids[a:b], passage[a:b]
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            rows = np.add.reduceat(weighted[i], starts, axis=0)  # each passage times the random matrix
            at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p))))
            order = np.argsort(i, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]]))
            term = i[order][first]
            out[term] += np.add.reduceat(rows[at[order]], first, axis=0) * (idf[term] ** 2)[:, None]
        return out

    y = _sum_over(docs, products, n_terms, rank)
    # Nystroem: A'A ~ Y (G'Y)^-1 Y'; directions without energy are held above zero.
    inner = probe.T @ y
    energy, axes = np.linalg.eigh((inner + inner.T) / 2)
    root = axes / np.sqrt(np.maximum(energy, 1e-10 * max(energy.max(), 1e-300)))
    # The directions alone, not over their singular values: an item that leaked often is a strong direction itself.
    return idf, np.linalg.svd(y @ root, full_matrices=False)[0][:, :RANK]


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_terms: int = MOST_TERMS, seed: int = 0
) -> DataFrame:
    """doc id, item_id, lcs (share of the item's words found in order), cosine: one row for each document and item in it."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = max(1, -(-benchmark.count() // ITEMS_A_BLOCK))
    types = f"id {rows.schema['id'].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, lcs double, cosine double"
    texts = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    spoken = texts.select(F.explode(F.udf(lambda t: list(set(_words(t))), "array<binary>")("text")).alias("w")).distinct()
    if spoken.count() > most_terms and texts.distinct().count() > 1:
        halves = [benchmark.filter(F.pmod(F.xxhash64(item_id, item_text, F.lit(seed)), F.lit(2)) == half) for half in (0, 1)]
        a, b = (matches(docs, half, id_col, text_col, item_id, item_text, most_terms, seed + 1) for half in halves)
        # Rows that are repeated in the benchmark fall into the same half, an id with several texts maybe not.
        return a.unionByName(b).groupBy(id_col, "item_id").agg(F.max("lcs").alias("lcs"), F.max("cosine").alias("cosine"))
    terms = {w: k for k, w in enumerate(sorted(bytes(r.w) for r in spoken.collect()))}
    if terms:
        rows = _numbered(rows, docs.sparkSession.sparkContext.broadcast(terms))
    space = _space(rows, len(terms)) if terms else None
    out = None
    for block in range(blocks):
        part = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = sorted(((r.item_id, _words(r.text)) for r in part.collect()), key=lambda x: (x[0] is None, x[0], x[1]))
        items = [x for x in items if x[1]]
        if not items:
            continue
        model = docs.sparkSession.sparkContext.broadcast(Latent(terms, items, *space))

        def run(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            for b in batches:
                for texts in _pieces(b["ids"]):
                    hits = list(model.value.matches(texts))
                    yield pd.DataFrame({"id": b.loc[texts.index, "id"].iloc[[h[0] for h in hits]].to_numpy(), **{c: [h[i] for h in hits] for i, c in ((1, "item_id"), (2, "lcs"), (3, "cosine"))}})
            give_back()

        found = rows.mapInPandas(run, types)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], types)
    return out.groupBy(F.col("id").alias(id_col), "item_id").agg(F.max("lcs").alias("lcs"), F.max("cosine").alias("cosine"))
