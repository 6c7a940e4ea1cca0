"""Edit-aware token counts.

A text is split into pre-tokens (the tokenizer's own pattern); leaves of `LEAF` pre-tokens hold their length in characters and
their number of tokens, and a segment tree over the leaves holds the sums. An edit replaces a range of characters. Only
pre-tokens from the last boundary that the edit cannot have moved (one character of context before it) to the first old
boundary that the new text meets again can differ. Leaves keep sums, so the leaves that hold these pre-tokens are walked through as a whole; what is then in
them is cut into leaves of `LEAF` again, however much was inserted, and the sums above are updated. `chars_encoded` is all that was walked through.

Defined results: null and empty texts have no tokens and one empty leaf; edits apply one after the other to the text as it is by
then, their ranges are clipped to it, and a null insert inserts nothing; a null list of edits changes nothing; repeated rows
are counted alike; further columns are ignored; white space and very long words are pre-tokens like any other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a parameter; the file is never copied
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
MEMORY = 500_000  # pre-tokens whose counts a worker remembers


class Encoder:
    """Token counts of pre-tokens; a merge never crosses a pre-token's boundary, so a text's count is their sum."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.coder = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        return cls._by_path.get(path) or cls._by_path.setdefault(path, cls(path))

    def count(self, pre_token: str) -> int:
        n = self.known.get(pre_token)
        if n is None:
            n = len(self.coder.encode_ordinary(pre_token))
            if len(self.known) < MEMORY:
                self.known[pre_token] = n
        return n


class Tree:
    """The leaves' lengths and counts, and the sums of both in a segment tree (the leaf i at place size + i)."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = max(1, len(chars))
        self.size = 1 << (self.n - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(chars)] = chars
        self.tokens[self.size : self.size + len(tokens)] = tokens
        for i in range(self.size - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.size + leaf
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i >>= 1
            self._add(i)

    def splice(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Puts other leaves in the place of the leaves first to last: as many as these, and only the sums above them change."""
        if len(chars) == last - first + 1:
            for i, (c, n) in enumerate(zip(chars, tokens, strict=True)):
                self.put(first + i, c, n)
            return
        mine, counts = self.leaves()
        self.__init__(mine[:first] + chars + mine[last + 1 :], counts[:first] + tokens + counts[last + 1 :])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one, for the text's end), and where that leaf starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if char >= start + self.chars[i] and start + self.chars[i] < self.chars[1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size : self.size + self.n], self.tokens[self.size : self.size + self.n]


def built(text: str, encoder: Encoder, leaf: int = LEAF) -> Tree:
    pre = encoder.pattern.findall(text)
    known, count = encoder.known.get, encoder.count
    tokens = np.array([known(p) or count(p) for p in pre], np.int64)
    chars = np.array(list(map(len, pre)), np.int64)
    at = np.arange(0, len(pre), leaf)
    return Tree(np.add.reduceat(chars, at).tolist() if len(pre) else [0], np.add.reduceat(tokens, at).tolist() if len(pre) else [0])


def edited(text: str, tree: Tree, start: int, stop: int, insert: str, encoder: Encoder, leaf: int = LEAF) -> tuple[str, int]:
    """The new text, and how many characters were walked through to count it; the tree is updated."""
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    new, shift = text[:start] + insert + text[stop:], len(insert) - (stop - start)
    # Old boundaries from the leaf of the character before the edit's context on.
    first, base = tree.leaf_at(max(0, start - 2))
    old = [base]
    last, end = first, base + tree.chars[tree.size + first]
    # A pre-token depends on its characters and the one after it: those that end at least 2 before the edit stay.
    at = base
    while True:
        m = encoder.pattern.match(text, at)
        if m is None or m.end() + 2 > start:
            break
        at = m.end()
        old.append(at)
    # What lies before `at` in the first leaf keeps its tokens.
    lengths, counts = [b - a for a, b in zip(old, old[1:])], [encoder.count(text[a:b]) for a, b in zip(old, old[1:])]
    begin, here, walk = at, at, at  # walk: along the old text's boundaries
    while here < len(new):
        if here - shift >= stop and here > begin:
            while walk < here - shift:
                walk = encoder.pattern.match(text, walk).end()
            if walk == here - shift:
                break
        m = encoder.pattern.match(new, here)
        lengths.append(m.end() - here)
        counts.append(encoder.count(m.group()))
        here = m.end()
    met = max(here - shift, stop)  # where the old text goes on unchanged
    while end < met:
        last += 1
        end += tree.chars[tree.size + last]
    # The rest of the last leaf touched keeps its pre-tokens.
    a = met
    while a < end:
        m = encoder.pattern.match(text, a)
        lengths.append(m.end() - a)
        counts.append(encoder.count(m.group()))
        a = m.end()
    cut = range(0, len(lengths), leaf)
    tree.splice(first, last, [sum(lengths[i : i + leaf]) for i in cut], [sum(counts[i : i + leaf]) for i in cut])
    return new, sum(lengths)


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, leaf: int = LEAF) -> DataFrame:
    """id, text, leaf_chars, leaf_tokens, n_tokens of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.at(path)
        for b in batches:
            done = [built(t or "", encoder, leaf) for t in b["text"]]
            leaves = [t.leaves() for t in done]
            yield b.assign(leaf_chars=[x[0] for x in leaves], leaf_tokens=[x[1] for x in leaves], n_tokens=[t.tokens[1] for t in done])

    rows = docs.select(id_col, F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, text string, leaf_chars array<long>, leaf_tokens array<long>, n_tokens long")


def with_edits(counted: DataFrame, edits: str = "edits", id_col: str = "doc_id", path: str = TOKENIZER, leaf: int = LEAF) -> DataFrame:
    """Applies a column of edits (array of struct start, stop, insert; in characters) to trees().

    id, text (new), leaf_chars, leaf_tokens, n_tokens (new), tokens_before, chars_encoded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.at(path)
        for b in batches:
            out = {c: [] for c in ("text", "leaf_chars", "leaf_tokens", "n_tokens", "tokens_before", "chars_encoded")}
            for text, chars, tokens, changes in zip(b["text"], b["leaf_chars"], b["leaf_tokens"], b["edits"], strict=True):
                tree, new, encoded = Tree(list(chars), list(tokens)), text or "", 0
                before = tree.tokens[1]
                for e in changes if changes is not None else ():
                    new, n = edited(new, tree, int(e["start"]), int(e["stop"]), e["insert"] or "", encoder, leaf)
                    encoded += n
                leaves = tree.leaves()
                for c, v in zip(out, (text if text is None and not new else new, *leaves, tree.tokens[1], before, encoded), strict=True):
                    out[c].append(v)
            yield pd.DataFrame({id_col: b[id_col], **out})

    rows = counted.select(id_col, "text", "leaf_chars", "leaf_tokens", F.col(edits).alias("edits"))
    kind = counted.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"`{id_col}` {kind}, text string, leaf_chars array<long>, leaf_tokens array<long>, n_tokens long, tokens_before long, chars_encoded long")
