"""Phrase collocations by hierarchical pair naming.

A word's name is a 64-bit number; a phrase of k words is the pair of the names of its first and its last k - 1 words. Level by level, texts are
read with the names of level k - 1 in place of their words, adjacent names are counted as pairs, Spark adds the counts up, the frequent
pairs make the table of level k, and joins of that table with the one below (by the pair's two names) fetch what the parents have: those
two names are the parent pointers by which cuts find the frequency of every prefix and suffix and by which longer phrases drop what they
subsume. A pair's own name is made from its two names, so that the next level's reader needs no table of all pairs: it asks a Bloom
filter of bounded size which names are frequent. What that lets through too much is dropped by the join with the table.

Names are unique, not only likely so: the names of all words of all groups, and of all frequent pairs of a level, are counted, and should two
share one everything is named again from another seed. Pairs are counted by both names and a check number of all their words, which the join
compares with the parents' words, so that no infrequent pair can pass for a frequent one.

Texts stay where they are (a scan a level); what moves are counts, added up in each task first, so that a word that makes a third of all words
is one row a task. The best of each group are picked in steps of bounded windows.

Defined results: a null text is empty; a null group is `und`; pieces end at separators, phrases never cross them; a group without candidates has no
rows; repeated rows count each; ties go by a descending, then phrase; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, give_back, mix64, stored

LEAST, LONGEST, TOP, MILLION = 10, 3, 2000, 1_000_000
SUBSUMED = 50  # per cent of a phrase's occurrences that a longer one must have
BLOOM_BITS = 1 << 28  # 32 MiB at most
WINDOW_ROWS = 20_000  # of one window task when the best are picked
TOKENS = 1 << 20  # counted at once
SLICE = 4 << 20  # bytes of a text split at once

_U64 = np.uint64
_END = b"\xff"  # stands for a separator: no byte of UTF-8
_TABLE = bytes.maketrans(ASCII_UPPER.encode() + b".,;:!?\x0b\x0c\r\t", ASCII_LOWER.encode() + b"\n" * 9 + b" ")


def tokens_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text with a mark wherever a piece ends, a slice at a time."""
    data, at = text.encode("utf-8").translate(_TABLE), 0
    while at < len(data):
        stop = at + SLICE
        if stop < len(data):
            cut = max(data.rfind(b" ", at, stop), data.rfind(b"\n", at, stop))  # between words; one word of a whole slice stays whole
            while cut < 0 and stop < len(data):
                stop += SLICE
                cut = max(data.rfind(b" ", at, stop), data.rfind(b"\n", at, stop))
            stop = cut if cut >= 0 else len(data)
        yield data[at : max(stop, at + 1)].replace(b"\n", b" " + _END + b" ").split()
        at = max(stop, at + 1)


class Names(dict):
    """Word -> 64-bit name before its group's salt; the mark's is 0. Remembers a bounded number of words."""

    def __init__(self, seed: int, bits: int, most: int = 300_000):
        super().__init__({_END: 0})
        self.seed, self.shift, self.most = seed, 64 - bits, most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = (xxhash.xxh64_intdigest(word, self.seed) >> self.shift) or 1
        if len(self) < self.most:
            self[word] = value
        return value

    def of_group(self, words: np.ndarray, group: str) -> np.ndarray:
        """Names within the group: a one-to-one scrambling that differs between groups."""
        import xxhash

        salted = _kept(mix64(words ^ _U64(xxhash.xxh64_intdigest(group.encode(), self.seed + 1))), self.shift)
        return np.where(words == 0, _U64(0), salted)


def _kept(names: np.ndarray, shift: int) -> np.ndarray:
    return np.maximum(names >> _U64(shift), _U64(1)) if shift else np.maximum(names, _U64(1))


def _joined(a: np.ndarray, b: np.ndarray, shift: int = 0) -> np.ndarray:
    """The name of the pair (a, b)."""
    with np.errstate(over="ignore"):
        return _kept(mix64(mix64(a) * _U64(0x9E3779B97F4A7C15) + b), shift)


class Bloom:
    """A set of names with false members but no false absence."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, _U64(len(bits) * 64 - 1)

    def places(self, names: np.ndarray) -> Iterator[np.ndarray]:
        other = mix64(names ^ _U64(0xD6E8FEB86659FD93))
        with np.errstate(over="ignore"):
            for k in range(3):
                yield (names + _U64(k) * other) & self.mask

    def has(self, names: np.ndarray) -> np.ndarray:
        out = names != 0
        for at in self.places(names):
            out &= (self.bits[at >> _U64(6)] >> (at & _U64(63))) & _U64(1) == 1
        return out


def bloom_of(names: DataFrame, n: int, most_bits: int = BLOOM_BITS) -> np.ndarray:
    """names: one column of longs, about n rows. The filter's words: tasks set bits, Spark joins them by bit_or; at most most_bits / 64 rows reach the driver."""
    size = 1 << 10
    while size < min(most_bits, 16 * n):
        size *= 2
    empty = Bloom(np.zeros(size // 64, _U64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.zeros(size // 64, _U64)
        for b in batches:
            for at in empty.places(b["name"].to_numpy(np.int64).view(_U64)):
                np.bitwise_or.at(mine, (at >> _U64(6)).astype(np.int64), _U64(1) << (at & _U64(63)))
        there = np.flatnonzero(mine)
        yield pd.DataFrame({"at": there, "bits": mine[there].view(np.int64)})

    found = names.select("name").mapInPandas(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, _U64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(_U64)
    return bits


def _texts(docs: DataFrame, text_col: str, group_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("grp"), F.col(text_col).alias("text")).filter(F.length("text") > 0)


def word_counts(texts: DataFrame, seed: int, bits: int) -> DataFrame:
    """grp, word, name, n of every word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, counts = Names(seed, bits), {}

        def out() -> Iterator[pd.DataFrame]:
            for group, mine in counts.items():
                words = list(mine)
                values = names.of_group(np.fromiter(map(names.__getitem__, words), _U64, len(words)), group)
                yield pd.DataFrame({"grp": group, "word": [w.decode() for w in words], "name": values.view(np.int64), "n": list(mine.values())})
            counts.clear()

        for b in batches:
            for group, text in zip(b["grp"], b["text"], strict=True):
                mine = counts.setdefault(group, Counter())
                for tokens in tokens_of(text):
                    mine.update(tokens)
                mine.pop(_END, None)
                if sum(map(len, counts.values())) > TOKENS // 4:
                    yield from out()
        yield from out()
        give_back()

    return texts.mapInPandas(run, "grp string, word string, name long, n long").groupBy("grp", "word", "name").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, level: int, blooms: list, seed: int, bits: int) -> DataFrame:
    """left, right, check, n: the pairs of adjacent names of level - 1 whose filters (one for each level so far) pass them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, filters = Names(seed, bits), [Bloom(b.value) for b in blooms]
        held: dict[str, list[np.ndarray]] = {}
        n_held = 0

        def out() -> Iterator[pd.DataFrame]:
            for group, parts in held.items():
                words = names.of_group(np.concatenate(parts), group)
                words = np.where(filters[0].has(words), words, _U64(0))
                here, check = words, words
                for k, known in enumerate(filters[1:], 2):
                    both = (here[:-1] != 0) & (here[1:] != 0)
                    here = np.where(both, _joined(here[:-1], here[1:], names.shift), _U64(0))
                    check = _joined(check[:-1], words[k - 1 :])
                    here = np.where(known.has(here), here, _U64(0))
                at = np.flatnonzero((here[:-1] != 0) & (here[1:] != 0))
                found = np.empty(len(at), [("left", _U64), ("right", _U64), ("check", _U64)])
                found["left"], found["right"] = here[at], here[at + 1]
                found["check"] = _joined(check[at], words[at + level - 1])
                # Sorted by one scrambled number, then cut where any of the three changes: equal numbers of unequal pairs only give more rows.
                order = np.argsort(_joined(found["left"], found["right"]), kind="stable")
                found = found[order]
                first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
                yield pd.DataFrame({c: found[c][first].view(np.int64) for c in ("left", "right", "check")} | {"n": np.diff(np.append(first, len(found)))})
            held.clear()

        for b in batches:
            for group, text in zip(b["grp"], b["text"], strict=True):
                parts = held.setdefault(group, [])
                for tokens in tokens_of(text):
                    parts.append(np.fromiter(map(names.__getitem__, tokens), _U64, len(tokens)))
                    n_held += len(tokens)
                parts.append(np.zeros(1, _U64))
                if n_held > TOKENS:
                    yield from out()
                    n_held = 0
        yield from out()
        give_back()

    found = texts.mapInPandas(run, "left long, right long, check long, n long")
    return found.groupBy("left", "right", "check").agg(F.sum("n").alias("n"))


def _named(pairs: DataFrame, bits: int) -> DataFrame:
    """pairs with `name`, the name of (left, right), and `check` as the next level expects it."""
    shift = 64 - bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = lambda c: c.to_numpy(np.int64).view(_U64)
        for b in batches:
            yield b.assign(name=_joined(u(b["left"]), u(b["right"]), shift).view(np.int64), own=_joined(u(b["left_check"]), u(b["last_name"])).view(np.int64))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, f"{fields}, name long, own long")


def _unique(names: DataFrame) -> bool:
    return names.groupBy("name").count().filter("count > 1").isEmpty()


def _levels(docs: DataFrame, least: int, longest: int, text_col: str, group_col: str, seed: int, bits: int, most_bits: int) -> tuple[list[DataFrame], DataFrame] | None:
    """The table of each level and the words of each group; nothing if two names clash.

    A level's columns: grp, name, n, left, right (names of the parents), words, prefixes and suffixes (frequencies of the first and the
    last 1, 2, .. k words), last_name (of the last word), check."""
    spark, texts = docs.sparkSession, _texts(docs, text_col, group_col)
    words = stored(word_counts(texts, seed, bits), "words")
    if not _unique(words):
        return None
    none = F.lit(None).cast("long")
    tables = [
        stored(
            words.filter(F.col("n") >= least).select(
                "grp", "name", "n", none.alias("left"), none.alias("right"), F.array("word").alias("words"), F.array("n").alias("prefixes"), F.array("n").alias("suffixes"),
                F.col("name").alias("last_name"), F.col("name").alias("check"),
            ),
            "phrases-1",
        )
    ]
    blooms = []
    for level in range(2, longest + 1):
        below = tables[-1]
        blooms.append(spark.sparkContext.broadcast(bloom_of(below, below.count(), most_bits)))
        pairs = pair_counts(texts, level, blooms, seed, bits).filter(F.col("n") >= least)
        a = below.select(F.col("name").alias("left"), "grp", F.col("words").alias("left_words"), F.col("prefixes").alias("left_prefixes"), F.col("check").alias("left_check"))
        b = below.select(F.col("name").alias("right"), F.element_at("words", -1).alias("last"), F.col("suffixes").alias("right_suffixes"), "last_name")
        named = _named(pairs.join(a, "left").join(b, "right"), bits).filter("check = own")
        n = F.array("n")
        table = stored(
            named.select(
                "grp", "name", "n", "left", "right", F.concat("left_words", F.array("last")).alias("words"), F.concat("left_prefixes", n).alias("prefixes"), F.concat("right_suffixes", n).alias("suffixes"),
                "last_name", "check",
            ),
            f"phrases-{level}",
        )
        if not _unique(table):
            return None
        tables.append(table)
    return tables, words.groupBy("grp").agg(F.sum("n").alias("total"))


def _cut(level: int) -> Column:
    """score, k, l, r of the lowest-scoring cut, ties to the smallest k. Products are decimals of 38 digits, the quotient is floored exactly."""
    d = lambda c: c.cast("decimal(13,0)")
    cuts = []
    for k in range(1, level):
        left, right = F.element_at("prefixes", k), F.element_at("suffixes", level - k)
        score = F.call_function("div", (d(F.col("n")) * d(F.col("n")) * F.lit(MILLION).cast("decimal(7,0)")), d(left) * d(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def _best(rows: DataFrame, top: int, order: list[Column]) -> DataFrame:
    """The first `top` rows of each group. Where a group has many, windows over parts of it go first, so that no task sorts a whole group."""
    most = rows.groupBy("grp").count().agg(F.max("count").alias("m")).first().m or 0
    while most > WINDOW_ROWS:
        parts = -(-most // max(WINDOW_ROWS, 4 * top))
        by = Window.partitionBy("grp", F.pmod(F.xxhash64("phrase", F.lit(parts)), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).drop("rank")
        if parts * top >= most:
            break
        most = parts * top
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, subsumed: int = SUBSUMED, text_col: str = "text", group_col: str = "lang", bits: int = 64, most_bits: int = BLOOM_BITS
) -> DataFrame:
    """grp, rank, phrase, a, l, r, n, score: the best phrases of 2 to `longest` words with at least `least` occurrences in each group."""
    seed, found = 1, None
    while found is None:
        found = _levels(docs, least, longest, text_col, group_col, seed, bits, most_bits)
        seed += 2
    tables, totals = found
    parts = []
    for level, table in enumerate(tables[1:], 2):
        rows = table
        if level < longest:
            longer = tables[level]
            above = longer.select(F.col("left").alias("name"), "n").unionByName(longer.select(F.col("right").alias("name"), "n")).groupBy("name").agg(F.max("n").alias("above"))
            rows = rows.join(above, "name", "left").filter(F.col("above").isNull() | (100 * F.col("above") < subsumed * F.col("n")))
        parts.append(rows.select("grp", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), _cut(level).alias("cut")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = stored(rows.select("grp", "phrase", "a", "cut.l", "cut.r", "cut.score"), "phrase-scores")
    best = _best(rows, top, [F.desc("score"), F.desc("a"), F.asc("phrase")])
    return best.join(totals.select(F.col("grp"), F.col("total").alias("n")), "grp").select("grp", "rank", "phrase", "a", "l", "r", "n", "score")
