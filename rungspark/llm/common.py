"""What the operators of this subpackage share: scratch tables, word rules and stable hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut_lineage

#: One word: a run of anything but the ASCII white space characters (as a Java or Python pattern).
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
_LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
_U64 = np.uint64


def stored(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage and survives lost executors."""
    return cut_lineage(df, rows, tag)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    """As many shuffle partitions as the session is set to."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def groups_for(spark: SparkSession, n_bytes: int) -> int:
    """Into how many groups work on so many bytes of text is dealt, a task each. A group has 4 MB of 0.5 GB; its size grows with the
    root of the input, up to 128 MB, so that neither the groups nor their number get out of hand."""
    size = min(128e6, 4e6 * (max(n_bytes, 1) / 5e8) ** 0.5)
    return max(tasks_for(spark), int(n_bytes / size) + 1)


def summed(docs: DataFrame, per_batch: Callable[[pd.DataFrame], np.ndarray], rows: int, columns: int, width: int = 64) -> np.ndarray:
    """The sum over all batches of a rows x columns array of a known shape: added up in each task, then by Spark's aggregation
    (partial sums for each row, nothing is held for a group), `width` columns at a time. That array reaches the driver."""
    names = [f"s{i}" for i in range(width)]
    parts = -(-columns // width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rows, parts * width))
        for b in batches:
            total[:, :columns] += per_batch(b)
        there = np.flatnonzero(total.any(axis=1))
        for part in range(parts):
            for k in range(0, len(there), 8192):
                at = there[k : k + 8192]
                yield pd.DataFrame(total[at, part * width : (part + 1) * width], columns=names).assign(key=at * parts + part)
        del total
        give_back()

    schema = ", ".join(f"{n} double" for n in names) + ", key long"
    found = docs.mapInPandas(run, schema).groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((rows * parts, width))
    out[found["key"].to_numpy(np.int64)] = found[names].to_numpy()
    return out.reshape(rows, parts * width)[:, :columns]


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its task, and the next stage's work comes beside it."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased. bytes.split() splits on exactly the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class WordIds(dict):
    """Word -> 64-bit hash, remembered between batches up to a bounded number of words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U64, len(words))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
