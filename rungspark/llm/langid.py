"""Language identification by compression.

A language's dictionary is raw text of labelled documents; a text is cut into chunks, each chunk is compressed with
every language's dictionary (zstandard), and the language with the fewest bytes over the whole text wins. A text whose
best two languages lie closer than `min_margin` (share of the compressed bytes) is rejected.

Defined results: a null text and a text without a letter are `und` with score 0 and rejected; equal sizes go to the
language first in code point order; labels of null are not learned; no labelled document at all makes everything `und`.
Repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

DICT_BYTES = 96 * 1024  # of each language's dictionary
DOCS_A_LANGUAGE = 170  # distinct labelled texts that may go into a dictionary: the bound of the training sample
DOC_BYTES = 600  # characters of a piece of them
CHUNK = 1500  # characters compressed at once
LEVEL = 6
MIN_MARGIN = 0.0005
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _ranked_pieces(text: str, size: int, most: int) -> list[tuple[str, int]]:
    """The distinct pieces of `size` characters of the whole text, by hash, as far as `most` characters go; and what they take in a dictionary."""
    pieces = {text[i : i + size] for i in range(0, len(text), size)}
    out, n = [], 0
    for piece in sorted(pieces, key=lambda x: (zlib.crc32(x.encode("utf-8", "surrogatepass")), x)):
        if n >= most:
            break
        out.append((piece, len(piece.lower().encode("utf-8", "surrogatepass")) + 1))
        n += len(piece)
    return out


def fit(docs: DataFrame, dict_bytes: int = DICT_BYTES, docs_a_language: int = DOCS_A_LANGUAGE, doc_bytes: int = DOC_BYTES) -> dict[str, bytes]:
    """A dictionary for each language from a bounded sample: the distinct texts first by hash, at most `docs_a_language` of each.

    Each text is cut whole into pieces of `doc_bytes` characters; a text's pieces are taken in the order of their hash, one of
    every text in turn, until there are `dict_bytes`.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & (F.octet_length(F.coalesce("text", F.lit(""))) > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    picked = (
        labelled.select("lang", "h").distinct()
        .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .filter(F.col("nth") <= docs_a_language)
    )
    ranked = F.udf(lambda text, size, most: _ranked_pieces(text, size, most), "array<struct<piece:string,size:int>>")
    texts = labelled.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("nth").alias("nth"), F.min("text").alias("text"))
    pieces = texts.select("lang", "nth", F.posexplode(ranked("text", F.lit(doc_bytes), F.lit(dict_bytes))).alias("turn", "p")).select("lang", "nth", "turn", "p.*")
    # A language's pieces are bounded by docs_a_language and dict_bytes; only those that go into its dictionary reach the driver.
    before = Window.partitionBy("lang").orderBy("turn", "nth").rowsBetween(Window.unboundedPreceding, -1)
    taken = pieces.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter(F.col("before") < dict_bytes)
    out: dict[str, bytes] = {}
    joined: dict[str, list[bytes]] = {}
    for r in taken.select("lang", "turn", "nth", "piece").orderBy("lang", "turn", "nth").collect():
        joined.setdefault(r.lang, []).append(r.piece.lower().encode("utf-8", "surrogatepass"))
    for lang, parts in joined.items():
        out[lang] = b"\n".join(parts[::-1])[-dict_bytes:]  # the first turn last, nearest to what is compressed
    return out


class _Sizer:
    def __init__(self, dictionaries: dict[str, bytes], level: int):
        import zstandard as z

        self.langs = sorted(dictionaries)
        self.by = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            params = z.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.by.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str, chunk: int) -> list[int]:
        text = text.lower()
        parts = [text[i : i + chunk].encode("utf-8", "surrogatepass") for i in range(0, len(text), chunk)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.by]

    def judged(self, text: str | None, chunk: int, min_margin: float) -> tuple[str, float, float, bool]:
        if text is None or not self.by or not _LETTER.search(text):
            return UND, 0.0, 0.0, True
        sizes = self.sizes(text, chunk)
        ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[ranked[0]]
        gap = (sizes[ranked[1]] - best) / sizes[ranked[1]] if len(ranked) > 1 else 1.0
        score = 1 / (1 + sum(2.0 ** (-100 * (s - best) / best) for i, s in enumerate(sizes) if i != ranked[0]))
        return self.langs[ranked[0]], score, gap, gap < min_margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, chunk: int = CHUNK, level: int = LEVEL, id_col: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """id, the columns in `keep`, lang_pred, score (0 to 1), margin, rejected. Texts are read whole; only they go to Python, in pieces."""
    of = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages x dict_bytes

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizer = _Sizer(of.value, level)
        for b in batches:
            yield pd.DataFrame([sizer.judged(text, chunk, min_margin) for text in b], columns=["lang_pred", "score", "margin", "rejected"])
        del sizer
        give_back()

    cols = [id_col, *[c for c in keep if c != id_col]]
    found = "found"
    while found in cols:
        found += "_"
    return docs.select(*dict.fromkeys([*cols, "text"])).withColumn(found, judged("text")).select(*cols, f"{found}.*")
