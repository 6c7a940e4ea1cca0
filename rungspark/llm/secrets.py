"""Secret scans with a ledger of blobs.

Every version of every file (here: every text) is named by the SHA-256 of its bytes. The ledger says for each blob which rule versions
have looked at it and what they found; a rule's version is a hash of its definition. A scan reads only blobs that lack a version of a rule, each
once however many paths hold it, with just the rules it lacks, and appends what it found; then findings are joined back to all paths.

Texts move once: one copy of each blob that is to be scanned, after map-side aggregation by name, so that a text with millions of copies is
one row a task. Names and findings (no texts) are joined to the paths; only blobs with findings take part in that join.

The ledger is a Parquet table in a shared folder, appended to by one scan at a time; a scan that fails leaves nothing behind, one that is
repeated finds its pairs done. `scan` without a folder keeps the ledger of one run among the session's scratch tables.

Defined results: a null text is the empty blob; places are code points, ends exclusive; findings of one kind do not overlap, those of different
kinds may; rows that are repeated each get the findings; ties of start go by the rules' order; null paths are paths; very long texts are scanned
whole; an empty table gives an empty result and an empty ledger; further columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

FEW_FINDINGS = 100_000  # up to which they are broadcast: some 5 MB
LEDGER = "blob string, rules array<string>, found array<struct<rule:string,start:int,stop:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (leftmost, not overlapping), dropped if `group` has fewer than `least` characters. `hints`: a text without any
    of these, in lower case, cannot match."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(repr((self.pattern, self.least, self.group, self.any_case)).encode()).hexdigest()[:16]}"


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", "AKIA[A-Z0-9]+", 18, hints=("akia",)),
    Rule("hex", "[0-9a-f]+", 16),
)
#: Spans beyond the base: formats that announce themselves. Runs that may start anywhere are bounded, so that no text takes quadratic time.
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, hints=("private key-----",)),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9+/_.=-]+)", 20, 1, True, ("bearer",)),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]+", 30, hints=("eyj",)),
    Rule("userinfo", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 6, 1, hints=("://",)),
)
RULES = BASE + ADDED


def spans_of(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(version, start, stop) of all findings, rule by rule."""
    low, out = text.lower(), []
    for rule in rules:
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        # Runs of one class: asking for enough of them at once finds the same as dropping short ones.
        pattern = f"[0-9a-f]{{{rule.least},}}" if rule.pattern == "[0-9a-f]+" else rule.pattern
        for m in re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0)).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((rule.version, *m.span()))
    return out


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, folder: str | None) -> DataFrame:
    """blob, rules, found: a row for each scan of a blob. No folder, or none there yet: an empty ledger."""
    try:
        return spark.read.schema(LEDGER).parquet(folder) if folder else spark.createDataFrame([], LEDGER)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """blob, text, lacks: each blob once that some rule version has not looked at, and these versions."""
    wanted = F.array(*[F.lit(r.version) for r in rules])
    texts = versions.select(blob_name(F.col(text_col)).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen")).filter(F.size(F.array_except(wanted, "seen")) == 0)
    partly = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    new = texts.join(seen.select("blob"), "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    return new.join(partly, "blob", "left").select("blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("lacks"))


def scanned(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's rows for what unseen() gives."""
    of = {r.version: r for r in rules}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [
                [{"rule": v, "start": s, "stop": e} for v, s, e in spans_of(text, tuple(of[v] for v in lacks))] for text, lacks in zip(b["text"], b["lacks"], strict=True)
            ]
            yield pd.DataFrame({"blob": b["blob"], "rules": b["lacks"], "found": found})

    return blobs.mapInPandas(run, LEDGER)


def scan(versions: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "found") -> DataFrame:
    """versions with column `out`: array of struct(kind, start, stop, nth) by start, then the rules' order (nth)."""
    spark = versions.sparkSession
    ledger = read_ledger(spark, folder)
    new = scanned(unseen(versions, ledger, rules, text_col) if folder else unseen_first(versions, rules, text_col), rules)
    if folder:
        new.write.mode("append").option("compression", "zstd").parquet(folder)
        ledger = read_ledger(spark, folder)
    else:
        ledger = stored(new, "blob-ledger")
    return joined_back(versions, ledger, rules, text_col, out)


def unseen_first(versions: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """unseen() where nothing has been scanned yet: nothing to join."""
    texts = versions.select(blob_name(F.col(text_col)).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("lacks", F.array(*[F.lit(r.version) for r in rules]))


def joined_back(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "found") -> DataFrame:
    """The findings of the given rules at every path that holds the blob."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.version), F.struct(F.lit(i).alias("nth"), F.lit(r.kind).alias("kind")))])
    mine = F.array(*[F.lit(r.version) for r in rules])
    found = ledger.select("blob", F.explode("found").alias("f")).filter(F.array_contains(mine, F.col("f.rule")))
    # Two scans at a time may have done a pair twice: a set, not a list.
    found = found.groupBy(F.col("blob").alias("at_blob")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("f.start").alias("start"), order[F.col("f.rule")]["nth"].alias("nth"), F.col("f.stop").alias("stop"), order[F.col("f.rule")]["kind"].alias("kind")))).alias("at_found")
    )
    # Stored, so that both sides of the join are read in for it and a blob with very many paths can be split; few findings are sent to every task.
    found = stored(found, "blob-findings")
    found = F.broadcast(found) if (found.agg(F.sum(F.size("at_found"))).first()[0] or 0) <= FEW_FINDINGS else found
    spans = F.transform(F.coalesce("at_found", F.array().cast("array<struct<start:int,nth:int,stop:int,kind:string>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["nth"].alias("nth")))
    name = "blob_name"
    while name in versions.columns:
        name += "_"
    joined = versions.withColumn(name, blob_name(F.col(text_col))).join(found, F.col(name) == F.col("at_blob"), "left")
    return joined.select(*[versions[c] for c in versions.columns if c != out], spans.alias(out))


def listed(spans: Column) -> Column:
    """kind:start:stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
