"""Removal of repeated byte strings, by bucket-pointer refinement over all texts.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. What a suffix array would put side by
side up to that depth, buckets put together: a string's bucket is refined from the bucket of its q-gram by the buckets of
later offsets (see _windows), the names of one refinement being used again by the next. Only strings that can still share
a bucket are kept in play:

1. Every string of `length` bytes has an anchor, the place of its least q-gram bucket. Consecutive strings of one anchor are
   a run; runs are sorted by anchor bucket, then by the bucket of their whole extent. A run alone in its anchor bucket is
   settled (nothing repeats), and so is one whose whole extent occurs again (everything repeats).
2. The open rest, runs at the ends of repeated passages, is refined to single strings, sorted by their full bucket.
   Strings of one run overlap at the anchor, so the least and the greatest repeated one say which bytes go.

Texts travel as compressed blobs twice, runs and strings as packed arrays. No passage is hot: of the runs of one extent, and of
the equal strings, that a sender holds together it sends one, the others being known as repeated; runs of an anchor with many
extents are dealt by extent, all such anchors being listed first. Groups and tasks grow with the bytes. Buckets are 64-bit names (a chance of about 10^-4 that any two of 10^8 open strings collide).

Defined results: null and empty texts have no bytes, nothing removed and an empty rest; texts shorter than `length` are kept;
rows that are repeated as a whole, id and text, are copies of each other; null ids are allowed; very long texts are read in
overlapping segments; further columns are ignored; matches never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._windows import SEGMENT, buckets, runs
from .common import groups_for, mix64, stored, text_bytes
from .ngram import _keys, _owner, _pack, _planes, _unpack

LENGTH = 200
Q = 32
FULL, OPEN, PARTNER = 0, 1, 2
RUN = (("extent", np.uint64), ("k", np.int64), ("first", np.int64), ("n", np.uint8), ("again", bool))
HOT, HOT_SHARE = 64, 400  # an anchor is spread if a sender holds over HOT extents of it at once, and over 1 / HOT_SHARE of all its runs


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _cut(key: np.ndarray, owners: int) -> list[tuple[int, slice]]:
    cuts = np.searchsorted(_owner(key, owners), np.arange(owners + 1))
    return [(k, slice(cuts[k], cuts[k + 1])) for k in range(owners) if cuts[k] < cuts[k + 1]]


def _part(k: np.ndarray, parts: int) -> np.ndarray:
    return (k.view(np.uint64) % np.uint64(parts)).astype(np.int64)


def _sent_runs(rows: DataFrame, length: int, q: int, owners: int, parts: int) -> DataFrame:
    """Runs for their owners (of equal extents held together the first, `again`), with the anchors to spread; the others, settled, for their parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, size, done = [], 0, []

        def look() -> None:
            nonlocal pieces, size
            lengths = np.array([len(p[2]) for p in pieces], np.int64)
            ends = np.cumsum(lengths)
            anchor, extent, first, n, _ = runs(np.frombuffer(b"".join(p[2] for p in pieces), np.uint8), ends - lengths, ends, length, q)
            of = np.searchsorted(ends, first, "right")
            offset = np.array([p[1] for p in pieces], np.int64) - (ends - lengths)
            done.append((anchor, extent, np.array([p[0] for p in pieces], np.int64)[of], first + offset[of], n.astype(np.uint8)))
            pieces, size = [], 0

        def flush() -> pd.DataFrame:
            anchor, extent, k, first, n = (np.concatenate(x) for x in zip(*done, strict=True))
            done.clear()
            anchor = mix64(anchor)  # least buckets lie low, their scrambled names anywhere
            order = np.lexsort((first, k, extent, anchor))
            anchor, extent, k, first, n = (x[order] for x in (anchor, extent, k, first, n))
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (extent[1:] != extent[:-1])
            again = np.diff(np.append(np.flatnonzero(new), len(new))) > 1
            to = _part(k[~new], parts)
            known = [(p, *(x[~new][to == p] for x in (k, first, n))) for p in np.unique(to)]
            least = max(HOT, len(new) // HOT_SHARE)
            anchor, extent, k, first, n = (x[new] for x in (anchor, extent, k, first, n))
            buckets_, extents = np.unique(anchor, return_counts=True)
            hot = buckets_[extents > least]
            cut = _cut(anchor, owners)
            sent = pd.DataFrame({
                "owner": [o for o, _ in cut], "anchor": [_planes(anchor[s]) for _, s in cut],
                **{name: [_pack(x[s]) for _, s in cut] for name, x in (("extent", extent), ("k", k), ("first", first), ("n", n), ("again", again))},
                "spread": False, "hot": [hot[_owner(hot, owners) == o].tobytes() or None for o, _ in cut], "part": pd.Series([None] * len(cut), dtype="Int32"), "kind": None,
            })
            settled = pd.DataFrame({
                "owner": pd.Series([None] * len(known), dtype="Int32"), "anchor": None, "extent": None,
                **{name: [_pack(x[i]) for x in known] for i, name in ((1, "k"), (2, "first"), (3, "n"))}, "again": None,
                "spread": False, "hot": None, "part": [x[0] for x in known], "kind": [_pack(np.full(len(x[1]), FULL, np.uint8)) for x in known],
            })
            return pd.concat([sent.astype({"owner": "Int32"}), settled.astype({"part": "Int32"})]) if known else sent

        for b in batches:
            for k, text in zip(b["k"], b["text"], strict=True):
                raw = _bytes(text)
                for a in range(0, max(0, len(raw) - length + 1), SEGMENT):
                    piece = raw[a : a + SEGMENT + length - 1]
                    if size + len(piece) > SEGMENT and pieces:
                        look()
                    pieces.append((k, a, piece))
                    size += len(piece)
                if sum(len(x[0]) for x in done) > 400_000:
                    yield flush()
        if pieces:
            look()
        if done:
            yield flush()

    assert length - q + 1 < 256
    return rows.mapInPandas(run, "owner int, anchor binary, extent binary, k binary, first binary, n binary, again binary, spread boolean, hot binary, part int, kind binary")


def _spread(sent: DataFrame, owners: int) -> DataFrame:
    """The runs of listed anchors dealt by extent."""
    listed = [r.hot for r in sent.filter("hot IS NOT NULL").select("hot").distinct().collect()]  # at most HOT_SHARE anchors for each time a sender sends
    sent = sent.filter("owner IS NOT NULL").select("owner", "anchor", "extent", "k", "first", "n", "again", "spread")
    if not listed:
        return sent
    of = sent.sparkSession.sparkContext.broadcast(np.unique(np.frombuffer(b"".join(listed), np.uint64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                anchor = _keys(row.anchor)
                hot = np.isin(anchor, of.value)
                if not hot.any():
                    yield pd.DataFrame([row], columns=b.columns)
                    continue
                cols = [anchor, *(_unpack(getattr(row, c), t) for c, t in RUN)]
                to = np.where(hot, _owner(cols[1], owners) + owners, row.owner)
                order = np.argsort(to, kind="stable")
                to, cols = to[order], [x[order] for x in cols]
                cuts = [0, *(np.flatnonzero(np.diff(to)) + 1), len(to)]
                yield pd.DataFrame([
                    {"owner": int(to[x]) % owners, "anchor": _planes(cols[0][x:y]), **{c: _pack(v[x:y]) for (c, _), v in zip(RUN, cols[1:], strict=True)}, "spread": bool(to[x] >= owners)}
                    for x, y in zip(cuts, cuts[1:], strict=False)
                ], columns=b.columns)

    return sent.mapInPandas(run, sent.schema)


def _marks(sent: DataFrame, parts: int, owners: int) -> DataFrame:
    """Runs that may hold repeated strings: part (of their text), and packed k, first, n, kind."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        anchor = [_keys(x) for x in part["anchor"]]
        spread = np.repeat(part["spread"].to_numpy(bool), [len(x) for x in anchor])
        anchor = np.concatenate(anchor)
        extent, k, first, n, again = (np.concatenate([_unpack(x, t) for x in part[c]]) for c, t in RUN)
        order = np.lexsort((first, k, extent, anchor))
        anchor, extent, k, first, n, again, spread = (x[order] for x in (anchor, extent, k, first, n, again, spread))
        new_bucket = np.ones(len(anchor), bool)
        new_bucket[1:] = anchor[1:] != anchor[:-1]
        new_extent = new_bucket.copy()
        new_extent[1:] |= extent[1:] != extent[:-1]
        bucket, ext = np.cumsum(new_bucket) - 1, np.cumsum(new_extent) - 1
        alone, twice = (np.bincount(bucket, 1 + again)[bucket] == 1) & ~spread, np.bincount(ext, 1 + again)[ext] > 1
        mixed = (np.bincount(bucket, weights=new_extent)[bucket] > 1) | spread
        kind = np.where(twice, FULL, OPEN).astype(np.uint8)
        partner = new_extent & twice & mixed
        keep = ~alone
        rows = [np.concatenate([x[keep], y[partner]]) for x, y in ((k, k), (first, first), (n, n), (kind, np.full(len(kind), PARTNER, np.uint8)))]
        to = _part(rows[0], parts)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(parts + 1))
        there = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        return pd.DataFrame({"part": there, **{c: [_pack(x[order[cuts[p] : cuts[p + 1]]]) for p in there] for c, x in zip(("k", "first", "n", "kind"), rows, strict=True)}})

    return sent.repartition(owners, "owner").groupBy("owner").applyInPandas(run, "part int, k binary, first binary, n binary, kind binary")


def _blobs(rows: DataFrame, parts: int) -> DataFrame:
    """The texts dealt to parts, compressed: part, ids, k, lengths, blob."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            to = _part(np.array([h[1] for h in held], np.int64), parts)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(parts + 1))
            there = [(p, [held[i] for i in order[cuts[p] : cuts[p + 1]]]) for p in range(parts) if cuts[p] < cuts[p + 1]]
            return pd.DataFrame({
                "part": [p for p, _ in there], "ids": [np.array([h[0] for h in x], object) for _, x in there], "k": [_pack(np.array([h[1] for h in x], np.int64)) for _, x in there],
                "lengths": [_pack(np.array([-1 if h[2] is None else len(h[2]) for h in x], np.int64)) for _, x in there],
                "blob": [_pack(np.frombuffer(b"".join(h[2] or b"" for h in x), np.uint8)) for _, x in there],
            })

        for b in batches:
            for i, k, text in zip(b["id"], b["k"], b["text"], strict=True):
                raw = _bytes(text)
                held.append((None if pd.isna(i) else i, k, raw))
                size += len(raw)
                if size > 32_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.mapInPandas(run, f"part int, ids array<{rows.schema['id'].dataType.simpleString()}>, k binary, lengths binary, blob binary")


def _ordered(marks: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """k, first, n, kind of a part's marks, in an order that does not depend on how the rows came."""
    k, first, n, kind = (np.concatenate([_unpack(x, t) for x in marks[c]]) if len(marks) else np.empty(0, t) for c, t in (("k", np.int64), ("first", np.int64), ("n", np.uint8), ("kind", np.uint8)))
    order = np.lexsort((kind, n, first, k))
    return k[order], first[order], n[order].astype(np.int64), kind[order]


def _texts(left: pd.DataFrame) -> Iterator[tuple[object, int, bytes]]:
    for ids, k, lengths, blob in zip(left["ids"], left["k"], left["lengths"], left["blob"], strict=True):
        raw = _unpack(blob, np.uint8).tobytes()
        ends = np.cumsum(_unpack(lengths, np.int64))
        at = 0
        for i, key, end in zip(ids, _unpack(k, np.int64), ends, strict=True):
            yield i, int(key), raw[at:end]
            at = int(end)


def _sent_windows(blobs: DataFrame, marks: DataFrame, length: int, owners: int) -> DataFrame:
    """The strings of open runs and their partners: owner, window bucket, and the run's number in its part, the string's in its run."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        k, first, n, kind = _ordered(right)
        wanted = np.flatnonzero(kind != FULL)
        keys, of = np.unique(k[wanted], return_index=True)
        range_of = {int(key): (a, b) for key, a, b in zip(keys, of, [*of, len(wanted)][1:], strict=True)}
        out, pieces, size = [], [], 0

        def look() -> None:
            nonlocal pieces, size
            lengths = np.array([len(p[1]) for p in pieces], np.int64)
            window = buckets(np.frombuffer(b"".join(p[1] for p in pieces), np.uint8), (length,))[length]
            count = lengths - length + 1
            starts = np.cumsum(lengths) - lengths
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append((window[np.repeat(starts, count) + offset], np.repeat(np.array([p[0] for p in pieces], np.int32), count), offset.astype(np.uint8)))
            pieces, size = [], 0

        for _, key, raw in _texts(left):
            if key in range_of:
                a, b = range_of.pop(key)  # equal rows once: their runs are all on the list
                for j in wanted[a:b]:
                    pieces.append((j, raw[first[j] : first[j] + n[j] - 1 + length]))
                    size += len(pieces[-1][1])
                if size > SEGMENT:
                    look()
        if pieces:
            look()
        if not out:
            return pd.DataFrame({"owner": [], "part": [], "key": [], "run": [], "at": [], "partner": [], "lo": [], "hi": []})
        window, number, at = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(window, kind="stable")
        window, number, at = window[order], number[order], at[order]
        partner = kind[number] == PARTNER
        # Of equal strings one goes on, for those of other parts; it needs no answer.
        new = np.ones(len(window), bool)
        new[1:] = window[1:] != window[:-1]
        again = np.diff(np.append(np.flatnonzero(new), len(new))) > 1
        held = np.repeat(again, np.diff(np.append(np.flatnonzero(new), len(new)))) & ~partner
        settled = _ranges(number[held], at[held])
        window, number, at, partner = window[new], number[new], at[new], partner[new] | again
        there, part = _cut(window, owners), right["part"].iloc[0]
        sent = pd.DataFrame({
            "owner": [o for o, _ in there], "part": part, "key": [_planes(window[s]) for _, s in there], "run": [_pack(number[s]) for _, s in there],
            "at": [_pack(at[s]) for _, s in there], "partner": [_pack(partner[s]) for _, s in there], "lo": None, "hi": None,
        })
        return pd.concat([sent, pd.DataFrame([{"owner": part % owners, "part": part, "key": None, "at": None, "partner": None, **settled}])]) if held.any() else sent

    schema = "owner int, part int, key binary, run binary, at binary, partner binary, lo binary, hi binary"
    return blobs.groupBy("part").cogroup(marks.groupBy("part")).applyInPandas(run, schema)


def _ranges(number: np.ndarray, at: np.ndarray) -> dict[str, bytes]:
    """The runs' numbers, each once, with the least and the greatest place."""
    x = pd.DataFrame({"run": number, "at": at}).groupby("run", sort=True)["at"].agg(["min", "max"]).reset_index()
    return {"run": _pack(x["run"].to_numpy(np.int32)), "lo": _pack(x["min"].to_numpy(np.uint8)), "hi": _pack(x["max"].to_numpy(np.uint8))}


def _hits(windows: DataFrame, owners: int) -> DataFrame:
    """part, and packed: numbers of runs with repeated strings, the least and the greatest of these."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        settled, rows = rows.loc[rows["lo"].notna(), ["part", "run", "lo", "hi"]], rows[rows["lo"].isna()]
        if not len(rows):
            return settled
        key = [_keys(x) for x in rows["key"]]
        sizes = [len(x) for x in key]
        _, at, count = np.unique(np.concatenate(key), return_inverse=True, return_counts=True)
        number, place, partner = (np.concatenate([_unpack(x, t) for x in rows[c]]) for c, t in (("run", np.int32), ("at", np.uint8), ("partner", bool)))
        part = np.repeat(rows["part"].to_numpy(np.int64), sizes)
        again = (count[at] > 1) & ~partner
        found = pd.DataFrame({"part": part[again], "run": number[again], "at": place[again]})
        return pd.concat([settled, pd.DataFrame([{"part": p, **_ranges(x["run"], x["at"])} for p, x in found.groupby("part")], columns=["part", "run", "lo", "hi"])])

    return windows.repartition(owners, "owner").groupBy("owner").applyInPandas(run, "part int, run binary, lo binary, hi binary")


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q) -> DataFrame:
    """id, n_bytes, n_removed, spans (start and stop of the maximal removed runs, in bytes) and kept (the remaining bytes)."""
    spark = docs.sparkSession
    owners = parts = groups_for(spark, text_bytes(docs, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("k"))
    sent = stored(_sent_runs(rows, length, q, owners, parts), "repeats-runs")
    settled = sent.filter("owner IS NULL").select("part", "k", "first", "n", "kind")
    marks = stored(_marks(_spread(sent, owners), parts, owners).unionByName(settled), "repeats-marks")
    blobs = _blobs(rows, parts)
    hits = stored(_hits(_sent_windows(blobs, marks, length, owners), owners), "repeats-hits")
    known = marks.select("part", "k", "first", "n", "kind", *[F.lit(None).cast("binary").alias(c) for c in ("run", "lo", "hi")]).unionByName(
        hits.select("part", *[F.lit(None).cast("binary").alias(c) for c in ("k", "first", "n", "kind")], "run", "lo", "hi")
    )

    def final(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        k, first, n, kind = _ordered(right[right["k"].notna()])
        found = right[right["run"].notna()]
        lo, hi = np.full(len(k), 255), np.full(len(k), -1)
        for r, a, b in zip(found["run"], found["lo"], found["hi"], strict=True):
            r = _unpack(r, np.int32)
            lo[r] = np.minimum(lo[r], _unpack(a, np.uint8))
            hi[r] = np.maximum(hi[r], _unpack(b, np.uint8))
        start, stop = np.where(kind == FULL, first, first + lo), np.where(kind == FULL, first + n - 1, first + hi) + length
        goes = (kind == FULL) | (kind == OPEN) & (hi >= 0)
        k, start, stop = k[goes], start[goes], stop[goes]
        out = {"id": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for i, key, raw in _texts(left):
            a, b = np.searchsorted(k, key, "left"), np.searchsorted(k, key, "right")
            kept, spans = raw, []
            if a < b:
                s, e = _merged(start[a:b], stop[a:b])
                kept = b"".join(raw[x:y] for x, y in zip(np.append(0, e), np.append(s, len(raw)), strict=True))
                spans = [{"start": int(x), "stop": int(y)} for x, y in zip(s, e, strict=True)]
            for c, v in zip(out, (i, len(raw), len(raw) - len(kept), spans, kept), strict=True):
                out[c].append(v)
        return pd.DataFrame(out)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"
    return blobs.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(final, schema).withColumnRenamed("id", id_col)
