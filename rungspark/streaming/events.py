"""Streaming twins of the operators over time: windows, sessions, timers.

Defined results: events later than the watermark allows are dropped (it begins in 1970, so what is timed before is late); null times belong to no window; rows that are repeated count each, but once() keeps one;
an empty stream gives nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, ts: str, by: list[str], size: str, late: str) -> DataFrame:
    """Counts of each window; a window is final once the watermark has passed it."""
    out = events.withWatermark(ts, late).groupBy(*by, F.window(ts, size).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str) -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def timer_changes(events: DataFrame, key: str, ts: str, value: str, delay_s: float, late: str, mode: str = "on") -> DataFrame:
    """key, at_s, output: each change of a timer's output, also when no further event comes: an event-time timer fires once the watermark has passed it.

    on: the output rises `delay_s` after the input rose, if it has not fallen by then, and falls with it; off: it rises with the input and falls `delay_s` after it fell, if it
    has not risen again by then. Inputs start false; an event at the very time of the timer comes first; a null value changes nothing. Events wait in the state of
    their key until the watermark has passed them and are taken in order of time, so those that come late, but within `late`, count as if they had come in
    order; of a key the state holds what lies within `late`, the last input and output and the pending timer."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, last, output, due = state.get if state.exists else ([], [], False, False, None)
        waiting = list(zip(times, values, strict=True))
        for b in batches:
            waiting += [(float(t), bool(v)) for t, v in zip(b["t"], b["v"], strict=True) if v is not None and v == v]
        waiting.sort(key=lambda e: e[0])
        passed, out, n = state.getCurrentWatermarkMs() / 1000, [], 0

        def turn(at: float, to: bool) -> None:
            nonlocal output
            if output != to:
                output = to
                out.append((k[0], at, to))

        while True:
            event = waiting[n] if n < len(waiting) and waiting[n][0] <= passed else None
            if due is not None and due <= passed and (event is None or due < event[0]):
                turn(due, mode == "on")
                due = None
                continue
            if event is None:
                break
            n += 1
            if event[1] == last:
                continue
            last = event[1]
            if last == (mode == "on"):  # the timer starts
                if delay_s <= 0:
                    turn(event[0], last)
                elif output != last:
                    due = event[0] + delay_s
            else:
                due = None
                turn(event[0], last)
        waiting = waiting[n:]
        state.update(([e[0] for e in waiting], [e[1] for e in waiting], last, output, due))
        ahead = [t for t in (waiting[0][0] if waiting else None, due) if t is not None]
        if ahead:
            state.setTimeoutTimestamp(max(int(min(ahead) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at_s", "output"])

    rows = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).cast("double").alias("t"), F.col(value).alias("v"), ts)
    fields = "times array<double>, vs array<boolean>, last boolean, output boolean, due double"
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, at_s double, output boolean", fields, "append", GroupStateTimeout.EventTimeTimeout)


def on_delay(events: DataFrame, key: str, ts: str, value: str, delay_s: float, late: str) -> DataFrame:
    """key, from_s, to_s of the on-delay timer's true spans, emitted when they end. State of a key: whether the input is on, and since when.

    Events of a key are taken in order of time within a batch; the watermark says how late one may come. Spans still open are not emitted; for these see timer_changes().
    """
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        up, rose = state.get if state.exists else (False, 0.0)
        out = []
        for t, v in zip(rows["t"], rows["v"], strict=True):
            if v and not up:
                up, rose = True, float(t)
            elif not v and up:
                if rose + delay_s < t:
                    out.append((k[0], rose + delay_s, float(t)))
                up = False
        state.update((up, rose))
        yield pd.DataFrame(out, columns=["key", "from_s", "to_s"])

    rows = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).cast("double").alias("t"), F.col(value).alias("v"), ts)
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, from_s double, to_s double", "up boolean, rose double", "append", GroupStateTimeout.NoTimeout)
