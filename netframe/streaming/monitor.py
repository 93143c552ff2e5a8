"""Live waveforms: changes and rising edges of signals whose values arrive out of order, as waves.changes and waves.edges give them of a table.

Values wait, by signal, until the watermark has passed them; then they are taken in the order of time and seq, and compared with the
signal's value before. What is kept of a signal is that value and what waits: the values of as much time as the stream may be late. A timer lets a
signal go that has been silent for long; its next value is a first one again. A value that comes behind the watermark is dropped, as in any
windowed stream. Signals are dealt by name, and a signal's values are in order only in one place, so one signal is one task's."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "known boolean, value int, last_ms long, ms array<long>, seq array<long>, waiting array<int>"
_UNKNOWN = -1  # a null value while it is kept


def _ordered(waves: DataFrame, late: str, idle_ms: int, rising: bool) -> DataFrame:
    """(signal, ts, seq, value) of a stream with these columns: its changes, or its rising edges."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, value, last_ms, ms, seq, waiting = state.get if state.exists else (False, _UNKNOWN, 0, [], [], [])
        passed = max(0, state.getCurrentWatermarkMs())
        rows = list(zip(ms, seq, waiting, strict=True))
        if not state.hasTimedOut:
            for batch in batches:
                at = batch["ms"].astype("int64")
                held = batch["value"].where(batch["value"].notna(), _UNKNOWN).astype("int64")
                rows += [r for r in zip(at.tolist(), batch["seq"].tolist(), held.tolist(), strict=True) if r[0] >= passed]
        rows.sort()
        due = bisect.bisect_left(rows, (passed,))
        out = []
        for at, number, now in rows[:due]:
            if (value == 0 and now == 1 and known) if rising else (not known or now != value):
                out.append((at, number, now))
            known, value, last_ms = True, now, at
        rows = rows[due:]
        if rows or passed < last_ms + idle_ms:
            state.update((known, value, last_ms, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
            state.setTimeoutTimestamp(max(passed + 1, rows[0][0] if rows else last_ms + idle_ms))
        elif state.exists:
            state.remove()
        if out:
            made = pd.DataFrame(out, columns=["ms", "seq", "value"])
            made.insert(0, "signal", key[0])
            yield made

    named = waves.withWatermark("ts", late).select("signal", F.unix_millis("ts").alias("ms"), "ts", F.col("seq").cast("long").alias("seq"), F.col("value").cast("int").alias("value"))
    found = named.groupBy("signal").applyInPandasWithState(step, "signal string, ms long, seq long, value int", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("signal", F.timestamp_millis("ms").alias("ts"), "seq", F.when(F.col("value") != _UNKNOWN, F.col("value")).alias("value"))


def changes_of_stream(waves: DataFrame, late: str = "1 minute", idle_ms: int = 86_400_000) -> DataFrame:
    """Values of a stream (signal, ts, seq, value: 0, 1 or null) that differ from their signal's one before; unknown is a value, and a first value a change."""
    return _ordered(waves, late, idle_ms, rising=False)


def edges_of_stream(waves: DataFrame, late: str = "1 minute", idle_ms: int = 86_400_000) -> DataFrame:
    """Rising edges of a stream: 0, then 1."""
    return _ordered(waves, late, idle_ms, rising=True)


def windowed_changes(changes: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Changes of each signal in each window of a stream (ts, signal), late ones up to late."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "signal").agg(F.count("*").alias("n")).select("w.start", "signal", "n")
