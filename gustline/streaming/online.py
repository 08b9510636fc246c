"""Online versions of the causal operators, as Structured Streaming over an event table. An extension: the batch
operators are the definition, and these give the same rows for rows in order.

State is one small record a key, so it fits any state store, and survives a lost executor through the checkpoint
of the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "universe string, event_id long, start_ts timestamp, end_ts timestamp, n_rows long, cumulative_intensity double"


def event_clock(stream: DataFrame, value: str, threshold: float, ts: str = "ts", universe: str = "universe") -> DataFrame:
    """Closes an event whenever the intensity since the last one reaches the threshold."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        acc, n, start, number = state.get if state.exists else (0.0, 0, None, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for t, v in zip(rows["ts"], rows["v"]):
            if pd.isna(v):
                continue
            start = t.to_pydatetime() if start is None else start
            acc, n = acc + float(v), n + 1
            if acc >= threshold:
                out.append((key[0], number, start, t.to_pydatetime(), n, acc))
                acc, n, start, number = 0.0, 0, None, number + 1
        state.update((acc, n, start, number))
        yield pd.DataFrame(out, columns=["universe", "event_id", "start_ts", "end_ts", "n_rows", "cumulative_intensity"])

    rows = stream.select(F.col(universe).alias("universe"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("universe").applyInPandasWithState(step, EVENTS, "acc double, n long, start timestamp, number long", "append", GroupStateTimeout.NoTimeout)


def smoother(stream: DataFrame, label: str, m: int, ts: str = "ts", universe: str = "universe") -> DataFrame:
    """Minimum-duration smoothing, row by row."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, candidate, streak = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for t, x in zip(rows["ts"], rows["x"]):
            if pd.isna(x):
                candidate, streak = None, 0
                out.append((key[0], t, None))
                continue
            x = int(x)
            streak = streak + 1 if candidate == x else 1
            candidate = x
            if current is None or streak >= m:
                current = x
            out.append((key[0], t, current))
        state.update((current, candidate, streak))
        done = pd.DataFrame(out, columns=["universe", "ts", "smoothed"])
        done["smoothed"] = done["smoothed"].astype("Int32")
        yield done

    rows = stream.select(F.col(universe).alias("universe"), F.col(ts).alias("ts"), F.col(label).cast("int").alias("x"))
    return rows.groupBy("universe").applyInPandasWithState(step, "universe string, ts timestamp, smoothed int", "current int, candidate int, streak int", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, value: str, late: str = "2 hours", size: str = "1 hour", slide: str | None = None, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")


def sessions(stream: DataFrame, gap: str = "5 days", late: str = "10 days", ts: str = "ts", key: str = "universe") -> DataFrame:
    """Spans of rows at most ``gap`` apart (calendar time; the batch operator counts weekdays)."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, write Parquet, stop."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
