"""Debouncing, latest-wins, bursts and weekly counters over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_key(ts: Column) -> Column:
    """ISO week as YYYY-Www."""
    year, week = F.extract(F.lit("YEAROFWEEK"), ts), F.extract(F.lit("WEEK"), ts)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def weekly_counts(events: DataFrame, ts: str, fields: list[str], keep_weeks: int | None = None) -> DataFrame:
    """week, fields, n; keep_weeks: only so many of the latest weeks (batch only)."""
    out = events.groupBy(week_key(F.col(ts)).alias("week"), *fields).agg(F.count("*").alias("n"))
    if keep_weeks is None:
        return out
    weeks = out.select("week").distinct()  # one row a week
    rank = F.row_number().over(Window.orderBy(F.desc("week")))
    return out.join(F.broadcast(weeks.withColumn("_r", rank).where(F.col("_r") <= keep_weeks).select("week")), "week", "left_semi")


def debounce(events: DataFrame, key: str, ts: str, gap: str, tie: str, late: str | None = None) -> DataFrame:
    """The last event of each burst: a burst ends where gap passes without an event; the same for a table and a stream.

    late: how far behind the newest event of a stream one may come; a burst is given out once none of its events can come any more, and what comes
    later is dropped and counted (late_rows).  A table has no late rows.
    """
    if late is not None:
        events = events.withWatermark(ts, late)
    burst = events.groupBy(key, F.session_window(ts, gap))
    last = F.max_by(F.struct(F.col(ts), F.col(tie)), F.struct(F.col(ts), F.col(tie)))
    out = burst.agg(F.min(ts).alias("first_ts"), F.count("*").alias("inputs"), last.alias("last"))
    return out.select(key, "first_ts", F.col(f"last.{ts}").alias("last_ts"), F.col(f"last.{tie}").alias("last_id"), "inputs")


def late_rows(query) -> int:
    """How many rows a running or finished query has dropped because they came too late, over the progress that it still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def latest(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The event with the highest seq of each key, in batch."""
    columns = [c for c in events.columns if c not in (key, seq)]
    top = events.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("it"), F.max(seq).alias(seq))
    return top.select(key, seq, "it.*")


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before it; the first of a key always counts."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(value)) | F.col("_before").isNull()).drop("_before")


def latest_only(stream: DataFrame, key: str, seq: str, ttl_ms: int = 3_600_000) -> DataFrame:
    """A stream's events whose seq is higher than all seen of their key; a key's state ends after ttl_ms without events."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = stream.schema

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        top = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values(seq)
            new = frame if top is None else frame[frame[seq] > top]
            if len(new):
                top = int(new[seq].max())
                yield new.drop_duplicates(seq)
        if top is not None:
            state.update((top,))
        state.setTimeoutDuration(ttl_ms)

    return stream.groupBy(key).applyInPandasWithState(step, schema, "top long", "append", GroupStateTimeout.ProcessingTimeTimeout)
