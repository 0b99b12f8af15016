"""Structured Streaming twins of capture and batching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.sessions import BATCH_TYPE, EVERY_N, IDLE_MS, BatchState, captured

BATCH_COLUMNS = [c.split()[0] for c in BATCH_TYPE.split(", ")]


#: A session whose state is not touched for so long is forgotten: three times a day of activity.
FORGET_MS = 3 * 86_400_000


def newer_than_cursor(stream: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Rows strictly newer than all that their session has captured in earlier micro-batches.

    The state is one time a session. With `forget_ms` (FORGET_MS, say) it goes after so long without rows of the
    session; rows are handed on at once, so nothing is pending then. A stream that forgets runs until it is stopped,
    as Spark looks for timeouts in further batches; one that shall end when its input does keeps its cursors.
    """
    names = stream.columns

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cursor = state.get[0] if state.exists else None
        latest = cursor
        for frame in frames:
            kept = frame if cursor is None else frame[frame["timestamp"] > cursor]
            if len(kept):
                latest = max(int(kept["timestamp"].max()), latest if latest is not None else -(1 << 62))
                yield kept[names]
        if latest is not None:
            state.update((latest,))
            if forget_ms:
                state.setTimeoutDuration(forget_ms)

    return stream.groupBy("session_key").applyInPandasWithState(keep, stream.schema, "cursor long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout)


def capture(stream: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Clean, worthwhile rows newer than their session's cursor."""
    return newer_than_cursor(captured(stream), forget_ms)


def idle_windows(stream: DataFrame, idle: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """(session_key, first, end, rounds) of sessions closed by idleness."""
    w = stream.withWatermark("ts", late).groupBy("session_key", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("rounds"))
    return w.select("session_key", F.col("w.start").alias("first"), F.col("w.end").alias("end"), "rounds")


def round_batches(stream: DataFrame, n: int = EVERY_N, idle_ms: int = IDLE_MS, late: str = "10 minutes") -> DataFrame:
    """Batches by count with warm-up and by idleness in event time; a session's state goes when the watermark passes its last round by idle_ms.

    stream: (session_key, ts timestamp). Rows of a micro-batch are taken in order of time.
    """
    state_type = "count long, threshold long, last long, first long, batch long"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = BatchState(*(int(x) for x in state.get)) if state.exists else BatchState()
        out = []
        if state.hasTimedOut:
            out += own.flush("idle_timeout", n)
            # the count and the threshold start anew only when the session itself does
            state.remove()
        else:
            times = sorted(int(t.value // 1_000_000) for frame in frames for t in frame["ts"])
            for t in times:
                out += own.add(t, n, idle_ms)
            state.update((own.count, own.threshold, own.last, own.first, own.batch))
            state.setTimeoutTimestamp(max(own.last + idle_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=BATCH_COLUMNS)

    return stream.withWatermark("ts", late).groupBy("session_key").applyInPandasWithState(fold, BATCH_TYPE, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def once_per_call(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each tool call id once within the watermark. stream: (tool_call_id, ts timestamp, ...)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tool_call_id"])
