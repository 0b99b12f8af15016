"""Turns of sessions: cleaning into messages, cursors, newest rows, batches for extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Fixed values of batching.
NEW_MESSAGES, BACKGROUND_MESSAGES = 10, 5
EVERY_N, IDLE_MS = 5, 600_000
BATCH_TYPE = "session_key string, batch long, reason string, rounds long, first_ts long, last_ts long"


def flatten_blocks(content: Column, blocks: Column) -> Column:
    """Plain content, or the text blocks of an array<struct<type, text>> one a line; inline images become `[image]`."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    joined = F.coalesce(content, F.array_join(texts, "\n"))
    return T.trim_all(F.regexp_replace(joined, r"data:image/[A-Za-z+]+;base64,[A-Za-z0-9+/=]+", "[image]"))


def captured(rows: DataFrame, text_col: str = "message_text") -> DataFrame:
    """User and assistant rows with clean, worthwhile text."""
    c = T.sanitize(F.col(text_col))
    clean = F.when(F.col("role") == "assistant", T.strip_code_blocks(c)).otherwise(c)
    return rows.where(F.col("role").isin("user", "assistant")).withColumn(text_col, clean).where(T.should_capture(F.col(text_col)))


def after_cursor(rows: DataFrame, cursors: DataFrame, floor_ms: int = 0) -> DataFrame:
    """Rows strictly newer than their session's cursor (cursor 0 or missing: newer than the floor). cursors: (session_key, cursor)."""
    joined = rows.join(cursors, "session_key", "left")
    least = F.coalesce(F.when(F.col("cursor") > 0, F.col("cursor")), F.lit(floor_ms))
    return joined.where(F.col("timestamp") > least).drop("cursor")


def from_position(rows: DataFrame, n: Column) -> DataFrame:
    """Messages from position n on where 0 < n <= the session's count, else all."""
    w = Window.partitionBy("session_key")
    out = rows.withColumn("__pos", F.row_number().over(w.orderBy("timestamp", "record_id")) - 1).withColumn("__all", F.count("*").over(w))
    return out.where(~((n > 0) & (n <= F.col("__all"))) | (F.col("__pos") >= n)).drop("__pos", "__all")


def advance_cursors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_key").agg(F.max("timestamp").alias("max_timestamp"), F.max("recorded_at").alias("max_recorded_at"), F.count("*").alias("captured"))


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each session, with their place from the oldest (0)."""
    w = Window.partitionBy("session_key").orderBy(F.desc("recorded_at"), F.desc("timestamp"), F.desc("record_id"))
    back = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return back.withColumn("place", (F.max("__rn").over(Window.partitionBy("session_key")) - F.col("__rn")).cast("long")).drop("__rn")


def grouped_by_session_id(rows: DataFrame, n: int) -> DataFrame:
    """(session_key, session_id, first_ts, messages, place): the newest n rows of each key by session id, groups by first time."""
    items = F.sort_array(F.collect_list(F.struct("place", "record_id", "role", "message_text", "timestamp")))
    groups = newest(rows, n).groupBy("session_key", "session_id").agg(items.alias("messages"), F.min("timestamp").alias("first_ts"))
    return groups.withColumn("place", (F.row_number().over(Window.partitionBy("session_key").orderBy("first_ts", "session_id")) - 1).cast("long"))


def split_new(rows: DataFrame) -> DataFrame:
    """Qualified messages of each group: the newest as `new`, those before as `background`."""
    w = Window.partitionBy("session_key", "session_id").orderBy(F.desc("timestamp"), F.desc("record_id"))
    out = rows.where(T.should_extract(F.col("message_text"))).withColumn("__rn", F.row_number().over(w))
    part = F.when(F.col("__rn") <= NEW_MESSAGES, "new").when(F.col("__rn") <= NEW_MESSAGES + BACKGROUND_MESSAGES, "background")
    return out.withColumn("part", part).where("part is not null").drop("__rn")


def extraction_text(rows: DataFrame) -> DataFrame:
    """(session_key, session_id, background, new): `[id] [role] [time]: content` blocks of `split_new` rows, oldest first."""
    line = F.concat(F.lit("["), "record_id", F.lit("] ["), "role", F.lit("] ["), "recorded_at", F.lit("]: "), "message_text")
    items = rows.withColumn("item", F.struct("timestamp", "record_id", line.alias("line")))

    def joined(part: str) -> Column:
        own = F.sort_array(F.collect_list(F.when(F.col("part") == part, F.col("item"))))
        return F.array_join(F.transform(own, lambda s: s["line"]), "\n\n")

    return items.groupBy("session_key", "session_id").agg(joined("background").alias("background"), joined("new").alias("new"))


def rounds(rows: DataFrame) -> DataFrame:
    """Rounds of each session, one for each user row: (session_key, round, ts)."""
    w = Window.partitionBy("session_key").orderBy("timestamp", "record_id")
    return rows.where("role = 'user'").select("session_key", (F.row_number().over(w)).cast("long").alias("round"), F.col("timestamp").alias("ts"))


def warm_up_batch(round_number: Column, n: int = EVERY_N) -> Column:
    """Batch (from 1) of a round: batches of 1, 2, 4, ... rounds below n, then of n each."""
    ends, size, total = [], 1, 0
    while size < n:
        total += size
        ends.append(total)
        size *= 2
    out = F.lit(len(ends)) + F.ceil((round_number - total) / n)
    for k, end in reversed(list(enumerate(ends, 1))):
        out = F.when(round_number <= end, F.lit(k)).otherwise(out)
    return out.cast("long")


def idle_batch(idle_ms: int = IDLE_MS) -> Column:
    """Batch (from 1) of a round by gaps of more than idle_ms in its session."""
    w = Window.partitionBy("session_key").orderBy("ts", "round")
    gap = (F.col("ts") - F.lag("ts").over(w) > idle_ms).cast("long")
    return gap


def idle_sessions(r: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    w = Window.partitionBy("session_key").orderBy("ts", "round")
    return r.withColumn("__gap", F.coalesce(idle_batch(idle_ms), F.lit(0))).withColumn("batch", F.sum("__gap").over(w) + 1).drop("__gap")


class BatchState:
    """What decides about a session's next batch: rounds so far, the threshold (0: warmed up), the last time."""

    def __init__(self, count: int = 0, threshold: int = 1, last: int = 0, first: int = 0, batch: int = 0):
        self.count, self.threshold, self.last, self.first, self.batch = count, threshold, last, first, batch

    def _emit(self, reason: str, n: int) -> tuple:
        self.batch += 1
        row = (self.batch, reason, self.count, self.first, self.last)
        self.count = 0
        if self.threshold and reason != "flush":
            self.threshold = 0 if 2 * self.threshold >= n else 2 * self.threshold
        return row

    def add(self, ts: int, n: int = EVERY_N, idle_ms: int = IDLE_MS) -> Iterator[tuple]:
        if self.count and ts - self.last > idle_ms:
            yield self._emit("idle_timeout", n)
        if not self.count:
            self.first = ts
        self.count, self.last = self.count + 1, ts
        if self.count >= (min(self.threshold, n) if self.threshold else n):
            yield self._emit("threshold", n)

    def flush(self, reason: str = "flush", n: int = EVERY_N) -> Iterator[tuple]:
        if self.count:
            yield self._emit(reason, n)


def batches(r: DataFrame, n: int = EVERY_N, idle_ms: int = IDLE_MS) -> DataFrame:
    """Batches of rounds by count with warm-up and by idleness together, which depend on each other.

    A fold over each session's rounds in order of time. Rows are dealt out by session and stream through
    in order, so a task holds one state, however long a session is.
    """
    ordered = r.select("session_key", "ts").repartition("session_key").sortWithinPartitions("session_key", "ts")

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for frame in frames:
            for k, ts in zip(frame["session_key"], frame["ts"]):
                if state is None or k != key:
                    if state is not None:
                        out += [(key, *row) for row in state.flush()]
                    key, state = k, BatchState()
                out += [(key, *row) for row in state.add(int(ts), n, idle_ms)]
            yield pd.DataFrame(out, columns=["session_key", "batch", "reason", "rounds", "first_ts", "last_ts"])
            out = []
        if state is not None:
            yield pd.DataFrame([(key, *row) for row in state.flush()], columns=["session_key", "batch", "reason", "rounds", "first_ts", "last_ts"])

    return ordered.mapInPandas(folded, BATCH_TYPE)


def recent_unique(rows: DataFrame, k: int) -> DataFrame:
    """The k texts of each session that were said last, each once, oldest first."""
    last = rows.groupBy("session_key", "message_text").agg(F.max(F.struct("timestamp", "record_id")).alias("last"))
    w = Window.partitionBy("session_key").orderBy(F.desc("last"))
    kept = last.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return kept.select("session_key", "message_text", (F.max("__rn").over(Window.partitionBy("session_key")) - F.col("__rn")).cast("long").alias("place"))


def last_turn(rows: DataFrame) -> DataFrame:
    """(session_id, user_id, assistant_id): the last assistant row and the nearest user row before it."""
    answer = rows.where("role = 'assistant'").groupBy("session_id").agg(F.max_by("record_id", "turn").alias("assistant_id"), F.max("turn").alias("__at"))
    asked = rows.where("role = 'user'").select("session_id", F.col("turn").alias("__turn"), F.col("record_id").alias("__user"))
    joined = asked.join(answer, "session_id").where("__turn < __at")
    return joined.groupBy("session_id", "assistant_id").agg(F.max_by("__user", "__turn").alias("user_id"))


def recent_history(rows: DataFrame, turns: int = 5, answers: int = 3, cut: int = 400, current: str | None = None) -> DataFrame:
    """The last turns of each conversation: a user row and up to `answers` assistant rows after it, texts cut.

    User rows of 5 characters or fewer and assistant rows of 10 or fewer don't count, nor does a user row that is the
    `current` prompt. A heartbeat of a user ends the turn, so what follows belongs to none; those of assistants are left out.
    """
    text, size = F.coalesce("message_text", F.lit("")), F.char_length(F.coalesce("message_text", F.lit("")))
    beat = text.contains("HEARTBEAT.md") | text.contains("HEARTBEAT_OK")
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    asked = plain(F.lit(current))
    same = F.lit(False) if current is None else plain(text).startswith(asked) | asked.startswith(plain(text))
    user = (F.col("role") == "user") & (size > 5)
    event = F.when(user & beat, "none").when(user & ~same, "turn")
    w = Window.partitionBy("session_id").orderBy("turn")
    out = rows.withColumn("__event", event).withColumn("turn_no", F.sum((F.coalesce("__event", F.lit("")) == "turn").cast("long")).over(w)).withColumn("__in", F.last("__event", ignorenulls=True).over(w))
    answer = (F.col("role") == "assistant") & (size > 10) & ~beat & (F.col("__in") == "turn")
    out = out.where((F.col("__event") == "turn") | answer)
    own = Window.partitionBy("session_id", "turn_no").orderBy("turn")
    out = out.withColumn("__k", F.row_number().over(own) - 1).withColumn("__last", F.max("turn_no").over(Window.partitionBy("session_id")))
    kept = out.where((F.col("__k") <= answers) & (F.col("turn_no") > F.col("__last") - turns))
    return kept.select("session_id", "turn_no", "turn", "role", F.substring("message_text", 1, cut).alias("content"))


def carried_scene(b: DataFrame) -> DataFrame:
    """The scene of the last earlier batch of the session that has one. b: (session_key, batch, scene)."""
    w = Window.partitionBy("session_key").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("previous_scene", F.last("scene", ignorenulls=True).over(w))
