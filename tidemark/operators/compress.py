"""Emergency compression of conversations, and the refresh schedule of sessions as a fold in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the cuts and of the schedule.
KEEP, LEAST_TO_TRUNCATE, STUB_TOKENS = 2, 600, 30
DELAY_MS, MIN_MS, MAX_MS, ACTIVE_MS = 10_000, 900_000, 3_600_000, 86_400_000


def tool_units(messages: DataFrame) -> DataFrame:
    """`messages` with `unit`, the turn of the call that a result belongs to (the last one before it with an id of its own), else the own turn."""
    ids = messages.select("conv_id", "turn", "is_result", F.explode("tool_ids").alias("id"))
    calls = ids.where(~F.col("is_result")).select("conv_id", "id", F.col("turn").alias("call"))
    owners = ids.where("is_result").join(calls, ["conv_id", "id"]).where("call < turn").groupBy("conv_id", "turn").agg(F.max("call").alias("call"))
    return messages.join(owners, ["conv_id", "turn"], "left").withColumn("unit", F.coalesce("call", "turn")).drop("call")


def _gone(units: DataFrame, order: list[Column], excess: Column) -> Column:
    """Whether a unit goes, in `order`: the ones before it have not freed enough, and KEEP messages stay."""
    w = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (F.sum("tokens").over(w) - F.col("tokens") < excess) & (F.col("messages") - F.sum("n").over(w) >= KEEP)


def emergency_compress(messages: DataFrame, budget: int, share: float = 0.95, target: float = 0.6) -> DataFrame:
    """(conv_id, turn, tokens) of the messages that stay; only conversations above `share` of the budget are touched.

    messages: (conv_id, turn, role, tokens, tool_ids array<string>, is_result). What is cut is a unit: a call
    with its results, or one message. Until a conversation is at `target` of the budget, units go from the
    head as far as the last user row, then the largest units other than user rows, and at last the largest
    texts are cut to a stub. The last user row and KEEP messages always stay. Each step is a running sum
    over a conversation's units; texts don't travel.
    """
    totals = messages.groupBy("conv_id").agg(F.sum("tokens").alias("total"), F.count("*").alias("messages"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("asked"))
    marked = messages.join(totals, "conv_id")
    calm = marked.where(F.col("total") <= budget * share).select("conv_id", "turn", "tokens")
    limit = int(budget * target)
    rows = tool_units(marked.where(F.col("total") > budget * share))
    units = rows.groupBy("conv_id", "unit", "total", "messages", "asked").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.bool_or(F.col("turn") == F.col("asked")).alias("holds_asked"), F.bool_or(F.col("role") == "user").alias("of_user")
    )
    before_asked = (F.col("asked").isNull() | (F.col("unit") < F.col("asked"))) & ~F.coalesce("holds_asked", F.lit(False))
    units = units.withColumn("free", before_asked)
    head = units.withColumn("gone", F.col("free") & _gone(units, [F.desc("free"), F.col("unit")], F.col("total") - limit))
    kept = _left(head)
    largest = kept.withColumn("fixed", F.col("of_user"))
    largest = largest.withColumn("gone", ~F.col("fixed") & _gone(largest, [F.col("fixed"), F.desc("tokens"), F.col("unit")], F.col("total") - limit))
    stay = _left(largest).select("conv_id", "unit", F.col("total").alias("left"))
    held = rows.drop("total").join(stay, ["conv_id", "unit"])
    large = (F.col("tokens") >= LEAST_TO_TRUNCATE) & ~F.coalesce(F.col("turn") == F.col("asked"), F.lit(False))
    w = Window.partitionBy("conv_id").orderBy(F.desc("large"), F.desc("tokens"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum(F.col("tokens") - STUB_TOKENS).over(w), F.lit(0))
    cut = held.withColumn("large", large).withColumn("cut", F.col("large") & (freed < F.col("left") - limit))
    return calm.unionByName(cut.select("conv_id", "turn", F.when(F.col("cut"), F.lit(STUB_TOKENS)).otherwise(F.col("tokens")).cast("long").alias("tokens")))


def _left(units: DataFrame) -> DataFrame:
    """The units that stay, with the totals of what is left."""
    w = Window.partitionBy("conv_id")
    kept = units.withColumn("kept", ~F.col("gone"))
    total, messages = F.sum(F.when(F.col("kept"), F.col("tokens"))).over(w), F.sum(F.when(F.col("kept"), F.col("n"))).over(w)
    return kept.withColumns({"total": total, "messages": messages}).where("kept").drop("kept", "gone")


class Schedule:
    """When a session's scenes are refreshed: soon after new memories, not too often, again after the longest interval while it is active."""

    def __init__(self):
        self.at, self.kind, self.last, self.active = None, "", 0, 0

    def _fire(self, until: int) -> Iterator[tuple[int, str]]:
        while self.at is not None and self.at <= until:
            now, kind = self.at, self.kind
            self.at = None
            if kind == "max_interval" and now - self.active >= ACTIVE_MS:
                return
            yield now, kind
            self.last = now
            self.at, self.kind = now + MAX_MS, "max_interval"

    def new_memories(self, now: int) -> Iterator[tuple[int, str]]:
        yield from self._fire(now)
        self.active = now
        wanted = max(now + DELAY_MS, self.last + MIN_MS if self.last else 0)
        if self.at is None or wanted < self.at:
            self.at, self.kind = wanted, "delay"

    def end(self, until: int) -> Iterator[tuple[int, str]]:
        yield from self._fire(until)


def refreshes(events: DataFrame, until_ms: int) -> DataFrame:
    """(session_key, fired_ms, kind): refreshes of each session up to a time. events: (session_key, ts); streamed in order."""
    ordered = events.select("session_key", "ts").repartition("session_key").sortWithinPartitions("session_key", "ts")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, None
        for frame in frames:
            out = []
            for k, ts in zip(frame["session_key"], frame["ts"]):
                if own is None or k != key:
                    if own is not None:
                        out += [(key, *f) for f in own.end(until_ms)]
                    key, own = k, Schedule()
                out += [(key, *f) for f in own.new_memories(int(ts))]
            yield pd.DataFrame(out, columns=["session_key", "fired_ms", "kind"])
        if own is not None:
            yield pd.DataFrame([(key, *f) for f in own.end(until_ms)], columns=["session_key", "fired_ms", "kind"])

    return ordered.mapInPandas(fold, "session_key string, fired_ms long, kind string")


def stage_of(tokens: Column, budget: Column) -> Column:
    """none, mild, aggressive or emergency by the share of the budget."""
    share = tokens / budget
    return F.when(share >= 0.95, "emergency").when(share >= 0.85, "aggressive").when(share >= 0.5, "mild").otherwise("none")
