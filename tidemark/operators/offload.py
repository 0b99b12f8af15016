"""Tool entries of long conversations: boundaries, node ids, triggers, and what to cut from a conversation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.tokens import estimate_tokens

# Fixed values of triggers, cuts and stand-in rows.
HEARTBEAT = "HEARTBEAT.md"
NULLS, TIMEOUT_S, WAIT_S = 4, 300, 120
CHUNK, FLUSH_AT = 5, 4
KEEP_HEAD, KEEP_TAIL, TAIL_SHARE, HEAD_SHARE, HISTORY_SHARE = 2, 10, 0.60, 0.2, 0.2
MILD, AGGRESSIVE, EMERGENCY = 0.5, 0.85, 0.95
SCAN_SHARE, FIRST_SCORE, LAST_SCORE, ENOUGH_REPLACED = 0.7, 7, 1, 10
TRIGGER_COST = 80


def message_tokens(text: Column, counter: Callable[[Column], Column] = estimate_tokens) -> Column:
    """Tokens of a message by a counter that the caller may supply: a function of Columns, the estimate by default."""
    return counter(F.coalesce(text, F.lit("")))


def boundary_of(entries: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Entries with `result` and `target` of the last boundary at or before their index.

    boundaries: (session_key, start_index, at, result, target); of equal starts the last written counts.
    One shuffle by session: boundaries and entries are sorted together and the last boundary is carried on.
    """
    b = boundaries.groupBy("session_key", "start_index").agg(F.max_by(F.struct("result", "target"), "at").alias("b"))
    left = entries.withColumn("b", F.lit(None).cast(b.schema["b"].dataType)).withColumn("__is", F.lit(1))
    right = b.select("session_key", F.col("start_index").alias("idx"), "b", F.lit(0).alias("__is"))
    w = Window.partitionBy("session_key").orderBy("idx", "__is").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("b", F.last("b", ignorenulls=True).over(w)).where("__is = 1")
    return both.withColumns({"result": F.col("b.result"), "target": F.col("b.target")}).drop("b", "__is")


def eligible(entries: DataFrame, boundaries: DataFrame, now_ms: int) -> DataFrame:
    """Entries that wait for a node: null ones, and `wait` ones of WAIT_S seconds or more, within long tasks that have a canvas."""
    own = boundary_of(entries, boundaries).where(~F.coalesce(F.col("summary").contains(HEARTBEAT), F.lit(False)))
    open_ = F.col("node_id").isNull() | ((F.col("node_id") == "wait") & ((now_ms - F.col("ts_ms")) / 1000 >= WAIT_S))
    return own.where(open_ & (F.col("result") == "long") & F.col("target").isNotNull())


def triggers(entries: DataFrame, boundaries: DataFrame, last_run: DataFrame, now_ms: int) -> DataFrame:
    """(session_key, eligible, nulls, canvases, reason): whether a session's canvas is due; reason null: no.

    last_run: (session_key, last_ms), missing where none has run.
    """
    e = eligible(entries, boundaries, now_ms)
    sums = e.groupBy("session_key").agg(
        F.count_distinct("target", "tool_call_id").alias("eligible"), F.count(F.when(F.col("node_id").isNull(), 1)).alias("nulls"), F.count_distinct("target").alias("canvases")
    )
    open_nulls = entries.where(F.col("node_id").isNull()).groupBy("session_key").agg(F.min_by("ts_ms", "idx").alias("oldest"), F.max("ts_ms").alias("latest"))
    out = sums.join(open_nulls, "session_key", "left").join(last_run, "session_key", "left")
    waiting = F.col("eligible") > F.col("nulls")
    elapsed = (now_ms - F.col("last_ms")) / 1000
    reason = (
        F.when(F.col("nulls") >= NULLS, "null_count")
        .when(F.col("last_ms").isNotNull() & (elapsed >= TIMEOUT_S) & (waiting | (F.col("latest") > F.col("last_ms"))), "timeout")
        .when(F.col("last_ms").isNull() & waiting, "retry_wait")
        .when(F.col("last_ms").isNull() & ((now_ms - F.col("oldest")) / 1000 >= TIMEOUT_S), "oldest_null")
    )
    return out.select("session_key", "eligible", "nulls", "canvases", reason.alias("reason"))


def backfill(entries: DataFrame, mapping: DataFrame, waiting: DataFrame, canvas_fallback: str | None) -> DataFrame:
    """Entries with node ids: the mapped one, else for waiting ones the most frequent mapped id of the session or the canvas's.

    entries: (session_key, tool_call_id, node_id, ...); mapping: (session_key, tool_call_id, node, pos), of which the last
    for an id counts; waiting: (session_key, tool_call_id).
    """
    key = ["session_key", "tool_call_id"]
    m = mapping.where(F.trim("node") != "").groupBy(*key).agg(F.max_by(F.trim("node"), "pos").alias("node"), F.max("pos").alias("pos"))
    best = m.groupBy("session_key", "node").agg(F.count("*").alias("n"), F.min("pos").alias("p")).groupBy("session_key").agg(F.max_by("node", F.struct("n", -F.col("p"))).alias("best"))
    out = entries.join(m.drop("pos"), key, "left").join(waiting.select(*key).distinct().withColumn("__w", F.lit(True)), key, "left").join(best, "session_key", "left")
    late = (F.col("node_id") == "wait") & F.col("__w")
    fallback = F.coalesce("best", F.lit(canvas_fallback), "node_id")
    return out.withColumn("node_id", F.when(F.col("node").isNotNull(), F.col("node")).when(late, fallback).otherwise(F.col("node_id"))).drop("node", "__w", "best")


def new_entries(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Entries whose id, written with or without underscores, isn't stored in their session; repeats within the batch stay.

    Both: (session_key, tool_call_id, ...). Entries without an id (null or empty) are always new.
    """
    has_id = F.coalesce(F.col("tool_call_id") != "", F.lit(False))
    known = stored.where(has_id).select("session_key", T.tool_key(F.col("tool_call_id")).alias("__k")).distinct()
    own = batch.withColumn("__k", F.when(has_id, T.tool_key(F.col("tool_call_id"))))
    return own.join(known, ["session_key", "__k"], "left_anti").select(*batch.columns)


def lookup(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """Asked ids with `entry`, the stored entry of their session (null: none), a struct of the other columns of `entries`.

    ids: (session_key, tool_call_id, ...); entries: (session_key, idx, tool_call_id, ...). The last entry of the exact id
    counts; else the last one of the id without underscores, else the first whose id gives that without its own.
    """
    key = ["session_key", "tool_call_id"]
    entry = F.struct(*(c for c in entries.columns if c not in key))
    bare = T.tool_key(F.col("tool_call_id"))
    last = entries.groupBy(*key).agg(F.max_by(entry, "idx").alias("__last"))
    plain = F.col("tool_call_id") == bare
    loose = entries.groupBy("session_key", bare.alias("__k")).agg(F.max_by(F.when(plain, entry), F.when(plain, F.col("idx"))).alias("__plain"), F.min_by(F.when(~plain, entry), F.when(~plain, F.col("idx"))).alias("__first"))
    out = ids.withColumn("__k", bare).join(last, key, "left").join(loose, ["session_key", "__k"], "left")
    return out.select(*(F.col(c) for c in ids.columns), F.coalesce("__last", "__plain", "__first").alias("entry"))


def chunks(pairs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Pending pairs of a session without heartbeats in chunks by arrival, and whether enough are pending to flush."""
    own = pairs.where(~F.coalesce(F.col("summary").contains(HEARTBEAT), F.lit(False)))
    w = Window.partitionBy("session_key")
    rn = F.row_number().over(w.orderBy("idx")) - 1
    return own.withColumn("chunk", F.floor(rn / size)).withColumn("due", F.count("*").over(w) >= FLUSH_AT)


def head_cut(messages: DataFrame, threshold: Column) -> DataFrame:
    """(conv_id, cut, tokens_left): messages to delete from the head so that the tokens come down to the threshold.

    messages: (conv_id, turn, role, tokens, is_tool_result). At most all but KEEP_HEAD; tool results after the cut go
    along; the last user row stays.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("pos", F.row_number().over(w)).withColumn("sum", F.sum("tokens").over(w)).withColumn("limit", threshold)
    m = m.withColumn("next_kept", F.min(F.when(~F.col("is_tool_result"), F.col("pos"))).over(w.rowsBetween(0, Window.unboundedFollowing)))
    total, n = F.max("sum"), F.max("pos")
    sums = m.groupBy("conv_id").agg(total.alias("total"), n.alias("n"), F.max("limit").alias("limit"), F.max(F.when(F.col("role") == "user", F.col("pos") - 1)).alias("last_user"))
    need, most = F.col("total") - F.col("limit"), F.greatest(F.col("n") - KEEP_HEAD, F.lit(0))
    j = m.join(sums.drop("limit"), "conv_id")
    first = F.min(F.when(F.col("sum") >= F.col("total") - F.col("limit"), F.col("pos")))
    cut = j.groupBy("conv_id").agg(first.alias("first")).join(sums, "conv_id")
    raw = F.when(need <= 0, 0).otherwise(F.least(F.col("first"), most))
    cut = cut.withColumn("raw", raw)
    after = m.select("conv_id", (F.col("pos") - 1).alias("raw"), F.coalesce(F.col("next_kept") - 1, F.lit(None)).alias("adjusted"))
    cut = cut.join(after, ["conv_id", "raw"], "left").withColumn("adjusted", F.when((F.col("raw") <= 0) | (F.col("raw") >= F.col("n")), F.col("raw")).otherwise(F.coalesce("adjusted", "n")))
    capped = F.when(F.col("adjusted") <= 0, 0).when(F.col("last_user").isNull() | (F.col("adjusted") <= F.col("last_user")), F.col("adjusted")).otherwise(F.col("last_user"))
    cut = cut.select("conv_id", capped.cast("long").alias("cut"), "total")
    gone = m.select("conv_id", F.col("pos").alias("cut"), "sum")
    return cut.join(gone, ["conv_id", "cut"], "left").select("conv_id", "cut", (F.col("total") - F.coalesce("sum", F.lit(0))).alias("tokens_left"))


def tail_keep(messages: DataFrame, target: Column) -> DataFrame:
    """(conv_id, keep_from, n): the tail to keep, from the position `keep_from` on.

    messages: (conv_id, turn, role, tokens, is_tool_result). The longest tail within the target, without tool results at
    its head, whose calls are gone; with the last user row; of KEEP_TAIL messages at least. One shuffle, by conversation.
    """
    all_, order = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("pos", F.row_number().over(order) - 1).withColumn("target", target)
    m = m.withColumn("suffix", F.sum("tokens").over(all_) - F.sum("tokens").over(order) + F.col("tokens"))
    m = m.withColumn("from", F.coalesce(F.max(F.when(F.col("suffix") > F.col("target"), F.col("pos") + 1)).over(all_), F.lit(0)))
    s = m.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.min(F.when((F.col("pos") >= F.col("from")) & ~F.col("is_tool_result"), F.col("pos"))).alias("from"),
        F.max(F.when(F.col("role").isin("user", "human"), F.col("pos"))).alias("user"),
    )
    start = F.coalesce("from", "n")
    kept = F.when((F.col("user") < start) & (start < F.col("n")), F.col("user")).otherwise(start)
    kept = F.when(F.col("n") - kept < KEEP_TAIL, F.greatest(F.col("n") - KEEP_TAIL, F.lit(0))).otherwise(kept)
    return s.select("conv_id", kept.cast("long").alias("keep_from"), "n")


def canvas_budget(canvases: DataFrame, deleted: DataFrame, budget: int) -> DataFrame:
    """(agent, used, chosen): canvases of deleted work, the highest prefix first, in full where they fit in the budget, else in short form where that fits, else not.

    canvases: (agent, filename, is_active, full, short) with sizes in tokens; deleted: (agent, node_id) of deleted entries.
    Only canvases count whose name's part before the first `-` is that of a deleted node, and never the active one;
    chosen ones are told oldest first. A greedy walk over each agent's sizes; texts don't travel.
    """
    prefix = lambda c: F.substring_index(c, "-", 1)
    gone = deleted.where(prefix("node_id") != "").select("agent", prefix("node_id").alias("__p")).distinct()
    own = canvases.where(~F.col("is_active")).withColumn("__p", prefix("filename")).join(gone, ["agent", "__p"], "left_semi")
    sorted_ = own.groupBy("agent").agg(F.sort_array(F.collect_list(F.struct("filename", "full", "short")), False).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("chosen"))

    def step(s: Column, c: Column) -> Column:
        fits, short = s["used"] + c["full"] <= budget, s["used"] + c["short"] <= budget
        name = lambda form: F.concat(F.array(F.concat(c["filename"], F.lit(form))), s["chosen"])
        return F.struct(
            F.when(fits, s["used"] + c["full"]).when(short, s["used"] + c["short"]).otherwise(s["used"]).alias("used"),
            F.when(fits, name("")).when(short, name("(meta)")).otherwise(s["chosen"]).alias("chosen"),
        )

    return sorted_.select("agent", F.aggregate("items", start, step).alias("r")).select("agent", F.col("r.used").alias("used"), F.col("r.chosen").alias("chosen"))


def reapply_deleted(blocks: DataFrame, deleted: DataFrame) -> DataFrame:
    """Blocks that stay: tool results and tool uses with an id deleted in their conversation go, and so do rows of which nothing is left.

    blocks: (conv_id, turn, kind, tool_call_id, ...); deleted: (conv_id, tool_call_id). Ids count without underscores.
    """
    known = deleted.select("conv_id", T.tool_key(F.col("tool_call_id")).alias("__k")).distinct()
    return blocks.withColumn("__k", T.tool_key(F.col("tool_call_id"))).join(known, ["conv_id", "__k"], "left_anti").select(*blocks.columns)


def summary_text(node: Column, summary: Column, ref: Column) -> Column:
    """What replaces a stored tool result."""
    return F.concat(
        F.lit("[Offloaded Tool Result | node: "), F.coalesce(node, F.lit("N/A")), F.lit("]\nSummary: "), summary, F.lit("\nresult_ref: "), ref, F.lit(" (read this file for full tool call and raw result)")
    )


def stand_in(tool: Column, params: Column, result: Column) -> Column:
    """struct(tool_call, summary): the row of a pair that no model has summed up."""
    cut = F.when(F.length(result) > 300, F.concat(F.substring(result, 1, 297), F.lit("..."))).otherwise(result)
    return F.struct(F.concat(tool, F.lit("("), F.substring(params, 1, 200), F.lit(")")).alias("tool_call"), F.concat(F.lit("[L1 degraded] "), tool, F.lit(": "), cut).alias("summary"))


def compact_call(call: Column, most: int = 300) -> Column:
    """At most `most` characters of a tool call, with `…` where it was cut."""
    return F.when(F.length(call) <= most, call).otherwise(F.concat(F.substring(call, 1, most), F.lit("…")))


def largest_group(blocks: DataFrame) -> DataFrame:
    """(conv_id, tool_call_id, tokens): the tool call with its results that takes most tokens of a conversation; ties to the smaller id."""
    sums = blocks.where("tool_call_id is not null").groupBy("conv_id", "tool_call_id").agg(F.sum("tokens").alias("tokens"))
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("tokens"), "tool_call_id"))
    return sums.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def replaceable(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Tool results of which their session has an entry, by the id without underscores. Both: (session_key, tool_call_id, ...)."""
    known = entries.select("session_key", T.tool_key(F.col("tool_call_id")).alias("__k")).distinct()
    return results.withColumn("__k", T.tool_key(F.col("tool_call_id"))).join(known, ["session_key", "__k"], "left_semi").select(*results.columns)


def scored_messages(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """(session_key, idx, kind, ids, score, fits) of messages that may be replaced: results with an entry, and calls all of whose ids have one.

    messages: (session_key, idx, kind `result` or `use`, ids, size); entries: (session_key, tool_call_id, score, summary_size).
    A call has the least score of its ids; results whose summary is longer than they are don't fit.
    """
    own = messages.select("session_key", "idx", "kind", "ids", "size", F.explode("ids").alias("tool_call_id"))
    e = entries.groupBy("session_key", T.tool_key(F.col("tool_call_id")).alias("__k")).agg(F.min(F.coalesce("score", F.lit(5))).alias("score"), F.min("summary_size").alias("summary_size"))
    found = own.withColumn("__k", T.tool_key(F.col("tool_call_id"))).join(e, ["session_key", "__k"])
    sums = found.groupBy("session_key", "idx", "kind", "ids", "size").agg(F.min("score").alias("score"), F.count("*").alias("n"), F.min("summary_size").alias("summary_size"))
    fits = (F.col("kind") == "use") | (F.col("summary_size") <= F.col("size"))
    return sums.where(F.col("n") == F.size("ids")).select("session_key", "idx", "kind", "ids", "score", fits.alias("fits"))


def cascade(scored: DataFrame, totals: DataFrame) -> DataFrame:
    """(session_key, idx, level) of messages to replace: of the first SCAN_SHARE of a session's, by falling score until ENOUGH_REPLACED are.

    scored: as `scored_messages` gives them; totals: (session_key, messages). Calls take their results along,
    wherever these stand; a message is replaced at the highest level that reaches it.
    """
    known = scored.join(totals, "session_key").withColumn("level", F.least("score", F.lit(FIRST_SCORE))).where(F.col("score") >= LAST_SCORE)
    scanned = known.where(F.col("idx") < F.floor(F.col("messages") * SCAN_SHARE))
    own = scanned.where("fits").select("session_key", "idx", "level")
    calls = scanned.where("kind = 'use'").select("session_key", "level", F.explode("ids").alias("id"))
    taken = scored.where("kind = 'result'").select("session_key", "idx", F.element_at("ids", 1).alias("id")).join(calls, ["session_key", "id"]).select("session_key", "idx", "level")
    reached = own.unionByName(taken).groupBy("session_key", "idx").agg(F.max("level").alias("level"))
    per = reached.groupBy("session_key", "level").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("session_key").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = per.withColumn("above", above).where(F.col("above") < ENOUGH_REPLACED).select("session_key", "level")
    return reached.join(levels, ["session_key", "level"])


def residue(entries: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Entries, heartbeats aside, before the start of a newer task that still wait and belong to the canvas before it."""
    own = boundary_of(entries, boundaries).where(~F.coalesce(F.col("summary").contains(HEARTBEAT), F.lit(False)))
    w = Window.partitionBy("session_key").orderBy("start_index")
    switch = boundaries.groupBy("session_key", "start_index").agg(F.max_by("target", "at").alias("target")).withColumn("before", F.lag("target").over(w)).where("before is not null and target is not null and before <> target")
    last = switch.groupBy("session_key").agg(F.max("start_index").alias("start"), F.max_by("before", "start_index").alias("before"))
    waits = F.col("node_id").isNull() | (F.col("node_id") == "wait")
    return own.join(last, "session_key").where((F.col("idx") < F.col("start")) & waits & (F.col("target") == F.col("before"))).drop("start", "before")
