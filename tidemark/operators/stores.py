"""Stored memories, profiles and scenes: decisions, upserts, retention, sync, inspection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Fixed values of retention and of the filter language.
LEAST_L0, LEAST_L1, MOST_EXPIRED = 50, 20, 0.8
OPERATORS = (">=", "<=", "!=", ">", "<", "=")
CANVASES_KEPT = 15
META_START, META_END = "-----META-START-----", "-----META-END-----"
DELETED = "[DELETED]"


def complete_decisions(new: DataFrame, decisions: DataFrame) -> DataFrame:
    """One decision for each new memory: the last given one (largest `at`), `store` where there is none or the action is unknown.

    decisions: (record_id, at, action, target_ids, merged_content, merged_type, merged_priority).
    """
    last = decisions.where(F.coalesce("record_id", F.lit("")) != "").withColumn("__rn", F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("at"))))
    last = last.where("__rn = 1").drop("__rn", "at")
    action = F.when(F.lower("action").isin("store", "update", "merge", "skip"), F.lower("action")).otherwise(F.lit("store"))
    kind = F.when(F.col("merged_type").isin("persona", "episodic", "instruction"), F.col("merged_type"))
    return new.select("record_id").join(last, "record_id", "left").withColumn("action", F.coalesce(action, F.lit("store"))).withColumn("merged_type", kind)


def apply_decisions(existing: DataFrame, new: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """The live memories (record_id, content, type, priority, scene_name, created_time, updated_time) after a batch.

    skip drops the new memory; update and merge remove their targets and write merged fields where given.
    Targets are existing records, so one pass over the set equals running the decisions in order.
    """
    full = complete_decisions(new, decisions)
    removed = full.where(F.col("action").isin("update", "merge")).select(F.explode("target_ids").alias("record_id")).distinct()
    merged = F.col("action").isin("update", "merge")
    pick = lambda m, own: F.when(merged, F.coalesce(m, own)).otherwise(F.col(own)).alias(own)
    written = new.join(full, "record_id").where("action <> 'skip'").select(
        "record_id", pick("merged_content", "content"), pick("merged_type", "type"), pick("merged_priority", "priority"), "scene_name", F.lit(now).alias("created_time"), F.lit(now).alias("updated_time")
    )
    return existing.join(removed, "record_id", "left_anti").select(*written.columns).unionByName(written)


def upsert(existing: DataFrame, new: DataFrame, key: str, first_value: tuple[str, ...], order: str) -> DataFrame:
    """Rows by key, new values over old ones; columns in `first_value` keep what was inserted first.

    Of new rows with one key the last by `order` counts, and for `first_value` the first; both are taken before the join.
    """
    of = [c for c in existing.columns if c != key]
    new = new.groupBy(key).agg(*((F.min_by if c in first_value else F.max_by)(c, order).alias(c) for c in of))
    both = existing.alias("o").join(new.alias("n"), key, "full_outer")
    cols = [F.col(key)]
    fresh, known = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    for c in existing.columns:
        if c != key:
            cols.append((F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in first_value else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c))
    return both.select(*cols)


def expire(rows: DataFrame, time_col: str, cutoff: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one audit row). Rows with a time before the cutoff go, unless the table is small or too many would."""
    gone = F.coalesce((F.col(time_col) != "") & (F.col(time_col) < cutoff), F.lit(False))
    audit = rows.agg(F.count("*").alias("total"), F.count(F.when(gone, 1)).alias("expired"))
    state = F.when(F.col("total") <= least, "skipped").when(F.col("expired") == 0, "nothing").when(F.col("expired") / F.col("total") > MOST_EXPIRED, "blocked").otherwise("deleted")
    audit = audit.withColumn("state", state)
    kept = rows.crossJoin(F.broadcast(audit.select("state"))).where((F.col("state") != "deleted") | ~gone).drop("state")
    return kept, audit


def sync_profiles(local: DataFrame, remote: DataFrame, now_ms: int) -> DataFrame:
    """(id, action, version, created_at_ms, updated_at_ms): insert, skip, conflict or update of each local row; only hashes travel.

    local: (id, content_md5, baseline_version, created_at_ms); remote: (id, content_md5, version, created_at_ms).
    """
    r = remote.select("id", F.col("content_md5").alias("r_md5"), F.col("version").alias("r_version"), F.col("created_at_ms").alias("r_created"), F.lit(True).alias("r"))
    action = (
        F.when(F.col("r").isNull(), "insert").when(F.col("r_md5") == F.col("content_md5"), "skip")
        .when(F.coalesce("baseline_version", F.lit(0)) != F.col("r_version"), "conflict").otherwise("update")
    )
    out = local.join(r, "id", "left").withColumn("action", action)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(now_ms))
    return out.select(
        "id", "action",
        F.when(F.col("action") == "insert", F.lit(1)).when(F.col("action") == "update", F.col("r_version") + 1).otherwise(F.col("r_version")).cast("long").alias("version"),
        F.when(F.col("action") == "insert", positive("created_at_ms")).otherwise(positive("r_created")).cast("long").alias("created_at_ms"),
        F.when(F.col("action").isin("insert", "update"), F.lit(now_ms)).cast("long").alias("updated_at_ms"),
    )


def diff_scenes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(filename, status): created, updated (content differs) and deleted scenes. Both: (filename, content)."""
    b, a = (x.select("filename", F.sha2(F.coalesce("content", F.lit("")), 256).alias(h)) for x, h in ((before, "b"), (after, "a")))
    status = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "updated")
    return b.join(a, "filename", "full_outer").select("filename", status.alias("status")).where("status is not null")


def parse_scene(raw: Column) -> Column:
    """struct(created, updated, summary, heat, content) of a scene file; all is content where there is no META section."""
    start, end = F.locate(META_START, raw), F.locate(META_END, raw)
    meta = T.trim_all(F.substring(raw, start + len(META_START), end - start - len(META_START)))
    there = (start > 0) & (end > 0)
    field = lambda name: F.when(there, T.trim_all(F.regexp_extract(meta, rf"(?m)^{name}:\s*(.*)$", 1))).otherwise(F.lit(""))
    heat = F.coalesce(F.regexp_extract(field("heat"), r"^([+-]?\d+)", 1).try_cast("long"), F.lit(0))
    content = F.when(there, F.substring(raw, end + len(META_END), F.length(raw))).otherwise(raw)
    return F.struct(field("created").alias("created"), field("updated").alias("updated"), field("summary").alias("summary"), heat.alias("heat"), T.trim_all(content).alias("content"))


def format_scene(created: Column, updated: Column, summary: Column, heat: Column, content: Column) -> Column:
    meta = [F.lit(META_START), F.concat(F.lit("created: "), created), F.concat(F.lit("updated: "), updated), F.concat(F.lit("summary: "), summary), F.concat(F.lit("heat: "), heat.cast("string")), F.lit(META_END)]
    return F.concat(F.concat_ws("\n", *meta), F.lit("\n\n"), content)


def live_scene(raw: Column) -> Column:
    """Whether a scene file is neither blank, marked deleted nor metadata only."""
    body = parse_scene(raw)["content"]
    return (T.trim_all(raw) != "") & (T.trim_all(raw) != DELETED) & (body != "") & (body != DELETED)


def unique_names(rows: DataFrame, dir_col: str, name_col: str) -> DataFrame:
    """`target`: normalised file names, with -2, -3, ... where several rows of a folder want one; names that are canonical already come first."""
    target = T.scene_file_name(F.col(name_col))
    w = Window.partitionBy(dir_col, "__target").orderBy(F.when(F.col(name_col) == F.col("__target"), 0).otherwise(1), name_col)
    n = F.row_number().over(w)
    out = rows.withColumn("__target", target).withColumn("__n", n)
    stem = F.regexp_replace("__target", r"\.md$", "")
    return out.withColumn("target", F.when(F.col("__n") == 1, F.col("__target")).otherwise(F.concat(stem, F.lit("-"), "__n", F.lit(".md")))).drop("__target", "__n")


def reclaim_canvases(c: DataFrame, cutoff_ms: int) -> DataFrame:
    """Canvases to drop: expired ones, oldest first, never active ones, while CANVASES_KEPT remain for the agent. c: (agent, filename, mtime_ms, is_active)."""
    w = Window.partitionBy("agent")
    held = c.where(~F.col("is_active")).withColumn("__rn", F.row_number().over(w.orderBy("mtime_ms", "filename"))).withColumn("__all", F.count("*").over(w))
    return held.where((F.col("mtime_ms") < cutoff_ms) & (F.col("__all") - F.col("__rn") >= CANVASES_KEPT)).drop("__rn", "__all")


def persona_trigger(interval: int) -> Column:
    """The first condition that holds of five, as a name; null: none.

    Columns: request_update, scenes_processed, last_persona_at, has_scenes, has_body, memories_since.
    """
    c = F.col
    return (
        F.when(c("request_update"), "request").when((c("scenes_processed") > 0) & (c("last_persona_at") == 0) & c("has_scenes"), "cold_start")
        .when((c("last_persona_at") > 0) & c("has_scenes") & ~c("has_body"), "recovery").when((c("scenes_processed") == 1) & (c("memories_since") > 0), "first_scene")
        .when(c("memories_since") >= interval, "threshold")
    )


def filter_column(expression: str, columns: tuple[str, ...]) -> Column:
    """A predicate of `a=1,b>=2,c!=x`: commas join, camelCase names are taken, values that look like numbers are numbers."""
    out = F.lit(True)
    for part in filter(None, (p.strip() for p in expression.split(","))):
        op = next((o for o in OPERATORS if o in part), None)
        if op is None:
            raise ValueError(f"no operator in {part!r}")
        name, value = (x.strip() for x in part.split(op, 1))
        column = re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), name)
        if column not in columns:
            raise ValueError(f"unknown column {name!r}")
        number = re.fullmatch(r"-?\d+(\.\d+)?", value)
        v = F.lit(float(value) if "." in value else int(value)) if number else F.lit(value)
        c = F.col(column)
        out = out & {">=": c >= v, "<=": c <= v, "!=": c != v, ">": c > v, "<": c < v, "=": c == v}[op]
    return out


def time_bound(expression: str, now_ms: int) -> int:
    """Epoch milliseconds of `7d`, `24h`, `30m`, `10s` before now, or of an ISO time."""
    m = re.fullmatch(r"(\d+)([dhms])", expression.strip())
    if m:
        return now_ms - int(m[1]) * {"d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000}[m[2]]
    from datetime import UTC, datetime

    at = datetime.fromisoformat(expression)
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def overview(l0: DataFrame, l1: DataFrame) -> DataFrame:
    """(layer, key, n): totals, messages by role, memories by type."""
    total = lambda df, layer: df.agg(F.count("*").alias("n")).select(F.lit(layer).alias("layer"), F.lit("total").alias("key"), "n")
    by = lambda df, layer, c: df.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(layer).alias("layer"), "key", "n")
    return total(l0, "L0").unionByName(by(l0, "L0", "role")).unionByName(total(l1, "L1")).unionByName(by(l1, "L1", "type"))


def most_frequent(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The value of each group that is most frequent; ties to the one seen first."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    return counts.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "__first"))).where("__rn = 1").drop("__rn", "__first")
