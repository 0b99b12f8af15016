"""The given tables as messages (L0), memories (L1), tool entries and rounds, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timefn import ms_to_iso

FIRST_MS = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def global_row_number(df: DataFrame, group: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """Row numbers from 0 over (group, order), by a prefix sum in two levels.

    `bucket` must not fall where `group` grows. Groups are counted, counts are summed within buckets and
    then over buckets, so no window sees more than a bucket's groups or one row a bucket.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("__n"), F.first(bucket).alias("__bucket"))
    buckets = counts.groupBy("__bucket").agg(F.sum("__n").alias("__all"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = buckets.select("__bucket", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__begin"))
    within = Window.partitionBy("__bucket").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(begins, "__bucket").select(group, (F.col("__begin") + F.coalesce(F.sum("__n").over(within), F.lit(0))).alias("__start"))
    own = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.join(starts, group).withColumn(name, F.col("__start") + own).drop("__start")


def fill_times(rows: DataFrame, first_ms: int = FIRST_MS, step_ms: int = 100) -> DataFrame:
    """Times for rows without any: a step for each place in the order of session and turn."""
    numbered = global_row_number(rows, "conv_id", ["turn"], F.floor(F.col("conv_id") / 1024), "__at")
    return numbered.withColumn("timestamp", F.lit(first_ms) + F.col("__at") * step_ms).drop("__at")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_times(table(spark, sf_dir, "conversations"))
    return rows.select(
        F.concat(F.lit("l0_"), "conv_id", F.lit("_"), "turn").alias("record_id"),
        F.concat(F.lit("agent:a"), F.col("conv_id") % 5, F.lit(":s"), F.col("conv_id") % 20).alias("session_key"),
        F.concat(F.lit("c"), "conv_id").alias("session_id"), "role", F.col("text").alias("message_text"), ms_to_iso(F.col("timestamp")).alias("recorded_at"),
        "timestamp", "conv_id", "turn",
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.lit(FIRST_MS) + F.col("doc_id") * 3_600_000
    return d.select(
        F.concat(F.lit("m_"), "doc_id").alias("record_id"), F.col("text").alias("content"),
        F.element_at(F.array(F.lit("persona"), F.lit("episodic"), F.lit("instruction")), (F.col("doc_id") % 3 + 1).cast("int")).alias("type"),
        (F.col("doc_id") % 101).cast("long").alias("priority"), F.col("source").alias("scene_name"),
        F.concat(F.lit("agent:a"), F.col("doc_id") % 5, F.lit(":s"), F.col("doc_id") % 20).alias("session_key"),
        F.concat(F.lit("c"), F.col("doc_id") % 50).alias("session_id"), ms_to_iso(at).alias("updated_time"), at.alias("updated_ms"), "doc_id",
    )


def tool_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as tool entries of their user's session, in order."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("session_key"), (F.row_number().over(order) - 1).cast("long").alias("idx"), "event_id",
        F.concat(F.lit("call_"), "event_id").alias("tool_call_id"), (F.col("event_id") % 11).cast("long").alias("score"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lpad((F.col("event_id") % 7).cast("string"), 3, "0"), F.lit("-N"), F.col("event_id") % 5)).when(F.col("event_id") % 3 == 1, "wait").alias("node_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("props").alias("summary"),
    )


MESSAGES_SQL = f"""messages AS (
    SELECT 'l0_' || conv_id || '_' || turn AS record_id, 'agent:a' || (conv_id % 5) || ':s' || (conv_id % 20) AS session_key, 'c' || conv_id AS session_id,
           role, text AS message_text, strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS recorded_at, ts AS timestamp, conv_id, turn
    FROM (SELECT *, {FIRST_MS} + 100 * (row_number() OVER (ORDER BY conv_id, turn) - 1) AS ts FROM conversations)
)"""
MEMORIES_SQL = f"""memories AS (
    SELECT 'm_' || doc_id AS record_id, text AS content, ['persona', 'episodic', 'instruction'][doc_id % 3 + 1] AS type, CAST(doc_id % 101 AS BIGINT) AS priority, source AS scene_name,
           'agent:a' || (doc_id % 5) || ':s' || (doc_id % 20) AS session_key, 'c' || (doc_id % 50) AS session_id,
           strftime(make_timestamp(({FIRST_MS} + doc_id * 3600000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS updated_time, {FIRST_MS} + doc_id * 3600000 AS updated_ms, doc_id
    FROM documents
)"""
ENTRIES_SQL = """entries AS (
    SELECT 'u' || user_id AS session_key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id, 'call_' || event_id AS tool_call_id,
           CAST(event_id % 11 AS BIGINT) AS score,
           CASE event_id % 3 WHEN 0 THEN lpad(CAST(event_id % 7 AS VARCHAR), 3, '0') || '-N' || (event_id % 5) WHEN 1 THEN 'wait' END AS node_id,
           epoch_ns(ts) // 1000000 AS ts_ms, props AS summary
    FROM events
)"""
