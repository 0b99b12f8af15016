"""Registered queries of tables that are kept: retention by day, statistics by changes, table functions in SQL, loose JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import jsontext as J
from tidemark.functions.tables import register
from tidemark.operators import stores as S
from tidemark.operators.daily import DayTable
from tidemark.operators.termstats import TermStats
from tidemark.plans import store_queries
from tidemark.plans.base import memories, table
from tidemark.plans.offload_queries import ORACLES as OFFLOAD_SQL
from tidemark.plans.search_queries import ORACLES as SEARCH_SQL
from tidemark.plans.search_queries import BM25_SQL
from tidemark.sources.folders import shared_folder

CUTOFF = "2024-01-06T00:00:00.000Z"


def a14_expiry_by_day(spark, d):
    """The rows that are left of a table by day after its retention."""
    days = DayTable(spark, f"memories_{uuid.uuid4().hex}", "updated_time")
    days.append(memories(spark, d).select("record_id", "updated_time"))
    days.expire(CUTOFF, S.LEAST_L1)
    return days.rows()


def a14_days_left(spark, d):
    """Rows a day after a retention in the middle of a day, as counted beside the table."""
    days = DayTable(spark, f"memories_{uuid.uuid4().hex}", "updated_time")
    days.append(memories(spark, d).select("record_id", "updated_time"))
    days.expire("2024-01-03T07:30:00.000Z", S.LEAST_L1)
    return days.counts()


def a15_kept_stats(spark, d):
    """Term statistics after a load, a batch of changed and new texts, and one of deletions, which comes twice."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    none, k = docs.limit(0), F.col("id")
    stats = TermStats(spark, shared_folder(spark, "term-stats"))
    stats.apply(docs.where(k % 5 != 1), none, 0)
    changed = docs.where(k % 5 < 2).withColumn("text", F.when(k % 5 == 1, F.col("text")).otherwise(F.concat("text", F.lit(" once more"))))
    stats.apply(changed, docs.where(k % 7 == 1), 1)
    for _ in range(2):
        stats.apply(none, docs.where(k % 3 == 2), 2)
    kept = stats.compact(shared_folder(spark, "term-stats"), most=2)
    return kept.stats().select("term", "df", "n", F.round("avg_len", 6).alias("avg_len"))


def p6_sql_terms(spark, d):
    """The terms of all texts, by a table function in SQL."""
    register(spark)
    return spark.sql("SELECT * FROM index_terms(TABLE(SELECT doc_id AS id, text FROM {docs}))", docs=table(spark, d, "documents"))


def w10_sql_budget(spark, d):
    """Canvases of each user's events within a budget, the last first, by a table function in SQL."""
    register(spark)
    name = "lpad(CAST(event_id % 90 AS STRING), 3, '0') || '-task-' || event_id || '.mmd'"
    rows = f"SELECT 'u' || user_id AS agent, {name} AS filename, event_id % 97 + 20 AS full, event_id % 13 + 5 AS short FROM {{events}}"
    return spark.sql(f"SELECT agent, used, array_join(chosen, ',') AS chosen FROM canvas_budget(TABLE({rows}) PARTITION BY (agent) ORDER BY (filename DESC), 450)", events=table(spark, d, "events"))


def _texts(k):
    """JSON of several kinds, and texts that are none."""
    kinds = [F.col("props"), F.lit("[1, 2]"), F.lit("5"), F.lit('{"k": '), F.lit(None), F.concat(F.lit('{"k": {"a": ["x", "y'), k, F.lit('"]}, "s": true}')), F.lit('"text"'), F.lit("null")]
    return F.element_at(F.array(*(x.cast("string") for x in kinds)), (k % len(kinds) + 1).cast("int"))


def x22_metadata(spark, d):
    """Metadata of any kind as VARIANT: all but objects become empty, and fields are read by their path."""
    m = J.metadata_of(_texts(F.col("event_id")))
    e = table(spark, d, "events").select("event_id", m.alias("m"))
    return e.select("event_id", (F.to_json("m") == "{}").alias("empty"), J.field(F.col("m"), "$.k", "bigint").alias("k"), J.field(F.col("m"), "$.k.a[1]", "string").alias("second"), J.field(F.col("m"), "$.s", "boolean").alias("s"))


def x18_control_characters(spark, d):
    """JSON with raw control characters: escaped inside strings, or without the rare ones, or given up."""
    k = F.col("event_id")
    texts = [
        F.concat(F.lit('{\n"a": "line\none\t'), k, F.lit('"}')), F.concat(F.lit('{"a": "x\x01y'), k, F.lit('"}')), F.concat(F.lit('{"a"\x02: "z'), k, F.lit('"}')), F.concat(F.lit('{"a": "open'), k),
        F.concat(F.lit('{"a": "say \\"\n\\" and \\\\", "b": '), k, F.lit("}")),
    ]
    raw = F.element_at(F.array(*texts), (k % len(texts) + 1).cast("int"))
    good = J.tolerant(raw)
    return table(spark, d, "events").select("event_id", J.escaped(raw).alias("escaped"), good.alias("read"), J.field(F.try_parse_json(good), "$.a", "string").alias("a"))


QUERIES = {f.__name__: f for f in (a14_expiry_by_day, a14_days_left, a15_kept_stats, p6_sql_terms, w10_sql_budget, x22_metadata, x18_control_characters)}

_KINDS = """m AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '[1, 2]' WHEN 2 THEN '5' WHEN 3 THEN '{"k": ' WHEN 4 THEN NULL WHEN 5 THEN '{"k": {"a": ["x", "y' || event_id || '"]}, "s": true}' WHEN 6 THEN '"text"' ELSE 'null' END AS t FROM events),
    o AS (SELECT event_id, CASE WHEN coalesce(json_valid(t), false) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT' THEN t ELSE '{}' END AS t FROM m)"""
_MEMORIES = store_queries.MEMORIES_SQL
ORACLES = {
    "a14_expiry_by_day": store_queries.ORACLES["a14_expiry"],
    "a14_days_left": f"""WITH {_MEMORIES}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE updated_time < '2024-01-03T07:30:00.000Z') AS e FROM memories)
        SELECT substr(updated_time, 1, 10) AS day, count(*) AS n FROM memories, n WHERE NOT (total > 20 AND e > 0 AND e / total <= 0.8 AND updated_time < '2024-01-03T07:30:00.000Z') GROUP BY 1""",
    "a15_kept_stats": "WITH " + BM25_SQL.split(",\n    weights")[0].replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' once more' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 2 AND (doc_id % 7 <> 1 OR doc_id % 5 < 2)))")
    + " SELECT term, df, n, round(avg_len, 6) AS avg_len FROM dfs, stats",
    "p6_sql_terms": SEARCH_SQL["p6_postings"],
    "w10_sql_budget": OFFLOAD_SQL["w10_canvas_budget"].replace("FROM e WHERE event_id % 17 <> 0 AND EXISTS (SELECT 1 FROM e d WHERE d.event_id % 4 = 0 AND d.agent = e.agent AND d.prefix = e.prefix)", "FROM e"),
    "x22_metadata": f"""WITH {_KINDS} SELECT event_id, t = '{{}}' AS empty, TRY_CAST(json_extract_string(t, '$.k') AS BIGINT) AS k, json_extract_string(t, '$.k.a[1]') AS second, CAST(json_extract_string(t, '$.s') AS BOOLEAN) AS s FROM o""",
    "x18_control_characters": r"""WITH t AS (SELECT event_id, event_id % 5 AS c, event_id AS k FROM events)
        SELECT event_id, CASE c WHEN 0 THEN '{' || chr(10) || '"a": "line\none\t' || k || '"}' WHEN 1 THEN '{"a": "x\u0001y' || k || '"}' WHEN 2 THEN '{"a"' || chr(2) || ': "z' || k || '"}' WHEN 3 THEN '{"a": "open' || k ELSE '{"a": "say \"\n\" and \\", "b": ' || k || '}' END AS escaped,
            CASE c WHEN 0 THEN '{' || chr(10) || '"a": "line\none\t' || k || '"}' WHEN 1 THEN '{"a": "x\u0001y' || k || '"}' WHEN 2 THEN '{"a": "z' || k || '"}' WHEN 4 THEN '{"a": "say \"\n\" and \\", "b": ' || k || '}' END AS read,
            CASE c WHEN 0 THEN 'line' || chr(10) || 'one' || chr(9) || k WHEN 1 THEN 'x' || chr(1) || 'y' || k WHEN 2 THEN 'z' || k WHEN 4 THEN 'say "' || chr(10) || '" and \' END AS a FROM t""",
}
