"""Registered queries of model output, canvases, schedules and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import jsontext as J
from tidemark.functions import text as T
from tidemark.operators import compress as C
from tidemark.operators import models as M
from tidemark.plans.base import ENTRIES_SQL, FIRST_MS, memories, table, tool_entries
from tidemark.plans.offload_queries import QUICK_SQL


def _outputs(spark, d):
    """Model texts in several wrappings about each event."""
    e = tool_entries(spark, d)
    body = F.concat(F.lit('[{"tool_call_id": "'), "tool_call_id", F.lit('", "summary": "about '), "session_key", F.lit('"'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "score": '), F.col("score"))).otherwise(F.lit("")), F.lit("}]"))
    raw = (
        F.when(F.col("event_id") % 5 == 0, body).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("I think "), F.replace(body, F.lit("}]"), F.lit("},]")), F.lit(" so")))
        .when(F.col("event_id") % 5 == 3, F.lit("no answer"))
    )
    return e.select(F.col("event_id").alias("batch_id"), raw.alias("raw"))


def x17_x21_summaries(spark, d):
    s = _outputs(spark, d).select("batch_id", F.explode(J.extract(F.col("raw"), schemas.SUMMARIES)).alias("s"))
    return s.select("batch_id", "s.tool_call_id", "s.summary", F.coalesce("s.score", F.lit(J.DEFAULT_SCORE)).cast("long").alias("score"))


def a17_canvas_summary(spark, d):
    """Status counts and the last node summaries of canvases."""
    e = tool_entries(spark, d).where("node_id is not null and node_id <> 'wait'")
    status = F.element_at(F.array(F.lit("done"), F.lit("doing"), F.lit("todo")), (F.col("event_id") % 3 + 1).cast("int"))
    sums = e.withColumn("status", status).groupBy("session_key").agg(
        *(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("done", "doing", "todo")), F.max(F.struct("idx", "event_id")).alias("last"),
    )
    before = e.join(sums.select("session_key", F.col("last.idx").alias("top")), "session_key").where("idx < top").groupBy("session_key").agg(F.max_by("event_id", "idx").alias("second"))
    step = lambda c: F.concat(F.lit("step "), c)
    return sums.join(before, "session_key", "left").select("session_key", "done", "doing", "todo", F.concat_ws(",", step("second"), step("last.event_id")).alias("last"))


def f19_changed_scenes(spark, d):
    m = memories(spark, d).withColumn("updated", F.when(F.col("doc_id") % 7 == 0, "someday").otherwise(F.col("updated_time")))
    return m.where(F.coalesce(F.try_to_timestamp("updated") > F.to_timestamp(F.lit("2024-01-05T00:00:00Z")), F.lit(True))).select("record_id", "updated")


def j16_registry(spark, d):
    """Sessions whose file is there and that were seen since the cutoff."""
    e = table(spark, d, "events")
    registry = e.groupBy("user_id").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("seen_ms"))
    files = e.where("event_type <> 'error' or user_id % 3 = 0").where("user_id % 4 <> 1").select("user_id").distinct()
    return registry.join(files, "user_id", "left_semi").where(F.col("seen_ms") >= FIRST_MS + 29 * 86_400_000)


def j19_canvas_entries(spark, d):
    """Entries whose node stands in their session's canvas, here the nodes of its first entries."""
    e = tool_entries(spark, d)
    canvas = e.where("idx < 6 and node_id is not null").groupBy("session_key").agg(F.array_join(F.collect_list("node_id"), " --> ").alias("canvas"))
    nodes = canvas.select("session_key", F.explode(T.canvas_nodes(F.col("canvas"))).alias("node_id"))
    return e.join(nodes, ["session_key", "node_id"], "left_semi").select("event_id", "session_key", "node_id")


def f9_captured_pairs(spark, d):
    """Tool pairs without heartbeats and without those that wait for approval."""
    e = tool_entries(spark, d).withColumn("result", F.concat(F.lit('{"details": {"status": "'), F.when(F.col("event_id") % 4 == 0, F.lit("approval-pending")).otherwise(F.lit("ok")), F.lit('"}}')))
    e = e.withColumn("summary", F.when(F.col("event_id") % 5 == 0, F.lit("HEARTBEAT.md")).otherwise(F.col("summary")))
    return e.where(~F.col("summary").contains("HEARTBEAT.md") & (F.get_json_object("result", "$.details.status") != "approval-pending")).select("event_id")


def x6_p1_embeddings(spark, d):
    """Embeddings by a stand-in: shares of vowels in the first 512 characters."""
    import numpy as np

    def vowels(texts):
        return np.array([[t.count(v) for v in "aeiou"] for t in texts], dtype=float)

    out = M.embed(table(spark, d, "documents"), "doc_id", "text", vowels, 512)
    return out.select("doc_id", *(F.round(F.col("embedding")[k], 6).alias(f"v{k}") for k in range(5)))


def p5_emergency(spark, d):
    m = table(spark, d, "conversations").select(
        F.floor(F.col("conv_id") / 5).alias("conv_id"), (F.col("turn") + F.col("conv_id") % 5 * 100).alias("turn"), "role", T.quick_tokens(F.coalesce("text", F.lit(""))).alias("tokens"),
        F.array(F.concat(F.lit("c"), F.col("turn") % 3)).alias("tool_ids"), (F.col("role") == "system").alias("is_result"),
    )
    return C.emergency_compress(m, 1500)  # all conversations, in groups of five


def st5_refreshes(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'").select(F.concat(F.lit("u"), "user_id").alias("session_key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return C.refreshes(e, FIRST_MS + 31 * 86_400_000).groupBy("session_key", "kind").agg(F.count("*").alias("n"), F.max("fired_ms").alias("last"))


def x31_persona_signals(spark, d):
    """Reasons of persona updates that texts ask for, as blocks or inline."""
    c = F.col("event_id")
    reason = F.concat(F.lit("seen "), "event_type", F.lit(" by "), "user_id")
    text = (
        F.when(c % 5 == 0, F.concat(F.lit("ok [PERSONA_UPDATE_REQUEST]\n reason: "), reason, F.lit(" \n[/PERSONA_UPDATE_REQUEST] PERSONA_UPDATE_REQUEST: no")))
        .when(c % 5 == 1, F.concat(F.lit("[PERSONA_UPDATE_REQUEST]"), reason, F.lit("\nand more[/PERSONA_UPDATE_REQUEST]"))).when(c % 5 == 2, F.concat(F.lit("so PERSONA_UPDATE_REQUEST:  "), reason, F.lit(" \nnext line")))
        .when(c % 5 == 3, F.lit("[PERSONA_UPDATE_REQUEST] open")).otherwise(F.col("event_type"))
    )
    return table(spark, d, "events").select("event_id", T.persona_signal(text).alias("reason"))


QUERIES = {f.__name__: f for f in (x31_persona_signals, x17_x21_summaries, a17_canvas_summary, f19_changed_scenes, j16_registry, j19_canvas_entries, f9_captured_pairs, x6_p1_embeddings, p5_emergency, st5_refreshes)}
_REASON = "'seen ' || event_type || ' by ' || user_id"
_OVER = f"""m AS (SELECT conv_id // 5 AS conv_id, turn + conv_id % 5 * 100 AS turn, role, {QUICK_SQL} AS tokens, 'c' || (turn % 3) AS tid, role = 'system' AS is_result FROM conversations),
        t AS (SELECT conv_id, sum(tokens) AS total, count(*) AS messages, max(turn) FILTER (WHERE role = 'user') AS asked FROM m GROUP BY 1),
        r AS (SELECT m.*, total, messages, asked, coalesce(CASE WHEN is_result THEN (SELECT max(c.turn) FROM m c WHERE c.conv_id = m.conv_id AND NOT c.is_result AND c.tid = m.tid AND c.turn < m.turn) END, turn) AS unit FROM m JOIN t USING (conv_id) WHERE total > 1425),
        u AS (SELECT conv_id, unit, total, messages, asked, sum(tokens) AS tokens, count(*) AS n, coalesce(bool_or(turn = asked), false) AS holds, bool_or(role = 'user') AS of_user FROM r GROUP BY 1, 2, 3, 4, 5),
        h AS (SELECT *, free AND sum(tokens) OVER w - tokens < total - 900 AND messages - sum(n) OVER w >= 2 AS gone FROM (SELECT *, (asked IS NULL OR unit < asked) AND NOT holds AS free FROM u) WINDOW w AS (PARTITION BY conv_id ORDER BY free DESC, unit)),
        k AS (SELECT conv_id, unit, tokens, n, of_user, sum(tokens) OVER (PARTITION BY conv_id) AS total, sum(n) OVER (PARTITION BY conv_id) AS messages FROM h WHERE NOT gone),
        l AS (SELECT *, NOT of_user AND sum(tokens) OVER w - tokens < total - 900 AND messages - sum(n) OVER w >= 2 AS gone FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY of_user, tokens DESC, unit)),
        s AS (SELECT conv_id, unit, sum(tokens) OVER (PARTITION BY conv_id) AS rest FROM l WHERE NOT gone),
        x AS (SELECT r.conv_id, turn, r.tokens, rest, r.tokens >= 600 AND NOT coalesce(turn = asked, false) AS large FROM r JOIN s USING (conv_id, unit)),
        y AS (SELECT *, large AND coalesce(sum(tokens - 30) OVER (PARTITION BY conv_id ORDER BY large DESC, tokens DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest - 900 AS cut FROM x)"""
ORACLES = {
    "x31_persona_signals": f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN {_REASON} WHEN 1 THEN {_REASON} || chr(10) || 'and more' WHEN 2 THEN {_REASON} END AS reason FROM events",
    "p5_emergency": f"WITH {_OVER} SELECT conv_id, turn, tokens FROM m JOIN t USING (conv_id) WHERE total <= 1425 UNION ALL SELECT conv_id, turn, CASE WHEN cut THEN 30 ELSE tokens END FROM y",
    "x17_x21_summaries": f"WITH {ENTRIES_SQL} SELECT event_id AS batch_id, tool_call_id, 'about ' || session_key AS summary, CASE WHEN event_id % 2 = 0 THEN score ELSE 5 END AS score FROM entries WHERE event_id % 5 < 3",
    "a17_canvas_summary": f"""WITH {ENTRIES_SQL}, c AS (SELECT * FROM entries WHERE node_id IS NOT NULL AND node_id <> 'wait'), r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY idx DESC) AS rn FROM c)
        SELECT session_key, count(*) FILTER (WHERE event_id % 3 = 0) AS done, count(*) FILTER (WHERE event_id % 3 = 1) AS doing, count(*) FILTER (WHERE event_id % 3 = 2) AS todo, string_agg('step ' || event_id, ',' ORDER BY idx) FILTER (WHERE rn <= 2) AS last FROM r GROUP BY 1""",
    "f19_changed_scenes": f"SELECT 'm_' || doc_id AS record_id, CASE WHEN doc_id % 7 = 0 THEN 'someday' ELSE strftime(make_timestamp(({FIRST_MS} + doc_id * 3600000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS updated FROM documents WHERE doc_id % 7 = 0 OR doc_id > 96",
    "j16_registry": f"""WITH r AS (SELECT user_id, max(epoch_ns(ts) // 1000000) AS seen_ms FROM events GROUP BY 1)
        SELECT * FROM r WHERE user_id % 4 <> 1 AND user_id IN (SELECT user_id FROM events WHERE event_type <> 'error' OR user_id % 3 = 0) AND seen_ms >= {FIRST_MS + 29 * 86_400_000}""",
    "j19_canvas_entries": f"""WITH {ENTRIES_SQL}, n AS (SELECT DISTINCT session_key, node_id FROM entries WHERE idx < 6 AND node_id <> 'wait') SELECT event_id, session_key, node_id FROM entries SEMI JOIN n USING (session_key, node_id)""",
    "f9_captured_pairs": f"WITH {ENTRIES_SQL} SELECT event_id FROM entries WHERE event_id % 5 <> 0 AND event_id % 4 <> 0",
    "x6_p1_embeddings": """WITH c AS (SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: CAST(length(substr(text, 1, 512)) - length(replace(substr(text, 1, 512), v, '')) AS DOUBLE)) AS v FROM documents),
        n AS (SELECT doc_id, v, sqrt(list_dot_product(v, v)) AS n FROM c) SELECT doc_id, """ + ", ".join(f"round(CASE WHEN n < 1e-10 THEN v[{k + 1}] ELSE v[{k + 1}] / n END, 6) AS v{k}" for k in range(5)) + " FROM n",
}
