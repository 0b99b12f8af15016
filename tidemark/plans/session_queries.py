"""Registered queries of sessions and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sessions as S
from tidemark.plans.base import FIRST_MS, MESSAGES_SQL, messages, table
from tidemark.plans.text_queries import DIRTY_SQL, capture_sql, dirty, extract_sql, sanitize_sql, _squeeze_sql, _trim_sql


def event_rounds(spark, d):
    """Events of a user as rounds of a session."""
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("session_key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("record_id"), F.lit("user").alias("role"))
    return S.rounds(e)


def f1_flatten(spark, d):
    c = F.col("text")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block("text", c), block("image", F.lit("no")), block("text", F.concat(F.lit(" data:image/png;base64,AAAA "), F.col("role"))))
    content = F.when(F.col("turn") % 2 == 0, c)
    rows = table(spark, d, "conversations").where("role in ('user', 'assistant')").select("conv_id", "turn", S.flatten_blocks(content, blocks).alias("content"))
    return rows.where("content <> ''")


def captured_messages(spark, d):
    rows = dirty(spark, d).select("conv_id", "turn", "role", F.col("text").alias("message_text"))
    return S.captured(rows)


def f10_cursor(spark, d):
    m = messages(spark, d)
    cursors = m.groupBy("session_key").agg(F.when(F.min("conv_id") % 3 == 0, F.lit(0)).otherwise(F.expr("cast((min(timestamp) + max(timestamp)) / 2 as bigint)")).alias("cursor")).where("session_key not like '%s7'")
    return S.after_cursor(m, cursors, FIRST_MS + 5000).select("record_id", "session_key", "timestamp")


def f11_position(spark, d):
    return S.from_position(messages(spark, d), F.col("conv_id") % 20).select("record_id", "session_key")


def a4_cursors(spark, d):
    return S.advance_cursors(messages(spark, d))


def w3_newest(spark, d):
    return S.newest(messages(spark, d), 8).select("session_key", "place", "record_id", "role")


def a2_grouped(spark, d):
    g = S.grouped_by_session_id(messages(spark, d), 12)
    ids = F.array_join(F.transform("messages", lambda m: m["record_id"]), ",")
    return g.select("session_key", "session_id", "place", "first_ts", ids.alias("ids"))


def w2_split(spark, d):
    rows = messages(spark, d).withColumn("session_id", F.lit("all"))
    return S.split_new(rows).select("record_id", "session_key", "part")


def x34_extraction_text(spark, d):
    return S.extraction_text(S.split_new(messages(spark, d)))


def w4_warm_up(spark, d):
    r = event_rounds(spark, d).withColumn("batch", S.warm_up_batch(F.col("round")))
    return r.groupBy("session_key", "batch").agg(F.count("*").alias("rounds"), F.max("ts").alias("last_ts"))


def w5_idle(spark, d):
    r = S.idle_sessions(event_rounds(spark, d), 3_600_000 * 6)
    return r.groupBy("session_key", "batch").agg(F.count("*").alias("rounds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def st4_batches(spark, d):
    return S.batches(event_rounds(spark, d), 5, 3_600_000 * 6)


def w6_a12_times(spark, d):
    m = messages(spark, d)
    return m.select("record_id", "timestamp", "recorded_at")


def w11_recent_unique(spark, d):
    return S.recent_unique(messages(spark, d), 4)


def w12_last_turn(spark, d):
    return S.last_turn(messages(spark, d))


def w13_history(spark, d):
    """Several conversations as one, with heartbeats and short rows among them."""
    m = messages(spark, d).withColumn("session_id", F.concat(F.lit("c"), F.floor(F.col("conv_id") / 6))).withColumn("turn", F.col("conv_id") * 100 + F.col("turn"))
    text = F.when(F.col("turn") % 11 == 2, "HEARTBEAT.md please").when(F.col("turn") % 13 == 3, "short").otherwise(F.col("message_text"))
    return S.recent_history(m.withColumn("message_text", text))


def w15_scenes(spark, d):
    b = event_rounds(spark, d).withColumn("batch", S.warm_up_batch(F.col("round"))).select("session_key", "batch").distinct()
    b = b.withColumn("scene", F.when(F.col("batch") % 3 == 1, F.concat(F.lit("scene-"), "batch")))
    return S.carried_scene(b)


def a11_time_presence(spark, d):
    c = table(spark, d, "conversations").withColumn("t", F.when((F.col("conv_id") % 3 == 0) | ((F.col("conv_id") % 3 == 1) & (F.col("turn") > 1)), F.col("turn")))
    some, none = F.bool_or(F.col("t").isNotNull()), F.bool_or(F.col("t").isNull())
    return c.groupBy((F.col("conv_id") % 3).alias("input")).agg(F.when(some & none, "mixed").when(some, "all_present").otherwise("all_missing").alias("times"), F.count_distinct("conv_id").alias("sessions"), F.count(F.when(F.col("role") == "user", 1)).alias("rounds"), F.count("*").alias("messages"))


QUERIES = {f.__name__: f for f in (
    f1_flatten, captured_messages, f10_cursor, f11_position, a4_cursors, w3_newest, a2_grouped, w2_split, x34_extraction_text, w4_warm_up, w5_idle, st4_batches, w6_a12_times, w11_recent_unique, w12_last_turn, w13_history, w15_scenes, a11_time_presence,
)}
_ROUNDS = "rounds AS (SELECT 'u' || user_id AS session_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round, epoch_ns(ts) // 1000000 AS ts FROM events)"
_WARM = "(CASE WHEN round <= 1 THEN 1 WHEN round <= 3 THEN 2 WHEN round <= 7 THEN 3 ELSE 3 + CAST(ceil((round - 7) / 5.0) AS BIGINT) END)"
_SPLIT = f"""split AS (SELECT *, CASE WHEN rn <= 10 THEN 'new' WHEN rn <= 15 THEN 'background' END AS part FROM (
    SELECT *, row_number() OVER (PARTITION BY session_key, sid ORDER BY timestamp DESC, record_id DESC) AS rn FROM (SELECT *, SID AS sid FROM messages) WHERE {extract_sql('message_text')}))"""
_BACK = "back AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY recorded_at DESC, timestamp DESC, record_id DESC) AS rn FROM messages)"


def captured_sql(rows: str) -> str:
    """CTEs ending in k: the clean, worthwhile user and assistant rows of a table of messages."""
    return f"""c AS (SELECT conv_id, turn, role, {sanitize_sql('text')} AS s FROM {rows} WHERE role IN ('user', 'assistant')),
        j AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN {_squeeze_sql("regexp_replace(s, '```[^\\n]*\\n[\\s\\S]*?```', '', 'g')")} ELSE s END AS message_text FROM c), k AS (SELECT * FROM j WHERE {capture_sql('message_text')})"""


ORACLES = {
    "f1_flatten": f"""WITH t AS (SELECT conv_id, turn, {_trim_sql("regexp_replace(CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || ' data:image/png;base64,AAAA ' || role END, 'data:image/[A-Za-z+]+;base64,[A-Za-z0-9+/=]+', '[image]', 'g')")} AS content
        FROM conversations WHERE role IN ('user', 'assistant')) SELECT * FROM t WHERE content <> ''""",
    "captured_messages": f"WITH {DIRTY_SQL}, {captured_sql('dirty')} SELECT conv_id, turn, role, message_text FROM k",
    "f10_cursor": f"""WITH {MESSAGES_SQL}, c AS (SELECT session_key, CASE WHEN min(conv_id) % 3 = 0 THEN 0 ELSE (min(timestamp) + max(timestamp)) // 2 END AS cursor FROM messages WHERE session_key NOT LIKE '%s7' GROUP BY 1)
        SELECT record_id, session_key, timestamp FROM messages LEFT JOIN c USING (session_key) WHERE timestamp > coalesce(nullif(cursor, 0), {FIRST_MS + 5000})""",
    "f11_position": f"""WITH {MESSAGES_SQL}, p AS (SELECT record_id, session_key, conv_id % 20 AS n, row_number() OVER (PARTITION BY session_key ORDER BY timestamp, record_id) - 1 AS pos, count(*) OVER (PARTITION BY session_key) AS total FROM messages)
        SELECT record_id, session_key FROM p WHERE NOT (n > 0 AND n <= total) OR pos >= n""",
    "a4_cursors": f"WITH {MESSAGES_SQL} SELECT session_key, max(timestamp) AS max_timestamp, max(recorded_at) AS max_recorded_at, count(*) AS captured FROM messages GROUP BY 1",
    "w3_newest": f"WITH {MESSAGES_SQL}, {_BACK} SELECT session_key, max(rn) OVER (PARTITION BY session_key) - rn AS place, record_id, role FROM back WHERE rn <= 8",
    "a2_grouped": f"""WITH {MESSAGES_SQL}, {_BACK}, g AS (SELECT session_key, session_id, min(timestamp) AS first_ts, string_agg(record_id, ',' ORDER BY rn DESC) AS ids FROM back WHERE rn <= 12 GROUP BY 1, 2)
        SELECT session_key, session_id, row_number() OVER (PARTITION BY session_key ORDER BY first_ts, session_id) - 1 AS place, first_ts, ids FROM g""",
    "w2_split": f"WITH {MESSAGES_SQL}, {_SPLIT.replace('SID', chr(39) + 'all' + chr(39))} SELECT record_id, session_key, part FROM split WHERE part IS NOT NULL",
    "x34_extraction_text": f"""WITH {MESSAGES_SQL}, {_SPLIT.replace('SID', 'session_id')}, l AS (SELECT *, '[' || record_id || '] [' || role || '] [' || recorded_at || ']: ' || message_text AS line FROM split WHERE part IS NOT NULL)
        SELECT session_key, session_id, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY timestamp, record_id) FILTER (WHERE part = 'background'), '') AS background,
               coalesce(string_agg(line, chr(10) || chr(10) ORDER BY timestamp, record_id) FILTER (WHERE part = 'new'), '') AS "new" FROM l GROUP BY 1, 2""",
    "w4_warm_up": f"WITH {_ROUNDS} SELECT session_key, {_WARM} AS batch, count(*) AS rounds, max(ts) AS last_ts FROM rounds GROUP BY 1, 2",
    "w5_idle": f"""WITH {_ROUNDS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_key ORDER BY ts, round) > 21600000 THEN 1 ELSE 0 END AS gap FROM rounds),
        b AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY session_key ORDER BY ts, round) AS BIGINT) + 1 AS batch FROM g) SELECT session_key, batch, count(*) AS rounds, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY 1, 2""",
    "w6_a12_times": f"WITH {MESSAGES_SQL} SELECT record_id, timestamp, recorded_at FROM messages",
    "w11_recent_unique": f"""WITH {MESSAGES_SQL}, u AS (SELECT session_key, message_text, max(timestamp) AS t FROM messages GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY t DESC) AS rn FROM u) SELECT session_key, message_text, max(rn) OVER (PARTITION BY session_key) - rn AS place FROM r WHERE rn <= 4""",
    "w12_last_turn": f"""WITH {MESSAGES_SQL}, a AS (SELECT session_id, max(turn) AS t, max_by(record_id, turn) AS assistant_id FROM messages WHERE role = 'assistant' GROUP BY 1)
        SELECT m.session_id, assistant_id, max_by(record_id, turn) AS user_id FROM messages m JOIN a USING (session_id) WHERE role = 'user' AND turn < t GROUP BY 1, 2""",
    "w13_history": f"""WITH {MESSAGES_SQL}, m AS (SELECT 'c' || (conv_id // 6) AS session_id, conv_id * 100 + turn AS turn, role, CASE WHEN (conv_id * 100 + turn) % 11 = 2 THEN 'HEARTBEAT.md please' WHEN (conv_id * 100 + turn) % 13 = 3 THEN 'short' ELSE message_text END AS t FROM messages),
        e AS (SELECT *, CASE WHEN role = 'user' AND length(coalesce(t, '')) > 5 THEN CASE WHEN contains(t, 'HEARTBEAT.md') THEN 'none' ELSE 'turn' END END AS event FROM m),
        o AS (SELECT *, CAST(count(*) FILTER (WHERE event = 'turn') OVER w AS BIGINT) AS turn_no, last_value(event IGNORE NULLS) OVER w AS inside FROM e WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
        k AS (SELECT * FROM o WHERE event = 'turn' OR (role = 'assistant' AND length(coalesce(t, '')) > 10 AND NOT contains(t, 'HEARTBEAT.md') AND inside = 'turn')),
        p AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY turn) - 1 AS k, max(turn_no) OVER (PARTITION BY session_id) AS top FROM k)
        SELECT session_id, turn_no, turn, role, substr(t, 1, 400) AS content FROM p WHERE k <= 3 AND turn_no > top - 5""",
    "st4_batches": f"""WITH RECURSIVE {_ROUNDS}, st AS (
            SELECT DISTINCT session_key, CAST(0 AS BIGINT) AS round, CAST(0 AS BIGINT) AS cnt, CAST(1 AS BIGINT) AS thr, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS batch, false AS idle, false AS hit,
                CAST(0 AS BIGINT) AS pc, CAST(0 AS BIGINT) AS pf, CAST(0 AS BIGINT) AS pl, CAST(0 AS BIGINT) AS hc FROM rounds
            UNION ALL
            SELECT session_key, round, CASE WHEN hit THEN 0 ELSE c2 END, CASE WHEN hit AND t1 > 0 THEN CASE WHEN 2 * t1 >= 5 THEN 0 ELSE 2 * t1 END ELSE t1 END, f2, ts, b1 + CASE WHEN hit THEN 1 ELSE 0 END, idle, hit, pc, pf, pl, c2
            FROM (SELECT *, c2 >= CASE WHEN t1 > 0 THEN least(t1, 5) ELSE 5 END AS hit FROM (
                SELECT *, CASE WHEN idle OR pc = 0 THEN 1 ELSE pc + 1 END AS c2, CASE WHEN idle OR pc = 0 THEN ts ELSE pf END AS f2, pb + CASE WHEN idle THEN 1 ELSE 0 END AS b1,
                    CASE WHEN idle AND pt > 0 THEN CASE WHEN 2 * pt >= 5 THEN 0 ELSE 2 * pt END ELSE pt END AS t1 FROM (
                    SELECT r.session_key, r.round, r.ts, s.cnt AS pc, s.thr AS pt, s.first AS pf, s.last AS pl, s.batch AS pb, s.cnt > 0 AND r.ts - s.last > 21600000 AS idle FROM st s JOIN rounds r ON r.session_key = s.session_key AND r.round = s.round + 1))))
        SELECT session_key, batch - CASE WHEN hit THEN 1 ELSE 0 END AS batch, 'idle_timeout' AS reason, pc AS rounds, pf AS first_ts, pl AS last_ts FROM st WHERE idle
        UNION ALL SELECT session_key, batch, 'threshold', hc, first, last FROM st WHERE hit
        UNION ALL SELECT session_key, batch + 1, 'flush', cnt, first, last FROM st WHERE cnt > 0 AND round = (SELECT max(round) FROM rounds r WHERE r.session_key = st.session_key)""",
    "w15_scenes": f"""WITH {_ROUNDS}, b AS (SELECT DISTINCT session_key, {_WARM} AS batch FROM rounds), s AS (SELECT *, CASE WHEN batch % 3 = 1 THEN 'scene-' || batch END AS scene FROM b)
        SELECT *, last_value(scene IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_scene FROM s""",
    "a11_time_presence": """WITH c AS (SELECT *, CASE WHEN conv_id % 3 = 0 OR (conv_id % 3 = 1 AND turn > 1) THEN turn END AS t FROM conversations)
        SELECT conv_id % 3 AS input, CASE WHEN count(t) = count(*) THEN 'all_present' WHEN count(t) = 0 THEN 'all_missing' ELSE 'mixed' END AS times, count(DISTINCT conv_id) AS sessions, count(*) FILTER (WHERE role = 'user') AS rounds, count(*) AS messages FROM c GROUP BY 1""",
}
