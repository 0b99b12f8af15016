"""Registered queries of stored memories, profiles, scenes, retention and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.timefn import ms_to_iso
from tidemark.functions import jsontext as J
from tidemark.operators import stores as S
from tidemark.plans.base import FIRST_MS, MEMORIES_SQL, MESSAGES_SQL, memories, messages, table

NOW = "2024-06-01T00:00:00.000Z"
NOW_MS = 1_717_200_000_000


def _memory_rows(spark, d):
    return memories(spark, d).select("record_id", "content", "type", "priority", "scene_name", F.col("updated_time").alias("created_time"), "updated_time", "doc_id")


def j5_u3_x20_decisions(spark, d):
    rows = _memory_rows(spark, d)
    new, old = rows.where("doc_id % 5 = 0").drop("doc_id"), rows.where("doc_id % 5 <> 0").drop("doc_id")
    decisions = table(spark, d, "documents").where("doc_id % 10 = 0").select(
        F.concat(F.lit("m_"), "doc_id").alias("record_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), "doc_id"
    ).select(
        "record_id", "at", F.element_at(F.array(*map(F.lit, ("update", "skip", "MERGE", "nonsense", "store"))), ((F.col("doc_id") / 10 + F.col("at")) % 5 + 1).cast("int")).alias("action"),
        F.array(F.concat(F.lit("m_"), F.col("doc_id") + 1), F.concat(F.lit("m_"), F.col("doc_id") + 3)).alias("target_ids"), F.when(F.col("doc_id") % 20 == 0, F.lit("merged")).alias("merged_content"),
        F.when(F.col("doc_id") % 30 == 0, F.lit("odd")).otherwise(F.lit("persona")).alias("merged_type"), F.when(F.col("doc_id") % 40 == 0, F.lit(7)).cast("long").alias("merged_priority"),
    )
    return S.apply_decisions(old, new, decisions, NOW)


def j6_upsert(spark, d):
    rows = _memory_rows(spark, d)
    old = rows.where("doc_id % 3 <> 0").drop("doc_id")
    new = rows.where("doc_id % 2 = 0").withColumns({"content": F.concat("content", F.lit("*")), "created_time": F.lit(NOW), "scene_name": F.lit(None).cast("string"), "updated_time": F.lit(NOW), "at": F.lit(1)})
    again = new.where("doc_id % 8 = 0").withColumns({"content": F.concat("content", F.lit("*")), "at": F.lit(2)})
    return S.upsert(old, new.unionByName(again).drop("doc_id"), "record_id", ("created_time",), "at")


def a14_expiry(spark, d):
    kept, _ = S.expire(memories(spark, d).select("record_id", "updated_time"), "updated_time", "2024-01-06T00:00:00.000Z", S.LEAST_L1)
    return kept


def a14_expiry_audit(spark, d):
    m = memories(spark, d).select("record_id", "updated_time")
    cases = (("2024-01-06T00:00:00.000Z", S.LEAST_L1), ("2099", S.LEAST_L1), ("2024-01-06T00:00:00.000Z", 10**9), ("2000", S.LEAST_L1))
    out = None
    for cutoff, least in cases:
        one = S.expire(m, "updated_time", cutoff, least)[1].select(F.lit(cutoff).alias("cutoff"), "total", "expired", "state")
        out = one if out is None else out.unionByName(one)
    return out


def _profiles(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("p"), "doc_id").alias("id"), "doc_id", "text")
    remote = docs.where("doc_id % 4 <> 0").select("id", F.md5("text").alias("content_md5"), (F.col("doc_id") % 3 + 1).alias("version"), (F.col("doc_id") % 2 * 1000).alias("created_at_ms"))
    local = docs.where("doc_id % 7 <> 0").select("id", F.md5(F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_md5"), F.when(F.col("doc_id") % 5 < 3, F.col("doc_id") % 3 + 1).alias("baseline_version"), (F.col("doc_id") % 2 * 500).alias("created_at_ms"))
    return local, remote


def j12_profile_sync(spark, d):
    return S.sync_profiles(*_profiles(spark, d), NOW_MS)


def u2_deleted_profiles(spark, d):
    local, remote = _profiles(spark, d)
    return remote.select("id").join(local, "id", "left_anti")


def _scenes(spark, d):
    docs = table(spark, d, "documents")
    raw = (
        F.when(F.col("doc_id") % 6 == 0, F.lit(S.DELETED)).when(F.col("doc_id") % 6 == 1, F.lit("  \n")).when(F.col("doc_id") % 6 == 2, F.concat(F.lit("plain "), "text"))
        .otherwise(S.format_scene(F.lit("2024-01-01"), F.concat(F.lit("2024-02-"), F.col("doc_id") % 28 + 1), F.concat(F.lit("about "), "source"), F.col("n_chars"), F.when(F.col("doc_id") % 6 == 3, F.lit("")).otherwise(F.col("text"))))
    )
    return docs.select("doc_id", F.concat(F.lit("s"), "doc_id", F.lit(".md")).alias("filename"), raw.alias("raw"))


def x13_scenes(spark, d):
    p = S.parse_scene(F.col("raw"))
    return _scenes(spark, d).select("filename", *(p[c].alias(c) for c in ("created", "updated", "summary", "heat", "content")))


def f20_live_scenes(spark, d):
    return _scenes(spark, d).where(S.live_scene(F.col("raw"))).select("filename")


def j13_scene_diff(spark, d):
    s = _scenes(spark, d).select("doc_id", "filename", S.parse_scene(F.col("raw"))["content"].alias("content"))
    after = s.where("doc_id % 5 <> 1").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("+"))).otherwise(F.col("content")))
    return S.diff_scenes(s.where("doc_id % 5 <> 0"), after)


def t8_scenes_by_heat(spark, d):
    s = _scenes(spark, d).select("filename", S.parse_scene(F.col("raw"))["heat"].alias("heat"))
    return s.orderBy(F.desc("heat"), "filename")


def w16_unique_names(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 10).alias("dir"), "doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("a b ")).otherwise(F.lit("a-b-")), F.col("doc_id") % 30, F.when(F.col("doc_id") % 2 == 0, F.lit(".md")).otherwise(F.lit("?.md"))).alias("name"))
    return S.unique_names(rows.groupBy("dir", "name").agg(F.count("*").alias("n")), "dir", "name").select("dir", "name", "target")


def w14_canvases(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("agent"), F.concat(F.lit("c"), "event_id").alias("filename"), F.unix_millis(F.col("ts").cast("timestamp")).alias("mtime_ms"), (F.col("event_id") % 7 == 0).alias("is_active"))
    return S.reclaim_canvases(e, FIRST_MS + 15 * 86_400_000).select("agent", "filename")


def a19_persona_trigger(spark, d):
    m = memories(spark, d).groupBy("session_key").agg(F.count("*").alias("memories_since"), F.count_distinct("scene_name").alias("scenes_processed"), F.min("doc_id").alias("k"))
    m = m.withColumns({"request_update": F.col("k") % 9 == 0, "last_persona_at": F.col("k") % 4, "has_scenes": F.col("k") % 5 != 0, "has_body": F.col("k") % 3 != 0})
    return m.select("session_key", S.persona_trigger(12).alias("reason"))


def a1_overview(spark, d):
    return S.overview(messages(spark, d), memories(spark, d))


def a9_most_frequent(spark, d):
    return S.most_frequent(table(spark, d, "events"), "user_id", "event_type", "event_id").select("user_id", "event_type", "n")


def a5_a6_rollup(spark, d):
    """Memories of each session by type, all and since the last persona."""
    m = memories(spark, d)
    return m.groupBy("session_key").pivot("type", ["persona", "episodic", "instruction"]).count().na.fill(0).join(
        m.groupBy("session_key").agg(F.count("*").alias("total"), F.sum((F.col("updated_ms") > FIRST_MS + 100 * 3_600_000).cast("long")).alias("since_persona"), F.max("updated_time").alias("last")), "session_key")


def f12_t6_l1_query(spark, d):
    m = memories(spark, d).where((F.col("session_id") == "c7") & (F.col("updated_time") > "2024-01-02"))
    return m.orderBy("updated_time").select("record_id", "updated_time")


def f13_time_range(spark, d):
    low, high = S.time_bound("150d", NOW_MS), S.time_bound("2024-01-10T00:00:00Z", NOW_MS)
    return memories(spark, d).where(F.col("updated_ms").between(low, high)).select("record_id", "updated_ms")


def f14_filter_language(spark, d):
    cols = ("session_key", "type", "priority", "scene_name")
    return memories(spark, d).where(S.filter_column("type!=persona, priority>=20,priority<90,sceneName=src1", cols)).select("record_id", "priority")


def f21_u4_records(spark, d):
    """Stored rows as records: times without blanks and repeats, metadata read from JSON, anything but an object empty."""
    e = table(spark, d, "events").withColumn("t", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))
    times = F.array_distinct(F.filter(F.array("t", "event_type", "t"), lambda x: x != ""))
    meta = J.metadata_of(F.when(F.col("event_id") % 4 == 0, F.lit("[1]")).otherwise(F.lit('{"a": "x"}')))
    return e.select("event_id", F.array_join(times, ",").alias("timestamps"), F.coalesce(J.field(meta, "$.a", "string"), F.lit("")).alias("a"))


def a3_time_parts(spark, d):
    m = messages(spark, d).groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "recorded_at"))), lambda s: s["recorded_at"]).alias("times"))
    return m.select("session_id", F.element_at("times", 1).alias("first"), F.array_min("times").alias("low"), F.array_max("times").alias("high"))


def t4_page(spark, d):
    """A page by newest first, with the count of all rows."""
    m = memories(spark, d).select("record_id", "updated_time")
    total = m.agg(F.count("*").alias("total"))
    return m.orderBy(F.desc("updated_time"), "record_id").offset(10).limit(15).crossJoin(F.broadcast(total))


def t5_keyset_page(spark, d):
    return messages(spark, d).where(F.col("record_id") > "l0_2").orderBy("record_id").limit(25).select("record_id", "role")


def t7_sorted_l0(spark, d):
    m = messages(spark, d).withColumn("recorded_at", F.when(F.col("turn") == 1, "bad").otherwise(F.col("recorded_at")))
    return m.orderBy(F.try_to_timestamp("recorded_at").asc_nulls_last(), "record_id").select("record_id", "recorded_at")


def j17_drill_down(spark, d):
    """Memories with the messages that they were taken from."""
    m = memories(spark, d).select("record_id", F.explode(F.array(F.concat(F.lit("l0_"), F.col("doc_id") % 50, F.lit("_0")), F.concat(F.lit("l0_"), F.col("doc_id") % 50, F.lit("_9")))).alias("source"))
    l0 = messages(spark, d).select(F.col("record_id").alias("source"), "role", "timestamp")
    return m.join(l0, "source")


def j15_restored_prompts(spark, d):
    m = messages(spark, d)
    clean = m.where("role = 'user' and conv_id % 4 = 0").select("session_key", "timestamp", F.lit("the clean prompt").alias("clean"))
    return m.join(clean, ["session_key", "timestamp"], "left").select("record_id", F.coalesce("clean", "message_text").alias("message_text"))


QUERIES = {f.__name__: f for f in (
    j5_u3_x20_decisions, j6_upsert, a14_expiry, a14_expiry_audit, j12_profile_sync, u2_deleted_profiles, x13_scenes, f20_live_scenes, j13_scene_diff, t8_scenes_by_heat, w16_unique_names, w14_canvases, a19_persona_trigger,
    a1_overview, a9_most_frequent, a5_a6_rollup, f12_t6_l1_query, f13_time_range, f14_filter_language, f21_u4_records, a3_time_parts, t4_page, t5_keyset_page, t7_sorted_l0, j17_drill_down, j15_restored_prompts,
)}
_ROWS = "rows AS (SELECT record_id, content, type, priority, scene_name, updated_time AS created_time, updated_time, doc_id FROM memories)"
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_SCENES = f"""parsed AS (SELECT doc_id, filename, k, CASE WHEN k > 2 THEN '2024-01-01' ELSE '' END AS created, CASE WHEN k > 2 THEN '2024-02-' || (doc_id % 28 + 1) ELSE '' END AS updated, CASE WHEN k > 2 THEN 'about ' || source ELSE '' END AS summary,
        CASE WHEN k > 2 THEN n_chars ELSE 0 END AS heat, CASE k WHEN 0 THEN '[DELETED]' WHEN 1 THEN '' WHEN 2 THEN {_TRIM.format("'plain ' || text")} WHEN 3 THEN '' ELSE {_TRIM.format("text")} END AS content
        FROM (SELECT *, doc_id % 6 AS k, 's' || doc_id || '.md' AS filename FROM documents))"""
_P = """docs AS (SELECT 'p' || doc_id AS id, doc_id, text FROM documents),
    remote AS (SELECT id, md5(text) AS m, doc_id % 3 + 1 AS version, doc_id % 2 * 1000 AS created FROM docs WHERE doc_id % 4 <> 0),
    local AS (SELECT id, md5(CASE WHEN doc_id % 2 = 0 THEN text || '!' ELSE text END) AS m, CASE WHEN doc_id % 5 < 3 THEN doc_id % 3 + 1 END AS base, doc_id % 2 * 500 AS created FROM docs WHERE doc_id % 7 <> 0)"""
ORACLES = {
    "j5_u3_x20_decisions": f"""WITH {MEMORIES_SQL}, {_ROWS},
        d AS (SELECT 'm_' || doc_id AS record_id, doc_id, lower(['update', 'skip', 'MERGE', 'nonsense', 'store'][(doc_id // 10 + 2) % 5 + 1]) AS action FROM documents WHERE doc_id % 10 = 0),
        gone AS (SELECT 'm_' || (doc_id + 1) AS record_id FROM d WHERE action IN ('update', 'merge') UNION SELECT 'm_' || (doc_id + 3) FROM d WHERE action IN ('update', 'merge'))
        SELECT record_id, content, type, priority, scene_name, created_time, updated_time FROM rows WHERE doc_id % 5 <> 0 AND record_id NOT IN (SELECT record_id FROM gone)
        UNION ALL SELECT r.record_id, CASE WHEN action IN ('update', 'merge') AND r.doc_id % 20 = 0 THEN 'merged' ELSE content END, CASE WHEN action IN ('update', 'merge') AND r.doc_id % 30 <> 0 THEN 'persona' ELSE type END,
            CASE WHEN action IN ('update', 'merge') AND r.doc_id % 40 = 0 THEN 7 ELSE priority END, scene_name, '{NOW}', '{NOW}' FROM rows r LEFT JOIN d USING (record_id) WHERE r.doc_id % 5 = 0 AND coalesce(action, 'store') <> 'skip'""",
    "j6_upsert": f"""WITH {MEMORIES_SQL}, {_ROWS} SELECT record_id, CASE WHEN doc_id % 8 = 0 THEN content || '**' WHEN doc_id % 2 = 0 THEN content || '*' ELSE content END AS content, type, priority, CASE WHEN doc_id % 2 <> 0 THEN scene_name END AS scene_name,
        CASE WHEN doc_id % 3 <> 0 THEN created_time ELSE '{NOW}' END AS created_time, CASE WHEN doc_id % 2 = 0 THEN '{NOW}' ELSE updated_time END AS updated_time FROM rows WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""",
    "a14_expiry": f"""WITH {MEMORIES_SQL}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE updated_time < '2024-01-06T00:00:00.000Z') AS e FROM memories)
        SELECT record_id, updated_time FROM memories, n WHERE NOT (total > 20 AND e / total <= 0.8 AND updated_time < '2024-01-06T00:00:00.000Z')""",
    "a14_expiry_audit": f"""WITH {MEMORIES_SQL}, c AS (SELECT * FROM (VALUES ('2024-01-06T00:00:00.000Z', 20), ('2099', 20), ('2024-01-06T00:00:00.000Z', 1000000000), ('2000', 20)) t(cutoff, least)),
        n AS (SELECT cutoff, least, count(*) AS total, count(*) FILTER (WHERE updated_time < cutoff) AS expired FROM memories, c GROUP BY 1, 2)
        SELECT cutoff, total, expired, CASE WHEN total <= least THEN 'skipped' WHEN expired = 0 THEN 'nothing' WHEN expired / total > 0.8 THEN 'blocked' ELSE 'deleted' END AS state FROM n""",
    "j12_profile_sync": f"""WITH {_P}, j AS (SELECT l.id, r.version AS rv, l.created AS lc, r.created AS rc, CASE WHEN r.id IS NULL THEN 'insert' WHEN r.m = l.m THEN 'skip' WHEN coalesce(base, 0) <> r.version THEN 'conflict' ELSE 'update' END AS action FROM local l LEFT JOIN remote r USING (id))
        SELECT id, action, CASE action WHEN 'insert' THEN 1 WHEN 'update' THEN rv + 1 ELSE rv END AS version, CASE WHEN action = 'insert' THEN coalesce(nullif(lc, 0), {NOW_MS}) ELSE coalesce(nullif(rc, 0), {NOW_MS}) END AS created_at_ms,
               CASE WHEN action IN ('insert', 'update') THEN {NOW_MS} END AS updated_at_ms FROM j""",
    "u2_deleted_profiles": f"WITH {_P} SELECT id FROM remote WHERE id NOT IN (SELECT id FROM local)",
    "x13_scenes": f"WITH {_SCENES} SELECT filename, created, updated, summary, heat, content FROM parsed",
    "f20_live_scenes": f"WITH {_SCENES} SELECT filename FROM parsed WHERE content NOT IN ('', '[DELETED]')",
    "j13_scene_diff": f"""WITH {_SCENES}, a AS (SELECT filename, CASE WHEN doc_id % 7 = 0 THEN content || '+' ELSE content END AS a FROM parsed WHERE doc_id % 5 <> 1), b AS (SELECT filename, content AS b FROM parsed WHERE doc_id % 5 <> 0)
        SELECT filename, status FROM (SELECT filename, CASE WHEN b IS NULL THEN 'created' WHEN a IS NULL THEN 'deleted' WHEN a <> b THEN 'updated' END AS status FROM a FULL JOIN b USING (filename)) WHERE status IS NOT NULL""",
    "t8_scenes_by_heat": f"WITH {_SCENES} SELECT filename, heat FROM parsed ORDER BY heat DESC, filename",
    "w16_unique_names": """WITH n AS (SELECT DISTINCT doc_id % 10 AS dir, CASE WHEN doc_id % 3 = 0 THEN 'a b ' ELSE 'a-b-' END || (doc_id % 30) || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '?.md' END AS name FROM documents),
        t AS (SELECT dir, name, replace(replace(name, ' ', '-'), '?', '') AS t FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY dir, t ORDER BY CASE WHEN name = t THEN 0 ELSE 1 END, name) AS k FROM t)
        SELECT dir, name, CASE WHEN k = 1 THEN t ELSE replace(t, '.md', '') || '-' || k || '.md' END AS target FROM r""",
    "w14_canvases": f"""WITH c AS (SELECT 'u' || (user_id % 20) AS agent, 'c' || event_id AS filename, epoch_ns(ts) // 1000000 AS m FROM events WHERE event_id % 7 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY m, filename) AS rn, count(*) OVER (PARTITION BY agent) AS n FROM c) SELECT agent, filename FROM r WHERE m < {FIRST_MS + 15 * 86_400_000} AND n - rn >= 15""",
    "a19_persona_trigger": f"""WITH {MEMORIES_SQL}, m AS (SELECT session_key, count(*) AS since, count(DISTINCT scene_name) AS scenes, min(doc_id) AS k FROM memories GROUP BY 1)
        SELECT session_key, CASE WHEN k % 9 = 0 THEN 'request' WHEN scenes > 0 AND k % 4 = 0 AND k % 5 <> 0 THEN 'cold_start' WHEN k % 4 > 0 AND k % 5 <> 0 AND k % 3 = 0 THEN 'recovery' WHEN scenes = 1 AND since > 0 THEN 'first_scene' WHEN since >= 12 THEN 'threshold' END AS reason FROM m""",
    "a1_overview": f"""WITH {MESSAGES_SQL}, {MEMORIES_SQL} SELECT 'L0' AS layer, 'total' AS key, count(*) AS n FROM messages UNION ALL SELECT 'L0', role, count(*) FROM messages GROUP BY role
        UNION ALL SELECT 'L1', 'total', count(*) FROM memories UNION ALL SELECT 'L1', type, count(*) FROM memories GROUP BY type""",
    "a9_most_frequent": "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) SELECT user_id, event_type, n FROM r WHERE rn = 1",
    "a5_a6_rollup": f"""WITH {MEMORIES_SQL} SELECT session_key, count(*) FILTER (WHERE type = 'persona') AS persona, count(*) FILTER (WHERE type = 'episodic') AS episodic, count(*) FILTER (WHERE type = 'instruction') AS instruction,
        count(*) AS total, count(*) FILTER (WHERE updated_ms > {FIRST_MS + 100 * 3_600_000}) AS since_persona, max(updated_time) AS last FROM memories GROUP BY 1""",
    "f12_t6_l1_query": f"WITH {MEMORIES_SQL} SELECT record_id, updated_time FROM memories WHERE session_id = 'c7' AND updated_time > '2024-01-02'",
    "f13_time_range": f"WITH {MEMORIES_SQL} SELECT record_id, updated_ms FROM memories WHERE updated_ms BETWEEN {NOW_MS} - CAST(150 AS BIGINT) * 86400000 AND 1704844800000",
    "f14_filter_language": f"WITH {MEMORIES_SQL} SELECT record_id, priority FROM memories WHERE type <> 'persona' AND priority >= 20 AND priority < 90 AND scene_name = 'src1'",
    "f21_u4_records": "SELECT event_id, event_type AS timestamps, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'x' END AS a FROM events",
    "a3_time_parts": f"WITH {MESSAGES_SQL} SELECT session_id, min_by(recorded_at, turn) AS first, min(recorded_at) AS low, max(recorded_at) AS high FROM messages GROUP BY 1",
    "t4_page": f"WITH {MEMORIES_SQL} SELECT record_id, updated_time, (SELECT count(*) FROM memories) AS total FROM memories ORDER BY updated_time DESC, record_id LIMIT 15 OFFSET 10",
    "t5_keyset_page": f"WITH {MESSAGES_SQL} SELECT record_id, role FROM messages WHERE record_id > 'l0_2' ORDER BY record_id LIMIT 25",
    "t7_sorted_l0": f"WITH {MESSAGES_SQL} SELECT record_id, recorded_at FROM (SELECT record_id, CASE WHEN turn = 1 THEN 'bad' ELSE recorded_at END AS recorded_at, CASE WHEN turn = 1 THEN NULL ELSE timestamp END AS t FROM messages) ORDER BY t NULLS LAST, record_id",
    "j17_drill_down": f"""WITH {MESSAGES_SQL}, {MEMORIES_SQL}, s AS (SELECT record_id, unnest(['l0_' || (doc_id % 50) || '_0', 'l0_' || (doc_id % 50) || '_9']) AS source FROM memories)
        SELECT source, s.record_id, role, timestamp FROM s JOIN messages m ON m.record_id = source""",
    "j15_restored_prompts": f"WITH {MESSAGES_SQL} SELECT record_id, CASE WHEN role = 'user' AND conv_id % 4 = 0 THEN 'the clean prompt' ELSE message_text END AS message_text FROM messages",
}
