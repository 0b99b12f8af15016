"""Registered queries of tool entries, compression and token estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import tokens as K
from tidemark.functions.tokens import estimate_tokens
from tidemark.operators import offload as O
from tidemark.plans.base import ENTRIES_SQL, FIRST_MS, table, tool_entries

NOW_MS = FIRST_MS + 20 * 86_400_000


def boundaries(spark, d):
    e = tool_entries(spark, d).where("idx % 7 = 2")
    return e.select(
        "session_key", F.col("idx").alias("start_index"), F.col("event_id").alias("at"), F.element_at(F.array(F.lit("long"), F.lit("short"), F.lit("long"), F.lit("pending")), (F.col("event_id") % 4 + 1).cast("int")).alias("result"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("canvas"), F.col("event_id") % 3)).alias("target"),
    )


def chat(spark, d):
    """Conversations with a size for each message; every third assistant row stands for a tool result."""
    return table(spark, d, "conversations").select("conv_id", "turn", "role", T.quick_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), ((F.col("role") == "assistant") & (F.col("turn") % 3 == 0)).alias("is_tool_result"))


def j7_boundaries(spark, d):
    return O.boundary_of(tool_entries(spark, d), boundaries(spark, d)).select("event_id", "result", "target")


def a18_triggers(spark, d):
    k = F.substring("session_key", 2, 20).cast("long")
    last = tool_entries(spark, d).select("session_key").distinct().where(k % 3 != 0).withColumn("last_ms", F.lit(NOW_MS - 1_000_000_000) + k * 7_919_000 % 1_000_000_000)
    return O.triggers(tool_entries(spark, d), boundaries(spark, d), last, NOW_MS)


def a20_residue(spark, d):
    e = tool_entries(spark, d).withColumn("summary", F.when(F.col("event_id") % 9 == 0, F.lit("see HEARTBEAT.md")).otherwise(F.col("summary")))
    return O.residue(e, boundaries(spark, d)).select("event_id", "session_key")


def j10_backfill(spark, d):
    e = tool_entries(spark, d)
    mapping = e.where("event_id % 4 = 0").select("session_key", "tool_call_id", F.when(F.col("event_id") % 8 == 0, F.concat(F.lit(" 00"), F.col("event_id") % 3, F.lit("-N1 "))).otherwise(F.lit("")).alias("node"), F.col("event_id").alias("pos"))
    again = mapping.where("pos % 24 = 0").select("session_key", "tool_call_id", F.lit("007-N7").alias("node"), (F.col("pos") + 1).alias("pos"))
    return O.backfill(e.select("session_key", "tool_call_id", "node_id"), mapping.unionByName(again), e.where("event_id % 5 < 3").select("session_key", "tool_call_id"), "000-N9")


def _shared_ids(spark, d):
    """Tool entries whose ids every session counts anew, so sessions share them; some ids come twice in a session, in two spellings."""
    n = F.col("idx") - F.when(F.col("idx") % 9 == 8, 4).otherwise(0)
    return tool_entries(spark, d).withColumn("tool_call_id", F.concat(F.when(F.col("idx") % 3 == 0, F.lit("call")).otherwise(F.lit("call_")), n))


def j8_new_entries(spark, d):
    """Entries of even events that are not stored in their own session."""
    e = _shared_ids(spark, d)
    stored = e.where("event_id % 3 = 0").select("session_key", F.when(F.col("event_id") % 2 == 0, F.replace("tool_call_id", F.lit("_"), F.lit(""))).otherwise(F.col("tool_call_id")).alias("tool_call_id"))
    batch = e.where("event_id % 2 = 0").select("session_key", F.when(F.col("event_id") % 14 != 0, F.col("tool_call_id")).alias("tool_call_id"), "event_id")
    return O.new_entries(batch.unionByName(batch.where("event_id % 5 = 0")), stored)


def j9_lookup(spark, d):
    """The stored entry of each asked id in its session."""
    e = _shared_ids(spark, d)
    spelling = F.when(F.col("event_id") % 4 == 0, F.col("tool_call_id")).when(F.col("event_id") % 6 == 0, F.concat(F.lit("none_"), "tool_call_id")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("c_"), F.substring("tool_call_id", 2, 99)))
    asked = e.select("session_key", F.coalesce(spelling, F.replace("tool_call_id", F.lit("_"), F.lit(""))).alias("tool_call_id"), F.col("event_id").alias("asked"))
    return O.lookup(asked, e.where("event_id % 5 <> 0").select("session_key", "idx", "tool_call_id", "event_id")).select("session_key", "tool_call_id", "asked", F.col("entry.event_id").alias("event_id"))


def j11_orphans(spark, d):
    """Payloads that no surviving entry names and that are older than the cutoff."""
    e = tool_entries(spark, d)
    refs = e.select(F.concat(F.lit("refs/"), "event_id", F.lit(".md")).alias("result_ref"), F.col("ts_ms").alias("mtime_ms"))
    named = e.where("event_id % 3 <> 0").select(F.concat(F.lit("x/y/"), "event_id", F.lit(".md")).alias("result_ref"))
    base = lambda c: F.substring_index(c, "/", -1)
    return refs.where(F.col("mtime_ms") < FIRST_MS + 15 * 86_400_000).join(named.select(base("result_ref").alias("name")), base(F.col("result_ref")) == F.col("name"), "left_anti")


def w17_chunks(spark, d):
    c = O.chunks(tool_entries(spark, d).withColumn("summary", F.when(F.col("event_id") % 9 == 0, F.lit("see HEARTBEAT.md"))))
    return c.select("event_id", "session_key", "chunk", "due")


def w8_head_cut(spark, d):
    return O.head_cut(chat(spark, d), F.lit(120) + F.col("conv_id") % 90)


def w9_tail_keep(spark, d):
    m = chat(spark, d).withColumn("turn", F.col("turn") + F.col("conv_id") * 10).withColumn("conv_id", F.floor(F.col("conv_id") / 10))
    return O.tail_keep(m, F.lit(900) + F.col("conv_id") % 500)


def w10_canvas_budget(spark, d):
    """Canvases of each user's events, those of deleted work within a budget."""
    e = table(spark, d, "events").withColumn("agent", F.concat(F.lit("u"), "user_id"))
    name = F.concat(F.lpad((F.col("event_id") % 90).cast("string"), 3, "0"), F.lit("-task-"), "event_id", F.lit(".mmd"))
    canvases = e.select("agent", name.alias("filename"), (F.col("event_id") % 17 == 0).alias("is_active"), (F.col("event_id") % 97 + 20).alias("full"), (F.col("event_id") % 13 + 5).alias("short"))
    deleted = e.where("event_id % 4 = 0").select("agent", F.concat(F.lpad((F.col("event_id") % 90).cast("string"), 3, "0"), F.lit("-N1")).alias("node_id"))
    return O.canvas_budget(canvases, deleted, 450).select("agent", "used", F.array_join("chosen", ",").alias("chosen"))


def u5_replaceable(spark, d):
    """Tool results that their session's stored entries can replace, here with ids written in two ways."""
    e = _shared_ids(spark, d)
    results = e.select("session_key", "event_id", F.when(F.col("event_id") % 2 == 0, F.replace("tool_call_id", F.lit("_"), F.lit(""))).otherwise(F.col("tool_call_id")).alias("tool_call_id"))
    return O.replaceable(results, e.where("event_id % 3 <> 0"))


def _messages(spark, d):
    """Entries as results, and a call for every three of them in order."""
    e = tool_entries(spark, d)
    results = e.select("session_key", (F.col("idx") * 2 + 1).alias("idx"), F.lit("result").alias("kind"), F.array("tool_call_id").alias("ids"), (F.col("event_id") % 50).alias("size"))
    calls = e.groupBy("session_key", F.floor(F.col("idx") / 3).alias("k")).agg(F.min("idx").alias("idx"), F.array_sort(F.collect_list("tool_call_id")).alias("ids"))
    calls = calls.select("session_key", (F.col("idx") * 2).alias("idx"), F.lit("use").alias("kind"), "ids", F.lit(0).cast("long").alias("size"))
    return results.unionByName(calls), e.where("event_id % 7 <> 0").select("session_key", "tool_call_id", "score", (F.col("event_id") % 40).alias("summary_size"))


def p4_t9_a8_cascade(spark, d):
    """Messages to replace in each session, with the level that reached them."""
    m, e = _messages(spark, d)
    return O.cascade(O.scored_messages(m, e), m.groupBy("session_key").agg(F.count("*").alias("messages")))


def a8_score_histogram(spark, d):
    """Candidates of each session by score."""
    m, e = _messages(spark, d)
    return O.scored_messages(m, e).groupBy("session_key", "score").agg(F.count("*").alias("n"))


def p3_counted_messages(spark, d):
    """Totals of conversations by the default counter and by one that the caller brings."""
    c = table(spark, d, "conversations")
    own = O.message_tokens(F.col("text"), lambda t: F.ceil(F.char_length(t) / 4).cast("long"))
    return c.groupBy("conv_id").agg(F.sum(own).alias("tokens"), F.min(O.message_tokens(F.lit("the cat"))).alias("two"))


def _blocks(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "assistant", F.array(F.lit("text"), F.lit("tool_use"), F.lit("tool_use"))).otherwise(F.array(F.lit("tool_result")))
    b = c.select("conv_id", "turn", F.posexplode(kind).alias("block", "kind"), F.coalesce("text", F.lit("")).alias("text"))
    call = F.concat(F.lit("call_"), (F.col("conv_id") * 3 + F.col("turn") + F.col("block")) % 40)
    return b.select("conv_id", "turn", "block", "kind", F.when(F.col("kind") != "text", call).alias("tool_call_id"), T.quick_tokens(F.col("text")).alias("tokens"))


def j18_reapply(spark, d):
    """Blocks of conversations without the calls that were deleted in them; conversations share ids."""
    b = _blocks(spark, d)
    deleted = b.where("kind = 'tool_use' and (conv_id + turn) % 3 = 0").select("conv_id", F.replace("tool_call_id", F.lit("_"), F.lit("")).alias("tool_call_id"))
    return O.reapply_deleted(b, deleted).select("conv_id", "turn", "block", "kind")


def j14_heartbeat_rows(spark, d):
    """Conversations without heartbeat calls, their results, and rows that were nothing else."""
    b = _blocks(spark, d)
    ids = b.where("kind = 'tool_use' and conv_id % 5 = 0").select("conv_id", "tool_call_id").distinct()
    return b.join(ids, ["conv_id", "tool_call_id"], "left_anti").groupBy("conv_id", "turn").agg(F.count("*").alias("blocks"))


def t10_largest_group(spark, d):
    return O.largest_group(_blocks(spark, d))


def a7_compression_totals(spark, d):
    """Tokens saved by stage, and running net savings of each session."""
    from pyspark.sql import Window

    e = tool_entries(spark, d).withColumns({"before": F.length("summary") + F.col("score") * 10, "after": F.col("event_id") % 60})
    saved = F.greatest(F.col("before") - F.col("after"), F.lit(0))
    w = Window.partitionBy("session_key").orderBy("idx")
    return e.select("event_id", saved.alias("saved"), (saved - O.TRIGGER_COST).alias("net"), F.sum(saved - O.TRIGGER_COST).over(w).alias("cumulative"), F.round(saved * 100 / F.col("before"), 2).alias("percent"))


def a10_x33_budgets(spark, d):
    """Token totals of conversations with overhead, utilisation and which stage they call for."""
    c = chat(spark, d).groupBy("conv_id").agg((F.sum("tokens") + F.ceil(F.count("*") * 0.5)).alias("total"))
    budget = 400
    stage = F.when(F.col("total") >= budget * O.EMERGENCY, "emergency").when(F.col("total") >= budget * O.AGGRESSIVE, "aggressive").when(F.col("total") >= budget * O.MILD, "mild").otherwise("none")
    return c.select("conv_id", "total", F.round(F.col("total") * 100 / budget, 2).alias("percent"), stage.alias("stage"))


def x26_x27_x35_texts(spark, d):
    e = tool_entries(spark, d)
    stand = O.stand_in(F.lit("grep"), F.repeat("summary", 20), F.repeat(F.col("summary"), 12))
    text = O.summary_text(F.col("node_id"), F.col("summary"), F.concat(F.lit("refs/"), "event_id"))
    return e.select("event_id", stand["tool_call"].alias("tool_call"), stand["summary"].alias("summary"), text.alias("text"), (F.length(text) - F.length("summary")).cast("long").alias("delta"), O.compact_call(F.repeat("summary", 20)).alias("compact"), T.tool_key(F.col("tool_call_id")).alias("key"))


def f18_statuses(spark, d):
    """Ids of confirmed and of deleted entries, as they are and without underscores."""
    e = tool_entries(spark, d).withColumn("offloaded", F.when(F.col("event_id") % 3 == 0, "deleted").when(F.col("event_id") % 3 == 1, "true"))
    s = e.where("offloaded is not null").select(F.explode(F.array("tool_call_id", T.tool_key(F.col("tool_call_id")))).alias("id"), (F.col("offloaded") == "deleted").alias("deleted"))
    return s.distinct()


def x7_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


QUERIES = {f.__name__: f for f in (
    j7_boundaries, a18_triggers, a20_residue, j10_backfill, j8_new_entries, j9_lookup, j11_orphans, w17_chunks, w8_head_cut, w9_tail_keep, w10_canvas_budget, j18_reapply, j14_heartbeat_rows, t10_largest_group,
    u5_replaceable, p4_t9_a8_cascade, a8_score_histogram, p3_counted_messages, a7_compression_totals, a10_x33_budgets, x26_x27_x35_texts, f18_statuses, x7_token_estimate,
)}
_B = """bounds AS (SELECT session_key, idx AS start_index, event_id AS at, ['long', 'short', 'long', 'pending'][event_id % 4 + 1] AS result, CASE WHEN event_id % 5 <> 0 THEN 'canvas' || (event_id % 3) END AS target FROM entries WHERE idx % 7 = 2),
    own AS (SELECT e.*, b.result, b.target FROM entries e ASOF LEFT JOIN bounds b ON e.session_key = b.session_key AND e.idx >= b.start_index)"""
QUICK_SQL = f"CAST(ceil(1.5 * len(regexp_extract_all(coalesce(text, ''), '{T.CJK}')) + (length(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), '{T.CJK}'))) / 4.0) AS BIGINT)"
_CHAT = f"chat AS (SELECT conv_id, turn, role, {QUICK_SQL} AS tokens, role = 'assistant' AND turn % 3 = 0 AS is_tool FROM conversations)"
_BLOCKS = f"""blocks AS (SELECT conv_id, turn, block, kind, CASE WHEN kind <> 'text' THEN 'call_' || ((conv_id * 3 + turn + block) % 40) END AS tool_call_id, tokens FROM (
    SELECT conv_id, turn, {QUICK_SQL} AS tokens, unnest(CASE WHEN role = 'assistant' THEN [{{'block': 0, 'kind': 'text'}}, {{'block': 1, 'kind': 'tool_use'}}, {{'block': 2, 'kind': 'tool_use'}}] ELSE [{{'block': 0, 'kind': 'tool_result'}}] END, recursive := true) FROM conversations))"""
def _steps_sql(n: str, steps: tuple, more: float) -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {most} THEN {cost}" for most, cost in steps) + f" ELSE {steps[-1][1]} + ({n} - {steps[-1][0]}) * {more} END"


_CLASSES = "CASE " + " ".join(f"WHEN {' OR '.join(f'u BETWEEN {a} AND {b}' for a, b in ranges)} THEN '{name}'" for name, ranges in K.RANGES.items()) + " WHEN u > 65535 THEN 'pair' ELSE '' END"
#: Token estimates by classes of characters; texts have no character beyond the basic plane before position SAMPLE, where units and characters would part.
ESTIMATES_SQL = f"""c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
    k AS (SELECT doc_id, i, u, {_CLASSES} AS k FROM (SELECT doc_id, i, ascii(ch) AS u FROM c)),
    j AS (SELECT doc_id, i, u, CASE WHEN u = 39 AND lag(k) OVER w = 'latin' AND lead(k) OVER w = 'latin' THEN 'latin' WHEN u IN (44, 46) AND lag(k) OVER w = 'digits' AND lead(k) OVER w = 'digits' THEN 'digits' ELSE k END AS k,
        k = 'latin' AND u >= 128 AS accent FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    e AS (SELECT *, min(CASE WHEN accent THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nearest, CASE WHEN k = lag(k) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM j),
    n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
    f AS (SELECT doc_id, count(*) FILTER (WHERE u BETWEEN 65 AND 90 OR u BETWEEN 97 AND 122) AS letters, count(*) FILTER (WHERE accent) AS accents FROM j WHERE i <= {K.SAMPLE} GROUP BY 1),
    r AS (SELECT doc_id, k, min(i) AS a, count(*) AS n, count(*) FILTER (WHERE u = 44) AS commas, count(*) FILTER (WHERE u = 46) AS dots FROM n GROUP BY doc_id, run, k),
    t AS (SELECT r.*, letters > 100 AND accents > letters * 0.005::DOUBLE AND coalesce(e.nearest < r.a + r.n + {K.WINDOW}, false) AS near FROM r JOIN f USING (doc_id) LEFT JOIN e ON r.k = 'latin' AND e.doc_id = r.doc_id AND e.i = greatest(r.a - {K.WINDOW}, 1)),
    p AS (SELECT doc_id, CAST(CASE k WHEN 'latin' THEN CASE WHEN near THEN {_steps_sql('n', K.ACCENTED, K.ACCENTED_MORE)} ELSE {_steps_sql('n', K.ENGLISH, K.ENGLISH_MORE)} END
        WHEN 'han' THEN {K.HAN} * n * CASE WHEN n >= 4 THEN {K.HAN_FOUR} WHEN n >= 2 THEN {K.HAN_TWO} ELSE 1 END
        WHEN 'kana' THEN CASE WHEN n <= 4 THEN [{', '.join(map(str, K.KANA))}][n] WHEN n <= 6 THEN n * {K.KANA_MORE} ELSE n * {K.KANA_LONG} END
        WHEN 'digits' THEN CASE WHEN commas > 0 THEN commas * 2 + 1 WHEN dots > 0 THEN greatest(2, (n - dots)::DOUBLE / 3 + dots * 1.5) WHEN n <= 3 THEN 1 ELSE n::DOUBLE / 2.5 END
        WHEN 'pair' THEN 5.0 * n {' '.join(f"WHEN '{name}' THEN {cost} * n" for name, cost in K.PER_UNIT.items())} ELSE 0 END::DOUBLE * 1000000 AS BIGINT) AS cost FROM t)"""
_SHARED = "shared AS (SELECT * REPLACE (CASE WHEN idx % 3 = 0 THEN 'call' ELSE 'call_' END || (idx - CASE WHEN idx % 9 = 8 THEN 4 ELSE 0 END) AS tool_call_id) FROM entries)"
_SCORED = """m AS (SELECT session_key, idx * 2 + 1 AS idx, 'result' AS kind, [tool_call_id] AS ids, event_id % 50 AS size FROM entries UNION ALL
        SELECT session_key, min(idx) * 2, 'use', list_sort(list(tool_call_id)), 0 FROM entries GROUP BY session_key, idx // 3),
    s AS (SELECT session_key, idx, kind, ids, min(score) AS score, kind = 'use' OR min(summary_size) <= any_value(size) AS fits FROM (SELECT *, unnest(ids) AS tool_call_id FROM m)
        JOIN (SELECT session_key, tool_call_id, score, event_id % 40 AS summary_size FROM entries WHERE event_id % 7 <> 0) USING (session_key, tool_call_id) GROUP BY 1, 2, 3, 4 HAVING count(*) = len(ids))"""
ORACLES = {
    "j7_boundaries": f"WITH {ENTRIES_SQL}, {_B} SELECT event_id, result, target FROM own",
    "a18_triggers": f"""WITH {ENTRIES_SQL}, {_B},
        e AS (SELECT * FROM own WHERE (node_id IS NULL OR (node_id = 'wait' AND ({NOW_MS} - ts_ms) / 1000.0 >= 120)) AND result = 'long' AND target IS NOT NULL),
        s AS (SELECT session_key, count(DISTINCT (target, tool_call_id)) AS eligible, count(*) FILTER (WHERE node_id IS NULL) AS nulls, count(DISTINCT target) AS canvases FROM e GROUP BY 1),
        o AS (SELECT session_key, min_by(ts_ms, idx) AS oldest, max(ts_ms) AS latest FROM entries WHERE node_id IS NULL GROUP BY 1),
        l AS (SELECT DISTINCT session_key, {NOW_MS - 1_000_000_000} + CAST(substr(session_key, 2) AS BIGINT) * 7919000 % 1000000000 AS last_ms FROM entries WHERE CAST(substr(session_key, 2) AS BIGINT) % 3 <> 0)
        SELECT session_key, eligible, nulls, canvases, CASE WHEN nulls >= 4 THEN 'null_count' WHEN last_ms IS NOT NULL AND ({NOW_MS} - last_ms) / 1000.0 >= 300 AND (eligible > nulls OR latest > last_ms) THEN 'timeout'
            WHEN last_ms IS NULL AND eligible > nulls THEN 'retry_wait' WHEN last_ms IS NULL AND ({NOW_MS} - oldest) / 1000.0 >= 300 THEN 'oldest_null' END AS reason FROM s LEFT JOIN o USING (session_key) LEFT JOIN l USING (session_key)""",
    "a20_residue": f"""WITH {ENTRIES_SQL}, {_B}, s AS (SELECT *, lag(target) OVER (PARTITION BY session_key ORDER BY start_index) AS before FROM bounds),
        l AS (SELECT session_key, max(start_index) AS start, max_by(before, start_index) AS before FROM s WHERE before IS NOT NULL AND target IS NOT NULL AND before <> target GROUP BY 1)
        SELECT event_id, own.session_key FROM own JOIN l USING (session_key) WHERE idx < start AND (node_id IS NULL OR node_id = 'wait') AND target = before AND event_id % 9 <> 0""",
    "j10_backfill": f"""WITH {ENTRIES_SQL}, m AS (SELECT session_key, tool_call_id, CASE WHEN event_id % 24 = 0 THEN '007-N7' ELSE '00' || (event_id % 3) || '-N1' END AS node, event_id + CASE WHEN event_id % 24 = 0 THEN 1 ELSE 0 END AS pos FROM entries WHERE event_id % 8 = 0),
        c AS (SELECT session_key, node, row_number() OVER (PARTITION BY session_key ORDER BY count(*) DESC, min(pos)) AS rn FROM m GROUP BY 1, 2), b AS (SELECT session_key, node AS best FROM c WHERE rn = 1)
        SELECT e.session_key, e.tool_call_id, CASE WHEN m.node IS NOT NULL THEN m.node WHEN node_id = 'wait' AND event_id % 5 < 3 THEN coalesce(best, '000-N9') ELSE node_id END AS node_id
        FROM entries e LEFT JOIN m USING (session_key, tool_call_id) LEFT JOIN b USING (session_key)""",
    "j8_new_entries": f"""WITH {ENTRIES_SQL}, {_SHARED}, stored AS (SELECT DISTINCT session_key, replace(tool_call_id, '_', '') AS k FROM shared WHERE event_id % 3 = 0),
        batch AS (SELECT session_key, CASE WHEN event_id % 14 <> 0 THEN tool_call_id END AS tool_call_id, event_id, unnest(range(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END)) AS copy FROM shared WHERE event_id % 2 = 0)
        SELECT session_key, tool_call_id, event_id FROM batch b WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.session_key = b.session_key AND s.k = replace(b.tool_call_id, '_', ''))""",
    "j9_lookup": f"""WITH {ENTRIES_SQL}, {_SHARED}, stored AS (SELECT session_key, idx, tool_call_id AS id, replace(tool_call_id, '_', '') AS k, event_id FROM shared WHERE event_id % 5 <> 0),
        asked AS (SELECT session_key, event_id AS asked, CASE WHEN event_id % 4 = 0 THEN tool_call_id WHEN event_id % 6 = 0 THEN 'none_' || tool_call_id WHEN event_id % 4 = 1 THEN 'c_' || substr(tool_call_id, 2) ELSE replace(tool_call_id, '_', '') END AS tool_call_id FROM shared),
        met AS (SELECT a.session_key, a.asked, s.event_id, CASE WHEN s.id = a.tool_call_id THEN 0 WHEN s.id = s.k THEN 1 ELSE 2 END AS place, s.idx FROM asked a JOIN stored s ON s.session_key = a.session_key AND s.k = replace(a.tool_call_id, '_', '')),
        best AS (SELECT asked, event_id FROM met QUALIFY row_number() OVER (PARTITION BY asked ORDER BY place, CASE WHEN place < 2 THEN -idx ELSE idx END) = 1)
        SELECT session_key, tool_call_id, asked, event_id FROM asked LEFT JOIN best USING (asked)""",
    "j11_orphans": f"WITH {ENTRIES_SQL} SELECT 'refs/' || event_id || '.md' AS result_ref, ts_ms AS mtime_ms FROM entries WHERE event_id % 3 = 0 AND ts_ms < {FIRST_MS + 15 * 86_400_000}",
    "w17_chunks": f"""WITH {ENTRIES_SQL} SELECT event_id, session_key, (row_number() OVER (PARTITION BY session_key ORDER BY idx) - 1) // 5 AS chunk, count(*) OVER (PARTITION BY session_key) >= 4 AS due FROM entries WHERE event_id % 9 <> 0""",
    "w8_head_cut": f"""WITH {_CHAT}, p AS (SELECT *, row_number() OVER w AS pos, sum(tokens) OVER w AS s, 120 + conv_id % 90 AS lim FROM chat WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        t AS (SELECT conv_id, max(s) AS total, max(pos) AS n, max(lim) AS lim, max(pos - 1) FILTER (WHERE role = 'user') AS lu FROM p GROUP BY 1),
        f AS (SELECT t.*, CASE WHEN total - lim <= 0 THEN 0 ELSE least((SELECT min(pos) FROM p WHERE p.conv_id = t.conv_id AND s >= total - t.lim), greatest(n - 2, 0)) END AS raw FROM t),
        a AS (SELECT f.*, CASE WHEN raw <= 0 OR raw >= n THEN raw ELSE coalesce((SELECT min(pos) - 1 FROM p WHERE p.conv_id = f.conv_id AND pos > raw AND NOT is_tool), n) END AS adj FROM f),
        c AS (SELECT *, CASE WHEN adj <= 0 THEN 0 WHEN lu IS NULL OR adj <= lu THEN adj ELSE lu END AS cut FROM a)
        SELECT conv_id, cut, CAST(total - coalesce((SELECT s FROM p WHERE p.conv_id = c.conv_id AND pos = cut), 0) AS BIGINT) AS tokens_left FROM c""",
    "w9_tail_keep": f"""WITH {_CHAT}, m AS (SELECT conv_id // 10 AS conv_id, turn + conv_id * 10 AS turn, role, tokens, is_tool FROM chat),
        p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS suffix, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM m),
        s AS (SELECT conv_id, count(*) AS n, coalesce(max(pos + 1) FILTER (WHERE suffix > 900 + conv_id % 500), 0) AS f, max(pos) FILTER (WHERE role = 'user') AS u FROM p GROUP BY 1),
        g AS (SELECT conv_id, n, u, coalesce((SELECT min(pos) FROM p WHERE p.conv_id = s.conv_id AND pos >= f AND NOT is_tool), n) AS f FROM s),
        k AS (SELECT *, CASE WHEN u < f AND f < n THEN u ELSE f END AS k FROM g) SELECT conv_id, CASE WHEN n - k < 10 THEN greatest(n - 10, 0) ELSE k END AS keep_from, n FROM k""",
    "j18_reapply": f"""WITH {_BLOCKS} SELECT conv_id, turn, block, kind FROM blocks b WHERE tool_call_id IS NULL OR NOT EXISTS (
        SELECT 1 FROM blocks d WHERE d.kind = 'tool_use' AND (d.conv_id + d.turn) % 3 = 0 AND d.conv_id = b.conv_id AND d.tool_call_id = b.tool_call_id)""",
    "j14_heartbeat_rows": f"""WITH {_BLOCKS}, i AS (SELECT DISTINCT conv_id, tool_call_id FROM blocks WHERE kind = 'tool_use' AND conv_id % 5 = 0)
        SELECT conv_id, turn, count(*) AS blocks FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.conv_id = b.conv_id AND i.tool_call_id = b.tool_call_id) GROUP BY 1, 2""",
    "t10_largest_group": f"""WITH {_BLOCKS}, s AS (SELECT conv_id, tool_call_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM blocks WHERE tool_call_id IS NOT NULL GROUP BY 1, 2)
        SELECT conv_id, tool_call_id, tokens FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY tokens DESC, tool_call_id) AS rn FROM s) WHERE rn = 1""",
    "u5_replaceable": f"""WITH {ENTRIES_SQL}, {_SHARED} SELECT session_key, event_id, CASE WHEN event_id % 2 = 0 THEN replace(tool_call_id, '_', '') ELSE tool_call_id END AS tool_call_id FROM shared r
        WHERE EXISTS (SELECT 1 FROM shared s WHERE s.event_id % 3 <> 0 AND s.session_key = r.session_key AND replace(s.tool_call_id, '_', '') = replace(r.tool_call_id, '_', ''))""",
    "p4_t9_a8_cascade": f"""WITH {ENTRIES_SQL}, {_SCORED}, n AS (SELECT session_key, count(*) AS n FROM m GROUP BY 1),
        k AS (SELECT s.*, least(score, 7) AS level FROM s JOIN n USING (session_key) WHERE idx < floor(n * 0.7) AND score >= 1),
        r AS (SELECT session_key, idx, max(level) AS level FROM (SELECT session_key, idx, level FROM k WHERE fits UNION ALL
            SELECT t.session_key, t.idx, c.level FROM (SELECT session_key, level, unnest(ids) AS id FROM k WHERE kind = 'use') c JOIN s t ON t.kind = 'result' AND t.session_key = c.session_key AND t.ids[1] = c.id) GROUP BY 1, 2),
        p AS (SELECT session_key, level, coalesce(sum(count(*)) OVER (PARTITION BY session_key ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM r GROUP BY 1, 2)
        SELECT session_key, idx, level FROM r JOIN p USING (session_key, level) WHERE above < 10""",
    "a8_score_histogram": f"WITH {ENTRIES_SQL}, {_SCORED} SELECT session_key, score, count(*) AS n FROM s GROUP BY 1, 2",
    "p3_counted_messages": "SELECT conv_id, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens, CAST(2 AS BIGINT) AS two FROM conversations GROUP BY 1",
    "w10_canvas_budget": """WITH RECURSIVE e AS (SELECT *, 'u' || user_id AS agent, lpad(CAST(event_id % 90 AS VARCHAR), 3, '0') AS prefix FROM events),
        c AS (SELECT agent, prefix || '-task-' || event_id || '.mmd' AS filename, event_id % 97 + 20 AS f, event_id % 13 + 5 AS s FROM e WHERE event_id % 17 <> 0 AND EXISTS (SELECT 1 FROM e d WHERE d.event_id % 4 = 0 AND d.agent = e.agent AND d.prefix = e.prefix)),
        r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY filename DESC) AS rn FROM c),
        w AS (SELECT agent, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS chosen FROM (SELECT DISTINCT agent FROM c) UNION ALL
            SELECT w.agent, r.rn, CASE WHEN used + f <= 450 THEN used + f WHEN used + s <= 450 THEN used + s ELSE used END,
                CASE WHEN used + f <= 450 THEN list_prepend(filename, chosen) WHEN used + s <= 450 THEN list_prepend(filename || '(meta)', chosen) ELSE chosen END FROM w JOIN r ON r.agent = w.agent AND r.rn = w.rn + 1)
        SELECT agent, max(used) AS used, array_to_string(max_by(chosen, rn), ',') AS chosen FROM w GROUP BY agent""",
    "a7_compression_totals": f"""WITH {ENTRIES_SQL}, b AS (SELECT *, greatest(length(summary) + score * 10 - event_id % 60, 0) AS saved, length(summary) + score * 10 AS before FROM entries)
        SELECT event_id, saved, saved - 80 AS net, CAST(sum(saved - 80) OVER (PARTITION BY session_key ORDER BY idx) AS BIGINT) AS cumulative, round(saved * 100::DOUBLE / before, 2) AS percent FROM b""",
    "a10_x33_budgets": f"""WITH {_CHAT}, t AS (SELECT conv_id, CAST(sum(tokens) + ceil(count(*) * 0.5) AS BIGINT) AS total FROM chat GROUP BY 1)
        SELECT conv_id, total, round(total * 100::DOUBLE / 400, 2) AS percent, CASE WHEN total >= 380 THEN 'emergency' WHEN total >= 340 THEN 'aggressive' WHEN total >= 200 THEN 'mild' ELSE 'none' END AS stage FROM t""",
    "x26_x27_x35_texts": f"""WITH {ENTRIES_SQL}, t AS (SELECT *, '[Offloaded Tool Result | node: ' || coalesce(node_id, 'N/A') || ']' || chr(10) || 'Summary: ' || summary || chr(10) || 'result_ref: refs/' || event_id || ' (read this file for full tool call and raw result)' AS text FROM entries)
        SELECT event_id, 'grep(' || substr(repeat(summary, 20), 1, 200) || ')' AS tool_call, '[L1 degraded] grep: ' || CASE WHEN length(repeat(summary, 12)) > 300 THEN substr(repeat(summary, 12), 1, 297) || '...' ELSE repeat(summary, 12) END AS summary,
        text, length(text) - length(t.summary) AS delta, CASE WHEN length(repeat(t.summary, 20)) <= 300 THEN repeat(t.summary, 20) ELSE substr(repeat(t.summary, 20), 1, 300) || '…' END AS compact, replace(tool_call_id, '_', '') AS key FROM t""",
    "x7_token_estimate": f"WITH {ESTIMATES_SQL} SELECT doc_id, coalesce(greatest(1, (CAST(sum(cost) AS BIGINT) + 500000) // 1000000), 0) AS tokens FROM documents LEFT JOIN p USING (doc_id) GROUP BY doc_id",
    "f18_statuses": f"WITH {ENTRIES_SQL} SELECT DISTINCT unnest([tool_call_id, replace(tool_call_id, '_', '')]) AS id, event_id % 3 = 0 AS deleted FROM entries WHERE event_id % 3 < 2",
}
