"""Registered queries of sources, streams and model steps: the given tables written as files and read again by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.timefn import ms_to_iso
from tidemark.operators import models as M
from tidemark.plans.base import ENTRIES_SQL, FIRST_MS, MEMORIES_SQL, MESSAGES_SQL, memories, messages, table, tool_entries
from tidemark.plans.session_queries import captured_sql
from tidemark.plans.text_queries import DIRTY_SQL, dirty
from tidemark.sources import readers as R
from tidemark.sources.folders import shared_folder
from tidemark.streaming import capture as C
from tidemark.streaming import state as Z


def _l0(spark, d):
    m = messages(spark, d)
    return m.select(F.col("session_key").alias("sessionKey"), F.col("session_id").alias("sessionId"), F.col("recorded_at").alias("recordedAt"), F.col("record_id").alias("id"), "role", F.col("message_text").alias("content"), "timestamp")


def s1_s2_l0_shards(spark, d):
    """Messages appended to daily shards twice and read again; other files and broken lines in the folder are left out."""
    path, m = shared_folder(spark, "l0"), _l0(spark, d)
    later = m.withColumn("timestamp", F.col("timestamp") + F.when(F.hash("id") % 2 == 0, 0).otherwise(86_400_000))
    R.append_l0(later.where("role = 'user'"), path)
    R.append_l0(later.where("role <> 'user'"), path)
    m.select(F.to_json(F.struct("id", "role", "content")).alias("value")).write.text(f"{path}/notes")
    m.where("role = 'system'").select(F.concat(F.lit("{broken "), "id").alias("value")).write.mode("append").text(f"{path}/shard_date=2024-01-01")
    return R.read_l0(spark, path).select("id", "role", "content")


def s3_l1_shards(spark, d):
    path = shared_folder(spark, "l1")
    m = memories(spark, d).select(
        F.col("record_id").alias("id"), "content", "type", F.col("priority").cast("int").alias("priority"), "scene_name", F.array(F.lit("x")).alias("source_message_ids"),
        F.struct(F.lit(None).cast("string").alias("activity_start_time"), F.lit(None).cast("string").alias("activity_end_time")).alias("metadata"), F.array("updated_time").alias("timestamps"),
        F.col("updated_time").alias("createdAt"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("updated_time")).alias("updatedAt"), F.col("session_key").alias("sessionKey"), F.col("session_id").alias("sessionId"),
    )
    R.append_l1(m, path)
    return R.read_l1(spark, path).select("id", "content", "type", "priority", "scene_name", F.col("timestamps")[0].alias("time"))


def _history(spark, d):
    """Conversations as bulk history: sessions of one round each, with faults in some."""
    c = table(spark, d, "conversations")
    role = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "robot").otherwise(F.col("role"))
    content = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), "  ").otherwise(F.coalesce("text", F.lit("")))
    time = F.when(F.col("conv_id") % 3 == 0, F.lit("soon")).when(F.col("conv_id") % 3 == 1, ms_to_iso(F.lit(FIRST_MS) + F.col("conv_id") * 1000)).otherwise((F.lit(FIRST_MS) + F.col("turn")).cast("string"))
    m = F.struct("turn", F.struct(role.alias("role"), content.alias("content"), time.alias("timestamp")).alias("m"))
    rounds = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(m)), lambda x: x["m"]).alias("round"))
    key = F.when(F.col("conv_id") % 11 == 0, "").otherwise(F.concat(F.lit("k"), "conv_id"))
    s = rounds.select("conv_id", F.struct(key.alias("sessionKey"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), F.array("round").alias("conversations")).alias("s"))
    return s.groupBy((F.col("conv_id") % 16).alias("file")).agg(F.collect_list("s").alias("sessions"))


def _read_history(spark, d):
    path, h = shared_folder(spark, "history"), _history(spark, d)
    whole, listed = F.to_json(F.struct("sessions")), F.to_json("sessions")  # an object with its sessions, a list of them
    h.select(F.when(F.col("file") % 2 == 0, whole).otherwise(listed).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.read_history(spark, path)


def s4_history(spark, d):
    return _read_history(spark, d).select("sessionId", F.col("round").cast("long").alias("round"), F.col("message").cast("long").alias("message"), "role", "content", "timestamp_ms")


def a13_validation(spark, d):
    """How many errors of each kind the history has."""
    rows = _read_history(spark, d).withColumn("session_no", F.col("sessionId"))
    return R.validate_history(rows).groupBy("stage", "error").agg(F.count("*").alias("n"))


def s5_transcripts(spark, d):
    """Conversations as transcripts in four forms: by the line, as lines that hold a list, and as large documents in folders of their own."""
    c, path = table(spark, d, "conversations").where("text is not null and trim(text) <> ''"), shared_folder(spark, "transcripts")
    plain = F.struct(F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    blocks = F.struct(F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))
    item = F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.col("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("payload"))
    event = F.struct(F.lit("event_msg").alias("type"), F.struct(F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message")).alias("payload"))
    lines = c.withColumn("line", F.when(F.col("conv_id") % 4 == 0, F.to_json(plain)).when(F.col("conv_id") % 4 == 1, F.to_json(blocks)).when(F.col("conv_id") % 4 == 2, F.to_json(item)).otherwise(F.to_json(event)))
    lines.where("conv_id % 5 < 3 and (role <> 'system' or conv_id % 4 <> 3)").select(F.col("line").alias("value")).write.text(f"{path}/lines")
    listed = lines.where("conv_id % 5 >= 3 and (role <> 'system' or conv_id % 4 <> 3)").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), ", ").alias("items"))
    document_of = lambda k, items: F.when(k % 2 == 1, F.concat(F.lit("["), items, F.lit("]"))).otherwise(F.concat(F.lit('{"messages": ['), items, F.lit("]}")))
    document = document_of(F.col("conv_id"), F.col("items"))
    listed.where("conv_id % 3 = 0").select(document.alias("value")).write.text(f"{path}/listed")
    large = listed.where("conv_id % 3 <> 0").groupBy((F.col("conv_id") % 8).alias("file")).agg(F.array_join(F.collect_list("items"), ",\n").alias("items"))
    large.select("file", document_of(F.col("file"), F.col("items")).alias("value")).write.partitionBy("file").text(f"{path}/documents")
    rows = R.read_transcripts(spark, path)
    return rows.groupBy("role", "content").agg(F.count("*").alias("n"))


def s6_tolerant_lines(spark, d):
    """Entries written as lines, some broken or without an id, read again; what is left out is counted."""
    e, path = tool_entries(spark, d), shared_folder(spark, "entries")
    line = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), "event_id")).when(F.col("event_id") % 7 == 1, F.to_json(F.struct("summary")))
        .when(F.col("event_id") % 7 == 2, F.concat(F.lit('{"tool_call_id": "call_\x0b'), "event_id", F.lit('"}'))).otherwise(F.to_json(F.struct("tool_call_id", "summary", F.col("score").cast("int").alias("score"))))
    )
    e.select(line.alias("value")).write.text(path)
    entries, report = R.read_tolerant(spark, path)
    sums = report.agg(F.sum("corrupt").alias("corrupt"), F.sum("invalid").alias("invalid"))
    return entries.agg(F.count("*").alias("entries"), F.count_distinct("tool_call_id").alias("ids"), F.sum("score").alias("score")).crossJoin(F.broadcast(sums))


def s7_safe_lines(spark, d):
    e = tool_entries(spark, d)
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"a": "x\x02'), "event_id", F.lit('"}'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("open {"), "event_id")).otherwise(F.concat(F.lit('{"a": "é'), "event_id", F.lit('"}')))
    return e.select("event_id", R.safe_line(raw).alias("line"))


def s8_export(spark, d):
    """Vectors, memories and messages exported as JSON lines: filtered, cut, without vectors, counted."""
    v = table(spark, d, "embeddings")
    tables = {"vectors": v, "memories": memories(spark, d).select("record_id", "type"), "messages": messages(spark, d).select("record_id", "role")}
    path = shared_folder(spark, "export")
    return R.export(tables, path, {"vectors": F.col("label") == 1, "messages": F.col("role") == "user"}, offset=3, limit=50)


def s9_migration_counts(spark, d):
    """Rows of both layers into an empty target each, with the counts on both sides."""
    out = None
    for layer, source in (("L0", _l0(spark, d)), ("L1", memories(spark, d))):
        path = shared_folder(spark, "target")
        R.migrate(source, path, spark)
        there = spark.read.schema(source.schema).parquet(path)
        one = source.agg(F.count("*").alias("source")).crossJoin(F.broadcast(there.agg(F.count("*").alias("target"), F.count_distinct(source.columns[0]).alias("keys"))))
        one = one.select(F.lit(layer).alias("layer"), "source", "target", "keys")
        out = one if out is None else out.unionByName(one)
    return out


def s10_scene_files(spark, d):
    """Scenes written as texts, one folder a source, and read as rows with the path that they come from."""
    from tidemark.operators import stores as S

    path = shared_folder(spark, "scenes")
    docs = table(spark, d, "documents")
    raw = S.format_scene(F.lit("2024-01-01"), F.concat(F.lit("2024-02-"), F.col("doc_id") % 28 + 1), F.concat(F.lit("about "), "source"), F.col("n_chars"), F.lit("body"))
    docs.groupBy("source").agg(F.min_by(raw, "doc_id").alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("source").text(path)
    rows = R.read_scenes(spark, path).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("folder"), F.col("filename").rlike(r"^part-.*\.txt$").alias("named"), "created", "updated", "summary", "heat", "content")
    return rows


def s11_payloads(spark, d):
    path = shared_folder(spark, "refs")
    e = tool_entries(spark, d).select("tool_call_id", F.lit("grep").alias("tool"), ms_to_iso(F.col("ts_ms")).alias("timestamp"), F.col("summary").alias("result"))
    refs = R.write_payloads(e, path)
    return refs.join(spark.read.parquet(path), "result_ref").select("tool_call_id", "result_ref", F.char_length("body").cast("long").alias("size"))


def _extractions(spark, d):
    """Model texts about documents: scenes with memories of several types, in several wrappings."""
    k = F.col("doc_id")
    scene = F.concat(F.lit('[{"scene_name": "'), "source", F.lit('", "memories": [{"content": "a'), k, F.lit('", "type": "fact"}, {"content": "b", "type": "odd"}, {"content": "c", "type": "episodic", "priority": 9}]}, {"memories": [{"content": "d"}, {"content": " "}]}]'))
    raw = F.when(k % 4 == 0, scene).when(k % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), scene, F.lit("\n```"))).when(k % 4 == 2, F.concat(F.lit("I found "), F.replace(scene, F.lit("}]}]"), F.lit("},]},]")), F.lit(" there"))).otherwise(F.lit("nothing"))
    return table(spark, d, "documents").select(k.alias("batch_id"), raw.alias("raw"))


def x19_extractions(spark, d):
    return R.memories_from_output(_extractions(spark, d)).select("batch_id", F.col("place").cast("long").alias("place"), "scene_name", "content", "type", F.col("priority").cast("long").alias("priority"))


def p2_model_step(spark, d):
    """A model step with a stand-in that answers in JSON, and its parsed answers."""

    def model(texts):
        return ['[{"tool_call_id": "%s", "summary": "%d characters", "score": %d}]' % (t.split("\t")[0], len(t), len(t) % 10) for t in texts]

    e = tool_entries(spark, d).select(F.col("event_id").alias("batch_id"), F.concat("tool_call_id", F.lit("\t"), "summary").alias("text"))
    return R.summaries_from_output(M.run_model(e, "text", model)).select("batch_id", "tool_call_id", "summary", F.col("score").cast("long").alias("score"))


def _streamed(spark, parts, transform, name):
    """Files of `parts`, one run of the stream for each, with state carried on by its checkpoint; the rows written."""
    into, out, checks = (shared_folder(spark, f"{name}-{x}") for x in ("in", "out", "checks"))
    for part in parts:
        part.write.mode("append").parquet(into)
        stream = transform(spark.readStream.schema(part.schema).parquet(into))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checks).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def st1_st2_capture(spark, d):
    """Messages captured in two runs: the second brings new rows and old ones that come late."""
    m = dirty(spark, d).select(F.concat(F.lit("s"), F.col("conv_id") % 9).alias("session_key"), "conv_id", "turn", "role", F.col("text").alias("message_text"), (F.col("conv_id") * 100 + F.col("turn")).alias("timestamp"))
    got = _streamed(spark, (m.where("turn % 3 <> 1"), m.where("turn % 3 = 1")), C.capture, "capture")
    return got.select("conv_id", "turn", "role", "message_text")


def st3_idle_sessions(spark, d):
    """Sessions of events closed by ten idle minutes, as far as the watermark has come."""
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("session_key"), F.col("ts").cast("timestamp").alias("ts"))
    w = _streamed(spark, (e,), C.idle_windows, "idle")
    return w.select("session_key", F.unix_millis("first").alias("first_ms"), F.unix_millis("end").alias("end_ms"), "rounds")


def st6_once_per_call(spark, d):
    e = tool_entries(spark, d).select("tool_call_id", F.timestamp_millis("ts_ms").alias("ts"))
    return _streamed(spark, (e.unionByName(e.where("ts_ms % 2 = 0")),), C.once_per_call, "calls").select("tool_call_id", F.unix_millis("ts").alias("ts_ms"))


def st7_forgotten_sessions(spark, d):
    """Sessions of all events in runs of five days: rows are numbered within a session, which is forgotten after two idle days unless rows wait for a batch of three."""
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("session_key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.floor((F.dayofmonth("ts") - 1) / 5).alias("part"))
    parts = [e.where(F.col("part") == k).drop("part") for k in range(7)]
    got = _streamed(spark, parts, lambda stream: Z.session_rows(stream, 3, 2 * 86_400_000), "sessions")
    return got.select("session_key", "id", "place", "batch")


def _late_vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    late = v.where("vec_id % 3 <> 0").withColumn("embedding", F.when(F.col("vec_id") % 4 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return v.where("vec_id % 5 <> 0").select("vec_id"), late


def st8_late_vectors(spark, d):
    """Rows written without their vectors, which come later by id; zero vectors and those of no row are ignored."""
    rows, late = _late_vectors(spark, d)
    filled = M.fill_vectors(rows.withColumn("embedding", F.lit(None).cast("array<double>")), late, "vec_id")
    return filled.select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"))


def st8_two_phase_stream(spark, d):
    """The same as two streams: rows first, vectors merged later, and the last batch of each handed over once more."""
    rows, late = _late_vectors(spark, d)
    store = Z.VectorTable(spark, shared_folder(spark, "two-phase"), "vec_id", "vec_id bigint")
    for frame, add, name in ((rows, store.add_rows, "rows"), (late, store.add_vectors, "vectors")):
        into, checks, seen = shared_folder(spark, f"{name}-in"), shared_folder(spark, f"{name}-checks"), []
        for k in range(2):
            frame.where(F.col("vec_id") % 2 == k).write.mode("append").parquet(into)
            stream = spark.readStream.schema(frame.schema).parquet(into)
            store.writing(stream, lambda batch, number: (add(batch, number), seen.append(number)), checks).awaitTermination()  # noqa: B023
        add(frame.where("vec_id % 2 = 1"), max(seen))
    return store.rows().select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"))


def _calls(spark, d):
    """Calls and results of events: some without a result, some too late, ids shared by sessions."""
    e = tool_entries(spark, d).select("session_key", F.concat(F.lit("call_"), "idx").alias("tool_call_id"), F.timestamp_millis("ts_ms").alias("called"), "event_id")
    wait = F.make_dt_interval(secs=(F.col("event_id") % 900).cast("decimal(18,6)"))
    results = e.where("event_id % 4 <> 0").select("session_key", "tool_call_id", (F.col("called") + wait).alias("answered"), F.concat(F.lit("r"), "event_id").alias("result"))
    return e.select("session_key", "tool_call_id", "called"), results


def f9_paired_stream(spark, d):
    """Calls paired with their results as they come; the clock then goes on, so that calls without a result come out."""
    calls, results = _calls(spark, d)
    into, out, checks = (shared_folder(spark, f"pairs-{x}") for x in ("in", "out", "checks"))
    end = F.timestamp_millis(F.lit(FIRST_MS + 400 * 86_400_000))
    later = spark.range(1).select(F.lit("end").alias("session_key"), F.lit("end").alias("tool_call_id"), end.alias("t"))
    for part_calls, part_results in ((calls, results), (later.withColumnRenamed("t", "called"), later.withColumnRenamed("t", "answered").withColumn("result", F.lit("")))):
        part_calls.write.mode("append").parquet(f"{into}/calls")
        part_results.write.mode("append").parquet(f"{into}/results")
        stream = Z.paired_calls(spark.readStream.schema(calls.schema).parquet(f"{into}/calls"), spark.readStream.schema(results.schema).parquet(f"{into}/results"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checks).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(out).where("session_key <> 'end'")
    return got.select("session_key", "tool_call_id", F.unix_millis("called").alias("called_ms"), F.unix_millis("answered").alias("answered_ms"), "result")


QUERIES = {f.__name__: f for f in (
    s1_s2_l0_shards, s3_l1_shards, s4_history, a13_validation, s5_transcripts, s6_tolerant_lines, s7_safe_lines, s8_export, s9_migration_counts, s10_scene_files, s11_payloads, x19_extractions, p2_model_step,
    st1_st2_capture, st3_idle_sessions, st6_once_per_call, st7_forgotten_sessions, st8_late_vectors, st8_two_phase_stream, f9_paired_stream,
)}
_HISTORY = f"""h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 'robot' ELSE role END AS role,
    CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN '  ' ELSE coalesce(text, '') END AS content, CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN {FIRST_MS} + conv_id * 1000 ELSE {FIRST_MS} + turn END AS timestamp_ms FROM conversations)"""
ORACLES = {
    "s1_s2_l0_shards": f"WITH {MESSAGES_SQL} SELECT record_id AS id, role, message_text AS content FROM messages WHERE role IS NOT NULL AND message_text IS NOT NULL",
    "s3_l1_shards": f"WITH {MEMORIES_SQL} SELECT record_id AS id, content, type, CAST(priority AS INTEGER) AS priority, scene_name, updated_time AS time FROM memories WHERE content IS NOT NULL",
    "s4_history": f"WITH {_HISTORY} SELECT 'c' || conv_id AS \"sessionId\", CAST(0 AS BIGINT) AS round, message, role, content, timestamp_ms FROM h",
    "a13_validation": f"""WITH {_HISTORY}, e AS (SELECT 'session' AS stage, 'session key is missing' AS error FROM h WHERE conv_id % 11 = 0 UNION ALL SELECT 'message', 'role is not user or assistant' FROM h WHERE role NOT IN ('user', 'assistant')
        UNION ALL SELECT 'message', 'content is empty' FROM h WHERE trim(content) = '' UNION ALL SELECT 'message', 'timestamp can''t be read' FROM h WHERE timestamp_ms IS NULL
        UNION ALL SELECT 'round', 'needs a user and an assistant row' FROM (SELECT conv_id FROM h GROUP BY 1 HAVING NOT (coalesce(bool_or(role = 'user'), false) AND coalesce(bool_or(role = 'assistant'), false))))
        SELECT stage, error, count(*) AS n FROM e GROUP BY 1, 2""",
    "s5_transcripts": "SELECT role, trim(text) AS content, count(*) AS n FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' AND (role <> 'system' OR conv_id % 4 <> 3) GROUP BY 1, 2",
    "s6_tolerant_lines": f"""WITH {ENTRIES_SQL} SELECT count(*) FILTER (WHERE event_id % 7 > 1) AS entries, count(*) FILTER (WHERE event_id % 7 > 1) AS ids, CAST(sum(score) FILTER (WHERE event_id % 7 > 2) AS BIGINT) AS score,
        count(*) FILTER (WHERE event_id % 7 = 0) AS corrupt, count(*) FILTER (WHERE event_id % 7 = 1) AS invalid FROM entries""",
    "s7_safe_lines": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a": "x' || event_id || '"}' WHEN 1 THEN '{}' ELSE '{"a": "é' || event_id || '"}' END AS line FROM events""",
    "s8_export": """WITH c AS (SELECT 'vectors' AS collection, greatest(0, least(50, count(*) FILTER (WHERE label = 1) - 3)) AS documents FROM embeddings UNION ALL SELECT 'memories', greatest(0, least(50, count(*) - 3)) FROM documents
        UNION ALL SELECT 'messages', greatest(0, least(50, count(*) FILTER (WHERE role = 'user') - 3)) FROM conversations) SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(documents) AS BIGINT) FROM c""",
    "s9_migration_counts": "SELECT 'L0' AS layer, count(*) AS source, count(*) AS target, count(DISTINCT 'agent:a' || (conv_id % 5) || ':s' || (conv_id % 20)) AS keys FROM conversations UNION ALL SELECT 'L1', count(*), count(*), count(DISTINCT doc_id) FROM documents",
    "s10_scene_files": "SELECT source AS folder, true AS named, '2024-01-01' AS created, '2024-02-' || (min(doc_id) % 28 + 1) AS updated, 'about ' || source AS summary, min_by(n_chars, doc_id) AS heat, 'body' AS content FROM documents GROUP BY source",
    "s11_payloads": f"""WITH {ENTRIES_SQL}, t AS (SELECT *, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts FROM entries)
        SELECT tool_call_id, 'refs/' || replace(replace(ts, ':', '-'), '.', '-') || '-' || tool_call_id || '.md' AS result_ref, length('# grep' || chr(10) || ts || chr(10) || chr(10) || summary) AS size FROM t""",
    "x19_extractions": """WITH b AS (SELECT doc_id AS batch_id, source FROM documents WHERE doc_id % 4 < 3)
        SELECT batch_id, CAST(0 AS BIGINT) AS place, source AS scene_name, 'a' || batch_id AS content, 'persona' AS type, CAST(50 AS BIGINT) AS priority FROM b UNION ALL SELECT batch_id, 1, source, 'c', 'episodic', 9 FROM b UNION ALL SELECT batch_id, 2, '', 'd', 'episodic', 50 FROM b""",
    "p2_model_step": f"WITH {ENTRIES_SQL} SELECT event_id AS batch_id, tool_call_id, (length(tool_call_id) + 1 + length(summary)) || ' characters' AS summary, (length(tool_call_id) + 1 + length(summary)) % 10 AS score FROM entries",
    "st1_st2_capture": f"""WITH {DIRTY_SQL}, {captured_sql('dirty')}, r AS (SELECT *, 's' || (conv_id % 9) AS sk, conv_id * 100 + turn AS t FROM k), z AS (SELECT sk, max(t) AS cursor FROM r WHERE turn % 3 <> 1 GROUP BY 1)
        SELECT conv_id, turn, role, message_text FROM r LEFT JOIN z USING (sk) WHERE turn % 3 <> 1 OR t > coalesce(cursor, -1)""",
    "st3_idle_sessions": """WITH e AS (SELECT 'u' || user_id AS session_key, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_key ORDER BY t) <= 600000000 THEN 0 ELSE 1 END AS new FROM e),
        n AS (SELECT *, sum(new) OVER (PARTITION BY session_key ORDER BY t, new ROWS UNBOUNDED PRECEDING) AS k FROM g), w AS (SELECT session_key, min(t) AS f, max(t) + 600000000 AS e, count(*) AS rounds FROM n GROUP BY session_key, k)
        SELECT session_key, CAST(f // 1000 AS BIGINT) AS first_ms, CAST(e // 1000 AS BIGINT) AS end_ms, rounds FROM w WHERE e // 1000 <= (SELECT max(t) // 1000 - 600000 FROM e)""",
    "st6_once_per_call": f"WITH {ENTRIES_SQL} SELECT tool_call_id, ts_ms FROM entries",
    "st7_forgotten_sessions": """WITH RECURSIVE e AS (SELECT 'u' || user_id AS s, event_id AS id, epoch_us(ts) // 1000 AS t, (day(ts) - 1) // 5 AS part FROM events),
        o AS (SELECT *, row_number() OVER (PARTITION BY s, part ORDER BY t, id) - 1 AS k FROM e), g AS (SELECT s, part, count(*) AS n, max(t) AS last FROM e GROUP BY 1, 2),
        p AS (SELECT part, max(max(t)) OVER (ORDER BY part) AS clock FROM e GROUP BY part),
        r AS (SELECT s, CAST(-1 AS BIGINT) AS part, CAST(0 AS BIGINT) AS before, CAST(0 AS BIGINT) AS held, CAST(NULL AS BIGINT) AS last FROM (SELECT DISTINCT s FROM e) UNION ALL
            SELECT s, part, kept, kept + n, greatest(coalesce(new, last), coalesce(last, new)) FROM (
                SELECT r.s, r.part + 1 AS part, coalesce(g.n, 0) AS n, g.last AS new, r.last,
                    CASE WHEN r.last + 172800000 <= (SELECT clock FROM p WHERE p.part = r.part) AND r.held % 3 = 0 THEN 0 ELSE r.held END AS kept
                FROM r LEFT JOIN g ON g.s = r.s AND g.part = r.part + 1 WHERE r.part < 6))
        SELECT o.s AS session_key, id, before + k AS place, (before + k) // 3 AS batch FROM o JOIN r ON r.s = o.s AND r.part = o.part""",
    "st8_two_phase_stream": "SELECT vec_id, CASE WHEN vec_id % 3 <> 0 AND vec_id % 4 <> 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings WHERE vec_id % 5 <> 0",
    "f9_paired_stream": f"""WITH {ENTRIES_SQL}, c AS (SELECT session_key, 'call_' || idx AS tool_call_id, ts_ms, event_id FROM entries), r AS (SELECT session_key, tool_call_id, ts_ms + event_id % 900 * 1000 AS answered_ms, 'r' || event_id AS result FROM c WHERE event_id % 4 <> 0)
        SELECT c.session_key, c.tool_call_id, ts_ms AS called_ms, answered_ms, result FROM c LEFT JOIN r ON r.session_key = c.session_key AND r.tool_call_id = c.tool_call_id AND answered_ms BETWEEN ts_ms AND ts_ms + 600000""",
    "st8_late_vectors": "SELECT vec_id, CASE WHEN vec_id % 3 <> 0 AND vec_id % 4 <> 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings WHERE vec_id % 5 <> 0",
}
