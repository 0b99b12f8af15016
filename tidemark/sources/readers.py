"""Readers and writers of transcripts, shards, scene files and payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import jsontext as J
from tidemark.functions.timefn import iso_to_ms, local_date
from tidemark.operators.stores import parse_scene
from tidemark.sources.documents import forms, json_items

#: Files of a day: named by it, or written into its folder.
SHARD = r"(^|/)\d{4}-\d{2}-\d{2}\.jsonl$|/shard_date=\d{4}-\d{2}-\d{2}/[^/]+\.json$"
UNSAFE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u2028\u2029\uFFFE\uFFFF]"
NARROW = r"[^\x09\x0a\x0d\x20-\x7e\u00A0-\uD7FF\uE000-\uFFFD]"
#: Keys under which a transcript may hold its list of messages.
LISTS = ("messages", "conversation", "transcript")
ROLES = {"human": "user", "user": "user", "user_message": "user", "ai": "assistant", "assistant": "assistant", "assistant_message": "assistant", "model": "assistant", "system": "system", "tool": "tool"}


def _shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    rows = reader.option("recursiveFileLookup", "true").json(path)
    return rows.where(F.col("_metadata.file_path").rlike(SHARD)).where("_bad is null").drop("_bad")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, pos, line) of text files, which may be split over tasks: file is the full path, pos a struct that orders a file's lines."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("pos"), F.col("value").alias("line"))


def read_l0(spark: SparkSession, path: str) -> DataFrame:
    """Messages of daily shards; other files and lines that can't be read are left out, as are rows without role or content."""
    return _shards(spark, path, schemas.L0).where("role is not null and content is not null")


def append_l0(messages: DataFrame, path: str, zone: str = "UTC") -> None:
    """Messages into folders by local date."""
    messages.withColumn("shard_date", local_date(F.col("timestamp"), zone)).write.mode("append").partitionBy("shard_date").json(path)


def read_l1(spark: SparkSession, path: str) -> DataFrame:
    """Memories of all shards; rows without id or content are left out."""
    return _shards(spark, path, schemas.L1).where("id is not null and content is not null")


def append_l1(memories: DataFrame, path: str, zone: str = "UTC") -> None:
    """Memories into folders by the local date of their last change. memories: the columns of schemas.L1."""
    dated = memories.withColumn("shard_date", local_date(iso_to_ms(F.coalesce(F.nullif("updatedAt", F.lit("")), "createdAt")), zone))
    dated.write.mode("append").partitionBy("shard_date").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, session_no, sessionKey, sessionId, round, message, role, content, raw_timestamp, timestamp_ms) of bulk files.

    Each file is `{"sessions": [...]}` or the list itself; times are numbers or ISO texts. A file is read by as many
    tasks as it has byte ranges, session by session.
    """
    session = schemas.SESSIONS.removeprefix("array<").removesuffix(">")
    s = json_items(spark, path, ("sessions",)).select("file", F.col("item_no").alias("session_no"), F.from_json("item", session).alias("s"))
    r = s.select("file", "session_no", "s.sessionKey", "s.sessionId", F.posexplode("s.conversations").alias("round", "r"))
    m = r.select("file", "session_no", "sessionKey", "sessionId", "round", F.posexplode("r").alias("message", "m"))
    number = F.col("m.timestamp").try_cast("long")
    ms = F.when(F.col("m.timestamp").isNotNull(), F.coalesce(number, F.nullif(iso_to_ms(F.col("m.timestamp")), F.lit(0))))
    return m.select("file", "session_no", "sessionKey", "sessionId", "round", "message", "m.role", "m.content", F.col("m.timestamp").alias("raw_timestamp"), ms.alias("timestamp_ms"))


def validate_history(rows: DataFrame) -> DataFrame:
    """(file, session_no, round, message, stage, error): one row for each thing that is wrong."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad_time = F.col("raw_timestamp").isNotNull() & F.col("timestamp_ms").isNull()
    checks = [
        (blank(F.col("sessionKey")), "session", "session key is missing"), (~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "message", "role is not user or assistant"),
        (blank(F.col("content")), "message", "content is empty"), (bad_time, "message", "timestamp can't be read"),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(stage).alias("stage"), F.lit(error).alias("error"))) for test, stage, error in checks)))
    each = rows.select("file", "session_no", "round", "message", F.explode(found).alias("e")).select("file", "session_no", "round", "message", "e.stage", "e.error")
    roles = rows.groupBy("file", "session_no", "round").agg(F.collect_set("role").alias("roles"))
    missing = roles.where(~(F.array_contains("roles", "user") & F.array_contains("roles", "assistant")))
    return each.unionByName(missing.select("file", "session_no", "round", F.lit(None).cast("int").alias("message"), F.lit("round").alias("stage"), F.lit("needs a user and an assistant row").alias("error")))


def time_presence(rows: DataFrame) -> DataFrame:
    """One row: all_present, all_missing or mixed."""
    some, none = F.bool_or(F.col("raw_timestamp").isNotNull()), F.bool_or(F.col("raw_timestamp").isNull())
    return rows.agg(F.when(some & none, "mixed").when(some, "all_present").otherwise("all_missing").alias("times"))


def _items(value: Column) -> Column:
    """The messages of a JSON value as JSON texts: a list's items, those of an object's list, or the value itself."""
    listed = F.from_json(value, "array<string>")
    o = F.from_json(value, "messages array<string>, conversation array<string>, transcript array<string>, message string")
    inner = F.when(F.ltrim(o["message"]).startswith("{"), F.array(o["message"]))
    return F.when(F.ltrim(value).startswith("["), listed).when(F.ltrim(value).startswith("{"), F.coalesce(o["messages"], o["conversation"], o["transcript"], inner, F.array(value)))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, role, content) of transcripts: lists of messages, objects with such a list, or one message or entry a line.

    Entries may be of type response_item or event_msg. A file that is one document, over several lines or in a single
    one, is split at its items by as many tasks as it has byte ranges; all others are read by the line, and lines that
    can't be read are left out. file is the full path, pos orders the messages of a file. The driver holds the paths, as
    it does for any scan.
    """
    paths = {True: [], False: []}
    for file, is_document in forms(spark, path, LISTS).toLocalIterator():
        paths[is_document].append(file)
    parts = []
    if paths[True]:
        at = F.struct(F.lit(0).cast("long").alias("block"), F.col("item_no").alias("line"), F.lit(0).alias("k"))
        parts.append(json_items(spark, paths[True], LISTS).select("file", at.alias("pos"), "item"))
    if paths[False] or not parts:
        each = _lines(spark, paths[False] or path).where(F.trim("line") != "").select("file", "pos", F.posexplode(_items(F.col("line"))).alias("k", "item"))
        parts.append(each.select("file", F.struct("pos.block", "pos.line", "k").alias("pos"), "item"))
    each = reduce(DataFrame.unionByName, parts)
    get = lambda p: F.get_json_object("item", p)
    kind, inner = get("$.type"), get("$.payload.type")
    event_role = F.when(inner == "user_message", "user").when(inner == "agent_message", "assistant")
    event = F.when((kind == "response_item") & (inner == "message"), get("$.payload.role")).when(kind == "event_msg", event_role)
    role = F.coalesce(event, F.nullif(get("$.role"), F.lit("")), kind, get("$.speaker"))
    text = lambda c: F.nullif(F.trim(_text(c)), F.lit(""))
    content = F.coalesce(F.when(event.isNotNull(), text(F.coalesce(get("$.payload.content"), get("$.payload.message")))), *(text(get(f"$.{key}")) for key in ("content", "text", "message")))
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    out = each.select("file", "pos", known[F.lower(role)].alias("role"), content.alias("content"))
    return out.where("role is not null and content <> ''")


def _text(c: Column) -> Column:
    """The text of a content: itself, the texts of a list of blocks one a line, or that of an object inside."""
    blocks = F.from_json(c, "array<struct<type:string,text:string>>")
    inside = F.coalesce(*(F.get_json_object(c, f"$.{key}") for key in ("content", "text", "message")))
    return F.when(F.ltrim(c).startswith("["), F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")).when(F.ltrim(c).startswith("{"), inside).otherwise(c)


def last_turns(transcripts: DataFrame) -> DataFrame:
    """(file, user, assistant): the last answer of each file and the question before it."""
    a = transcripts.where("role = 'assistant'").groupBy("file").agg(F.max("pos").alias("at"), F.max_by("content", "pos").alias("assistant"))
    u = transcripts.where("role = 'user'").join(a, "file").where("pos < at").groupBy("file", "assistant").agg(F.max_by("content", "pos").alias("user"))
    return u.select("file", "user", "assistant")


def read_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, one report row a file: corrupt, invalid, sample of the first corrupt line) of line-wise tool entries.

    A line is tried as it is, then without unsafe characters; a line without a tool_call_id is invalid.
    """
    lines = _lines(spark, path).where(F.trim("line") != "")
    clean = F.regexp_replace("line", UNSAFE, "")
    whole, again = F.from_json("line", schemas.ENTRY), F.from_json(clean, schemas.ENTRY)
    marked = lines.withColumn("there", F.get_json_object(clean, "$").isNotNull()).withColumn("e", F.when(whole["tool_call_id"].isNotNull(), whole).otherwise(again))
    ok = F.coalesce(F.col("e.tool_call_id"), F.lit("")) != ""
    report = marked.groupBy("file").agg(
        F.count(F.when(~F.col("there"), 1)).alias("corrupt"), F.count(F.when(F.col("there") & ~ok, 1)).alias("invalid"),
        F.min_by(F.substring("line", 1, 200), F.when(~F.col("there"), F.col("pos"))).alias("sample"),
    )
    return marked.where(F.col("there") & ok).select("file", "pos", "e.*"), report


def safe_line(c):
    """A JSON line without unsafe code points; in a narrower set where that can't be read, `{}` at last."""
    a, b = F.regexp_replace(c, UNSAFE, ""), F.regexp_replace(c, NARROW, "")
    good = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x)
    return F.coalesce(good(a), good(b), F.lit("{}"))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, created, updated, summary, heat, content) of a folder of scene files, told apart by their full path."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"), parse_scene(F.col("value")).alias("s"))
    return raw.select("path", "filename", "s.*")


def export(tables: dict[str, DataFrame], path: str, where: dict[str, Column] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Tables as JSON lines without their vectors; (collection, documents) counts, all together under `total`.

    `where` filters a table by its name; offset and limit cut each table in the order of its first column.
    """
    counts = None
    for name, df in tables.items():
        kept = df.drop("vector", "embedding")
        if where and name in where:
            kept = kept.where(where[name])
        if offset or limit is not None:
            kept = kept.orderBy(kept.columns[0]).offset(offset)
            kept = kept if limit is None else kept.limit(limit)
        kept.write.mode("overwrite").json(f"{path}/{name}")
        one = df.sparkSession.read.schema(kept.schema).json(f"{path}/{name}").agg(F.count("*").alias("documents")).select(F.lit(name).alias("collection"), "documents")
        counts = one if counts is None else counts.unionByName(one)
    return counts.unionByName(counts.agg(F.sum("documents").alias("documents")).select(F.lit("total").alias("collection"), "documents"))


def migrate(source: DataFrame, target_path: str, spark: SparkSession) -> bool:
    """Rows into an empty target; whether the counts agree. A target that holds rows is refused."""
    reader = spark.read.schema(source.schema)
    try:
        held = not reader.parquet(target_path).isEmpty()
    except Exception as e:  # the folder isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = False
    if held:
        raise ValueError(f"{target_path} is not empty")
    source.write.mode("append").parquet(target_path)
    return source.count() == reader.parquet(target_path).count()


def write_payloads(pairs: DataFrame, path: str) -> DataFrame:
    """Tool results as addressable payloads with a header; the entries' references. pairs: (tool_call_id, tool, timestamp, result)."""
    ref = F.concat(F.lit("refs/"), F.regexp_replace("timestamp", "[:.]", "-"), F.lit("-"), "tool_call_id", F.lit(".md"))
    body = F.concat(F.lit("# "), "tool", F.lit("\n"), "timestamp", F.lit("\n\n"), "result")
    rows = pairs.select(ref.alias("result_ref"), "tool", "timestamp", body.alias("body"), "tool_call_id")
    rows.drop("tool_call_id").write.mode("append").parquet(path)
    return rows.select("tool_call_id", "result_ref")


def memories_from_output(outputs: DataFrame, most: int = 10) -> DataFrame:
    """(batch_id, place, scene_name, content, type, priority, source_message_ids) of model texts; rows of unknown types go, the first `most` of a batch stay."""
    from pyspark.sql import Window

    scenes = J.extract(F.col("raw"), schemas.SCENES)
    s = outputs.select("batch_id", F.posexplode(scenes).alias("scene_no", "s")).select("batch_id", "scene_no", F.coalesce("s.scene_name", F.lit(J.DEFAULT_SCENE)).alias("scene_name"), F.posexplode("s.memories").alias("no", "m"))
    rows = s.select("batch_id", "scene_no", "no", "scene_name", F.col("m.content").alias("content"), J.memory_type(F.col("m.type")).alias("type"), F.coalesce("m.priority", F.lit(J.DEFAULT_PRIORITY)).alias("priority"), "m.source_message_ids")
    rows = rows.where("type is not null and trim(content) <> ''")
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("scene_no", "no")) - 1
    return rows.withColumn("place", place).where(F.col("place") < most).drop("scene_no", "no")


def decisions_from_output(outputs: DataFrame) -> DataFrame:
    """(batch_id, at, record_id, action, target_ids, merged_content, merged_type, merged_priority) of model texts."""
    d = outputs.select("batch_id", F.posexplode(J.extract(F.col("raw"), schemas.DECISIONS)).alias("at", "d")).select("batch_id", "at", "d.*")
    action = F.when(F.lower("action").isin("store", "update", "merge", "skip"), F.lower("action")).otherwise(F.lit("store"))
    kind = F.when(F.col("merged_type").isin("persona", "episodic", "instruction"), F.col("merged_type"))
    return d.where(F.coalesce("record_id", F.lit("")) != "").withColumns({"action": action, "merged_type": kind, "target_ids": F.coalesce("target_ids", F.array().cast("array<string>"))})


def summaries_from_output(outputs: DataFrame) -> DataFrame:
    """(batch_id, tool_call_id, summary, score) of model texts; an id is needed, the score is 5 by default."""
    s = outputs.select("batch_id", F.explode(J.extract(F.col("raw"), schemas.SUMMARIES)).alias("s")).select("batch_id", "s.*")
    return s.where(F.coalesce("tool_call_id", F.lit("")) != "").withColumn("score", F.coalesce("score", F.lit(J.DEFAULT_SCORE)))
