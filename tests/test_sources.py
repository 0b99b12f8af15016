import json

from pyspark.sql import functions as F

from tidemark.sources import readers as R


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_l0_shards(spark, tmp_path):
    good = {"sessionKey": "k", "sessionId": "s", "recordedAt": "2024-01-01T00:00:00.000Z", "id": "1", "role": "user", "content": "hi", "timestamp": 1}
    write(tmp_path / "in/2024-01-01.jsonl", json.dumps(good) + "\nnot json\n" + json.dumps(good | {"content": None}) + "\n")
    write(tmp_path / "in/notes.jsonl", json.dumps(good))
    rows = R.read_l0(spark, str(tmp_path / "in"))
    assert [r.id for r in rows.collect()] == ["1"]
    R.append_l0(rows, str(tmp_path / "out"), "Asia/Tokyo")
    assert [p.name for p in (tmp_path / "out").glob("shard_date=*")] == ["shard_date=1970-01-01"]


def test_history_in_both_forms(spark, tmp_path):
    sessions = [{"sessionKey": "a", "sessionId": "x", "conversations": [[{"role": "user", "content": "q", "timestamp": 5}, {"role": "assistant", "content": "r", "timestamp": "2024-01-01T00:00:00Z"}], [{"role": "robot", "content": "", "timestamp": "soon"}]]}]
    write(tmp_path / "a/a.json", json.dumps({"sessions": sessions}))
    write(tmp_path / "b/b.json", json.dumps(sessions, indent=1))
    for form in "ab":
        rows = R.read_history(spark, str(tmp_path / form))
        got = [(r.round, r.message, r.role, r.timestamp_ms) for r in rows.orderBy("round", "message").collect()]
        assert got == [(0, 0, "user", 5), (0, 1, "assistant", 1704067200000), (1, 0, "robot", None)]
        errors = {(r.round, r.stage, r.error) for r in R.validate_history(rows).collect()}
        assert {e[2] for e in errors} == {"role is not user or assistant", "content is empty", "timestamp can't be read", "needs a user and an assistant row"}
        assert R.time_presence(rows).first().times == "all_present"


def test_transcripts(spark, tmp_path):
    lines = [
        {"role": "human", "content": "one"}, {"role": "ai", "content": [{"type": "text", "text": "two"}, {"type": "text", "text": "three"}]},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "four"}]}},
        {"type": "event_msg", "payload": {"type": "agent_message", "message": "five"}}, {"role": "user", "content": "six"},
    ]
    write(tmp_path / "t.jsonl", "\n".join(map(json.dumps, lines)) + "\nbroken")
    rows = R.read_transcripts(spark, str(tmp_path))
    assert [(r.role, r.content) for r in rows.orderBy("pos").collect()] == [("user", "one"), ("assistant", "two\nthree"), ("user", "four"), ("assistant", "five"), ("user", "six")]
    assert [(r.user, r.assistant) for r in R.last_turns(rows).collect()] == [("four", "five")]


def test_transcripts_as_documents(spark, tmp_path):
    two = [{"role": "user", "content": "one"}, {"type": "assistant_message", "message": {"text": "two"}}]
    for name, text in (("list", json.dumps(two)), ("spread", json.dumps(two, indent=2)), ("object", json.dumps({"conversation": two})), ("open", json.dumps({"transcript": two}, indent=1)), ("inner", json.dumps({"message": two[0]}) + "\n" + json.dumps({"speaker": "ai", "text": "two"}))):
        write(tmp_path / name / "t.json", text)
        rows = R.read_transcripts(spark, str(tmp_path / name)).orderBy("pos").collect()
        assert [(r.role, r.content) for r in rows] == [("user", "one"), ("assistant", "two")], name


def test_tolerant_lines(spark, tmp_path):
    good = {"tool_call_id": "c1", "summary": "s", "score": 3}
    write(tmp_path / "e.jsonl", json.dumps(good) + "\n" + json.dumps({"summary": "no id"}) + "\n{broken\n" + '{"tool_call_id": "c\x0b2"}' + "\n")
    entries, report = R.read_tolerant(spark, str(tmp_path))
    assert sorted(r.tool_call_id for r in entries.collect()) == ["c1", "c2"]
    r = report.first()
    assert (r.corrupt, r.invalid, r["sample"]) == (1, 1, "{broken")
    safe = spark.createDataFrame([('{"a":"b\x02c"}',), ("nope",)], "v string").select(R.safe_line(F.col("v")).alias("s"))
    assert [x.s for x in safe.collect()] == ['{"a":"bc"}', "{}"]


def test_scenes_export_migrate_payloads(spark, tmp_path):
    write(tmp_path / "scenes/a.md", "-----META-START-----\ncreated: 1\nupdated: 2\nsummary: s\nheat: 7\n-----META-END-----\n\nbody\n")
    got = R.read_scenes(spark, str(tmp_path / "scenes")).first()
    assert (got.filename, got.heat, got.content) == ("a.md", 7, "body")
    df = spark.createDataFrame([(1, [0.1])], "id long, vector array<double>")
    assert [tuple(r) for r in R.export({"l1": df}, str(tmp_path / "export")).collect()] == [("l1", 1), ("total", 1)]
    assert spark.read.json(str(tmp_path / "export/l1")).columns == ["id"]
    assert R.migrate(df, str(tmp_path / "target"), spark)
    try:
        R.migrate(df, str(tmp_path / "target"), spark)
        raise AssertionError("a full target was taken")
    except ValueError:
        pass
    pairs = spark.createDataFrame([("c1", "grep", "2024-01-01T00:00:00.000Z", "out")], "tool_call_id string, tool string, timestamp string, result string")
    ref = R.write_payloads(pairs, str(tmp_path / "refs")).first().result_ref
    assert spark.read.parquet(str(tmp_path / "refs")).first().result_ref == ref == "refs/2024-01-01T00-00-00-000Z-c1.md"


def test_model_outputs(spark):
    memories = '[{"scene_name": "s", "memories": [{"content": "a", "type": "fact"}, {"content": "b", "type": "odd"}, {"content": "c", "priority": 9}]}]'
    raw = [(1, memories), (2, f"Here:\n```json\n{memories}\n```"), (3, memories.replace("}]}]", "},]},]") + " done"), (4, "nothing"), (5, None)]
    rows = R.memories_from_output(spark.createDataFrame(raw, "batch_id long, raw string")).orderBy("batch_id", "place").collect()
    assert [(r.batch_id, r.content, r.type, r.priority) for r in rows] == [x for k in (1, 2, 3) for x in ((k, "a", "persona", 50), (k, "c", "episodic", 9))]
    decisions = [(1, '[{"record_id": "r1", "action": "MERGE", "target_ids": ["t"], "merged_type": "odd"}, {"record_id": ""}, {"record_id": "r2", "action": "?"}]')]
    got = R.decisions_from_output(spark.createDataFrame(decisions, "batch_id long, raw string")).orderBy("at").collect()
    assert [(r.record_id, r.action, r.merged_type, r.target_ids) for r in got] == [("r1", "merge", None, ["t"]), ("r2", "store", None, [])]
    sums = [(1, 'x [{"tool_call_id": "c", "summary": "line\nbreak"}, {"summary": "no id"}]')]
    assert [(r.tool_call_id, r.summary, r.score) for r in R.summaries_from_output(spark.createDataFrame(sums, "batch_id long, raw string")).collect()] == [("c", "line\nbreak", 5)]
