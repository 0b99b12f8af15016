import json
import random

import pytest

from tidemark.sources import readers as R
from tidemark.sources.documents import forms, json_items, pieces_of


def value(rng, deep=0):
    kind = rng.randrange(7 if deep < 3 else 4)
    if kind == 0:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "\n", "a", '"messages": [{', "🙂"]) for _ in range(rng.randrange(12)))
    if kind < 4:
        return rng.choice([1, -2.5, True, None, "text", ""])
    if kind == 4:
        return [value(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {f"k{k}" if rng.random() < 0.8 else "messages": value(rng, deep + 1) for k in range(rng.randrange(4))}


def objects(rng, n):
    return [{"id": k, "v": value(rng), "list": [value(rng), {"x": value(rng)}]} for k in range(n)]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_items_of_large_documents(spark, tmp_path, small_ranges):
    rng, wanted = random.Random(8), {}
    for n in (0, 1, 60):
        items = objects(rng, n)
        extra = {"meta": [{"a": {"b": value(rng)}}], "note": 'say "messages": [{"', "none": []}
        for name, form in {
            "list": items, "object": {"messages": items}, "late": extra | {"messages": items, "after": [{"z": 1}], "more": {"messages": [{"deep": 1}]}}, "both": {"messages": items, "conversation": items},
        }.items():
            for indent in (None, 2):
                path = tmp_path / f"{name}{n}{indent}" / "same.json"
                path.parent.mkdir()
                path.write_text(json.dumps(form, indent=indent, ensure_ascii=n == 1), encoding="utf-8")
                wanted[path.as_uri().replace("file:///", "file:/")] = items * (2 if name == "both" else 1)
    rows = json_items(spark, str(tmp_path), ("messages", "conversation"))
    got = {}
    for r in rows.orderBy("file", "item_no").collect():
        got.setdefault(r.file.replace("file:///", "file:/"), []).append((r.item_no, json.loads(r.item)))
    assert got == {f: list(enumerate(items)) for f, items in wanted.items() if items}
    assert pieces_of(spark, str(tmp_path)).rdd.getNumPartitions() > 40  # byte ranges, not files


def test_documents_that_end_early_and_plain_items(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text('["x", {"a": 1}, 3, {"b": "}"}, {"c": ')
    (tmp_path / "b.json").write_text('{"messages": [{"a": 1}, {"b": "unfinished } ')
    (tmp_path / "c.json").write_text("")
    got = [(r.file[-6:], r.item) for r in json_items(spark, str(tmp_path), ("messages",)).orderBy("file", "item_no").collect()]
    assert got == [("a.json", '{"a": 1}'), ("a.json", '{"b": "}"}'), ("b.json", '{"a": 1}')]


def test_forms(spark, tmp_path):
    for name, text in {"list": "\n [1", "lines": '{"a": 1}\n{"b": 2}', "spread": '{\n"a": 1}', "open": '{"messages": [{"a": 1}]}', "text": "no json", "listed": '[{"a": 1}]\n[{"b": 2}]\n', "held": '{"messages": [{"a": 1}]}\n{"messages": [{"a": 1}]}', "rows": '[{"a": 1},\n{"b": 2}]'}.items():
        (tmp_path / name).write_text(text)
    assert {r.file.split("/")[-1]: r.is_document for r in forms(spark, str(tmp_path), ("messages",)).collect()} == {"list": True, "lines": False, "spread": True, "open": True, "text": False, "listed": False, "held": False, "rows": True}


def test_one_list_is_read_by_several_tasks_and_names_may_repeat(spark, tmp_path, small_ranges):
    for d in (1, 2):
        messages = [{"role": "user" if k % 2 == 0 else "assistant", "content": f"{d}-{k} {{"} for k in range(50 * d)]
        (tmp_path / f"d={d}").mkdir()
        (tmp_path / f"d={d}/x.json").write_text(json.dumps(messages, indent=d - 1 or None))
        (tmp_path / f"d={d}/x.jsonl").write_text("\n".join(json.dumps(m) for m in messages[:4]) + "\nbroken {")
    rows = R.read_transcripts(spark, str(tmp_path))
    turns = sorted((r.file.split("/", 3)[-1][-10:], r.user, r.assistant) for r in R.last_turns(rows).collect())
    assert [t[1:] for t in turns] == [("1-48 {", "1-49 {"), ("2-98 {", "2-99 {"), ("1-2 {", "1-3 {"), ("2-2 {", "2-3 {")] or len({t[1:] for t in turns}) == 4
    assert rows.count() == 158 and rows.select("file").distinct().count() == 4
