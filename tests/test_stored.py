"""Tables by day, statistics kept by changes, table functions in SQL and loose JSON."""

import collections
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsontext as J
from tidemark.functions.tables import register
from tidemark.operators.daily import DayTable
from tidemark.operators.termstats import TermStats, rebuilt


def day_table(spark, rows):
    days = DayTable(spark, f"t_{uuid.uuid4().hex}", "at")
    days.append(spark.createDataFrame(rows, "id long, at string"))
    return days


ROWS = [(k, f"2024-01-{k % 9 + 1:02d}T{k % 24:02d}:00:00.000Z") for k in range(90)] + [(100, None), (101, "")]


def test_expired_days_are_dropped_and_the_cutoffs_day_alone_is_read(spark):
    days = day_table(spark, ROWS[:50])
    days.append(spark.createDataFrame(ROWS[50:], "id long, at string"))
    cutoff = "2024-01-04T12:00:00.000Z"
    assert {f.split("/day=")[1].split("/")[0] for f in days.of_day("2024-01-04").inputFiles()} == {"2024-01-04"}
    gone = [r for r in ROWS if r[1] and r[1] < cutoff]
    assert days.expire(cutoff, 20) == (92, len(gone), "deleted")
    left = sorted(r.id for r in days.rows().collect())
    assert left == sorted(r[0] for r in ROWS if r not in gone)
    counts = {r.day: r.n for r in days.counts().collect()}
    assert counts == {r.day: r["count"] for r in spark.table(days.name).groupBy("day").count().collect()} and min(d for d in counts) == "2024-01-04"
    assert days.expire(cutoff, 20) == (len(left), 0, "nothing")


def test_guards_keep_small_tables_and_most_rows(spark):
    days = day_table(spark, ROWS)
    assert days.expire("2024-01-05", 92)[2] == "skipped"
    assert days.expire("2024-02-01", 20) == (92, 90, "blocked")
    assert days.rows().count() == 92
    assert days.expire("2024-01-02T99", 20)[2] == "deleted" and days.rows().where("at <> '' and at < '2024-01-03'").count() == 0


def test_many_days_share_partitions(spark):
    """Partitions of an append are bounded, whatever its number of days; rows, counts and guards stay those of days."""
    first = dt.date(2023, 11, 1)
    rows = [(k, f"{first + dt.timedelta(days=k % 450)}T{k % 24:02d}:00:00.000Z") for k in range(1350)] + [(2000, None), (2001, ""), (2002, "it's"), (2003, "'24\\")]
    days = day_table(spark, rows)
    days.append(spark.createDataFrame([(3000, "2024-01-06T01:00:00.000Z"), (3001, "2024-01-06T23:00:00.000Z"), (3002, "2024-01-05T23:00:00.000Z")], "id long, at string"))
    rows += [(3000, "2024-01-06T01:00:00.000Z"), (3001, "2024-01-06T23:00:00.000Z"), (3002, "2024-01-05T23:00:00.000Z")]
    parts = lambda: {r.partition for r in spark.sql(f"SHOW PARTITIONS {days.name}").collect()}
    assert len(parts()) <= 25 and {"day=2024-01-05", "day=2024-01-06", "day=2024-01", "day=none"} <= parts()
    for cutoff in ("2024-01-06T12:00:00.000Z", "2024-03", "2024-03-31T99"):
        assert sorted(r.id for r in days.of_day("2024-01-06").collect()) == sorted(i for i, t in rows if t and t[:10] == "2024-01-06")
        left = [r for r in rows if not r[1] or r[1] >= cutoff]
        assert days.expire(cutoff, 20) == (len(rows), len(rows) - len(left), "deleted")
        rows = left
        assert sorted(r.id for r in days.rows().collect()) == sorted(i for i, _ in rows)
        assert {r.day: r.n for r in days.counts().collect()} == collections.Counter((t or "none")[:10] for _, t in rows)
        assert days.expire(cutoff, 20) == (len(rows), 0, "nothing")
    assert not any(p[:11] in ("day=2024-01", "day=2024-02", "day=2024-03") for p in parts())


def test_statistics_by_changes_equal_a_rebuild(spark, tmp_path):
    rng, texts = random.Random(9), {}
    stats = TermStats(spark, f"file://{tmp_path}/s")
    words = ["Café", "tea", "Rain", "snow", "x1", "x2"]
    shown = lambda frame: sorted((r.term, r.df, r.n, round(r.avg_len, 9)) for r in frame.collect())
    assert shown(stats.stats()) == []
    for number in range(4):
        changed = {k: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 6)))]) for k in rng.sample(range(30), 12)}
        gone = [k for k in rng.sample(range(30), 6)]
        frames = spark.createDataFrame(list(changed.items()), "id long, text string"), spark.createDataFrame([(k,) for k in gone], "id long")
        for _ in range(1 + number % 2):  # a repeated batch changes nothing
            stats.apply(*frames, number)
        texts = {k: t for k, t in texts.items() if k not in gone} | changed
        if number == 2:
            stats = stats.compact(f"file://{tmp_path}/c", most=2)
            assert stats.deltas() == 1
        assert shown(stats.stats()) == shown(rebuilt(spark.createDataFrame(list(texts.items()), "id long, text string")))
    assert stats.compact(f"file://{tmp_path}/d", most=8) is stats


def test_texts_are_cut_once(spark, tmp_path, monkeypatch):
    """Every text of a batch goes through the cutting of terms once, though two columns need them."""
    plans, write = [], TermStats._write
    monkeypatch.setattr(TermStats, "_write", lambda self, name, rows, number: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(self, name, rows, number)))
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    stats = TermStats(spark, f"file://{tmp_path}/s")
    stats.apply(spark.read.parquet(str(tmp_path / "d")), docs.limit(0), 0)
    assert [p.count("regexp_extract_all") for p in plans] == [1, 0, 0]
    assert sorted((r.id, r.terms, r.len) for r in stats.current().collect()) == [(1, ["a", "b"], 3), (2, None, None), (3, [], 0)]


def test_table_functions_in_sql(spark):
    register(spark)
    rows = spark.sql("SELECT * FROM index_terms(TABLE(SELECT * FROM VALUES (1, 'Été été, x'), (2, NULL) t(id, text)))").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "ete", 2, 3), (1, "x", 1, 3)]
    table = "SELECT * FROM VALUES ('a', '1', 5L, 2L), ('a', '2', 9L, 3L), ('a', '3', 4L, 1L), ('b', '1', 99L, 98L) t(agent, filename, full, short)"
    got = {r.agent: (r.used, r.chosen) for r in spark.sql(f"SELECT * FROM canvas_budget(TABLE({table}) PARTITION BY (agent) ORDER BY (filename DESC), 10)").collect()}
    assert got == {"a": (9, ["1(meta)", "2(meta)", "3"]), "b": (0, [])}
    for call in ("index_terms(TABLE(SELECT 1 AS id))", "canvas_budget(TABLE(SELECT 'a' AS agent), 10)", f"canvas_budget(TABLE({table}), -1)"):
        with pytest.raises(Exception, match="column|budget"):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_metadata_and_control_characters(spark):
    texts = ['{"a": 1}', "[1]", "7", '"x"', "null", "{", None, "", '{"a": {"b": [true]}}', '{"a": 1, "a": 2}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_json(J.metadata_of(F.col("t"))).alias("m")).collect()
    assert [r.m for r in rows] == ['{"a":1}', *["{}"] * 7, '{"a":{"b":[true]}}', "{}"]
    raw = '{\t"a\n": "\x00\x1f\\"\n", "b": "\\\\"}\n"open\n'
    assert spark.createDataFrame([(raw,)], "t string").select(J.escaped(F.col("t")).alias("e")).first().e == '{\t"a\\n": "\\u0000\\u001f\\"\\n", "b": "\\\\"}\n"open\n'
