import random
import time

from pyspark.sql import functions as F

from tidemark.operators.sessions import batches
from tidemark.streaming.capture import capture, idle_windows, newer_than_cursor, once_per_call, round_batches
from tidemark.streaming.state import VectorTable, paired_calls, session_rows


def stream_of(spark, frames, path):
    """One file a micro-batch, in order."""
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(stream, name, path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return q


def test_capture_keeps_newer_rows(spark, tmp_path):
    kind = "session_key string, role string, message_text string, timestamp long"
    parts = [[("a", "user", "hello", 10), ("a", "assistant", "fine ```x\ny```", 11), ("b", "user", "/reset", 5)], [("a", "user", "late", 11), ("a", "user", "new", 12), ("b", "user", "first", 4)]]
    frames = [spark.createDataFrame(p, kind) for p in parts]
    run(capture(stream_of(spark, frames, str(tmp_path / "in"))), "captured", str(tmp_path / "check"))
    assert sorted(r.message_text for r in spark.table("captured").collect()) == ["fine", "first", "hello", "new"]


def test_batches_equal_the_batch_twin(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.randrange(3_000), f"s{rng.randrange(4)}") for _ in range(120))
    frames = [spark.createDataFrame([(k, t) for t, k in rows[i : i + 40]], "session_key string, t long").select("session_key", F.timestamp_seconds("t").alias("ts")) for i in (0, 40, 80)]
    stream = stream_of(spark, frames, str(tmp_path / "in"))
    run(round_batches(stream, 5, 10**9), "batched", str(tmp_path / "check"))
    got = {(r.session_key, r.batch, r.reason, r.rounds, r.last_ts) for r in spark.table("batched").collect()}
    whole = frames[0].union(frames[1]).union(frames[2]).select("session_key", F.unix_millis("ts").alias("ts"))
    wanted = {(r.session_key, r.batch, r.reason, r.rounds, r.last_ts) for r in batches(whole, 5, 10**9).collect() if r.reason != "flush"}
    assert got == wanted


def test_idle_windows_and_single_calls(spark, tmp_path):
    frame = lambda *ts: spark.createDataFrame([("a", t, f"c{t % 2}") for t in ts], "session_key string, t long, tool_call_id string").select("session_key", F.timestamp_seconds("t").alias("ts"), "tool_call_id")
    frames = [frame(0, 500, 1000), frame(5000), frame(20000), frame(40000)]
    run(idle_windows(stream_of(spark, frames, str(tmp_path / "in")).drop("tool_call_id")), "windows", str(tmp_path / "c1"))
    got = sorted((r.first.timestamp(), r.rounds) for r in spark.table("windows").collect())
    assert [n for _, n in got][:2] == [3, 1]
    calls = stream_of(spark, [frame(0, 2, 1), frame(4, 3)], str(tmp_path / "in2"))
    run(once_per_call(calls), "calls", str(tmp_path / "c2"))
    assert sorted(r.tool_call_id for r in spark.table("calls").collect()) == ["c0", "c1"]


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """After the time without rows a session's cursor is gone, and older rows are taken again."""
    kind = "session_key string, timestamp long"
    frames = [spark.createDataFrame([("a", 10)], kind), spark.createDataFrame([("a", 5)], kind)]
    frames[0].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = newer_than_cursor(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 1).writeStream.format("memory").queryName("forgot").option("checkpointLocation", str(tmp_path / "c")).start()
    def until(n):
        for _ in range(120):
            if len(rows := spark.table("forgot").collect()) >= n:
                return sorted(r.timestamp for r in rows)
            time.sleep(0.5)
        return None

    try:
        assert until(1) == [10]
        time.sleep(3)
        frames[1].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert until(2) == [5, 10]
    finally:
        q.stop()


def test_sessions_without_pending_work_are_forgotten_and_their_state_goes(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "session_key string, id long, t long").select("session_key", "id", F.timestamp_seconds("t").alias("ts"))
    frames = [frame(("a", 1, 10), ("a", 2, 20), ("a", 3, 30), ("b", 4, 30)), frame(("c", 5, 9000), ("c", 6, 9001), ("c", 7, 9002)), frame(("a", 8, 9100), ("b", 9, 9100), ("c", 10, 9001), ("c", 11, 9100))]
    held = []
    for k, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = session_rows(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in")), 3, 3_600_000)
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        held.append({r.key.session_key for r in spark.read.format("statestore").option("stateVarName", "cursor").load(str(tmp_path / "check")).collect()})
    got = {(r.session_key, r.id): (r.place, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert held == [{"a", "b"}, {"b", "c"}, {"a", "b", "c"}]  # b's row waits for its batch, so b stays
    assert got == {("a", 1): (0, 0), ("a", 2): (1, 0), ("a", 3): (2, 0), ("b", 4): (0, 0), ("c", 5): (0, 0), ("c", 6): (1, 0), ("c", 7): (2, 0), ("a", 8): (0, 0), ("b", 9): (1, 0), ("c", 11): (3, 1)}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = VectorTable(spark, f"file://{tmp_path}/t", "id", "id bigint, text string")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    shown = lambda: sorted((r.id, r.text, r.embedding) for r in store.rows().collect())
    assert shown() == []
    for _ in range(2):
        store.add_rows(rows, 0)
    assert shown() == [(1, "a", None), (2, "b", None)]
    vectors = lambda *v: spark.createDataFrame(v, "id long, embedding array<double>")
    for _ in range(2):
        store.add_vectors(vectors((1, [1.0]), (2, [0.0]), (9, [2.0])), 0)
    assert shown() == [(1, "a", [1.0]), (2, "b", None)]
    store.add_vectors(vectors((1, [3.0])), 1)
    store.add_vectors(vectors((1, [1.0]), (9, [2.0])), 0)
    assert shown() == [(1, "a", [3.0]), (2, "b", None)]


def test_pairs_of_tables(spark):
    calls = spark.createDataFrame([("s", "1", 0), ("s", "2", 0), ("t", "1", 5)], "session_key string, tool_call_id string, t long").select("session_key", "tool_call_id", F.timestamp_seconds("t").alias("called"))
    results = spark.createDataFrame([("s", "1", 600, "x"), ("s", "2", 601, "late"), ("t", "1", 4, "early")], "session_key string, tool_call_id string, t long, result string").select("session_key", "tool_call_id", F.timestamp_seconds("t").alias("answered"), "result")
    assert sorted((r.session_key, r.tool_call_id, r.result) for r in paired_calls(calls, results).collect()) == [("s", "1", "x"), ("s", "2", None), ("t", "1", None)]


class _Calls:
    """A state handle that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getListState(self, name, schema):  # noqa: N802
        return _Calls()

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def put(self, value):
        self.update(value)

    def clear(self):
        self.update(None)

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return sorted(self.timers)

    def registerTimer(self, t):  # noqa: N802
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.calls += 1
        self.timers.remove(t)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_a_session_asks_little_of_its_state(spark):
    """A call to the state goes from one process to another: four at most a micro-batch, whatever it brings; a timer never comes too late."""
    from types import SimpleNamespace as Of

    from tidemark.streaming.state import _Sessions

    h, sessions, rng, t = _Calls(), _Sessions(3, 1000), random.Random(5), 0
    sessions.init(h)
    for k in range(60):
        t += rng.choice([1, 100, 600, 3000])
        before = h.calls
        out = [x.asDict() for x in sessions.handleInputRows(("a",), iter([Of(timestamp=t + x, id=x) for x in (2, 0, 1, 0)][: 1 + k % 4]), h)]
        assert h.calls - before <= 4 and out[0]["ids"] == [[2], [0, 2], [0, 1, 2], [0, 0, 1, 2]][k % 4]
        t = h.value[0]
        assert len(h.timers) == 1 and max(h.timers) <= t + 1000
        h.now = t + rng.choice([0, 500, 999])
        for timer in [x for x in h.timers if x <= h.now]:
            assert list(sessions.handleExpiredTimer(("a",), h, None)) == []
            h.timers.remove(timer)
            assert h.value and len(h.timers) == 1  # newer rows have come
    h.now, rows = t + 1000, h.value[1]
    for timer in list(h.timers):
        list(sessions.handleExpiredTimer(("a",), h, None))
        h.timers.remove(timer)
    while h.timers and rows % 3 == 0:
        h.now = max(h.timers)
        list(sessions.handleExpiredTimer(("a",), h, None))
        h.timers.remove(h.now)
    assert (h.value is None) == (rows % 3 == 0)
