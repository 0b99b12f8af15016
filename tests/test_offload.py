import random

from pyspark.sql import functions as F

from tidemark.functions.tokens import estimate
from tidemark.operators.offload import canvas_budget, lookup, new_entries, reapply_deleted, replaceable, tail_keep


def greedy(items, budget):
    used, chosen = 0, []
    for name, full, short in sorted(items, reverse=True):
        for size, form in ((full, ""), (short, "(meta)")):
            if used + size <= budget:
                used += size
                chosen.insert(0, name + form)
                break
    return used, chosen


def test_canvas_budget_is_greedy(spark):
    rng = random.Random(2)
    rows = [(f"a{i % 5}", f"{rng.randrange(20):03d}-x{i}", rng.random() < 0.1, rng.randint(1, 90), rng.randint(1, 30)) for i in range(90)]
    deleted = [(f"a{i % 5}", f"{i:03d}-N2") for i in range(0, 20, 2)] + [("a0", ""), ("a1", None)]
    got = {r.agent: (r.used, r.chosen) for r in canvas_budget(spark.createDataFrame(rows, "agent string, filename string, is_active boolean, full long, short long"), spark.createDataFrame(deleted, "agent string, node_id string"), 120).collect()}
    assert got
    for a in got:
        own = {n[:3] for k, n in deleted if k == a and n}
        assert got[a] == greedy([(r[1], *r[3:]) for r in rows if r[0] == a and not r[2] and r[1][:3] in own], 120)


def test_estimates():
    assert estimate("") == 0 and estimate(None) == 0 and estimate(" ") == 1
    assert estimate("the cat") == 2 and estimate("12,345") == 3 and estimate("3.14") == 3 and estimate("1234567890") == 4
    assert estimate("日本語") == 4 and estimate("你") == 1 and estimate("ひらがな") == 4 and estimate("안녕") == 3
    assert estimate("don't") == 1 and estimate("a\nb") == 3 and estimate("🙂") == 5 and estimate("🙂" * 10) == 50
    assert estimate("été " * 60) == 60 and estimate("élémentaire " * 60) == 192


def entries_frame(spark, rows):
    return spark.createDataFrame(rows, "session_key string, idx long, tool_call_id string, event_id long")


def test_ids_belong_to_their_session(spark):
    stored = entries_frame(spark, [("s1", 0, "call_1", 10), ("s1", 1, "", 11), ("s2", 0, "call2", 12), ("s2", 1, None, 13)])
    batch = entries_frame(spark, [("s1", 5, "call1", 20), ("s2", 5, "call_1", 21), ("s2", 6, "ca_ll2", 22), ("s1", 7, "", 23), ("s2", 8, None, 24), ("s3", 9, "call2", 25), ("s3", 9, "call2", 25)])
    assert sorted(r.event_id for r in new_entries(batch, stored).collect()) == [21, 23, 24, 25, 25]
    assert sorted(r.event_id for r in replaceable(batch, stored).collect()) == [20, 22, 23]
    blocks = spark.createDataFrame([(1, 0, "tool_use", "call_1"), (2, 0, "tool_use", "call_1"), (1, 1, "text", None)], "conv_id long, turn long, kind string, tool_call_id string")
    left = reapply_deleted(blocks, spark.createDataFrame([(1, "call1")], "conv_id long, tool_call_id string")).collect()
    assert sorted((r.conv_id, r.turn) for r in left) == [(1, 1), (2, 0)]


def test_lookup_takes_the_last_entry_of_an_id(spark):
    stored = entries_frame(spark, [("s1", 0, "a_1", 1), ("s1", 1, "a_1", 2), ("s1", 2, "a1", 3), ("s1", 3, "a1", 4), ("s1", 4, "b_2", 5), ("s1", 5, "b__2", 6), ("s2", 0, "a_1", 7)])
    asked = [("s1", "a_1"), ("s1", "a1"), ("s1", "_a1"), ("s1", "b2"), ("s1", "b_2"), ("s1", "_b2"), ("s2", "a1"), ("s2", "b_2"), ("s3", "a_1"), ("s1", None)]
    got = {(r.session_key, r.tool_call_id): r.entry and r.entry.event_id for r in lookup(spark.createDataFrame(asked, "session_key string, tool_call_id string"), stored).collect()}
    assert got == {("s1", "a_1"): 2, ("s1", "a1"): 4, ("s1", "_a1"): 4, ("s1", "b2"): 5, ("s1", "b_2"): 5, ("s1", "_b2"): 5, ("s2", "a1"): 7, ("s2", "b_2"): None, ("s3", "a_1"): None, ("s1", None): None}


def kept_tail(rows, target):
    """The tail by steps: within the target, no results without their call, the last user row, ten rows."""
    total, start = 0, 0
    for k in range(len(rows) - 1, -1, -1):
        if total + rows[k][1] > target:
            start = k + 1
            break
        total += rows[k][1]
    while start < len(rows) and rows[start][2]:
        start += 1
    users = [k for k, r in enumerate(rows) if r[0] == "user"]
    if start < len(rows) and users and users[-1] < start:
        start = users[-1]
    return max(0, len(rows) - 10) if len(rows) - start < 10 else start


def test_tail_keeps_calls_with_their_results(spark):
    rng, rows, wanted = random.Random(4), [], {}
    for conv in range(80):
        own = [(rng.choice(["user", "assistant", "tool", "tool"]), rng.randint(0, 50)) for _ in range(rng.randint(1, 40))]
        own = [(role, n, role == "tool") for role, n in own]
        wanted[conv] = kept_tail(own, 40 * (conv % 20))
        rows += [(conv, 3 * k, *r) for k, r in enumerate(own)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, tokens long, is_tool_result boolean")
    got = {r.conv_id: r.keep_from for r in tail_keep(frame, 40 * (F.col("conv_id") % 20)).collect()}
    assert got == wanted and len(set(wanted.values())) > 5
