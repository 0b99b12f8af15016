import random
from collections import defaultdict

from tidemark.operators.compress import DELAY_MS, KEEP, LEAST_TO_TRUNCATE, MAX_MS, MIN_MS, STUB_TOKENS, Schedule, emergency_compress

KIND = "conv_id long, turn long, role string, tokens long, tool_ids array<string>, is_result boolean"


def conversation(rng, c, n):
    rows = []
    for t in range(n):
        role = rng.choice(["user", "assistant", "tool"])
        ids = [f"c{rng.randrange(4)}"] if role != "user" and rng.random() < 0.7 else []
        rows.append((c, t, role, rng.choice([5, 50, 700]), ids, role == "tool"))
    return rows


def unit_of(rows):
    """The call before each result that shares an id with it, told plainly."""
    out = {}
    for _, t, _, _, ids, result in rows:
        calls = [c[1] for c in rows if not c[5] and c[1] < t and set(c[4]) & set(ids)] if result else []
        out[t] = max(calls, default=t)
    return out


def test_emergency_follows_the_rules(spark):
    rng = random.Random(3)
    budget, limit = 3000, 1800
    convs = {c: conversation(rng, c, rng.randint(1, 30)) for c in range(150)}
    got = defaultdict(dict)
    for r in emergency_compress(spark.createDataFrame([r for own in convs.values() for r in own], KIND), budget).collect():
        got[r.conv_id][r.turn] = r.tokens
    worked = 0
    for c, rows in convs.items():
        kept, total = got[c], sum(r[3] for r in rows)
        if total <= budget * 0.95:
            assert kept == {r[1]: r[3] for r in rows}
            continue
        worked += 1
        units, asked = unit_of(rows), max((r[1] for r in rows if r[2] == "user"), default=None)
        assert len(kept) >= min(KEEP, len(rows)) and (asked is None or asked in kept)
        for u in set(units.values()):  # a call and its results go or stay together
            own = [t for t in units if units[t] == u]
            assert all(t in kept for t in own) or not any(t in kept for t in own)
        gone = [r for r in rows if r[1] not in kept]
        head = [r for r in gone if asked is None or units[r[1]] < asked]
        if sum(kept.values()) > limit:  # nothing more could have gone
            left = [r for r in rows if r[1] in kept]
            assert all(kept[r[1]] < LEAST_TO_TRUNCATE or r[1] == asked for r in left)
        if any(r[2] == "user" for r in gone):  # user rows only go from the head, and before all units after them
            last = max(units[r[1]] for r in gone if r[2] == "user")
            assert all(units[r[1]] > last or r in gone or r[1] == asked or units[r[1]] == units.get(asked) for r in rows if units[r[1]] <= last)
        assert len(head) + len(kept) <= len(rows)
        assert all(v in (STUB_TOKENS, next(r[3] for r in rows if r[1] == t)) for t, v in kept.items())
    assert worked > 50


def test_head_then_largest_then_stubs(spark):
    """Units by hand: the head frees enough; a large answer after the last question goes; a lone large result is cut."""
    rows = [
        (1, 0, "user", 900, [], False), (1, 1, "assistant", 50, ["a"], False), (1, 2, "tool", 600, ["a"], True), (1, 3, "user", 800, [], False), (1, 4, "assistant", 10, [], False),
        (2, 0, "user", 900, [], False), (2, 1, "assistant", 600, [], False), (2, 2, "assistant", 20, [], False),
        (3, 0, "tool", 1400, [], True), (3, 1, "user", 100, [], False),
    ]
    got = {(r.conv_id, r.turn): r.tokens for r in emergency_compress(spark.createDataFrame(rows, KIND), 1500).collect()}
    assert got == {(1, 3): 800, (1, 4): 10, (2, 0): 900, (2, 2): 20, (3, 0): 30, (3, 1): 100} or got == {(1, 3): 800, (1, 4): 10, (2, 0): 900, (2, 2): 20, (3, 0): STUB_TOKENS, (3, 1): 100}


def test_schedule():
    s = Schedule()
    assert list(s.new_memories(1000)) == []
    assert list(s.new_memories(5000)) == []  # only ever moved earlier
    first = list(s.new_memories(20_000))
    assert first == [(1000 + DELAY_MS, "delay")]
    assert list(s.end(20_000 + MIN_MS)) == [(1000 + DELAY_MS + MIN_MS, "delay")]
    later = list(s.end(20_000 + MIN_MS + 30 * MAX_MS))
    assert len(later) == 23 and all(k == "max_interval" for _, k in later)  # stops after a day without memories
