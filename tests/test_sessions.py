import random

from tidemark.operators.sessions import batches


def fold(times, n, idle):
    """The rules of batching, told plainly."""
    out, count, threshold, last, first = [], 0, 1, None, None

    def emit(reason):
        nonlocal count, threshold
        out.append((len(out) + 1, reason, count, first, last))
        count = 0
        if threshold and reason != "flush":
            threshold = 0 if 2 * threshold >= n else 2 * threshold

    for t in times:
        if count and t - last > idle:
            emit("idle_timeout")
        first = t if not count else first
        count, last = count + 1, t
        if count >= (min(threshold, n) if threshold else n):
            emit("threshold")
    if count:
        emit("flush")
    return out


def test_batches_follow_the_rules(spark):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(12)}", rng.randrange(100_000)) for _ in range(600)] + [("hot", t) for t in range(0, 30_000, 3)]
    got = batches(spark.createDataFrame(rows, "session_key string, ts long"), 5, 900).collect()
    for key in {k for k, _ in rows}:
        own = sorted((r.batch, r.reason, r.rounds, r.first_ts, r.last_ts) for r in got if r.session_key == key)
        assert own == fold(sorted(t for k, t in rows if k == key), 5, 900)
