import random

import numpy as np
from oracle import rows_of, sql_rows

from tidemark.llm.common import Scratch
from tidemark.llm.near_dedup import ORACLES, SIZE, components, near_duplicates, op4_near_dedup, sketch


def words(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", out) if w]


def shingle_sets(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, percent=75):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingle_sets(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    out = [(-1 if i is None else i, len(shingle_sets(t)), -1 if i is None else root(i), i is None or root(i) == i) for i, t in rows]
    return sorted(out)


def got_rows(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in frame.collect())


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 1000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert (sketch(a) != np.iinfo(np.uint64).max).all()
    agree = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        agree.append((sketch(pool[:300]) == sketch(pool[100:])).mean())  # similarity 0.5
    assert abs(np.mean(agree) - 0.5) < 0.03
    assert len(sketch(pool)) == SIZE


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(100 + i, None) for i in range(2)] + [(i, "") for i in (103, 104)] + [(105, "Two words"), (106, "two\tWORDS "), (107, "two"), (None, "two words"), (None, "x")]
    at = 0
    for _ in range(12):  # chains: every text is an edit of the one before
        text = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            rows.append((at, " ".join(text)))
            at += 1
            text = text[:]
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
    rng.shuffle(rows)
    rows += rows[:5] + [(3, "another text of the same id"), (200, "another text of the same id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, band string").repartition(3)
    assert got_rows(near_duplicates(docs)) == brute(rows)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        text = base[:]
        for _ in range(4):
            text[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_rows(near_duplicates(docs)) == brute(rows)


def test_bands_of_many_unlinked_near_copies(spark, monkeypatch):
    """Heavily edited copies of one text: some links only between copies, not with the base; by pivot and directly."""
    import tidemark.llm.near_dedup as module

    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 140):
        text = base[: rng.choice([60, 60, 56, 50])]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            text[rng.randrange(0, len(text), 6)] = f"e{rng.randrange(3)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows)
    assert 2 < sum(r[3] for r in wanted) < 100
    for direct in (2, 1000):
        monkeypatch.setattr(module, "DIRECT", direct)
        assert got_rows(near_duplicates(docs)) == wanted


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 41)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(42)}, 90: 90, 95: 90, 100: 90}


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    assert rows_of(op4_near_dedup(spark, d)) == sql_rows(ORACLES["op4_near_dedup"], d)
