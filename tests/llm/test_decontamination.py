import pytest
import random

import numpy as np

from tidemark.llm.decontamination import MOST_WALKS, best_window, find_leaks, keep_clean, op3_decontamination, repeats


def distance_within(item, text):
    """Smallest edit distance between item and any run of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, row[j - 1] + (a != b), new[j - 1] + 1))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, row[j - 1] + (x != y), new[j - 1] + 1))
        row = new
    return row[-1]


def words(text):
    return (text or "").encode().lower().split()


def brute(docs, items, percent=25):
    out = {}
    for d, text in docs:
        for i, item in items:
            a, b = words(item), words(text)
            if not a:
                continue
            edits = distance_within(a, b)
            if edits <= percent * len(a) // 100:
                out[d, i] = edits
    return out


def test_best_window():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item, text = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64)
        edits, start, end = best_window(item, text)
        assert edits == distance_within(item.tolist(), text.tolist()) == distance(item.tolist(), text[start:end].tolist())


def edited(rng, item, edits, vocab):
    out = item[:]
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice(vocab)
        elif kind == 1 and len(out) > 1:
            del out[k]
        else:
            out.insert(k, rng.choice(vocab))
    return out


def test_recall_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(1, 60))]) for i in range(40)]
    docs = []
    for d in range(400):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if d % 2:
            _, item = rng.choice(items)
            k = rng.randint(0, len(body))
            body[k:k] = edited(rng, item, rng.choice([0, 0, 1, len(item) // 8, len(item) // 5]), vocab)
        docs.append((d, " ".join(body)))
    docs += [(1000, None), (1001, ""), (1002, "w1 " * 30000)]
    plain_items = [(i, " ".join(w).title()) for i, w in items] + [(90, None), (91, " ")]
    frame = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    wanted = {k: v for k, v in brute([r for r in docs if r[0] != 1002], plain_items).items()}
    for block_words in (10_000, 300):
        rows = find_leaks(frame, spark.createDataFrame(plain_items, "item_id long, text string"), block_words=block_words).collect()
        got = {(r.doc_id, r.item_id): r.edits for r in rows if r.doc_id != 1002}
        assert set(got) <= set(wanted)
        assert all(got[k] >= wanted[k] for k in got)
        assert {k for k, v in wanted.items() if v == 0} <= set(got)
        recall = len(got) / len(wanted)
        print(len(wanted), recall)
        assert recall >= 0.9
    held = {d for d, _ in got} | {r.doc_id for r in rows if r.doc_id == 1002}
    clean = {r.doc_id for r in keep_clean(frame, spark.createDataFrame(plain_items, "item_id long, text string")).collect()}
    assert clean == {d for d, _ in docs} - held
    assert find_leaks(frame.limit(0), spark.createDataFrame(plain_items, "item_id long, text string")).count() == 0
    assert find_leaks(frame, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_query_finds_every_exact_copy(spark):
    d = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, d).collect()}
    docs, items = spark.read.parquet(f"{d}/documents.parquet").collect(), spark.read.parquet(f"{d}/benchmark.parquet").collect()
    exact = {(r.doc_id, i.item_id) for r in docs for i in items if b" " + b" ".join(words(i.text)) + b" " in b" " + b" ".join(words(r.text)) + b" "}
    assert exact and exact <= got
    assert len(got) < 2 * len(exact)


def test_recall_by_length_at_all_allowed_edits(spark):
    """Random and evenly spread edits, as many as are allowed, for each class of lengths."""
    rng = random.Random(31)
    vocab = [f"u{rng.randrange(10**6)}" for _ in range(20_000)]
    items, docs, classes = [], [], {}
    for name, low, high in (("4-7", 4, 7), ("8-12", 8, 12), ("13-24", 13, 24), ("25-60", 25, 60)):
        for j in range(200):
            n = rng.randint(low, high)
            i, item = len(items), [f"u{rng.randrange(10**6)}" for _ in range(n)]
            items.append((i, " ".join(item)))
            classes[i] = name
            copy, k = item[:], n // 4
            if j % 2:
                for e in range(k):  # evenly spread
                    copy[(2 * e + 1) * n // (2 * k)] = "edit"
            else:
                for place in sorted(rng.sample(range(n), k), reverse=True):
                    copy[place : place + 1] = rng.choice([[rng.choice(vocab)], [rng.choice(vocab), copy[place]], []])
            docs.append((i, " ".join([f"z{rng.randrange(10**6)}" for _ in range(20)] + copy + ["end"] * 9)))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    edits = {(r.doc_id, r.item_id): r.edits for r in got}
    assert all(k[0] == k[1] and v <= len(items[k[0]][1].split()) // 4 for k, v in edits.items())
    for name in ("4-7", "8-12", "13-24", "25-60"):
        own = [i for i, c in classes.items() if c == name]
        recall = sum((i, i) in edits for i in own) / len(own)
        print(name, recall)
        assert recall >= 0.95


def test_walks_follow_the_target():
    assert repeats(3, 25) == 2 and 2 <= repeats(4, 25) <= repeats(12, 25) < MOST_WALKS
    assert repeats(60, 25) == repeats(64, 25) and repeats(64, 5) < repeats(64, 25)


def test_shares_of_edits_that_could_lose_windows_are_refused(spark):
    rows = spark.createDataFrame([(1, "some words of a text here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words of a text")], "item_id long, text string")
    for percent in (50, 80, -1):
        with pytest.raises(ValueError):
            find_leaks(rows, items, percent=percent)
