import random
import zlib
from collections import Counter

import pytest
from oracle import rows_of, sql_rows

from tidemark.llm.common import Scratch
from tidemark.llm.spelling_variants import ORACLES, Acceptors, count_words, near_words, op11_spelling_variants, roots_of, slipped, spelling_variants


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, times=5):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        form = min(others, key=lambda v: (-counts[v], v), default=None)
        out[w] = [n, len(others), form if form is not None and counts[form] >= times * n else None]
    rows = []
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, form, root, n, k, counts[form] if form else None))
    return sorted(rows)


def got(frame):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect())


def random_words(rng, n, letters, sizes):
    return {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)}


def test_query_equals_sql(spark, data_dir):
    for d in (data_dir, "/root/testdata/sf0.01"):
        assert rows_of(op11_spelling_variants(spark, d)) == sql_rows(ORACLES["op11_spelling_variants"], d)


def test_machines_are_minimal_and_their_composition_gives_the_pairs():
    rng, machines = random.Random(1), Acceptors(bound=60)
    for _ in range(60):
        words = sorted(random_words(rng, 25, "abé", range(0, 5)))
        initial = machines.machine(words)
        pairs = [frozenset(p[:2]) for p in machines.pairs(initial)]
        assert set(pairs) == {frozenset((a, b)) for a in words for b in words if near(a, b)}
        assert len(machines.register) == len(machines.arcs) == len({(e, *a.items()) for e, a in zip(machines.ends, machines.arcs)})
        assert machines.common(initial, initial, {}) and sorted(machines.common(initial, initial, {})) == words


def test_shared_endings_are_one_state():
    machines = Acceptors()
    machines.machine(["ending", "reading"])
    n = len(machines.arcs)
    machines.machine(["bing", "xing"])
    assert len(machines.arcs) == n + 1  # only the new partition's initial state


@pytest.mark.parametrize("bounds", [(20_000, 64), (128, 1), (128, 2), (130, 3)])
def test_cutting_again_changes_nothing(spark, bounds):
    rng = random.Random(7)
    words = random_words(rng, 300, "abc", range(6, 10)) | random_words(rng, 60, "xy", range(6, 8)) | {"q" * k for k in range(6, 40)} | {"q" * 12 + "é" + "q" * 9, "z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 150}
    counts = {w: rng.randint(1, 60) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = {r["word"]: (r["n_near"], r["best"]["near"], -r["best"]["less"]) for r in near_words(frame, Scratch(spark), *bounds).collect()}
    wanted = {}
    for w in counts:
        if others := [v for v in counts if near(w, v)]:
            form = min(others, key=lambda v: (-counts[v], v))
            wanted[w] = len(others), form, counts[form]
    assert found == wanted


def test_a_partition_of_many_words_is_cut_again(spark):
    letters = "abcdefghijkl"
    words = ["hot" + x + y + z + "end" for x in letters for y in letters for z in letters]
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = near_words(frame, Scratch(spark), 128, 64).collect()
    assert len(found) == len(words) and {r["n_near"] for r in found} == {33}


def test_texts_slips_and_forms(spark):
    rng = random.Random(11)
    base = sorted(random_words(rng, 12, "abcdeé", (6, 7)))
    texts = {k: " ".join(rng.choice([w, w, w, w.upper(), w[1:], w + "x"]) for w in rng.choices(base, [2 ** (i % 7) for i in range(12)], k=40)) for k in range(60)}
    texts |= {100: None, 101: "", 102: "ÀÖÿ×÷Abc short 123", 103: "a" * 3000 + " " + "a" * 3001, 104: "Éternel éternel ÉTERNEL"}
    counts = Counter()
    for k, t in texts.items():
        run = ""
        for c in (t or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{k}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run
                if len(word) >= 6:
                    counts[word] += 1
            run = ""
    docs = spark.createDataFrame([(k, t, "w", 3, "x") for k, t in texts.items()], "doc_id long, text string, word string, n int, key string").repartition(3)
    assert {r["word"]: r["n"] for r in count_words(docs, slip=7).collect()} == dict(counts)
    for least, times in ((1, 5), (3, 2)):
        wanted = brute({w: n for w, n in counts.items() if n >= least}, times)
        assert got(spelling_variants(docs, least_count=least, form_times=times, slip=7)) == wanted
        assert any(r[1] for r in wanted)


def test_slips_of_one_text():
    start = zlib.crc32(b"5:")
    words = ["banana", "cherry", "banana", "apples"] * 3
    out = slipped(words, start, 1)
    for w, o in zip(words, out):
        h = zlib.crc32(f"5:{w}".encode())
        assert o == w[: h % 6] + w[h % 6 + 1 :]
    assert slipped(words, start, 1 << 40) == words or 0 in {zlib.crc32(f"5:{w}".encode()) for w in words}


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(20)] + [("a", "b"), ("c", "b")]
    roots = {r["word"]: r["root"] for r in roots_of(spark.createDataFrame(chain, "word string, form string"), Scratch(spark)).collect()}
    assert roots == {f"w{k}": "w20" for k in range(20)} | {"a": "b", "c": "b"}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "branch")] * 3 + [(1, "branch")] * 2 + [(1, None)]
    found = got(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == [("branch", None, "branch", 5, 0, None)]
    assert got(spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], "doc_id long, text string"), partition_words=3)
