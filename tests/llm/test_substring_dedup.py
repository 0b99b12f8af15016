import random

import numpy as np

from tidemark.llm.substring_dedup import PASSAGE_WORDS, alike, compact_windows, find_passages, op2_substring_dedup


def test_windows_hold_every_run_once():
    rng = np.random.default_rng(5)
    for n, tokens, top in ((30, 4, 100), (60, 7, 8), (5, 5, 3), (3, 5, 9), (40, 1, 50), (200, 11, 10**6)):
        values = rng.integers(1, top, n).astype(np.uint64)
        l, c, r = compact_windows(values, tokens)
        for i in range(n):
            for j in range(i + tokens - 1, n):
                own = (l <= i) & (i <= c) & (c <= j) & (j <= r)
                assert own.sum() == 1
                assert int(c[own][0]) == i + int(np.argmin(values[i : j + 1]))
        assert ((r - l + 1) >= tokens).all()


def test_alike_finds_edited_passages():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 1 << 60, 300).astype(np.uint64), rng.integers(0, 1 << 60, 300).astype(np.uint64)
    b[50:150] = a[120:220]
    assert alike(a, b) == [(120, 220, 50, 150)]
    b[90:95] = 1
    assert alike(a, b) == [(120, 220, 50, 150)]
    c = np.concatenate([a[200:260], b[200:290], a[100:160]])  # two passages of a next to each other in a, far apart and turned round in c
    assert alike(a[100:260], c) == [(0, 60, 150, 210), (100, 160, 0, 60)]
    assert alike(a[:100], b) == [] and alike(a, b[:10]) == []


def planted(rng, n_docs=160):
    vocab = [f"w{int(10 ** rng.uniform(0, 4))}" for _ in range(4000)]  # about as skewed as words are
    passages = [[rng.choice(vocab) for _ in range(rng.randint(51, 120))] for _ in range(12)]
    docs, holders = [], {}
    for d in range(n_docs):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.6:
            p = rng.randrange(12)
            text = passages[p][:]
            if rng.random() < 0.4:
                text[rng.randrange(len(text))] = "edited"
            k = rng.randint(0, len(body))
            body[k:k] = text
            holders.setdefault(p, []).append(d)
        docs.append((d, " ".join(body)))
    return docs, holders


def test_planted_passages(spark):
    docs, holders = planted(random.Random(8))
    docs += [(900, None), (901, ""), (None, docs[0][1]), (902, "same " * 40_000), (903, "same " * 500), (904, "x y")]
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string").repartition(4)
    rows = find_passages(frame).collect()
    got = {r.doc_id for r in rows}
    texts = {i: (t or "").lower().split() for i, t in docs if i is not None}

    def runs(words):
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    wanted = {d for own in holders.values() if len(own) > 1 for d in own}
    assert got - wanted <= {902, 903}
    print(len(wanted), len(wanted & got))
    assert len(wanted & got) >= 0.97 * len(wanted)

    for r in rows:
        a, b = texts[r.doc_id][r.start_word : r.end_word], texts[r.class_id][r.class_start : r.class_end]
        assert min(len(a), len(b)) >= PASSAGE_WORDS and 100 * len(runs(a) & runs(b)) >= 75 * len(runs(a) | runs(b))
    assert find_passages(frame.limit(0)).count() == 0


def test_query_finds_every_exact_repeat(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id for r in op2_substring_dedup(spark, d).collect()}
    holders = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        words = (r.text or "").encode().lower().split()
        for k in range(len(words) - 50):
            holders.setdefault(tuple(words[k : k + 51]), set()).add(r.doc_id)
    wanted = {i for own in holders.values() if len(own) > 1 for i in own}
    print(len(wanted), len(got), len(wanted - got))
    assert len(wanted & got) >= 0.98 * len(wanted)


def test_passage_beside_a_shared_footer(spark):
    rng = random.Random(21)

    def words(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    docs, wanted = [], {}
    for g in range(25):
        footer, passage = words(60), words(60)
        variant = passage[:]
        for k in (15, 30, 45):  # far below the similarity
            variant[k] = "x"
        bodies = [variant + words(20), passage + words(20), words(15) + passage + words(15)]
        for k, body in enumerate(bodies):
            docs.append((3 * g + k, " ".join(body + footer)))
            wanted[3 * g + k] = (body.index(passage[0]), passage) if k else None
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = find_passages(frame).collect()
    for i, place in wanted.items():
        own = [r for r in rows if r.doc_id == i]
        assert own  # the footer
        if place:
            assert any(r.start_word <= place[0] and place[0] + 60 <= r.end_word and r.class_id == i - i % 3 + 1 for r in own), i


def test_windows_beyond_two_million_words(spark):
    rng = np.random.default_rng(23)
    passage = " ".join(f"p{k}" for k in range(70))
    far = " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, (1 << 21) + 50)) + " " + passage
    rows = find_passages(spark.createDataFrame([(1, passage), (2, far)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in rows} == {(1, 0, 70), (2, (1 << 21) + 50, (1 << 21) + 120)}


def test_recall_of_passages_near_the_limit(spark):
    """Passages of 60 to 150 words whose copies are 0.75 to 0.85 alike, against the exact similarity of each pair."""
    rng, docs, pairs = random.Random(31), [], 0

    def runs(words):
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    while pairs < 120:
        word = lambda: f"v{rng.randrange(10**6)}"
        passage = [word() for _ in range(rng.randint(60, 150))]
        copy = passage[:]
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(copy))
            copy[k : k + rng.randint(0, 1)] = [word()] if rng.random() < 0.7 else []
        a, b = runs(passage), runs(copy)
        if not 0.75 <= len(a & b) / len(a | b) <= 0.85:
            continue
        for k, own in enumerate((passage, copy)):
            docs.append((2 * pairs + k, " ".join([word() for _ in range(rng.randint(0, 60))] + own + [word() for _ in range(rng.randint(0, 60))])))
        pairs += 1
    got = {(r.class_id, r.doc_id) for r in find_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert sum((2 * k, 2 * k + 1) in got for k in range(pairs)) >= 0.95 * pairs
    assert all(a // 2 == b // 2 for a, b in got)


def test_lines_in_common_are_not_compared_in_pairs(spark, monkeypatch):
    """Texts that share a line far below the size of a passage meet in the joins; almost none of their pairs may reach the comparison of texts."""
    from tidemark.llm import substring_dedup

    rng, seen, real = random.Random(41), [], substring_dedup.verified
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]

    def counted(pairs, *others):
        seen.append(pairs.count())
        return real(pairs, *others)

    monkeypatch.setattr(substring_dedup, "verified", counted)
    lines = [words(18) for _ in range(6)]
    docs = [(k, " ".join(words(60) + lines[k % 6] + words(60))) for k in range(180)]
    docs += [(900, docs[0][1]), (901, docs[1][1])]
    rows = find_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.class_id) for r in rows} == {(0, 0), (900, 0), (1, 1), (901, 1)}
    print(seen)
    assert sum(seen[1:]) <= 180  # all but the first, which meets one hub a document


def test_links_between_members_of_classes(spark):
    """Two documents whose passages were found with others earlier are linked where they are alike, and runs of one token as long as a passage are alike."""
    rng = random.Random(51)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]

    def edited(p, *places):
        return [f"e{rng.randrange(10**6)}" if k in places else w for k, w in enumerate(p)]

    docs, pairs = [], []
    for g in range(20):
        m = words(60)
        n = edited(m, 20)  # alike, 51 of 61
        low, high = edited(m, 35), edited(n, 50)  # each alike with one of m and n only: 46 of 66 with the other
        for k, own in enumerate((low, high, m, n)):
            docs.append((4 * g + k, " ".join(words(15) + own + words(15))))
        pairs.append((4 * g + 2, 4 * g + 3))
    docs += [(900, " ".join(words(70) + ["same"] * 90)), (901, " ".join(["same"] * 70 + words(70)))]
    rows = find_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    group = {i: i for i, _ in docs}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for r in rows:
        group[root(r.doc_id)] = root(r.class_id)

    def runs(i):
        own = docs[i][1].split()[15:75]
        return {tuple(own[k : k + 5]) for k in range(56)}

    alike = [(a, b) for a, b in pairs if 100 * len(runs(a) & runs(b)) >= 75 * len(runs(a) | runs(b))]
    assert len(alike) == 20
    print(sum(root(a) == root(b) for a, b in alike))
    assert sum(root(a) == root(b) for a, b in alike) >= 19
    assert root(900) == root(901)


def test_windows_of_repeated_values_are_one():
    from tidemark.llm.substring_dedup import joined_windows

    l, c, d, r = joined_windows(np.full(500, 7, np.uint64), 46)
    assert len(c) == 1 and (l[0], c[0], r[0]) == (0, 0, 499) and d[0] >= 454
    rng = np.random.default_rng(9)
    for n, tokens, top in ((60, 4, 3), (200, 7, 2), (300, 11, 10**6), (200, 6, 5)):
        values = rng.integers(1, top + 1, n).astype(np.uint64)
        l, c, d, r = joined_windows(values, tokens)
        for i in range(n - tokens + 1):  # each run is in one window, whose value is its smallest
            own = (np.maximum(l, c - tokens + 1) <= i) & (i <= np.minimum(d, r - tokens + 1))
            assert own.sum() == 1 and values[c[own][0]] == values[i : i + tokens].min()


def test_bits_that_a_run_needs():
    from collections import Counter

    from tidemark.llm.substring_dedup import TOKENS, needs

    rng = np.random.default_rng(10)
    for n, top in ((60, 4), (120, 30), (200, 500), (47, 1)):
        bins = rng.integers(0, top, n)
        for spare, least in zip((6, 16), needs(bins, np.zeros(n, int), 6, 16)):
            for i in range(n - TOKENS + 1):
                want, left = 0, spare
                for times in sorted(Counter(bins[i : i + TOKENS].tolist()).values()):
                    want, left = (want, left - times) if times <= left else (want + 1, left)
                assert least[i] == want


def test_tokens_do_not_depend_on_spaces_or_chunks(monkeypatch):
    from tidemark.llm import substring_dedup

    rng = random.Random(61)
    words = [b"aB", b"ab", b"c" * 200, "é".encode(), b"x", b"A", b"\x00", b"zz\x1c"]
    texts = [b"".join(rng.choice(words) + rng.choice([b" ", b"\n\t", b"\x0b\x0c\r"]) for _ in range(rng.randint(0, 60))) for _ in range(100)] + [None, b"", b"  "]
    whole = substring_dedup.tokens_of(texts)
    monkeypatch.setattr(substring_dedup, "CHUNK", 64)
    seen = {}
    for text, tokens, again in zip(texts, whole, substring_dedup.tokens_of(texts)):
        own = (text or b"").lower().split()
        assert tokens.tolist() == again.tolist() and len(tokens) == (max(1, len(own) - 4) if own else 0)
        for k, token in enumerate(tokens.tolist()):
            assert seen.setdefault(tuple(own[k : k + 5]), token) == token
    assert len(set(seen.values())) == len(seen)
