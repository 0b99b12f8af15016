import itertools
import math
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import lm_score
from tidemark.llm.lm_score import OWN, Hmm, by_length, ending_class, expected_counts, log_likelihoods, op10_lm_score, score_documents


def random_hmm(rng, states, classes):
    return Hmm(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states))


def path_probabilities(hmm, seq):
    for path in itertools.product(range(len(hmm.first)), repeat=len(seq)):
        p = hmm.first[path[0]] * hmm.emits[path[0], seq[0]]
        for a, b, c in zip(path, path[1:], seq[1:]):
            p *= hmm.moves[a, b] * hmm.emits[b, c]
        yield path, p


def test_likelihood_and_expected_counts_by_enumeration():
    rng = np.random.default_rng(0)
    hmm = random_hmm(rng, 3, 5)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 4)]
    sums = [sum(p for _, p in path_probabilities(hmm, s)) for s in seqs]
    assert np.allclose(log_likelihoods(hmm, seqs), np.log(sums))
    first, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for s, total in zip(seqs, sums):
        for path, p in path_probabilities(hmm, s):
            first[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                moves[a, b] += p / total
            for a, c in zip(path, s):
                emits[a, c] += p / total
    for bound in (1, 3, 7, 1000):
        got = expected_counts(hmm, seqs, bound)
        assert all(np.allclose(a, b) for a, b in zip(got, (first, moves, emits)))


def plain_counts(hmm, seq):
    """One uncut forward and backward recursion, a step at a time."""
    alpha = [hmm.first * hmm.emits[:, seq[0]]]
    alpha[0] /= alpha[0].sum()
    for c in seq[1:]:
        alpha.append((alpha[-1] @ hmm.moves) * hmm.emits[:, c])
        alpha[-1] /= alpha[-1].sum()
    beta, moves, emits = np.ones(len(hmm.first)), np.zeros_like(hmm.moves), np.zeros_like(hmm.emits)
    for t in range(len(seq) - 1, -1, -1):
        share = alpha[t] * beta
        share /= share.sum()
        emits[:, seq[t]] += share
        if t:
            both = alpha[t - 1][:, None] * hmm.moves * (hmm.emits[:, seq[t]] * beta)[None, :]
            moves += both / both.sum()
            beta = hmm.moves @ (hmm.emits[:, seq[t]] * beta)
            beta /= beta.sum()
    return share, moves, emits


def test_long_texts_are_counted_uncut():
    rng = np.random.default_rng(3)
    hmm, seqs = random_hmm(rng, 4, 30), [rng.integers(0, 30, n) for n in (5000, 17, 1300)]
    wanted = [sum(x) for x in zip(*(plain_counts(hmm, s) for s in seqs))]
    for bound in (600, 100_000):
        assert all(np.allclose(a, b) for a, b in zip(expected_counts(hmm, seqs, bound), wanted))
    assert [len(s) for g in by_length(seqs, 5100) for s in g] == [5000, 1300, 17]


def test_long_sequences_do_not_underflow():
    hmm = random_hmm(np.random.default_rng(1), 4, 50)
    assert np.isfinite(log_likelihoods(hmm, [np.arange(100_000) % 50])).all()


def words(text):
    return (text or "").encode().lower().split()


def brute_base(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter()
    for (_, text), h in zip(rows, held):
        if not h:
            counts.update([*words(text), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, text), h in zip(rows, held):
        tokens = [*words(text), b""]
        out.append((-1 if i is None else i, h, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return sorted(out)


def same(got, wanted):
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [r[:5] for r in rows] == [r[:5] for r in wanted]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(rows, wanted))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_odd_rows(spark):
    rows = [(i, f"Some words w{i % 3} and W{i}") for i in range(30)] + [(31, None), (32, ""), (None, "null id here"), (3, "Some words w0 and W3")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    same(score_documents(docs, rounds=2).collect(), brute_base(rows))
    assert score_documents(docs.limit(0)).count() == 0
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2]
    same(score_documents(spark.createDataFrame(held, "doc_id long, text string"), rounds=1).collect(), brute_base(held))


def test_few_held_words_change_no_base_score(spark, monkeypatch):
    import tidemark.llm.lm_score as module

    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(i % 20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (1, 9):
        monkeypatch.setattr(module, "HELD_WORDS", held)
        same(score_documents(docs, rounds=1).collect(), brute_base(rows))


def test_query_against_brute_force_and_held_out_gain(spark):
    d = "/root/testdata/sf0.01"
    got = op10_lm_score(spark, d).collect()
    same(got, brute_base([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]))
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("log10 gain a token on held-out texts", gain)
    assert gain > 0.05


def test_scores_equal_a_plain_forward_pass(spark, data_dir, monkeypatch):
    """With the trained model at hand: states over classes word by word, and a word's part of its class."""
    kept = {}

    def trained(coded, class_counts, *more):
        kept["hmm"], kept["counts"] = train(coded, class_counts, *more), class_counts
        return kept["hmm"]

    def held(vocabulary):
        kept["top"] = held_words(vocabulary)
        return kept["top"]

    train, held_words = lm_score.train, lm_score.held_words
    monkeypatch.setattr(lm_score, "train", trained)
    monkeypatch.setattr(lm_score, "held_words", held)
    monkeypatch.setattr(lm_score, "HELD_WORDS", 5000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.score for r in op10_lm_score(spark, data_dir).collect()}
    counts = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(text), b""])
    hmm, own = kept["hmm"], {bytes(w): k for k, w in enumerate(kept["top"].word[:OWN])}
    of = lambda w: own[w] if w in own else ending_class(w)
    tokens, kinds = Counter(), Counter()
    for w, c in counts.items():
        tokens[of(w)] += c
        kinds[of(w)] += 1
    for i, text in rows[:120]:
        alpha, total = None, 0.0
        for w in [*words(text), b""]:
            k = of(w)
            alpha = (hmm.first if alpha is None else alpha @ hmm.moves) * hmm.emits[:, k]
            part = 1.0 if k < OWN else (counts[w] + 1) / (tokens[k] + kinds[k] + 1)
            total += math.log10(alpha.sum() * part)
            alpha = alpha / alpha.sum()
        assert math.isclose(got[i], total, rel_tol=1e-6)


def test_held_words_break_ties_by_the_word(spark, monkeypatch):
    rows = [(b"", 9)] + [(f"w{k:03d}".encode(), 3) for k in range(50)] + [(b"often", 20), (b"rare", 1)]
    frame = spark.createDataFrame(rows, "word binary, c long").repartition(3)
    for most, wanted in ((10, 8), (2, 0), (40, 38), (1000, 50)):
        monkeypatch.setattr(lm_score, "HELD_WORDS", most)
        held = [bytes(w) for w in lm_score.held_words(frame).word]
        assert held == [b"often", b"", *(f"w{k:03d}".encode() for k in range(wanted)), *([b"rare"] if most > 100 else [])]
