import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import tokenizer_path
from tidemark.llm.packing import TURN, _ChunkIds, op7_packing, pack

PATH = tokenizer_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def served_by_rounds(queues, quantum):
    """Deficit round-robin, a document at a time: each queue earns its quantum and serves what that covers."""
    queues, deficit, order = {q: list(own) for q, own in queues.items()}, dict.fromkeys(queues, Fraction(0)), []
    while any(queues.values()):
        for q in sorted(queues):
            deficit[q] += quantum[q]
            while queues[q] and queues[q][0][1] <= deficit[q]:
                i, n = queues[q].pop(0)
                deficit[q] -= n
                order.append((i, n))
    return order


def by_turns(docs, turn):
    """A queue's documents as runs of `turn` tokens (None: whole): ((id, start), tokens)."""
    return [((i, start), min(turn or n, n - start)) for i, n in docs for start in range(0, n, turn or n)]


@pytest.mark.parametrize("turn", [None, 7, 64])
def test_documents_are_served_by_rounds_and_deficits(spark, turn):
    rng = random.Random(5)
    for k, shares in enumerate(({"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 0.125, "b": 0.125, "c": 0.75})):
        rows = [(i, " ".join("word" for _ in range(rng.choice([0, 1, 3, 20, 150]))), rng.choice("abc")) for i in range(120)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
        pieces = sorted(pack(docs, size=64, shares=shares, turn=turn).collect(), key=lambda p: (p.sequence_id, p.offset))
        queues = defaultdict(list)
        for i, text, source in rows:
            queues[source].append((i, len(LIBRARY.encode(text, add_special_tokens=False).ids) + 1))
        wanted = served_by_rounds({q: by_turns(own, turn) for q, own in queues.items()}, {q: Fraction(64) * Fraction(s) for q, s in shares.items()})
        at, runs = 0, []
        for (i, start), n in wanted:  # runs that follow each other are one, cut at the windows' ends alone
            if runs and runs[-1][0] == i and runs[-1][1] + runs[-1][3] == start:
                runs[-1][3] += n
            else:
                runs.append([i, start, at, n])
            at += n
        cut = []
        for i, start, place, n in runs:
            while n:
                some = min(n, 64 - place % 64)
                cut.append((i, start, some, place // 64, place % 64))
                start, place, n = start + some, place + some, n - some
        assert [(p.doc_id, p.start, p.length, p.sequence_id, p.offset) for p in pieces] == cut


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*" \n\t'sdlmtABCΣß019.,!?éÉ日\u2003\u3000<|>", "<|endoftext|>", "<|ENDOFTEXT|>", "'S,", "word."]), st.characters(blacklist_categories=("Cs", "Cn", "Co"), max_codepoint=0x2FFF)), max_size=40).map("".join))
def test_chunks_give_the_identifiers_of_whole_texts(text):
    ids = np.frombuffer(_ChunkIds(LIBRARY, np.dtype("<u2")).of(text.encode()), "<u2").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids


def test_few_known_chunks_change_nothing():
    known, text = _ChunkIds(LIBRARY, np.dtype("<u2"), bound=4), "the cat, the dog. the end of a tale of the cat and 12 dogs!!"
    for _ in range(3):
        for words in (text.split()[:5], text.split()[4:9], text.split()):
            ids = np.frombuffer(known.of(" ".join(words).encode()), "<u2").tolist()
            assert ids == LIBRARY.encode(" ".join(words), add_special_tokens=False).ids and len(known) <= 6


def check_pieces(rows, pieces, size):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    assert set(by_doc) == {i for i, _, _ in rows}
    for i, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    last = max(by_window)
    for w, own in by_window.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == size or w == last and at < size
    return by_window


def test_query_packs_all_tokens(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    pieces = op7_packing(spark, data_dir).collect()
    by_window = check_pieces(rows, pieces, 2048)
    # while all queues last, each stays within its quantum and a document of its target
    source, n_of = {i: s for i, _, s in rows}, {p.doc_id: p.doc_tokens for p in pieces}
    own = defaultdict(int)
    for i, n in n_of.items():
        own[source[i]] += n
    total, longest = sum(own.values()), TURN
    weight = {s: (n / total) ** 0.7 for s, n in own.items()}
    target = {s: w / sum(weight.values()) for s, w in weight.items()}
    lasts = min(own[s] / target[s] for s in own)
    served, share = 0, defaultdict(int)
    for w in sorted(by_window):
        for p in by_window[w]:
            share[source[p.doc_id]] += p.length
            served += p.length
        if served > lasts - len(own) * longest:
            break
        assert all(abs(share[s] - target[s] * served) <= 2048 + len(own) * longest for s in own)


def test_shares_odd_rows_and_many_sources(spark):
    rows = [(i, None if i % 7 == 0 else ("word " * (i % 50)).strip(), None if i % 5 == 0 else f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, ids string").repartition(5)
    for extra in ({"shares": {"s0": 0.7, "s1": 0.2}}, {"temper": 0.5, "turn": 5}, {"turn": 1}, {}):
        pieces = pack(docs, size=64, payload=F.crc32, payload_name="ids_crc32", **extra).collect()
        check_pieces(rows, pieces, 64)
    assert pack(docs.limit(0)).count() == 0
    twice = pack(docs.limit(3).union(docs.limit(3)), size=64)
    assert twice.groupBy("doc_id").sum("length").count() == 3
    many = spark.createDataFrame([(i, "word " * (i % 7), f"site{i % 400}") for i in range(1200)], "doc_id long, text string, source string")
    check_pieces([tuple(r) for r in many.collect()], pack(many, size=64, payload=F.crc32, payload_name="ids_crc32").collect(), 64)
