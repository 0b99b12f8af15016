import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bin_packing
from tidemark.llm.bin_packing import PieceIds, SquaredGaps, op12_bin_packing, pack_best, place_group
from tidemark.llm.common import read_table, tokenizer_path

LIBRARY = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def ids_of(text, end=0):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [end]


def hold(rows, texts, size, payload):
    """Each row's identifiers lie in its pieces, each sequence is gapless and not too long."""
    by_row, sequences = {}, {}
    for r in rows:
        by_row.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert by_row.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = ids_of(text), 0
        pieces = sorted(by_row[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // size)))
        for r in pieces:
            assert r["start"] == at and (r["piece"] == 0 or r["length"] == size) and r["length"] > 0
            assert payload(r) == np.array(ids[at : at + r["length"]], "<u4").tobytes()
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(sequences)


def test_pieces_give_the_librarys_identifiers():
    rng, known = random.Random(3), PieceIds(LIBRARY, bound=50)
    parts = ["a", "b c", "\n", " ", "  ", "\t", "\x0b", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "é", "É", "don't", " 's", "12", "…", "<|endoftext|>", "<|", "日本", "x,", ".", "!!", "(", ")", "a_", "-b", "$$", "'", "=", "​", "÷", "᠎", " ", "﻿", "\U0001f642", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    assert [known.of(t) for t in texts] == [known.encoded(t) for t in texts]
    assert known.of(None) == b"" and len(known) <= 52 and known.direct


def test_each_document_goes_where_squares_are_least():
    rng, size = random.Random(5), 40
    gaps, fills = SquaredGaps(size), {}

    def squares(filled):
        left = [size - f for f in filled if f < size]
        return sum(left.count(g) ** 2 for g in set(left))

    for _ in range(300):
        s = rng.randint(1, size)
        wanted = min([squares([*fills.values(), s])] + [squares([*(f for j, f in fills.items() if j != k), fills[k] + s]) for k in fills if fills[k] + s <= size])
        sequence, offset = gaps.place(s)
        assert fills.get(sequence, 0) == offset
        fills[sequence] = offset + s
        assert squares(fills.values()) == wanted


@pytest.mark.parametrize("seed", range(4))
def test_few_sequences(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(2047, rng.lognormal(5.5 + seed / 3, 1, 4000).astype(np.int64) + 1)
    sequence, offset = place_group(sizes, 2048)
    fill = np.bincount(sequence, sizes)
    assert fill.max() <= 2048 and fill.min() > 0
    assert len(fill) <= -(-int(sizes.sum()) // 2048) * 1.005 + 1
    for s in rng.choice(len(fill), 50, replace=False):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == (np.cumsum(sizes[own]) - sizes[own]).tolist()


def test_places_of_few_and_equal_documents():
    for sizes in ([], [5], [7] * 100, [2047] * 5, [1024] * 9, [1] * 3000):
        sequence, _ = place_group(np.array(sizes, np.int64), 2048)
        assert len(set(sequence.tolist())) == -(-len(sizes) // (2048 // sizes[0])) if sizes else not len(sequence)


def test_query_packs_every_document(spark, data_dir):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, data_dir, "documents").collect()}
    rows = [r.asDict() | {"whole": None} for r in op12_bin_packing(spark, data_dir).collect()]
    crc = {(d, s, n): np.array(ids_of(t)[s : s + n], "<u4").tobytes() for d, t in texts.items() for s, n in {(r["start"], r["length"]) for r in rows if r["doc_id"] == d}}
    assert all(zlib.crc32(crc[r["doc_id"], r["start"], r["length"]]) == r["ids_crc32"] for r in rows)
    n = hold(rows, texts, 2048, lambda r: crc[r["doc_id"], r["start"], r["length"]])
    assert n <= 1.01 * sum(r["length"] for r in rows) / 2048 + 2


def test_odd_rows_in_several_groups(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a", 5: "a", 6: "x" * 30000, 7: "<|endoftext|> \n\n end ", 8: "one two\nthree"} | {k: f"text {k} " * (k % 9) for k in range(9, 60)}
    docs = spark.createDataFrame([(k, t, 5, "q", 1) for k, t in texts.items()], "doc_id long, text string, part int, ids string, n int").repartition(3)
    rows = pack_best(docs, size=64, group_rows=20).collect()
    n = hold(rows, texts, 64, lambda r: bytes(r["ids"]))
    assert n <= sum(r["length"] for r in rows) / 64 + 6
    assert len({r["sequence_id"] >> 32 for r in rows if r["sequence_id"] >= 0}) > 1


def test_repeated_rows_null_ids_and_exact_lengths(spark):
    docs = spark.createDataFrame([(None, "same"), (None, "same"), (1, "a b c"), (1, "a b c"), (2, "a b c d e f g")], "doc_id long, text string")
    rows = pack_best(docs, size=4, end_id=9).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["offset"]) for r in rows) == sorted(
        [("None", 0, 0, 2, 0), ("None", 0, 0, 2, 2), ("1", 0, 0, 4, 0), ("1", 0, 0, 4, 0), ("2", 0, 0, 4, 0), ("2", 1, 4, 4, 0)]
    )
    assert len({r["sequence_id"] for r in rows}) == 5


def test_empty_table_and_bad_size(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_best(empty).collect() == []
    assert pack_best(empty, payload=F.crc32, payload_name="crc").columns == ["doc_id", "piece", "start", "length", "crc", "sequence_id", "offset"]
    with pytest.raises(ValueError):
        pack_best(empty, size=0)


def test_groups_are_dealt_by_hash(spark):
    numbers = spark.range(1000).select(F.lit(0).alias("part"), F.col("id").alias("row"), F.lit(3).cast("long").alias("s"))
    rows = bin_packing.placed_rows(numbers, 6, 100).collect()
    assert len(rows) == 1000 and len({r["sequence_id"] >> 32 for r in rows}) == 10
    assert len({r["sequence_id"] for r in rows}) <= 510
