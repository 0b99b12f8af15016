import random

import numpy as np
import pytest

from tidemark.operators import search as S
from tidemark.operators.index import KeywordIndex, VectorIndex


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("query_id", "id", "score", "rank").collect())


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)] + ["often"]
    texts = [(k, " ".join(rng.choices(words, [1] * 40 + [30], k=rng.choice([1, 5, 30, 200])))) for k in range(600)]
    texts += [(900, None), (901, ""), (902, "rare rare w1"), (903, texts[0][1]), (904, texts[0][1])]
    return spark.createDataFrame(texts, "doc text long string".replace("doc text long string", "doc long, body string")).repartition(3)


def test_keyword_index_gives_the_searchs_rows(spark, documents, tmp_path):
    index = KeywordIndex.write(documents, f"file://{tmp_path}/i", "doc", "body", tile=8)
    queries = spark.createDataFrame([(1, "w1 often"), (2, "rare w2 w2 the"), (3, "nowhere"), (4, "often"), (5, None), (6, "w3 w4 w5 w6 w7")], "query_id long, text string")
    for k in (1, 5, 1000):
        assert rows_of(index.search(queries, k)) == rows_of(S.keyword_search(queries, documents, k, "doc", "body"))
    again = KeywordIndex(spark, f"file://{tmp_path}/i", "bigint")  # opened anew
    assert rows_of(again.search(queries, 3)) == rows_of(S.keyword_search(queries, documents, 3, "doc", "body"))


def test_keyword_index_leaves_blocks_unread(spark, documents, tmp_path):
    index = KeywordIndex.write(documents, f"file://{tmp_path}/i", "doc", "body", tile=8)
    queries = spark.createDataFrame([(2, "rare w2"), (4, "often"), (6, "w3 w4")], "query_id long, text string")
    counts = {r.query_id: (r.blocks, r.read) for r in index.blocks_read(queries, 3).collect()}
    assert counts[2][1] < 0.2 * counts[2][0] and counts[6][1] < 0.8 * counts[6][0]
    assert counts[4][1] == counts[4][0]  # a term of most documents weighs next to nothing: all scores round to one
    everything = {r.query_id: (r.blocks, r.read) for r in index.blocks_read(queries, 10_000).collect()}
    assert all(read == blocks for blocks, read in everything.values())


def test_texts_are_made_into_terms_once(spark, documents, tmp_path):
    index = KeywordIndex.write(documents, f"file://{tmp_path}/i", "doc", "body")
    search = index.search(spark.createDataFrame([(1, "w1")], "query_id long, text string"), 3)
    assert {f.split("/i/")[1].split("/")[0] for f in search.inputFiles() if "/i/" in f} == {"blocks"}  # with two small tables of the search itself
    assert "body" not in search._jdf.queryExecution().optimizedPlan().toString()


def vectors(spark, n=700, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows = [(int(k), [float(x) for x in centres[k % 6] + rng.normal(size=12) * 0.15]) for k in range(n)]
    rows += [(n, rows[0][1]), (n + 1, [0.0] * 12), (n + 2, None), (n + 3, [1.0, 2.0]), (n + 4, [float("nan")] * 12)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)


def test_vector_index_gives_the_searchs_rows_and_leaves_blocks_unread(spark, tmp_path):
    corpus = vectors(spark)
    queries = corpus.where("id % 9 = 0").selectExpr("id AS query_id", "embedding")
    index = VectorIndex.write(corpus, f"file://{tmp_path}/v", pivots=8, block=16)
    for k, alone in ((1, False), (5, True), (30, False), (2000, False)):
        assert rows_of(index.search(queries, k, alone)) == rows_of(S.vector_search(queries, corpus, k, exclude_self=alone).where("id < 700 or id = 700"))
    every, read = index.blocks_read(queries, 5)
    assert read < 0.5 * every
    assert index.blocks_read(queries, 5000) == (every, every)
    assert "Exchange" not in S.nearest_in(index.vectors, [1], np.ones((1, 12)), 3, "bigint", "bigint")._jdf.queryExecution().executedPlan().toString()


def test_vector_search_by_brute_force_with_mixed_lengths(spark):
    corpus = vectors(spark, 120)
    rows = {r.id: r.embedding for r in corpus.collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows.items() if v and np.isfinite(v).all() and any(v)}
    queries = spark.createDataFrame([(1, rows[1]), (2, [3.0, 1.0]), (3, [1.0] * 5), (4, [0.0] * 12)], "query_id long, embedding array<double>")
    wanted = []
    for q, v in ((1, rows[1]), (2, [3.0, 1.0])):
        u = np.array(v) / np.linalg.norm(v)
        best = sorted((-round(float(u @ w), 6), i) for i, w in good.items() if len(w) == len(u))[:4]
        wanted += [(q, i, -s, n) for n, (s, i) in enumerate(best)]
    assert rows_of(S.vector_search(queries, corpus, 4)) == sorted(wanted)
    assert rows_of(S.vector_search(queries.limit(0), corpus, 4)) == []


def test_empty_indexes(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>, body string")
    index = VectorIndex.write(none, f"file://{tmp_path}/v")
    assert rows_of(index.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 3)) == []
    words = KeywordIndex.write(none, f"file://{tmp_path}/k", "id", "body")
    assert rows_of(words.search(spark.createDataFrame([(1, "w")], "query_id long, text string"), 3)) == []
