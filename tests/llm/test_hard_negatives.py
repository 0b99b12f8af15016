import math

import numpy as np
import pytest
from oracle import rows_of, sql_rows
from pyspark.sql import functions as F

from tidemark.llm.hard_negatives import ORACLES, Best, PackedAnchors, hard_negatives, op13_hard_negatives

COLUMNS = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    usable = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, y, v in usable:
        if not is_anchor(a):
            continue
        best = lambda some: sorted({i: max(s for j, s in some if j == i) for i, _ in some}.items(), key=lambda x: (-x[1], x[0]))
        scored = [(i, z, sum(p * q for p, q in zip(v, w))) for i, z, w in usable if len(w) == len(v)]
        for p, ps in best([(i, s) for i, z, s in scored if z == y and i != a])[:positives]:
            for r, (i, s) in enumerate(best([(i, s) for i, z, s in scored if z != y and low * ps <= 100 * s <= high * ps])[:negatives], 1):
                out.append((a, p, r, i, ps, s))
    return sorted(out)


def got(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def frame_of(spark, rows, extra=False):
    return spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, label int, embedding array<double>, anchor int") if extra else spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def test_query_equals_sql(spark, data_dir):
    for d in (data_dir, "/root/testdata/sf0.01"):
        assert rows_of(op13_hard_negatives(spark, d)) == sql_rows(ORACLES["op13_hard_negatives"], d)


@pytest.mark.parametrize("most", [1, 3, 200, 5000, 1 << 20, 1 << 27])
@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 130), (7, 64, 70), (2, 0, 3)])
def test_packed_products_are_exact(most, shape):
    anchors, size, rows = shape
    rng = np.random.default_rng(most)
    for low, high in ((-most, most), (0, most), (-most, -most // 2 + 1)):
        a, b = rng.integers(low, high, (anchors, size), endpoint=True), rng.integers(low, high, (rows, size), endpoint=True)
        assert (PackedAnchors(a).scores(b) == a @ b.T).all()


def test_extreme_components_are_packed_without_loss():
    a, b = np.full((2, 64), -181), np.full((3, 64), 181)
    assert (PackedAnchors(a).scores(b) == -181 * 181 * 64).all()
    with pytest.raises(OverflowError):
        PackedAnchors(np.full((1, 64), 1 << 30)).scores(np.full((1, 64), 1 << 30))


def test_best_keeps_distinct_ids():
    best = Best(1, 2)
    for score, i in ((5, 1), (5, 1), (5, 1), (4, 2), (4, 0), (3, 9)):
        best.offer(np.zeros(1, np.int64), np.array([score]), np.array([i]))
        best.settle()
    assert list(zip(best.score.tolist(), best.id.tolist())) == [(5, 1), (4, 0)]


@pytest.mark.parametrize("block", [1 << 20, 40, 1])
def test_blocks_give_the_same_rows(spark, block):
    rng = np.random.default_rng(block)
    rows = [(int(k), int(rng.integers(0, 3)), [float(x) for x in rng.normal(0, 0.3, 8) + 0.1]) for k in range(-40, 160)]
    found = got(hard_negatives(frame_of(spark, rows).repartition(4), F.col("vec_id") % 20 == 0, block_components=block))
    assert found == brute(rows, lambda a: a % 20 == 0) and found


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one, two = [1.0, 0.5], [0.5, 0.25]
    rows = [
        (0, 1, one), (0, 1, one), (1, 1, one), (1, 1, one), (2, 1, two), (3, 2, two), (3, 2, two), (4, 2, [0.5, 0.0]), (5, None, one), (None, 1, one), (6, 2, None),
        (7, 2, [nan, 1.0]), (8, 2, [inf, 0.0]), (9, 2, [None, 0.3]), (10, 2, [0.5]), (11, 2, []), (12, 1, []), (20, 5, one), (3, 2, [0.6, 0.2]), (100, 2, [-inf, 1.0]), (200, 1, None),
    ]
    found = got(hard_negatives(frame_of(spark, rows, extra=True).repartition(3), F.col("vec_id") % 20 == 0))
    assert found == brute(rows, lambda a: a % 20 == 0) and found


def test_ties_copies_and_wide_values(spark):
    rows = [(k, k % 2, [0.4, -0.3, 0.2]) for k in range(60)] + [(k, k % 3, [30000.0 * (k % 7), -20000.0, 123.4]) for k in range(60, 120)]
    found = got(hard_negatives(frame_of(spark, rows), F.col("vec_id") % 30 == 0, high_percent=100))
    assert found == brute(rows, lambda a: a % 30 == 0, high=100) and found


def test_no_rows_and_no_anchors(spark):
    assert got(hard_negatives(frame_of(spark, []), F.col("vec_id") % 2 == 0)) == []
    some = hard_negatives(frame_of(spark, [(1, 1, [1.0]), (3, 2, [1.0])]), F.col("vec_id") % 2 == 0)
    assert got(some) == [] and tuple(some.columns) == COLUMNS
