"""Hard-negative mining with Kronecker-packed products.

Vectors have integer components. The components of several candidates, made non-negative by a bias, stand
in separate fields of one wide integer; one multiplication with an anchor's component then multiplies all of
them, and the sum over components holds an exact score in each field. Fields are as wide as the block's
components ask for. Where two or more fit into the 53 bits that a double carries exactly, the wide integers
are doubles and the sums a matrix product; else they are Python's integers, of any width.

Anchors are a stated query set. They go out in blocks of bounded size, each two narrow passes over all rows,
which are never shuffled: the first keeps the best positives a task, the second, which knows each positive's
bounds, the best negatives a task. Only these meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read_table

#: Components of all anchors that go out at once.
BLOCK_COMPONENTS = 1 << 20
#: Anchors and rows that are multiplied at once, and candidates in one of Python's integers.
ANCHORS_AT_ONCE, ROWS_AT_ONCE, WIDE = 256, 8192, 64
_NONE = np.iinfo(np.int64).min


class PackedAnchors:
    """Anchors of one length, ready to be multiplied with packed candidates."""

    def __init__(self, vectors: np.ndarray):
        self.n, self.size = vectors.shape
        self.bias = -int(vectors.min(initial=0))
        self.biased = vectors + self.bias
        self.most = int(self.biased.max(initial=0))
        self.sums = self.biased.sum(1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The inner product of each anchor with each row, exactly."""
        bias = -int(rows.min(initial=0))
        biased = rows + bias
        most = int(biased.max(initial=0))
        bits = max(1, (self.size * self.most * most).bit_length())
        if (self.size * max(self.most, self.bias) * max(most, bias)).bit_length() > 62:
            raise OverflowError("scores beyond 64 bits")
        products = self._doubles(biased, bits) if 2 * bits <= 53 else self._wide(biased, bits)
        return products - bias * self.sums[:, None] - self.bias * biased.sum(1)[None, :] + self.size * self.bias * bias

    def _doubles(self, biased: np.ndarray, bits: int) -> np.ndarray:
        fields, n = 53 // bits, len(biased)
        packed = np.zeros(((n + fields - 1) // fields, self.size))
        for k in range(fields):
            own = biased[k::fields]
            packed[: len(own)] += own * float(1 << bits * k)
        sums = (self.biased.astype(np.float64) @ packed.T).astype(np.int64)
        out = np.empty((self.n, n), np.int64)
        for k in range(fields):
            own = out[:, k::fields]
            own[:] = (sums[:, : own.shape[1]] >> bits * k) & ((1 << bits) - 1)
        return out

    def _wide(self, biased: np.ndarray, bits: int) -> np.ndarray:
        width = (bits + 7) // 8
        out = np.zeros((self.n, len(biased)), np.int64)
        anchors = self.biased.tolist()
        for low in range(0, len(biased), WIDE):
            own = biased[low : low + WIDE]
            fields = np.ascontiguousarray(own.T, "<i8").view(np.uint8).reshape(self.size, len(own), 8)[:, :, :width]
            packed = [int.from_bytes(f.tobytes(), "little") for f in fields]
            for a, components in enumerate(anchors):
                total = sum(x * p for x, p in zip(components, packed))
                held = np.zeros((len(own), 8), np.uint8)
                held[:, :width] = np.frombuffer(total.to_bytes(width * len(own), "little"), np.uint8).reshape(len(own), width)
                out[a, low : low + len(own)] = held.view("<i8")[:, 0]
        return out


class Best:
    """The best `k` candidates of each slot so far: higher scores, then smaller ids; an id counts once a slot."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.least = np.full(slots, _NONE + 1)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(slot):
            self.new.append((slot, score, ids))

    def settle(self) -> None:
        if not self.new:
            return
        slot, score, ids = (np.concatenate([own, *more]) for own, more in zip((self.slot, self.score, self.id), zip(*self.new)))
        self.new = []
        order = np.lexsort((-score, ids, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.ones(len(slot), bool)
        first[1:] = (slot[1:] != slot[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[first], score[first], ids[first]
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        begins = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        self.least[slot[rank == self.k - 1]] = score[rank == self.k - 1]
        kept = rank < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]


class Block:
    """Some of the anchors: ids, labels and vectors, and by part of one length the anchors' numbers."""

    def __init__(self, ids: list, labels: list, vectors: list[np.ndarray]):
        self.ids, self.labels = ids, np.array(labels, np.int64)
        by_size: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(k)
        self.parts: list[tuple[np.ndarray, PackedAnchors]] = []
        for size, numbers in by_size.items():
            numbers.sort(key=lambda k: labels[k])
            for low in range(0, len(numbers), ANCHORS_AT_ONCE):
                some = np.array(numbers[low : low + ANCHORS_AT_ONCE])
                self.parts.append((some, PackedAnchors(np.array([vectors[k] for k in some], np.int64).reshape(len(some), size))))


def scaled(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with finite components only, their lengths, all components times `scale` rounded down) of a batch."""
    values, ends = vectors.flatten(), np.cumsum(np.nan_to_num(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    begins = np.concatenate([[0], ends])[:-1]
    rows = np.flatnonzero((bad[ends] == bad[begins]) & ~vectors.is_null().to_numpy(zero_copy_only=False))
    sizes = (ends - begins)[rows]
    x = x[np.repeat(begins[rows], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    if len(x) and np.abs(x).max() >= 2.0**31:
        raise OverflowError("components beyond 32 bits")
    return rows, sizes, x.astype(np.int64)


def candidates(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of rows of one length, in blocks that double in size."""
    most = 128
    for batch in batches:
        rows, sizes, x = scaled(batch.column(2), scale)
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False)[rows].astype(np.int64) for k in (0, 1))
        begins = np.cumsum(sizes) - sizes
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            while len(own):
                some, own = own[:most], own[most:]
                most = min(2 * most, ROWS_AT_ONCE)
                yield ids[some], labels[some], x[begins[some][:, None] + np.arange(size)[None, :]]


def positives_of(rows: DataFrame, block: Block, k: int, scale: int) -> DataFrame:
    """(anchor, id, score): a task's best `k` rows of the same label for each anchor, by its number."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        own_ids = np.array(anchors.ids, np.int64)
        found = [Best(len(numbers), k) for numbers, _ in anchors.parts]
        for ids, labels, vectors in candidates(batches, scale):
            for (numbers, packed), kept in zip(anchors.parts, found):
                known = anchors.labels[numbers]
                some = np.flatnonzero(np.isin(labels, known)) if packed.size == vectors.shape[1] else ()
                if not len(some):
                    continue
                scores = packed.scores(vectors[some])
                fits = (scores >= kept.least[:, None]) & (known[:, None] == labels[some][None, :]) & (own_ids[numbers][:, None] != ids[some][None, :])
                a, c = np.nonzero(fits)
                kept.offer(a, scores[a, c], ids[some][c])
                kept.settle()
        for (numbers, _), kept in zip(anchors.parts, found):
            yield pa.RecordBatch.from_arrays([pa.array(numbers[kept.slot]), pa.array(kept.id), pa.array(kept.score)], names=["anchor", "id", "score"])

    return rows.mapInArrow(best, "anchor long, id long, score long")


def negatives_of(rows: DataFrame, block: Block, bounds: np.ndarray, k: int, scale: int) -> DataFrame:
    """(anchor, slot, id, score): a task's best `k` rows of another label for each anchor and slot with bounds[anchor, slot] = (low, high)."""
    shared = rows.sparkSession.sparkContext.broadcast((block, bounds))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, within = shared.value
        slots = within.shape[1]
        found = [Best(len(numbers) * slots, k) for numbers, _ in anchors.parts]
        for ids, labels, vectors in candidates(batches, scale):
            for (numbers, packed), kept in zip(anchors.parts, found):
                if packed.size != vectors.shape[1]:
                    continue
                scores = packed.scores(vectors)
                scores[anchors.labels[numbers][:, None] == labels[None, :]] = _NONE
                least = kept.least.reshape(len(numbers), slots)
                for s in range(slots):
                    low, high = np.maximum(within[numbers, s, 0], least[:, s]), within[numbers, s, 1]
                    if (low > high).all():
                        continue
                    a, c = np.nonzero((scores >= low[:, None]) & (scores <= high[:, None]))
                    kept.offer(a * slots + s, scores[a, c], ids[c])
                kept.settle()
        for (numbers, _), kept in zip(anchors.parts, found):
            a, s = np.divmod(kept.slot, slots)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[a]), pa.array(s), pa.array(kept.id), pa.array(kept.score)], names=["anchor", "slot", "id", "score"])

    return rows.mapInArrow(best, "anchor long, slot long, id long, score long")


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best `k` of all tasks for each of `keys`, with their rank from 1."""
    once = found.repartition(*keys).groupBy(*keys, "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks_of(anchors: DataFrame, scale: int, block_components: int) -> Iterator[Block]:
    """Blocks of `block_components` components at most (one anchor at least); the driver holds one partition and one block at a time."""
    ids, labels, vectors, held = [], [], [], 0
    for row in anchors.toLocalIterator():
        rows, _, x = scaled(pa.array([row["vector"]], pa.list_(pa.float64())), scale)
        if not len(rows):
            continue
        if ids and held + len(x) > block_components:
            yield Block(ids, labels, vectors)
            ids, labels, vectors, held = [], [], [], 0
        ids.append(row["id"])
        labels.append(row["label"])
        vectors.append(x)
        held += max(1, len(x))
    if ids:
        yield Block(ids, labels, vectors)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block_components: int = BLOCK_COMPONENTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Components are floor(scale * x). The rows for which `is_anchor` (a condition on the columns of `rows`)
    holds are anchors. An anchor's positives are its first `positives` other rows of its label by inner product,
    ties by smaller id; a positive's negatives its first `negatives` rows of other labels whose score lies
    within `low_percent` and `high_percent` of the positive's. Scores are exact; one that does not fit into
    64 bits, or a component beyond 32, ends the query with an error.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of
    different lengths have no score. Exact repeats of a row count once; an id that stands for several vectors
    counts once a positive, with its best score. An anchor with no positive, or a positive with no negative,
    has no row; an empty table has none. Anchors go out in blocks of `block_components` components, each two
    passes over the rows, written before the next block is made, so what a task and the driver hold doesn't
    grow with the table.
    """
    scratch = Scratch(rows.sparkSession)
    usable = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    name = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    every = name(usable)
    anchors = scratch.write(name(usable.where(is_anchor)).distinct(), "anchors")
    out = None
    for block in blocks_of(anchors, scale, block_components):
        if out is not None:
            out = scratch.write(out, "negatives")
        more = negatives_of_block(every, block, positives, negatives, low_percent, high_percent, scale)
        out = more if out is None else out.unionByName(more)
    scratch.drop(anchors)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def negatives_of_block(rows: DataFrame, block: Block, positives: int, negatives: int, low_percent: int, high_percent: int, scale: int) -> DataFrame:
    bounds = np.zeros((len(block.ids), positives, 2), np.int64)
    bounds[:, :, 0] = 1  # above 0: nothing lies within
    known = []
    for r in first_of(positives_of(rows, block, positives, scale), ["anchor"], positives).collect():  # `positives` an anchor at most
        slot, score = r["rank"] - 1, r["score"]
        bounds[r["anchor"], slot] = -(-low_percent * score // 100), high_percent * score // 100
        known.append((r["anchor"], slot, block.ids[r["anchor"]], r["id"], score))
    table = pa.table([pa.array(c, pa.int64()) for c in (zip(*known) if known else [[]] * 5)], names=["anchor", "slot", "anchor_id", "positive_id", "positive_score"])
    spark = rows.sparkSession
    best = first_of(negatives_of(rows, block, bounds, negatives, scale), ["anchor", "slot"], negatives)
    return best.join(F.broadcast(spark.createDataFrame(table)), ["anchor", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}

ORACLES = {
    "op13_hard_negatives": """
WITH r AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS a, a.label = b.label AS same, b.vec_id AS b, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.p AS positive_id,
    CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
    s.b AS negative_id, p.ps AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.ps <= 100 * s.score AND 100 * s.score <= 90 * p.ps
QUALIFY rank <= 10
""",
}
