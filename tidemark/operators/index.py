"""Stored indexes for search: postings with block bounds, and vectors by pivots with angle bounds.

Both are written once into a folder and read by many searches. A search first reads small tables of bounds,
takes the score of each query's k-th best row among its most promising blocks as a threshold, and then reads
only the blocks that can still reach it. Results are those of a search over everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import search as S
from tidemark.sources.folders import shared_folder

#: Documents that stand together in a block of each of their terms.
TILE = 256
#: Classes of term frequency, each with its greatest frequency and shortest document in a block: from these on.
CLASSES = (1, 2, 3, 5, 9, 17)
#: Rows of a block of vectors, pivots, and rows from which these are chosen.
VECTOR_BLOCK, PIVOTS, SAMPLE = 256, 64, 10_000
#: What rounding of angles and scores may add to a bound.
SLACK = 2e-6


class KeywordIndex:
    """Postings in blocks of one term and one tile of documents: `blocks` (term, tile, n, tops, postings), `stats` (n, known, total).

    A tile's documents stand together in one partition, so a task makes its blocks alone and no tokens are shuffled. A tile that
    comes in two batches has two blocks of a term; bounds add up, so they hold for these too.

    tops: for each class of term frequency that a block has, its greatest frequency and its shortest document; no weight
    in the block is above the greatest of these pairs', whatever the mean length. Blocks are sorted by term within files,
    so a search for few terms skips row groups; a term of many documents is spread over all files by its tiles.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str):
        self.spark, self.path = spark, path
        posting = f"array<struct<id:{id_type},tf:bigint,len:bigint>>"
        self.blocks = spark.read.schema(f"term string, tile long, postings {posting}").parquet(f"{path}/blocks")
        self.heads = spark.read.schema("term string, tile long, n long, tops array<struct<tf:bigint,len:bigint>>").parquet(f"{path}/blocks")  # columns of their own
        self.stats = spark.read.schema("n long, known long, total long").parquet(f"{path}/stats")

    @classmethod
    def write(cls, docs: DataFrame, path: str, id_col: str, text_col: str, tile: int = TILE) -> KeywordIndex:
        """The index of `docs`, whose ids are distinct, in a new folder. Texts are made into terms once; null texts count as documents, but not for the mean length."""
        spark = docs.sparkSession
        t = docs.select(F.col(id_col).alias("id"), T.terms(F.col(text_col)).alias("ts"), F.floor(F.monotonically_increasing_id() / tile).alias("tile"))
        t.select("id", "tile", F.when(F.col("ts").isNotNull(), F.size("ts")).cast("long").alias("len"), "ts").write.parquet(f"{path}/terms")
        t = spark.read.parquet(f"{path}/terms")
        t.agg(F.count("*").alias("n"), F.count("len").alias("known"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).write.parquet(f"{path}/stats")
        kind = docs.schema[id_col].dataType.simpleString()
        blocks = t.select("tile", "id", "len", "ts").mapInArrow(_blocks, f"term string, tile long, n long, tops array<struct<tf:bigint,len:bigint>>, postings array<struct<id:{kind},tf:bigint,len:bigint>>")
        blocks.sortWithinPartitions("term", "tile").write.parquet(f"{path}/blocks")
        return cls(spark, path, kind)

    def _wanted(self, queries: DataFrame) -> DataFrame:
        """(query_id, tile, term, idf, bound, n) for all blocks of the queries' terms."""
        asked = queries.select("query_id", F.explode(T.query_terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        words = S.small(asked.select("term").distinct())
        heads = self.heads.join(words, "term", "left_semi")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        stats = F.broadcast(self.stats.select(F.col("n").alias("docs"), F.try_divide("total", "known").alias("avg_len")))
        most = F.array_max(F.transform("tops", lambda t: _tf_part(t["tf"], t["len"], F.col("avg_len"))))
        own = heads.join(df, "term").crossJoin(stats).select("term", "tile", "n", "avg_len", S.idf(F.col("docs"), F.col("df")).alias("one"), most.alias("most"))
        both = S.small(asked).join(own, "term").withColumn("idf", F.col("one") * F.col("times"))
        return both.select("query_id", "tile", "term", "idf", "avg_len", "n", (F.col("idf") * F.col("most")).alias("bound"))

    def _scores(self, wanted: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score) of each query's k best documents in each of its wanted tiles; wanted: blocks (query_id, tile, term, idf, avg_len).

        Blocks of the wanted terms and tiles move once by tile, whatever the number of queries, and pairs of query and document not at all.
        """
        kind, query_kind = (f.schema[c].dataType.simpleString() for f, c in ((self.blocks.select("postings.id"), "id"), (wanted, "query_id")))
        kind = kind.removeprefix("array<").removesuffix(">")
        own = self.blocks.join(S.small(wanted.select("term").distinct()), "term", "left_semi").join(wanted.select("tile").distinct(), "tile", "left_semi")

        def scored(blocks: pa.Table, asked: pa.Table) -> pa.Table:
            best = _tile_best(blocks.combine_chunks(), asked.combine_chunks(), k)
            return pa.table({"query_id": pa.array([], asked.schema.field("query_id").type), "id": pa.array([], blocks.schema.field("postings").type.value_type.field("id").type), "score": pa.array([], pa.float64())}) if best is None else best

        return own.groupBy("tile").cogroup(wanted.groupBy("tile")).applyInArrow(scored, f"query_id {query_kind}, id {kind}, score double")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): what `keyword_search` gives over the indexed documents. queries: (query_id, text)."""
        first, rest = self._plan(queries, k)[1:]
        return S.top(first.unionByName(self._scores(rest, k)), k, F.desc("score"), F.asc("id"))

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """A small table of one search, written to the shared folder as it is read more than once."""
        path = shared_folder(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _plan(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Blocks read first, the best scores of their documents, and blocks read then because they can reach a query's k-th score. Blocks: (query_id, tile, term, idf, avg_len).

        First come the tiles of the greatest bounds that hold at least k documents of one of the query's terms together. All
        blocks of a tile are read or none, so scores are whole; a tile is left where its bounds add up to less than the
        k-th score of the first. That score is rounded as results are, so a tie is never left.
        """
        wanted = self._kept(self._wanted(queries), "wanted")
        tiles = wanted.groupBy("query_id", "tile").agg(F.sum("bound").alias("bound"), F.max("n").alias("n"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "tile")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        tiles = tiles.withColumn("first", before < k)
        keys = ["query_id", "tile"]
        blocks = ["query_id", "tile", "term", "idf", "avg_len"]
        seeds = wanted.join(tiles.where("first").select(*keys), keys).select(*blocks)
        first = self._kept(self._scores(seeds, k), "first")
        best = S.top(first, k, F.desc("score"), F.asc("id")).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
        reach = F.round(S.rank_score(-F.col("bound") * (1 + 1e-12)), 6) >= F.when(F.col("found") >= k, F.col("least")).otherwise(0.0)
        left = tiles.where("not first").join(best, "query_id", "left").where(F.coalesce(reach, F.lit(True))).select(*keys)
        return seeds, first, wanted.join(left, keys).select(*blocks)

    def blocks_read(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, blocks, read): blocks of each query's terms, and those of them that its search reads."""
        seeds, _, rest = self._plan(queries, k)
        read = seeds.unionByName(rest).groupBy("query_id").agg(F.count("*").alias("read"))
        return self._wanted(queries).groupBy("query_id").agg(F.count("*").alias("blocks")).join(read, "query_id", "left").select("query_id", "blocks", F.coalesce("read", F.lit(0)).alias("read"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (term, tile, n, tops, postings) of documents (tile, id, len, ts), some tiles at a time."""
    for whole in batches:
        tiles = whole.column("tile").to_numpy()
        starts = np.flatnonzero(np.diff(tiles, prepend=-1))[::16].tolist() + [len(tiles)]
        for low, high in zip(starts[:-1], starts[1:]):
            batch = whole.slice(low, high - low)
            size = pa.compute.list_value_length(batch.column("ts")).fill_null(0).to_numpy()
            words = batch.column("ts").flatten().dictionary_encode()
            if not len(words):
                continue
            every, place = np.unique(tiles[low:high], return_inverse=True)
            doc, rows, n = np.repeat(np.arange(high - low), size), high - low, len(words.dictionary)
            key, tf = np.unique((place[doc] * n + words.indices.to_numpy()) * rows + doc, return_counts=True)
            block, doc = key // rows, key % rows
            begin = np.flatnonzero(np.diff(block, prepend=-1))
            ends, length = np.append(begin, len(block)), batch.column("len").fill_null(0).to_numpy()[doc]
            posting = pa.StructArray.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(tf), pa.array(length)], names=["id", "tf", "len"])
            # the greatest frequency and the shortest document of each class that a block has
            group = np.repeat(np.arange(len(begin)), np.diff(ends)) * len(CLASSES) + np.searchsorted(CLASSES, tf, "right") - 1
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            top = pa.StructArray.from_arrays([pa.array(np.maximum.reduceat(tf[order], first)), pa.array(np.minimum.reduceat(length[order], first))], names=["tf", "len"])
            top_ends = np.searchsorted(group[order][first] // len(CLASSES), np.arange(len(begin) + 1))
            columns = [words.dictionary.take(pa.array(block[begin] % n)), pa.array(every[block[begin] // n]), pa.array(np.diff(ends))]
            lists = [pa.ListArray.from_arrays(pa.array(x, pa.int32()), y) for x, y in ((top_ends, top), (ends, posting))]
            yield pa.RecordBatch.from_arrays(columns + lists, names=["term", "tile", "n", "tops", "postings"])


def _tile_best(blocks: pa.Table, asked: pa.Table, k: int) -> pa.Table | None:
    """(query_id, id, score): the k best documents of a tile's blocks (term, postings) for each query of `asked` (query_id, term, idf, avg_len)."""
    if not blocks.num_rows or not asked.num_rows:
        return None
    column = lambda t, c: pa.concat_arrays(t.column(c).chunks)
    words, lists = column(blocks, "term").dictionary_encode(), column(blocks, "postings")
    code, posting = np.repeat(words.indices.to_numpy(), lists.value_lengths().to_numpy()), lists.flatten()
    tf, length = posting.field("tf").to_numpy(), posting.field("len").to_numpy()
    ids = posting.field("id").dictionary_encode()
    names = column(asked, "query_id").dictionary_encode("encode")
    term = pa.compute.index_in(column(asked, "term"), value_set=words.dictionary)
    there = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
    if not len(there):
        return None
    query, term = names.indices.to_numpy()[there], term.fill_null(0).to_numpy()[there]
    each, first = np.unique(query.astype(np.int64) * len(words.dictionary) + term, return_index=True)
    idf, avg_len = asked.column("idf").to_numpy()[there][first], asked.column("avg_len")[0].as_py()
    best, step = S.Best(len(names.dictionary), k), max(1, S.SCORES // len(names.dictionary))
    weight = tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * length / avg_len))
    doc = ids.indices.to_numpy()
    for low in range(0, len(ids.dictionary), step):
        own = (doc >= low) & (doc < low + step)
        raw = np.zeros((len(names.dictionary), min(step, len(ids.dictionary) - low)))
        S.add_weights(raw, code[own], doc[own] - low, weight[own], each // len(words.dictionary), each % len(words.dictionary), idf)
        best.add_raw(raw, ids.dictionary.slice(low, step))
    if best.ids is None:
        return None
    return pa.table({"query_id": names.dictionary.take(pa.array(best.query)), "id": best.ids, "score": pa.array(best.score)})


def _tf_part(tf: Column, length: Column, avg_len: Column) -> Column:
    return tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * length / avg_len))


class VectorIndex:
    """Vectors of one length by their nearest pivot: `vectors` (cell, block, id, v), `blocks` (block, cell, n, low, high) with the range of angles to the pivot.

    Pivots are rows of a bounded sample. For a query at angle a from a pivot, no row of a block is nearer than
    max(0, low - a, a - high): the triangle inequality of angles, so what a search leaves unread can't be among its results.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str):
        self.spark, self.path, self.id_type = spark, path, id_type
        self.vectors = spark.read.schema(f"block long, id {id_type}, v array<double>").parquet(f"{path}/vectors")
        self.blocks = spark.read.schema("block long, cell int, n long, low double, high double").parquet(f"{path}/blocks")
        rows = spark.read.schema("cell int, v array<double>").parquet(f"{path}/pivots").orderBy("cell").collect()  # PIVOTS at most
        self.pivots = np.array([r.v for r in rows]).reshape(len(rows), len(rows[0].v) if rows else 0)

    @classmethod
    def write(cls, corpus: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = VECTOR_BLOCK) -> VectorIndex:
        """The index of `corpus` in a new folder. Unusable vectors, and those of another length than the first sampled one, are left out."""
        spark = corpus.sparkSession
        rows = corpus.where(S.usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        sample = [np.array(r.v) for r in rows.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()]
        sample = np.array([v / np.linalg.norm(v) for v in sample if len(v) == len(sample[0])]) if sample else np.zeros((0, 0))
        chosen = farthest(sample, pivots)
        spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(chosen)], "cell int, v array<double>").coalesce(1).write.parquet(f"{path}/pivots")
        kind, size = rows.schema["id"].dataType.simpleString(), chosen.shape[1]
        shared = spark.sparkContext.broadcast(chosen)

        def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(shared.value):
                    continue
                v = unit_rows(batch.column(1))
                cos = v @ shared.value.T
                cell = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(v)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle), batch.column(0), batch.column(1)], names=["cell", "angle", "id", "v"])

        placed = rows.where(F.size("v") == size).mapInArrow(celled, f"cell int, angle double, id {kind}, v array<double>")
        # rows of a cell by angle, in blocks: a cell's rows may spread over files, and each file numbers its own
        ordered = placed.repartitionByRange(F.col("cell"), F.col("angle")).sortWithinPartitions("cell", "angle")
        row = F.monotonically_increasing_id()
        ordered.select("cell", "angle", "id", "v", row.alias("row")).write.parquet(f"{path}/ordered")
        ordered = spark.read.parquet(f"{path}/ordered")
        number = F.floor(F.col("row") / block) * len(chosen) + F.col("cell") if len(chosen) else F.lit(0).cast("long")
        ordered = ordered.withColumn("block", number)
        ordered.select("block", "id", "v").write.parquet(f"{path}/vectors")
        ordered.groupBy("block", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).write.parquet(f"{path}/blocks")
        return cls(spark, path, kind)

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """(query_id, id, score, rank): what `vector_search` gives over the indexed rows. Queries go out in blocks of bounded size; rows are never shuffled."""
        return S.top(self._found(queries, k + exclude_self, exclude_self)[0], k, F.desc("score"), F.asc("id"))

    def blocks_read(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """(block reads that a search over everything makes for all queries, those that this index makes)."""
        return self._found(queries, k, False)[1]

    def _found(self, queries: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, tuple[int, int]]:
        kind = queries.schema["query_id"].dataType.simpleString()
        out, every, read = None, 0, 0
        for ids, matrix in S.query_blocks(queries):
            if matrix.shape[1] != self.pivots.shape[1]:
                continue
            bounds = self._bounds(matrix)
            first = self._first(bounds, k)
            seeds = S.nearest_in(self._rows(first), ids, matrix, k, kind, self.id_type, first)
            least = np.full(len(ids), -np.inf)
            place = {q: n for n, q in enumerate(ids)}
            kth = S.top(seeds, k, F.desc("score"), F.asc("id")).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
            for r in kth.collect():  # a row a query of the block
                least[place[r.query_id]] = r.least
            rest = {b: np.setdiff1d(np.flatnonzero(bound + SLACK >= least), first.get(b, ())) for b, (_, bound) in bounds.items()}
            rest = {b: q for b, q in rest.items() if len(q)}
            found = seeds.unionByName(S.nearest_in(self._rows(rest), ids, matrix, k, kind, self.id_type, rest))
            every += len(bounds) * len(ids)
            read += sum(map(len, first.values())) + sum(map(len, rest.values()))
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.spark.createDataFrame([], f"query_id {kind}, id {self.id_type}, score double")
        if exclude_self:
            out = out.where(~F.col("query_id").eqNullSafe(F.col("id")))
        return out, (every, read)

    def _rows(self, wanted: dict[int, np.ndarray]) -> DataFrame:
        """The rows of some blocks; their numbers reach the scan as a filter."""
        return self.vectors.where(F.col("block").isin(sorted(wanted))) if wanted else self.vectors.limit(0)

    def _bounds(self, matrix: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
        """For each block its rows and the greatest cosine that it can have for each query. Blocks are small rows of a table, read one partition at a time."""
        angle = np.arccos(np.clip(matrix @ self.pivots.T, -1, 1))
        out = {}
        for r in self.blocks.toLocalIterator():
            a = angle[:, r.cell]
            out[r.block] = r.n, np.cos(np.maximum(0, np.maximum(r.low - a, a - r.high)))
        return out

    @staticmethod
    def _first(bounds: dict[int, tuple[int, np.ndarray]], k: int) -> dict[int, np.ndarray]:
        """For each query the blocks of the greatest bounds that hold k rows together, by block."""
        if not bounds:
            return {}
        numbers, sizes = list(bounds), np.array([n for n, _ in bounds.values()])
        table = np.stack([b for _, b in bounds.values()])
        order = np.argsort(-table, axis=0, kind="stable")
        before = np.cumsum(sizes[order], axis=0) - sizes[order]
        out: dict[int, list[int]] = {}
        for rank, query in zip(*np.nonzero(before < k)):
            out.setdefault(numbers[order[rank, query]], []).append(query)
        return {b: np.array(q) for b, q in out.items()}


def farthest(rows: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows, each as far from those before as any."""
    if not len(rows):
        return rows
    chosen, nearest = [0], rows @ rows[0]
    while len(chosen) < min(most, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
        if math.isclose(nearest.min(), 1.0, abs_tol=1e-9):
            break
    return rows[chosen]


def unit_rows(vectors: pa.Array) -> np.ndarray:
    v = vectors.flatten().to_numpy().reshape(len(vectors), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)
