"""Near-duplicate documents: fast similarity sketches, banding, exact confirmation, components.

A sketch has `SIZE` coordinates. In round i every shingle of a document is thrown into one coordinate
and keeps there the smallest value; coordinates that stay empty after `SIZE` rounds are filled in one
round each, by all shingles. So every coordinate is filled, and two sketches agree in a coordinate
with the Jaccard similarity as probability. Runs of `ROWS` coordinates are the bands; documents that
share a band are candidates, and candidates are confirmed on their full shingle sets.

Documents with equal shingle sets are one node. Links are only sought between nodes that earlier links
have not yet joined: first each node with one hub, the heaviest node of the bands that it shares most of,
then once more with another, and at last pairs across components within a band: all of them in small
bands, in large ones by what each node differs from a pivot in, so that a pair is met only where the two
share enough of these differences. Links within a component change nothing, so a group of n near copies
costs about n comparisons, not n squared, and nothing that could be a link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, WordHashes, mix64, read_table, shingles, words_of

SIZE, ROWS = 128, 4
WORDS = 5
SIMILARITY = 75  # per cent
#: Rounds that offer every band a hub before the exact pass over what is left.
HUB_ROUNDS = 2
#: Nodes of a band up to which all its pairs across components are compared; larger bands go by a pivot. Results don't depend on it.
DIRECT = 8
#: 64-bit words of the marks that bound how many hashes two nodes share; results don't depend on it.
MARKS = 8
#: Nodes of a pivot that tell which hashes many of them share; only the order of comparison depends on it.
SAMPLE = 16
_SEEDS = mix64(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64((1 << 56) - 1)


def sketch(distinct: np.ndarray) -> np.ndarray:
    """Coordinates of a non-empty set of 64-bit hashes: the round in the high byte, the smallest value below it."""
    out = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    at_once, i = max(1, 4096 // len(distinct)), 0
    while i < SIZE and (out == np.iinfo(np.uint64).max).any():
        rounds = np.arange(i, min(SIZE, i + at_once))
        h = mix64(distinct[:, None] ^ _SEEDS[rounds][None, :])
        bins = (h & np.uint64(SIZE - 1)).astype(np.int64)
        values = (h >> np.uint64(8)) & _LOW | (rounds.astype(np.uint64) << np.uint64(56))[None, :]
        np.minimum.at(out, bins.ravel(), values.ravel())
        i += len(rounds)
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[b] = ((mix64(distinct ^ _SEEDS[SIZE + b]) >> np.uint64(8)) & _LOW).min() | np.uint64(SIZE + b) << np.uint64(56)
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    h = np.arange(1, SIZE // ROWS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix64(h ^ coordinates[k::ROWS])
    return h.view(np.int64)


def shingle_set(text: bytes | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    return np.unique(shingles(hashes.of(words_of(text)), words))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    low, high = min(len(a), len(b)), max(len(a), len(b))
    if low == 0 or 100 * low < percent * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, f1, f2, bands) of each row; the fingerprint of an empty set is null."""
    kind = docs.schema["id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                n, f1, f2, own = [], [], [], []
                for text in batch.column(1).to_pylist():
                    found = shingle_set(text, hashes, words)
                    n.append(len(found))
                    both = xxhash.xxh3_128_intdigest(found.tobytes()) if len(found) else None
                    f1.append(None if both is None else (both >> 64) - (1 << 63))
                    f2.append(None if both is None else (both & (1 << 64) - 1) - (1 << 63))
                    own.append(bands(sketch(found)) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(own, pa.list_(pa.int64()))],
                    names=["id", "n", "f1", "f2", "bands"],
                )

    return docs.mapInArrow(signed, f"id {kind}, n long, f1 long, f2 long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts' shingle sets are similar enough. texts: (node, text), any number a node."""
    kind = pairs.schema["u"].dataType.simpleString()

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, hub = WordHashes(), None, None
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                keep = []
                for text_u, text_v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if hub is None or text_v != last:
                        last, hub = text_v, shingle_set(text_v, hashes, words)
                    keep.append(similar(shingle_set(text_u, hashes, words), hub, percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["u", "v"])

    with_u = pairs.join(texts.withColumnsRenamed({"node": "u", "text": "text_u"}), "u")
    with_both = with_u.join(texts.withColumnsRenamed({"node": "v", "text": "text_v"}), "v")
    return with_both.select("u", "v", "text_u", "text_v").mapInArrow(confirmed, f"u {kind}, v {kind}")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node that each node of the undirected edges (u, v) reaches, as a table of `scratch`.

    Labels go to neighbours and then jump to their own labels, so a chain takes about the logarithm
    of its length in rounds. Each round is a written table; the one before goes.
    """
    both = scratch.write(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    table = scratch.write(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"), F.lit(True).alias("moved")), "labels")
    while not table.where("moved").isEmpty():
        labels = table.select("node", "label")
        around = both.join(labels.withColumnsRenamed({"node": "v", "label": "l"}), "v").groupBy("u").agg(F.min("l").alias("l"))
        lowered = labels.join(around, labels["node"] == around["u"]).select("node", "label", F.least("label", "l").alias("low"))
        jumped = labels.withColumnsRenamed({"node": "low", "label": "far"})
        following = lowered.join(jumped, "low").select("node", F.least("low", "far").alias("next"), "label")
        following = scratch.write(following.select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "labels")
        scratch.drop(table)
        table = following
    scratch.drop(both)
    return table


def merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """`labels` (node, label) after the links (u, v) join some of them; only the labels go through `components`."""
    if labels is None:
        return components(links, scratch)
    of = labels.select("node", "label")
    ends = links.join(of.withColumnsRenamed({"node": "u", "label": "a"}), "u", "left").join(of.withColumnsRenamed({"node": "v", "label": "b"}), "v", "left")
    ends = ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).where("u <> v").distinct()
    joined = components(ends, scratch)
    new = joined.select("node", F.col("node").alias("label")).join(of.select("node"), "node", "left_anti")
    over = joined.select(F.col("node").alias("label"), F.col("label").alias("low"))
    out = of.unionByName(new).join(over, "label", "left").select("node", F.coalesce("low", "label").alias("label"))
    out = scratch.write(out, "labels")
    scratch.drop(labels, joined)
    return out


def same_documents(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) between the nodes of ids that come with several texts; mostly none."""
    several = signed.groupBy("id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("id is not null and low < high").select("id")
    of_id = signed.join(several, "id").join(nodes, ["f1", "f2"]).select("id", "node").distinct()
    return of_id.join(of_id.groupBy("id").agg(F.min("node").alias("v")), "id").where("node <> v").select(F.col("node").alias("u"), "v")


class Linker:
    """Labels of nodes, as links come in. buckets: (band, node); texts: (node, text)."""

    def __init__(self, scratch: Scratch, buckets: DataFrame, texts: DataFrame, words: int, percent: int):
        self.scratch, self.texts, self.words, self.percent = scratch, texts, words, percent
        sizes = buckets.groupBy("band").agg(F.count("*").alias("size"))
        self.weights = scratch.write(buckets.join(sizes, "band").groupBy("node").agg(F.sum("size").alias("weight")), "weights")
        self.buckets = scratch.write(buckets.join(self.weights, "node"), "weighted")
        self.labels: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """`rows` with the label of their node, in place of one that they have."""
        rows = rows.drop("label")
        if self.labels is None:
            return rows.withColumn("label", F.col("node"))
        found = rows.join(self.labels.select("node", F.col("label").alias("found")), "node", "left")
        return found.withColumn("label", F.coalesce("found", "node")).drop("found")

    def take(self, links: DataFrame) -> None:
        new = self.scratch.write(links, "links")
        if not new.isEmpty():
            self.labels = merged(self.labels, new, self.scratch)
        self.scratch.drop(new)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        return confirm(pairs, self.texts, self.words, self.percent)

    def to_hubs(self, k: int) -> None:
        """Hold every node against one hub: of the hubs of its bands outside its component, that of most of them."""
        now = self.labelled(self.buckets)
        first = F.struct("weight", "node") if k == 0 else F.struct(F.xxhash64("node", F.lit(k)), "node")
        hubs = now.groupBy("band").agg(F.max_by(F.struct("node", "label"), first).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high"))
        across = now.join(hubs.where("low < high").select("band", "hub"), "band").where(F.col("label") != F.col("hub.label"))
        shared = across.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("n"))
        chosen = shared.groupBy(F.col("node").alias("u")).agg(F.max_by("hub", F.struct("n", "hub")).alias("v"))
        self.take(self.confirmed(chosen))

    def rest(self) -> None:
        """All links that are left: those across components within a band."""
        now = self.scratch.write(self.labelled(self.buckets), "labelled")
        totals = now.groupBy("label").agg(F.count("*").alias("total"))
        sizes = now.groupBy("band", "label").agg(F.count("*").alias("n")).join(totals, "label")
        main = sizes.groupBy("band").agg(F.max_by("label", F.struct("n", "total", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("nodes"))
        mixed = self.scratch.write(now.join(main.where("labels > 1"), "band"), "mixed")
        small = mixed.where(F.col("nodes") <= DIRECT)
        ends = [small.select("band", F.col("node").alias(e), F.col("label").alias(f"label_{e}")) for e in "uv"]
        self.take(self.confirmed(ends[0].join(ends[1], "band").where("u < v and label_u <> label_v").select("u", "v").distinct()))
        deltas = self.scratch.write(self.differences(mixed.where(F.col("nodes") > DIRECT)), "deltas")
        self.scratch.drop(now, mixed)
        if not deltas.isEmpty():
            slack = self.slack("n", "d")
            best = deltas.groupBy("pivot").agg(F.max_by("node", F.struct(slack, "node")).alias("best"), F.max(slack).alias("top"))
            self.take(deltas.join(best, "pivot").where((slack + F.col("top") >= 0) & (F.col("node") != F.col("best"))).select(F.col("node").alias("u"), F.col("best").alias("v")).distinct())
            self.take(self.across(deltas, best))
        self.scratch.drop(deltas)

    def slack(self, n: str, d: str) -> Column:
        """Two sets are similar where the slacks of both, plus what they share of their differences, come to 0 at least."""
        return (100 - self.percent) * F.col(n) - (100 + self.percent) * F.col(d)

    def differences(self, large: DataFrame) -> DataFrame:
        """(node, label, pivot, n, d, delta, marks): every node of `large` (node, main) against the pivots of its bands.

        The pivot of a band is the heaviest node of its main component; n is the size of the node's set,
        delta the d hashes, in order, that only one of node and pivot has; marks has a bit for each of
        them, by its low bits.
        """
        centres = self.labelled(self.weights).groupBy(F.col("label").alias("main")).agg(F.max_by("node", F.struct("weight", "node")).alias("pivot"))
        held = large.select("node", "main").distinct().join(centres, "main").select("node", "pivot")
        held = self.labelled(held.unionByName(held.select(F.col("pivot").alias("node"), "pivot")).distinct())
        kind = held.schema["node"].dataType.simpleString()
        words = self.words

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, last, pivot = WordHashes(), None, None
            for whole in batches:
                for low in range(0, whole.num_rows, 512):
                    batch = whole.slice(low, 512)
                    n, d, delta, marks = [], [], [], []
                    for text, pivot_text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                        if pivot is None or pivot_text != last:
                            last, pivot = pivot_text, shingle_set(pivot_text, hashes, words)
                        own = shingle_set(text, hashes, words)
                        delta.append(np.setxor1d(own, pivot, assume_unique=True).view(np.int64))
                        n.append(len(own))
                        d.append(len(delta[-1]))
                        bits = np.zeros(64 * MARKS, bool)
                        bits[delta[-1] & (64 * MARKS - 1)] = True
                        marks.append(np.packbits(bits, bitorder="little").view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k) for k in range(3)), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(delta, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                        names=["node", "label", "pivot", "n", "d", "delta", "marks"],
                    )

        joined = held.join(self.texts, "node").join(self.texts.withColumnsRenamed({"node": "pivot", "text": "pivot_text"}), "pivot")
        return joined.select("node", "label", "pivot", "text", "pivot_text").mapInArrow(compared, f"node {kind}, label {kind}, pivot {kind}, n long, d long, delta array<long>, marks array<long>")

    def across(self, deltas: DataFrame, best: DataFrame) -> DataFrame:
        """Links (u, v) across components between nodes that are held against one pivot.

        What two sets differ in is what their deltas differ in. So similar nodes share `need` hashes of
        their deltas or more, and in one order of all hashes the first of them is among the first
        d - need + 1 of either: only these prefixes are joined, with what many nodes share last in the order,
        and only where the places there and the marks leave room for `need`: a mark that one node alone has
        is a hash that they don't share.
        Pairs that have another pivot as the nearest of both are left to that one.
        """
        p = self.percent
        now = self.labelled(deltas)
        homes = deltas.groupBy("node").agg(F.max_by("pivot", F.struct(self.slack("n", "d"), "pivot")).alias("home"))
        main = self.labelled(best.select("pivot", F.col("best").alias("node"))).select("pivot", F.col("label").alias("main"))
        now = self.scratch.write(now.join(homes, "node").join(main, "pivot").repartition("pivot", "node"), "homed")  # a hot pivot's nodes lie apart
        least = now.where("label <> main").groupBy("pivot").agg(F.min("d").alias("least"))  # of the nodes outside the main component
        now = now.join(least, "pivot")  # pivots with one component have no pairs
        counts = now.groupBy("pivot").agg(F.count("*").alias("nodes"))
        sample = now.join(counts, "pivot").where(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("nodes") / SAMPLE))) == 0)
        popular = sample.select("pivot", F.explode("delta").alias("h")).groupBy("pivot", "h").agg(F.count("*").alias("c")).where("c > 1")
        popular = popular.groupBy("pivot").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("popular")).select("pivot", F.col("popular.h").alias("popular"))
        beyond = F.when(F.col("label") == F.col("main"), F.col("d") - F.col("least"))
        prefix = F.floor(F.least(beyond, (100 - p) * F.col("n") / p) / 2 + (100 - p) * F.col("n") / (2 * p) + 1e-6) + 1
        ordered = now.join(popular, "pivot", "left").withColumn("popular", F.coalesce("popular", F.array().cast("array<long>")))
        ordered = ordered.withColumn("prefix", prefix.cast("int")).where("prefix > 0")
        hashes = F.slice(F.concat(F.array_except("delta", "popular"), F.array_intersect("popular", "delta")), F.lit(1), F.col("prefix"))
        rows = self.scratch.write(ordered.select("pivot", "node", "label", "home", "n", "d", *(F.col("marks")[k].alias(f"m{k}") for k in range(MARKS)), F.posexplode(hashes).alias("at", "h")), "prefixes")
        u, v = (rows.withColumnsRenamed({c: f"{c}_{e}" for c in ("label", "home", "n", "d", "at", *(f"m{k}" for k in range(MARKS)))} | {"node": e}) for e in "uv")
        after = (F.col("d_u") > F.col("d_v")) | (F.col("d_u") == F.col("d_v")) & (F.col("u") > F.col("v"))
        own = (F.col("home_u") != F.col("home_v")) | (F.col("home_u") == F.col("pivot"))
        sizes = 100 * F.least("n_u", "n_v") >= p * F.greatest("n_u", "n_v")
        slack = self.slack("n_u", "d_u") + self.slack("n_v", "d_v")
        reach = 2 * (100 + p) * F.least(F.col("d_u") - F.col("at_u"), F.col("d_v") - F.col("at_v"))
        alone = lambda a, b: reduce(Column.__add__, (F.bit_count(F.col(f"m{k}_{a}").bitwiseAND(F.bitwise_not(f"m{k}_{b}"))) for k in range(MARKS)))
        room = 2 * (100 + p) * F.least(F.col("d_u") - alone("u", "v"), F.col("d_v") - alone("v", "u"))
        found = u.join(v, ["pivot", "h"]).where(F.col("label_u") != F.col("label_v")).where(after & own & sizes & (slack + reach >= 0) & (slack + room >= 0))
        pairs = self.scratch.write(found.select("pivot", "u", "v").distinct(), "pairs")
        ends = [now.select("pivot", F.col("node").alias(e), F.col("delta").alias(f"delta_{e}"), self.slack("n", "d").alias(f"slack_{e}")) for e in "uv"]
        both = pairs.join(ends[0], ["pivot", "u"]).join(ends[1], ["pivot", "v"])
        return both.where(F.col("slack_u") + F.col("slack_v") + 2 * (100 + p) * F.size(F.array_intersect("delta_u", "delta_v")) >= 0).select("u", "v").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    A-Z is lower-cased; words stand between white space; the set of a text is its distinct runs of
    `words` words, or the whole sequence where there are fewer. Texts without words (or null) are
    linked with nothing. Two documents are linked where 100 * intersection >= `percent` * union;
    `component_id` is the smallest id reachable and `kept` marks its row. Rows that repeat an id are
    the same document. Rows without an id are linked with nothing: no component, kept. Empty tables
    give empty results.

    A pair of the least similarity shares a band with probability 1 - 5e-6; what is linked is exact
    on sets of 64-bit shingle hashes. Full texts travel only for documents that share a band.
    """
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(_signed(asked, words), "signed")
    nodes = signed.where("f1 is not null and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("node"))
    nodes = scratch.write(nodes, "nodes")
    first = signed.select(F.col("id").alias("node"), "f1", "f2", "bands").join(nodes, ["f1", "f2", "node"])
    banded = first.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band")
    buckets = scratch.write(banded.join(shared, "band").select("band", "node").distinct(), "buckets")
    wanted = buckets.select("node").distinct()
    texts = scratch.write(asked.join(wanted, F.col("id") == F.col("node"), "left_semi").select(F.col("id").alias("node"), "text").distinct(), "texts")
    linker = Linker(scratch, buckets, texts, words, percent)
    linker.take(same_documents(signed, nodes))
    for k in range(HUB_ROUNDS):
        linker.to_hubs(k)
    linker.rest()
    scratch.drop_but(signed, nodes, linker.labels)
    if linker.labels is not None:
        nodes = nodes.join(linker.labels, "node", "left").select("f1", "f2", F.coalesce("label", "node").alias("node"))
    out = signed.drop("bands").join(nodes, ["f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("node", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def near_dedup_sql(table: str, words: int = WORDS, percent: int = SIMILARITY) -> str:
    """CTEs in DuckDB SQL (WITH RECURSIVE), ending in `near_components(doc_id, n_shingles, component_id)`; ids must be unique."""
    runs = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
    near_words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM {table}
    ), near_shingles AS (
        SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words} + 2), lambda i: {runs})
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM near_words)
    ), near_sizes AS (
        SELECT doc_id, count(*) AS n FROM near_shingles GROUP BY doc_id
    ), near_shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM near_shingles a JOIN near_shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), near_links AS (
        SELECT s.a, s.b FROM near_shared s JOIN near_sizes x ON x.doc_id = s.a JOIN near_sizes y ON y.doc_id = s.b
        WHERE 100 * s.n >= {percent} * (x.n + y.n - s.n)
    ), near_reach AS (
        SELECT doc_id, doc_id AS reached FROM {table}
        UNION
        SELECT r.doc_id, CASE WHEN l.a = r.reached THEN l.b ELSE l.a END FROM near_reach r JOIN near_links l ON r.reached IN (l.a, l.b)
    ), near_components AS (
        SELECT t.doc_id, coalesce(x.n, 0) AS n_shingles, t.component_id
        FROM (SELECT doc_id, min(reached) AS component_id FROM near_reach GROUP BY doc_id) t LEFT JOIN near_sizes x USING (doc_id)
    )"""


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES = {
    "op4_near_dedup": f"WITH RECURSIVE {near_dedup_sql('documents')} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near_components"
}
