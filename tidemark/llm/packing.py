"""Packing: mixture-controlled sequences by deficit round-robin over source queues.

Every source is a queue of documents. In each round a queue earns its quantum, its target part of a
window's tokens, and serves from its head as long as what it has earned covers it: whole documents, or
`turn` tokens of one at a time, so that a long document leaves room for other sources in a window. What is
left is a queue's deficit, which it carries on over rounds, windows and partitions. So with x tokens before
it in its queue, a run of n tokens is served in round ceil((x + n) / quantum). Rounds follow each other,
queues have a fixed order within one, and the stream is cut where windows end. A run's place in the stream
is the sum of all rounds before, which partitions find without waiting for each other.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read_table, tokenizer_path
from tidemark.llm.token_counts import byte_symbols

_QUEUED = "id {id}, queue string, part int, row long, at long, n long, ids binary"
_PIECE = "id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Tokens of one document that a round serves at once, in the query: a sixteenth of a window.
TURN = 128
#: Rounds that one task sums up.
ROUNDS_AT_ONCE = 4096

#: Signs after a word, one pretoken together.
_SIGNS = b",.;:!?#*$%&|<>"
_LATIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


class _ChunkIds(dict):
    """Packed identifiers of lower-cased chunks between ASCII white space, which no pretoken crosses, made when one is first asked for.

    A chunk of plain Latin letters, signs after them or not, is one pretoken and one for the signs: its
    letters go straight to the merges, as the bytes' stand-ins. Every other chunk is encoded as a whole.
    At `bound` chunks, or 32 bytes for each, the chunks at hand become the old ones, from which those that
    are met again come back, and the old ones before go; so memory stays bounded and what is frequent stays.
    """

    def __init__(self, tokenizer, kind: np.dtype, bound: int = 400_000):
        super().__init__()
        self.tokenizer, self.code, self.bound, self.size = tokenizer, "H" if kind.itemsize == 2 else "I", bound, 0
        self.old: dict[bytes, bytes] = {}
        self.tokenize = tokenizer.model.tokenize
        self.shown = {b: c for c, b in byte_symbols().items()}
        self.direct = self._as_whole("\u00c9T\u00c9") == self._letters("\u00c9T\u00c9") and self._as_whole("it") == self._letters("it")

    def _as_whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        shown = word.lower() if word.isascii() else word.lower().encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def _made(self, chunk: bytes) -> bytes:
        word = chunk.rstrip(_SIGNS)
        if self.direct and (word.isalpha() if word.isascii() else _LATIN(word.decode())):
            if len(word) == len(chunk):
                return self._letters(word.decode())
            end = chunk[len(word) :]
            if end not in self:
                self[end] = self._as_whole(end.decode())
            return self[word] + self[end]
        return self._as_whole(chunk.decode())

    def __missing__(self, chunk: bytes) -> bytes:
        made = self.old.get(chunk)
        if made is None:
            made = self._made(chunk)
        if len(self) >= self.bound or self.size > 32 * self.bound:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += len(chunk)
        self[chunk] = made
        return made

    def lowered(self, text: bytes | None) -> list[bytes]:
        """Chunks of a text; lower-cased, which the tokenizer does anyway, unless that could make a special string."""
        if not text:
            return []
        return (text if b"<|" in text else text.lower()).split()

    def of(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, self.lowered(text)))


_KNOWN: dict[str, tuple[_ChunkIds, np.dtype]] = {}


def known_chunks(tokenizer: str | None) -> tuple[_ChunkIds, np.dtype]:
    """The chunks that this worker process knows; tasks of a process share them. The file is looked up where the task runs."""
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    if tokenizer not in _KNOWN:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer)
        width = np.dtype("<u2" if library.get_vocab_size() <= 1 << 16 else "<u4")
        _KNOWN[tokenizer] = _ChunkIds(library, width), width
    return _KNOWN[tokenizer]


def queue_tokens(docs: DataFrame, tokenizer: str | None, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, queue, part, row, at, n, ids): identifiers of each row, its number in its task, and where they start in its queue there."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = known_chunks(tokenizer)
        end, ends = np.array([end_id], width).tobytes(), {}
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                ids = [known.of(text) + end for text in some.column(1).to_pylist()]
                n = [len(x) // width.itemsize for x in ids]
                queues, at = some.column(2).to_pylist(), []
                for q, more in zip(queues, n):
                    at.append(ends.get(q, 0))
                    ends[q] = at[-1] + more
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), some.column(2), pa.array([part] * len(n), pa.int32()), pa.array(range(row, row + len(n)), pa.int64()),
                        pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["id", "queue", "part", "row", "at", "n", "ids"],
                )
                row += len(n)

    queue = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), queue.alias("queue"))
    return asked.mapInArrow(encoded, _QUEUED.format(id=kind))


def quanta(totals: DataFrame, size: int, shares: dict[str, float] | None, temper: float) -> DataFrame:
    """(queue, quantum) from (queue, total): tokens that each queue earns a round, `size` over all queues."""
    if any(s <= 0 for s in (shares or {}).values()):
        raise ValueError("shares must be above 0")
    spark = totals.sparkSession
    whole = totals.agg(F.sum("total")).first()[0] or 1
    wanted = spark.createDataFrame([(f"s{k}", float(v)) for k, v in (shares or {}).items()], "queue string, share double")
    weighed = totals.join(wanted, "queue", "left").select("queue", F.coalesce("share", F.pow(F.col("total") / whole, F.lit(temper))).alias("weight"))
    every = weighed.agg(F.sum("weight")).first()[0] or 1.0
    return weighed.select("queue", (F.col("weight") * (size / every)).alias("quantum"))


def begins_of(rounds: DataFrame) -> DataFrame:
    """(round, begin) from (round, n): tokens of all rounds before, summed within buckets of rounds and over buckets."""
    bucket = F.floor(F.col("round") / ROUNDS_AT_ONCE).alias("bucket")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("bucket").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0).cast("long"))
    buckets = rounds.groupBy(bucket).agg(F.sum("n").alias("n")).select("bucket", sum_of("n", earlier).alias("before"))
    return rounds.withColumn("bucket", bucket).join(buckets, "bucket").select("round", (F.col("before") + sum_of("n", within)).alias("begin"))


def pack(
    docs: DataFrame,
    size: int = 2048,
    shares: dict[str, float] | None = None,
    temper: float = 1.0,
    turn: int | None = None,
    tokenizer: str | None = None,
    end_id: int = 1,
    payload: Callable[[Column], Column] = lambda ids: ids,
    payload_name: str = "ids",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of all rows in windows of `size` tokens: id, start, length, doc_tokens, sequence_id, offset and a payload.

    Each row's identifiers are those of its text by `tokenizer`, then `end_id` (null or empty text:
    `end_id` alone); each lies in one piece. A source's weight is its part in `shares`, or else its own
    part of all tokens to the power of `temper` (below 1 small sources come more often); its quantum is
    `size` times its part of all weights. While all queues last, what a queue has been served stays
    within its quantum and one document (with `turn`, that many tokens) of what it has earned. A queue that runs dry leaves its part to
    the others, so only the last window is short. `payload` is a Column function of a piece's identifiers
    (little-endian unsigned 32-bit). A null source is a queue of its own; there may be any number of
    sources. Repeated rows and null ids are packed as they come. No rows: no pieces. The order in a queue
    is that of partitions and rows. Numbers alone are sorted, a round of them at a time; identifiers are
    shuffled once, to meet their place.
    """
    if turn is not None and turn < 1:
        raise ValueError("turn must be above 0")
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    queued = scratch.write(queue_tokens(docs, tokenizer, end_id, id_col, text_col, source_col), "queued")
    numbers = queued.select("queue", "part", "row", F.lit(0).cast("long").alias("start"), "at", "n")
    sum_before = lambda over: F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    by_part = numbers.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    begins = scratch.write(by_part.select("queue", "part", "n", sum_before(Window.partitionBy("queue").orderBy("part")).alias("begin")), "begins")
    quantum = quanta(begins.groupBy("queue").agg(F.sum("n").alias("total")), size, shares, temper)
    runs = numbers
    if turn is not None:
        runs = numbers.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(turn).cast("long"))))
        runs = runs.withColumns({"at": F.col("at") + F.col("start"), "n": F.least(F.lit(turn), F.col("n") - F.col("start")).cast("long")})
    x = F.col("begin") + F.col("at")
    served = runs.join(begins.drop("n").join(quantum, "queue"), ["queue", "part"]).select("queue", "part", "row", "start", "n", x.alias("x"), F.ceil((x + F.col("n")) / F.col("quantum")).alias("round"))
    in_round = served.withColumn("before", sum_before(Window.partitionBy("round").orderBy("queue", "x")))
    placed = in_round.join(begins_of(served.groupBy("round").agg(F.sum("n").alias("n"))), "round").select("part", "row", "start", (F.col("begin") + F.col("before")).alias("place"))
    if turn is None:
        placed = placed.select("part", "row", F.array("place").alias("places"))
    else:
        placed = placed.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("start", "place"))).alias("p")).select("part", "row", F.col("p.place").alias("places"))
    placed = scratch.write(placed, "placed")
    scratch.drop_but(queued, placed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                n, ids, lists = batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3)
                many, place = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), many)
                begin = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * (turn or 0)
                size_of = n[doc] - begin if turn is None else np.minimum(turn, n[doc] - begin)
                new = np.ones(len(doc), bool)  # runs that follow each other in their document and in the stream are one
                new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + size_of[:-1])
                first_of = np.flatnonzero(new)
                doc, begin, place, length = doc[first_of], begin[first_of], place[first_of], np.add.reduceat(size_of, first_of)
                first = place // size
                pieces = (place + length - 1) // size - first + 1
                run = np.repeat(np.arange(len(doc)), pieces)
                window = np.repeat(first, pieces) + np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.maximum(0, window * size - place[run])
                end = np.minimum(length[run], (window + 1) * size - place[run])
                offset, of = place[run] + start - window * size, doc[run]
                start, end = begin[run] + start, begin[run] + end
                wide = [np.frombuffer(i, "<u2" if len(i) == 2 * k else "<u4").astype("<u4") for i, k in zip(ids, n.tolist())]
                cut_ids = [wide[r][s:e].tobytes() for r, s, e in zip(of.tolist(), start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of)), pa.array(start), pa.array(end - start), pa.array(n[of]), pa.array(window), pa.array(offset), pa.array(cut_ids, pa.binary())],
                    names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    with_place = queued.select("id", "n", "ids", "part", "row").join(placed.hint("shuffle_hash"), ["part", "row"]).select("id", "n", "ids", "places")
    pieces = with_place.mapInArrow(cut, _PIECE.format(id=kind)).withColumn(payload_name, payload(F.col("ids")))
    return pieces.select(F.col("id").alias(id_col), "start", "length", payload_name, "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small sources come more often than they are: parts of all tokens to the power of 0.7; documents are served in turns of TURN tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pack(docs, temper=0.7, turn=TURN, payload=F.crc32, payload_name="ids_crc32")


QUERIES = {"op7_packing": op7_packing}
