"""Best-fit packing by sums of squares.

An open sequence has a gap, the tokens that it still takes. With N(g) open sequences of gap g, a document of
s tokens goes where the sum of all N(g)^2 becomes smallest: into a sequence of some gap g >= s, or into a new
one. This keeps gaps of many sizes at hand and closes sequences to the last token. Documents are dealt by hash
into groups of bounded size, whose numbers alone travel; a group is placed largest document first, then the
documents of sequences that are still open are placed again until that saves none.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, partitions_for, read_table, tokenizer_path
from tidemark.llm.token_counts import byte_symbols

#: Documents of one group.
GROUP_ROWS = 16_384
#: Characters of texts that a task encodes at once.
CHARS_AT_ONCE = 4_000_000

#: White space by the tokenizer's rule, without the plain space and the line feed.
_OTHER = r"\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = rf" \n{_OTHER}"
#: Pieces of a text that no pretoken crosses: a word with the space before it, or white space.
_PIECES = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER_SPACE = re.compile(f"[{_OTHER}]")
#: White space to some libraries only.
_UNSURE = re.compile(r"[\x1c-\x1f]")
#: Signs that no letter follows in a pretoken.
_SIGNS = ",.;:!?#*$%&|<>()[]{}=+-/_"
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


class PieceIds(dict):
    """Packed identifiers of the pieces of texts, made when a piece is first asked for.

    A piece after one space stands as itself, one that begins a line with a line feed before it, any other
    with a carriage return before it. Plain words go straight to the merges, signs after them apart. At
    `bound` pieces, or 32 characters for each, the pieces at hand become the old ones, from which those that
    are met again come back, and the old ones before go; so memory stays bounded and what is frequent stays.
    """

    def __init__(self, tokenizer, bound: int = 600_000):
        super().__init__()
        self.tokenizer, self.tokenize, self.bound, self.size = tokenizer, tokenizer.model.tokenize, bound, 0
        self.width = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.old: dict[str, bytes] = {}
        self.shown = {b: c for c, b in byte_symbols().items()}
        self.space = self.shown[32]
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.line_feed = self.encoded("\n")
        self.direct = all(self._letters(w, s) == self.encoded(s + w) for w in ("\u00c9t\u00e9", "It") for s in ("", " "))

    def encoded(self, text: str) -> bytes:
        """What the library gives for a whole text."""
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, before: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.tokenize(self.space + shown if before else shown)]).tobytes()

    def pieces_of(self, text: str) -> list[str] | None:
        """The pieces of a text; None where it has to be encoded as a whole."""
        if not text:
            return []
        if any(s in text for s in self.specials) or _UNSURE.search(text):
            return None
        if text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
            return [p[1:] if p[0] == " " and not p.isspace() else "\r" + p for p in _PIECES.findall(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        return ["\r" + first, *rest] if first else rest

    def _made(self, piece: str) -> bytes:
        lead, before, text = b"", "", piece[1:]
        if piece[0] == "\n":
            lead = self.line_feed
        elif piece[0] != "\r":
            before, text = " ", piece
        word = text.rstrip(_SIGNS)
        if self.direct and (word.isalpha() if word.isascii() else _LATIN(word)):
            if word == text and not lead:
                return self._letters(word, before)
            return lead + self[word if before else "\r" + word] + (self["\r" + text[len(word) :]] if word != text else b"")
        return lead + self.encoded(before + text)

    def __missing__(self, piece: str) -> bytes:
        made = self.old.get(piece)
        if made is None:
            made = self._made(piece)
        if len(self) >= self.bound or self.size > 32 * self.bound:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += len(piece)
        self[piece] = made
        return made

    def of(self, text: str | None) -> bytes:
        pieces = self.pieces_of(text or "")
        return self.encoded(text) if pieces is None else b"".join(map(self.__getitem__, pieces))


_KNOWN: dict[str, PieceIds] = {}


def known_pieces(tokenizer: str | None) -> PieceIds:
    """The pieces that this worker process knows; tasks of a process share them."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    if path not in _KNOWN:
        from tokenizers import Tokenizer

        _KNOWN[path] = PieceIds(Tokenizer.from_file(path))
    return _KNOWN[path]


class SquaredGaps:
    """Open sequences by gap; each document goes where the squared counts become smallest."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.n = 0

    def place(self, s: int) -> tuple[int, int]:
        """(sequence, offset) of a document of s tokens."""
        size, counts = self.size, self.counts
        change = counts[: size - s] - counts[s:size] + 1  # half of it, for each gap from s on; the first would be filled
        change[counts[s:size] == 0] = size << 32
        change = 2 * change
        if s < size and counts[s]:
            change[0] = 1 - 2 * counts[s]
        best = int(change.argmin()) if s < size else 0
        if s < size and change[best] <= 2 * counts[size - s] + 1:
            gap, left = s + best, best
            self.counts[gap] -= 1
            sequence = self.open[gap].pop()
        else:
            gap, left, sequence = size, size - s, self.n
            self.n += 1
        if left:
            self.counts[left] += 1
            self.open[left].append(sequence)
        return sequence, size - gap


def placed_once(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each document, in their order; which sequences are still open."""
    gaps = SquaredGaps(size)
    own = np.array([gaps.place(s) for s in sizes.tolist()], np.int64).reshape(len(sizes), 2)
    is_open = np.zeros(gaps.n, bool)
    is_open[[b for some in gaps.open for b in some]] = True
    return own, is_open


def place_group(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each document; sequences count from 0 without a break."""
    rest = np.argsort(-sizes, kind="stable")
    sequence, offset, closed = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    own, is_open = placed_once(sizes[rest], size)
    while True:
        again = is_open[own[:, 0]]
        fewer = placed_once(sizes[rest[again]], size)
        if len(fewer[1]) >= is_open.sum():  # placing them again saves none
            sequence[rest], offset[rest] = closed + own[:, 0], own[:, 1]
            return sequence, offset
        done, number = rest[~again], closed + np.cumsum(~is_open) - 1
        sequence[done], offset[done] = number[own[~again, 0]], own[~again, 1]
        closed, rest, (own, is_open) = closed + int((~is_open).sum()), rest[again], fewer


_QUEUED = "id {id}, part int, row long, n long, full long, ids binary"
_PIECE = "id {id}, piece int, start long, length long, sequence_id long, offset long, ids binary"


def encoded_rows(docs: DataFrame, tokenizer: str | None, end_id: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, part, row, n, full, ids): identifiers of each row, its number in its task, full sequences of the rows before it there."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_pieces(tokenizer)
        end, wide = np.array([end_id], known.width).tobytes(), known.width.itemsize
        part, row, full = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            low = 0
            ends = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))
            while low < batch.num_rows:
                before = ends[low - 1] if low else 0
                high = max(low + 1, min(low + 512, int(np.searchsorted(ends, before + CHARS_AT_ONCE, "right"))))
                some = batch.slice(low, high - low)
                low = high
                ids = [known.of(t) + end for t in some.column(1).to_pylist()]
                n = np.array([len(x) // wide for x in ids], np.int64)
                own = n // size
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(n),
                        pa.array(full + np.cumsum(own) - own), pa.array(ids, pa.binary()),
                    ],
                    names=["id", "part", "row", "n", "full", "ids"],
                )
                row, full = row + len(n), full + int(own.sum())

    text = F.col(text_col).cast("string")
    asked = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"))
    return asked.mapInArrow(encoded, _QUEUED.format(id=kind))


def placed_rows(numbers: DataFrame, size: int, group_rows: int) -> DataFrame:
    """(part, row, sequence_id, offset) from (part, row, s), s below `size`, packed within groups of about `group_rows` rows."""
    spark = numbers.sparkSession
    groups = max(1, -(-numbers.count() // group_rows))

    def packed(part: list, row: list, s: list, group: int) -> pa.RecordBatch:
        part, row, s = np.concatenate(part), np.concatenate(row), np.concatenate(s)
        order = np.lexsort((row, part))
        part, row, s = part[order], row[order], s[order]
        sequence, offset = place_group(s, size)
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(row), pa.array((group << 32) + sequence), pa.array(offset)], names=["part", "row", "sequence_id", "offset"])

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = ([], [], []), None
        for batch in batches:
            group = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if at is not None and group[low] != at:
                    yield packed(*held, at)
                    held = ([], [], [])
                at = int(group[low])
                for k, column in enumerate(held):
                    column.append(batch.column(k).to_numpy()[low:high])
        if at is not None:
            yield packed(*held, at)

    dealt = numbers.select("part", "row", "s", F.pmod(F.xxhash64("part", "row"), F.lit(groups)).alias("group"))
    together = dealt.repartition(min(groups, 4 * partitions_for(spark)), "group").sortWithinPartitions("group")
    return together.mapInArrow(by_group, "part int, row long, sequence_id long, offset long")


def pack_best(
    docs: DataFrame,
    size: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 0,
    payload: Callable[[Column], Column] = lambda ids: ids,
    payload_name: str = "ids",
    group_rows: int = GROUP_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all rows in sequences of at most `size` tokens: id, piece, start, length, a payload, sequence_id, offset.

    A row's identifiers are those of its text by `tokenizer`, then `end_id` (null or empty text: `end_id`
    alone). A row of more than `size` is cut into pieces of `size`, the first of which takes what is left
    over; a piece of `size` is a sequence of its own, with a number below 0. All others are placed by sums
    of squares within groups of about `group_rows` rows, dealt by hash: at most the last sequences of a
    group stay open. `payload` is a Column function of a piece's identifiers (little-endian unsigned
    32-bit). Repeated rows and null ids are packed as they come; other columns are not read. No rows: no
    pieces. Identifiers are shuffled once, to meet their place.
    """
    if not 1 <= size < 1 << 31:
        raise ValueError("size must be at least 1 and below 2^31")
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    queued = scratch.write(encoded_rows(docs, tokenizer, end_id, size, id_col, text_col), "queued")
    numbers = queued.select("part", "row", (F.col("n") % size).alias("s")).where("s > 0")
    placed = scratch.write(placed_rows(numbers, size, group_rows), "placed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                n, ids, part, full = batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy()
                own, place = (batch.column(k).fill_null(0).to_numpy() for k in (5, 6))
                first = (n - 1) % size + 1
                pieces = (n - first) // size + 1
                run = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(number > 0, first[run] + (number - 1) * size, 0)
                end = first[run] + number * size
                alone = end - start == size
                of_full = number - (first[run] < size)  # which of the row's full pieces it is
                sequence = np.where(alone, -1 - (part[run] << 40) - full[run] - of_full, own[run])
                wide = [np.frombuffer(i, "<u2" if len(i) == 2 * k else "<u4").astype("<u4") for i, k in zip(ids, n.tolist())]
                cut_ids = [wide[r][s:e].tobytes() for r, s, e in zip(run.tolist(), start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(run)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(end - start),
                        pa.array(sequence), pa.array(np.where(alone, 0, place[run])), pa.array(cut_ids, pa.binary()),
                    ],
                    names=["id", "piece", "start", "length", "sequence_id", "offset", "ids"],
                )

    met = queued.join(placed.hint("shuffle_hash"), ["part", "row"], "left").select("id", "n", "ids", "part", "full", "sequence_id", "offset")
    pieces = met.mapInArrow(cut, _PIECE.format(id=kind)).withColumn(payload_name, payload(F.col("ids")))
    return pieces.select(F.col("id").alias(id_col), "piece", "start", "length", payload_name, "sequence_id", "offset")


def op12_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_best(docs, payload=F.crc32, payload_name="ids_crc32")


QUERIES = {"op12_bin_packing": op12_bin_packing}
