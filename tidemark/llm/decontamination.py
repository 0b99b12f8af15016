"""Benchmark decontamination: random-walk embedding, bit-sampling keys over item-sized windows, exact edit verification.

Texts are sequences of words. A window of an item's length is embedded by the CGK walk: at each step it
gives out the word where it stands and moves on by a random bit of step and word, so texts that are few
edits apart agree in many steps. A key is made of `BITS` sampled steps of one walk; half of the walks go
backwards from the window's end. How many walks an item's length needs for the target recall at the most
edits that are allowed is found by walking over random edited copies (`repeats`). Where a window and an
item have a key in common, the word edit distance around that place decides.

Windows are only embedded where they could match: k edits leave all but 2k of an item's w - 1 pairs of
neighbouring words as they are, so a window has that many pairs that stand in the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, WordHashes, mix64, read_table, words_of

EDIT_PERCENT = 25
#: Words of items that one pass over the documents looks for.
BLOCK_WORDS = 1_000_000
#: Steps in a key, share of edited copies at the limit that keys shall meet, walks at most.
BITS, RECALL, MOST_WALKS = 3, 0.99, 128
#: Random edited copies that `repeats` tries, and the length from which longer items count alike there.
COPIES, LONGEST_TRIED = 48, 128
_SEEDS = mix64(np.arange(701, 701 + MOST_WALKS, dtype=np.uint64))
_BEYOND = np.uint64(0xA5A5A5A5A5A5A5A5)  # what a walk gives out behind its window
_FILTER = 22  # log2 of the bits that mark pairs of the benchmark


def best_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end): the run of `text` at the smallest edit distance from `item`; the earliest such end."""
    n = len(text)
    shift = np.int64(1) << np.int64(32)
    slope = np.arange(n + 1, dtype=np.int64) * shift
    row = np.arange(n + 1, dtype=np.int64)  # cost above, start below
    for word in item:
        new = row + shift
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(text == word, 0, shift))
        row = np.minimum.accumulate(new - slope) + slope
    end = int(np.argmin(row >> np.int64(32)))
    return int(row[end] >> np.int64(32)), int(row[end] & (shift - 1)), end


def walk(symbols: np.ndarray, starts: np.ndarray, seeds: np.ndarray, steps: int) -> np.ndarray:
    """Where walks from each start stand: (steps, seeds, starts). Symbols must go on for `steps` behind every start."""
    at = np.repeat(starts[None, :], len(seeds), axis=0)
    out = np.empty((steps, *at.shape), np.int64)
    factors = mix64(np.arange(1, steps + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(steps):
            out[j] = at
            at = at + (((symbols[at] ^ seeds[:, None]) * factors[j]) >> np.uint64(63)).astype(np.int64)
    return out


def steps_of(width: int) -> int:
    return max(BITS, 2 * width)


@lru_cache(maxsize=4096)
def sampled(width: int) -> np.ndarray:
    """The steps that a key of each walk is made of: (MOST_WALKS, BITS); from all of a window, early ones more often in long windows.

    The longer two walks have gone, the more edits have come between them.
    """
    steps = steps_of(width)
    weights = np.diff((np.arange(steps + 1) / steps) ** (1 / max(1.0, 1.7 * np.log2(width / 8))))
    rng = np.random.default_rng(width)
    return np.stack([np.sort(rng.choice(steps, BITS, replace=False, p=weights)) for _ in range(MOST_WALKS)])


def keys_of(symbols: np.ndarray, places: np.ndarray, starts: np.ndarray, which: np.ndarray, walks: np.ndarray, width: int) -> np.ndarray:
    """Keys (walks, starts) of windows of `width` words from the walks' places; `which`: the starts' columns there."""
    key = mix64(walks.astype(np.uint64) + np.uint64(width << 20))[:, None]
    rows = np.arange(len(walks))
    with np.errstate(over="ignore"):
        for steps in sampled(width)[walks].T:
            at = places[steps, rows][:, which]
            given = np.where(at - starts < width, symbols[at], _BEYOND)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ given)
    return key


def edits_of(width: int, percent: int) -> int:
    return percent * width // 100


def repeats(width: int, percent: int) -> int:
    """Walks (an even number) that meet RECALL of randomly edited copies of items of `width` words, at all edits allowed."""
    return _repeats(width if width <= 16 else min(-(-width // 16) * 16, LONGEST_TRIED), percent)


@lru_cache(maxsize=4096)
def _repeats(width: int, percent: int) -> int:
    k = edits_of(width, percent)
    if k == 0:
        return 2
    rng = np.random.default_rng(width)
    fresh = lambda n: mix64(rng.integers(1, 1 << 62, n).astype(np.uint64))
    items, texts, tried, starts, base = [], [], [], [], 0
    reach = steps_of(width) + 1
    for copy in range(COPIES):
        item = fresh(width)
        kinds = dict(zip(rng.choice(width, k, replace=False).tolist(), rng.integers(3, size=k).tolist()))
        edited = [x for i, w in enumerate(item) for x in {0: fresh(1), 1: [*fresh(1), w], 2: []}.get(kinds.get(i), [w])]
        text = np.concatenate([fresh(reach), np.array(edited, np.uint64), fresh(reach)])
        hits = np.flatnonzero(np.isin(pair_hashes(text), pair_hashes(item)))
        near = np.arange(reach - k, reach + k + 1)
        passed = np.searchsorted(hits, near + width + k - 1, "left") - np.searchsorted(hits, near, "left") >= pairs_left(width, k)
        items.append(np.concatenate([item, fresh(reach)]))
        texts.append(text)
        starts.append(base + near[passed])
        tried.append(np.full(passed.sum(), copy))
        base += len(text)
    text, starts, tried = np.concatenate(texts), np.concatenate(starts), np.concatenate(tried)
    met = np.zeros((MOST_WALKS, COPIES), bool)
    for walks, back in ((_FORWARD, 0), (_BACKWARD, 1)):
        own = np.concatenate([np.concatenate([x[:width][::-1], x[width:]]) if back else x for x in items])
        first = np.arange(COPIES) * (width + reach)
        wanted = keys_of(own, walk(own, first, _SEEDS[walks], steps_of(width)), first, np.arange(COPIES), walks, width)
        at = len(text) - starts - width if back else starts
        other = text[::-1] if back else text
        got = keys_of(other, walk(other, at, _SEEDS[walks], steps_of(width)), at, np.arange(len(at)), walks, width)
        for row, same in zip(walks, got == wanted[:, tried]):
            met[row] = np.bincount(tried[same], minlength=COPIES) > 0
    rate = np.maximum(met.mean(axis=0), 0.5 / MOST_WALKS)
    return next((r for r in range(2, MOST_WALKS, 2) if ((1 - rate) ** r).mean() <= 1 - RECALL), MOST_WALKS)


_FORWARD, _BACKWARD = np.arange(0, MOST_WALKS, 2), np.arange(1, MOST_WALKS, 2)


def pair_hashes(symbols: np.ndarray) -> np.ndarray:
    """A hash of each pair of neighbours."""
    with np.errstate(over="ignore"):
        return mix64((symbols[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ symbols[1:])


def pairs_left(width: int, edits: int) -> int:
    """Pairs of neighbours that so many edits leave of an item, at least."""
    return width - 1 - 2 * edits


def ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of n numbers for each, one after the other."""
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class Items:
    """A block of items with their keys: for each length and direction the sorted keys and the holders' numbers."""

    percent: int = EDIT_PERCENT
    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    marked: np.ndarray | None = None  # a bit for each pair's hash, by its high bits
    pairs: np.ndarray | None = None  # their sorted hashes, and the lengths of the items that have each: begins, lengths
    begins: np.ndarray | None = None
    lengths: np.ndarray | None = None
    single: np.ndarray | None = None

    def __post_init__(self):
        if not 0 <= self.percent < 50:
            raise ValueError("percent must be below 50: from there on a window could hold an item without a word pair in common")

    def most(self, number: int) -> int:
        """Edits that an item may have."""
        return edits_of(len(self.words[number]), self.percent)

    def add(self, item_id, words: np.ndarray) -> None:
        self.ids.append(item_id)
        self.words.append(words)

    def close(self) -> Items:
        by_width = defaultdict(list)
        for number, words in enumerate(self.words):
            by_width[len(words)].append(number)
        known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for width, numbers in by_width.items():
            for back in (0, 1):
                walks = np.arange(back, repeats(width, self.percent), 2)
                tail = np.zeros(steps_of(width) + 1, np.uint64)
                own = np.concatenate([x for k in numbers for x in (self.words[k][:: -1 if back else 1], tail)])
                first = np.arange(len(numbers)) * (width + len(tail))
                keys = keys_of(own, walk(own, first, _SEEDS[walks], steps_of(width)), first, np.arange(len(numbers)), walks, width).ravel()
                order = np.argsort(keys, kind="stable")
                self.keys[width, back] = keys[order], np.tile(numbers, len(walks))[order]
            pairs = np.unique(np.concatenate([pair_hashes(self.words[k]) for k in numbers]))
            known.append((pairs, np.full(len(pairs), width)))
        pairs, lengths = (np.concatenate(x) for x in zip(*known))
        order = np.lexsort((lengths, pairs))
        self.pairs, first = np.unique(pairs[order], return_index=True)
        self.begins, self.lengths = np.append(first, len(order)), lengths[order]
        marked = np.zeros(1 << _FILTER, bool)
        marked[self.pairs >> np.uint64(64 - _FILTER)] = True
        self.marked = np.packbits(marked, bitorder="little")
        self.single = np.unique(np.concatenate([self.words[k] for k in by_width.get(1, [])] or [np.zeros(0, np.uint64)]))
        return self

    def pairs_in(self, symbols: np.ndarray) -> dict[int, np.ndarray]:
        """For each length the places of pairs that its items have."""
        found = pair_hashes(symbols)
        place = found >> np.uint64(64 - _FILTER)
        hits = np.flatnonzero(self.marked[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
        own = np.minimum(np.searchsorted(self.pairs, found[hits]), max(0, len(self.pairs) - 1))
        real = self.pairs[own] == found[hits] if len(self.pairs) else np.zeros(0, bool)
        hits, own = hits[real], own[real]
        n = self.begins[own + 1] - self.begins[own]
        lengths, hits = self.lengths[ranges(self.begins[own], n)], np.repeat(hits, n)
        order = np.argsort(lengths, kind="stable")
        lengths, hits = lengths[order], hits[order]
        first = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1])) if len(lengths) else np.zeros(0, np.int64)
        return dict(zip(lengths[first].tolist(), np.split(hits, first[1:])))


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_words: int, percent: int) -> Iterator[Items]:
    """The items in blocks of bounded size, one at a time."""
    hashes, block, size = WordHashes(), Items(percent), 0
    asked = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).distinct().orderBy("id", "text")
    for row in asked.toLocalIterator():
        words = hashes.of(words_of(bytes(row.text) if row.text is not None else None))
        if len(words):
            block.add(row.id, words)
            size += len(words)
        if size >= block_words:
            yield block.close()
            block, size = Items(percent), 0
    if block.ids:
        yield block.close()


def merged_ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, high], each once; low must not fall."""
    if not len(low):
        return low
    reach = np.maximum.accumulate(high)
    begins = np.append(True, low[1:] > reach[:-1] + 1)
    first, last = low[begins], reach[np.append(np.flatnonzero(begins)[1:] - 1, len(low) - 1)]
    return ranges(first, last - first + 1)


class Finder:
    """Matches of one block of items in texts."""

    def __init__(self, items: Items, percent: int):
        self.items, self.percent, self.hashes = items, percent, WordHashes()
        self.sets = [set(w.tolist()) for w in items.words]
        self.most = np.array([items.most(k) for k in range(len(items.words))], np.int64)
        self.widths = np.array(sorted({len(w) for w in items.words}), np.int64)

    def find(self, texts: list[bytes | None]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text, item number: (edits, start, end). Texts go through in joint arrays."""
        out: list[dict[int, tuple[int, int, int]]] = []
        low = 0
        while low < len(texts):
            split, total = [], 0
            while low < len(texts) and total < 200_000:
                split.append(words_of(texts[low]))
                total += len(split[-1])
                low += 1
            out += self._joint(split)
        return out

    def _joint(self, split: list[list[bytes]]) -> list[dict[int, tuple[int, int, int]]]:
        gap = 4
        starts = np.cumsum([0] + [len(w) + gap for w in split])
        n = int(starts[-1])
        beyond = steps_of(int(self.widths[-1])) + 1 if len(self.widths) else 0
        symbols = mix64(np.arange(n + beyond, dtype=np.uint64) ^ np.uint64(0x5EED5EED5EED))  # between and behind the texts
        for k, words in enumerate(split):
            symbols[starts[k] : starts[k] + len(words)] = self.hashes.of(words)
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in split]
        if n == 0 or not len(self.widths):
            return found
        number, at = self._candidates(symbols, n)
        middle = at + np.array([len(w) for w in self.items.words])[number] // 2
        doc = np.searchsorted(starts, np.clip(middle, 0, n - 1), "right") - 1
        order = np.lexsort((at, number, doc))
        doc, number, at = doc[order], number[order], at[order]
        near = at // np.maximum(1, self.most[number])  # one window serves all starts that are so near
        first = np.ones(len(at), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]) | (near[1:] != near[:-1])
        ends = starts[:-1] + [len(w) for w in split]
        for d, k, x in zip(doc[first].tolist(), number[first].tolist(), at[first].tolist()):
            self._try(found[d], symbols, int(starts[d]), int(ends[d]), k, x)
        return found

    def _candidates(self, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(item number, start) of windows that have a key in common with an item."""
        asked: dict[int, np.ndarray] = {}
        if len(self.items.single):
            asked[1] = np.flatnonzero(np.isin(symbols[:n], self.items.single))
        for width, hits in self.items.pairs_in(symbols[: n + 1]).items():
            k = edits_of(width, self.percent)
            need = pairs_left(width, k)
            first, last = (hits[: len(hits) - need + 1], hits[need - 1 :]) if len(hits) >= need else (hits[:0], hits[:0])
            close = last - first < width + k - 1  # so many pairs stand in the window and the words that edits may add
            asked[width] = merged_ranges(np.maximum(0, last[close] - width - k + 2), first[close])
        numbers, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for widths in self._groups(asked):
            for back in (0, 1):
                for number, at in self._met(symbols, {w: asked[w] for w in widths}, back):
                    numbers.append(number)
                    ats.append(at)
        return np.concatenate(numbers), np.concatenate(ats)

    @staticmethod
    def _groups(asked: dict[int, np.ndarray]) -> Iterator[list[int]]:
        """Lengths that share their walks: those between two powers of two."""
        groups = defaultdict(list)
        for width, starts in asked.items():
            if len(starts):
                groups[(width - 1).bit_length()].append(width)
        yield from groups.values()

    def _met(self, symbols: np.ndarray, asked: dict[int, np.ndarray], back: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        text = symbols[::-1] if back else symbols
        if back:  # starts from the end; texts go on before the first word
            text = np.concatenate([text, mix64(np.arange(steps_of(max(asked)) + 1, dtype=np.uint64) ^ np.uint64(0xBACC))])
        total = len(symbols)
        begin = {w: np.sort(total - (s + w))[::1] if back else s for w, s in asked.items()}
        begin = {w: b[b >= 0] for w, b in begin.items()}
        together = np.unique(np.concatenate(list(begin.values())))
        walks = np.arange(back, max(repeats(w, self.percent) for w in asked), 2)
        steps = steps_of(max(asked))
        size = max(16, 4_000_000 // (steps * len(walks)))
        for low in range(0, len(together), size):
            some = together[low : low + size]
            places = walk(text, some, _SEEDS[walks], steps)
            for width, starts in begin.items():
                own = starts[np.searchsorted(starts, some[0], "left") : np.searchsorted(starts, some[-1], "right")]
                if not len(own):
                    continue
                of_width = walks[walks < repeats(width, self.percent)]
                keys = keys_of(text, places[:, : len(of_width)], own, np.searchsorted(some, own), of_width, width)
                known, holders = self.items.keys[width, back]
                left = np.searchsorted(known, keys.ravel(), "left")
                there = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == keys.ravel())
                if not len(there):
                    continue
                left, many = left[there], np.searchsorted(known, keys.ravel()[there], "right") - left[there]
                start = own[there % len(own)]
                number = holders[ranges(left, many)]
                both = np.unique(np.stack([number, np.repeat(total - start - width if back else start, many)]), axis=1)
                yield both[0], both[1]

    def _try(self, found: dict, symbols: np.ndarray, start: int, end: int, number: int, at: int) -> None:
        item = self.items.words[number]
        most = int(self.most[number])
        if number in found and found[number][0] == 0:
            return
        low, high = max(start, at - 2 * most), min(end, at + len(item) + 3 * most + 1)
        text = symbols[low:high]
        wanted = self.sets[number]
        if len(wanted.intersection(text.tolist())) < len(wanted) - most:  # an edit takes away one word at most
            return
        edits, first, last = best_window(item, text)
        if edits <= most:
            match = edits, low - start + first, low - start + last
            found[number] = min(found.get(number, match), match)


_FOUND = "item_id {item}, n_words long, edits long, start_word long, end_word long"


def find_leaks(
    docs: DataFrame, items: DataFrame, percent: int = EDIT_PERCENT, block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row for each document row and item that it holds: id, item_id, n_words, edits, start_word, end_word.

    A document holds an item where some run of its words is within `percent` of the item's words in
    edits (insert, delete, replace; A-Z lower-cased), whatever its length. start_word and end_word bound
    the best run. Verbatim copies are always found, those at the limit with probability RECALL. Items
    without words (or null) are held by nothing. Repeated document rows each get their rows, equal items
    one, an id with several texts one for each text. Null ids come as they are. Empty tables: no rows.
    Items go out in blocks of `block_words` words, each a pass over the documents that is written before
    the next block is made, so what driver and executors hold doesn't grow with the benchmark;
    documents are never shuffled.
    """
    scratch, kind = Scratch(docs.sparkSession), items.schema[item_col].dataType.simpleString()
    parts, last = [], Items(percent)
    for block in blocks_of(items, item_col, item_text_col, block_words, percent):
        if last.ids:
            parts.append(scratch.write(leaks_of_block(docs, last, percent, id_col, text_col, kind), "leaks"))
        last = block
    out = leaks_of_block(docs, last, percent, id_col, text_col, kind) if last.ids else leaks_of_block(docs.limit(0), last.close(), percent, id_col, text_col, kind)
    for more in parts:
        out = out.unionByName(more)
    return out


def leaks_of_block(docs: DataFrame, block: Items, percent: int, id_col: str, text_col: str, item_kind: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        finder = Finder(items, percent)
        for batch in batches:
            rows, cols = [], [[] for _ in range(5)]
            for k, hits in enumerate(finder.find(batch.column(1).to_pylist())):
                for number, match in sorted(hits.items()):
                    rows.append(k)
                    for col, v in zip(cols, (items.ids[number], len(items.words[number]), *match)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c) if c else pa.array([], pa.int64()) for c in cols)],
                names=["id", "item_id", "n_words", "edits", "start_word", "end_word"],
            )

    return asked.mapInArrow(found, f"id {kind}, {_FOUND.format(item=item_kind)}").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, items: DataFrame, percent: int = EDIT_PERCENT, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, all columns as they were; what is left after a block is written before the next."""
    scratch, before = Scratch(docs.sparkSession), None
    for block in blocks_of(items, "item_id", "text", block_words, percent):
        if before is not None:
            kept = scratch.write(without(docs, before, percent, text_col), "clean")
            scratch.drop(docs)
            docs = kept
        before = block
    return docs if before is None else without(docs, before, percent, text_col)


def without(docs: DataFrame, block: Items, percent: int, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, percent)
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not hits for hits in finder.find(texts)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
