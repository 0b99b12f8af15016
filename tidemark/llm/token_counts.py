"""Token counts: byte-pair merging with a heap over a linked list of symbols.

A pretoken starts as its bytes. The adjacent pair of lowest rank is merged again and again; each
merge removes one symbol, so a pretoken has as many tokens as it has bytes less its merges. No
identifiers are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table, tokenizer_path

#: How a text splits before merging (fixed by the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than the plain space that could tie neighbouring space-separated pieces together.
_OTHER = r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_TIES = regex.compile(rf"  |{_OTHER} | {_OTHER}")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeRanks:
    """Merge rules of a byte-level vocabulary file, by pair of symbols."""

    def __init__(self, vocabulary: dict):
        model = vocabulary["model"]
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level merges are supported")
        ids = model["vocab"]
        self.first = [0] * 256
        for shown, b in byte_symbols().items():
            self.first[b] = ids[shown]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a], ids[b]] = rank, ids[a + b]
        specials = [t["content"] for t in vocabulary.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def count(self, pretoken: bytes) -> int:
        """Symbols that are left of a pretoken when no pair can be merged."""
        n = len(pretoken)
        if n < 2:
            return n
        first, ranks = self.first, self.ranks
        symbol = [first[b] for b in pretoken]
        heap = []
        for i in range(n - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbol[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, merged, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n or symbol[j] != right:
                continue
            now = ranks.get((symbol[i], right))
            if now is None or now[1] != merged:
                continue  # the left symbol has changed since
            symbol[i], symbol[j] = merged, -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                found = ranks.get((merged, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], symbol[k]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbol[h], merged))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], merged))
        return n - merges


class _Kept(dict):
    """Counts of pieces seen before; emptied at `bound` entries or on long pieces, so that memory is bounded."""

    def __init__(self, make: Callable[[str], int], bound: int):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, piece: str) -> int:
        n = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = n
        return n


class TokenCounter:
    """Counts of whole texts, special strings inside them taken as one token each."""

    def __init__(self, vocabulary: dict, bound: int = 500_000):
        self.merges = MergeRanks(vocabulary)
        self.split = regex.compile(SPLIT).findall
        self.pretokens = _Kept(lambda p: self.merges.count(p.encode()), bound)
        self.pieces = _Kept(self._plain, bound)

    def _plain(self, text: str) -> int:
        return sum(map(self.pretokens.__getitem__, self.split(text)))

    def _between(self, text: str) -> int:
        if not text:
            return 0
        if _TIES.search(text):
            return self._plain(text)
        head, *rest = text.split(" ")  # a piece is its word with the space before it
        if rest and not rest[-1]:
            return self._plain(text)
        return self.pieces[head] + sum(map(self.pieces.__getitem__, [" " + w for w in rest]))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        special = self.merges.special
        if special is None or not special.search(text):
            return self._between(text)
        return len(special.findall(text)) + sum(map(self._between, special.split(text)))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, by the vocabulary file at `tokenizer`.

    A narrow map: no shuffle, a batch of texts in memory at a time. Null and empty texts have no
    tokens. Repeated rows and null ids are counted as they come. Other columns are not read. Pieces
    of text are kept with their counts up to a bound, which changes the speed only.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(tokenizer or tokenizer_path("byte_bpe_50k.json")) as f:  # looked up where the task runs
            counter = TokenCounter(json.load(f))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([counter.count(t) for t in texts], pa.int64()), batch.column(2)],
                names=["id", "n_tokens", "n_bytes"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _n_bytes(F.col(text_col)).alias("n_bytes"))
    return asked.mapInArrow(counted, f"id {kind}, n_tokens long, n_bytes long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def _n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read_table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op1_token_counts": op1_token_counts}
