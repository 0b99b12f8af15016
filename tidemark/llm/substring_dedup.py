"""Substring dedup: near-duplicate passages by compact windows of min-hashes.

The tokens of a text are its runs of `WORDS` words. For each of `FUNCTIONS` hash functions, the Cartesian
tree over the tokens' hashes gives the compact windows (l, c, r): the smallest hash of every run of tokens
that starts in [l, c] and ends in [c, r] stands at c. Windows of `TOKENS` tokens or more stand for all
passages of that size and are about 2 / (TOKENS + 1) of the tokens; where one token comes again and again,
the windows that follow each other are one (l, c, d, r), from its first place c to its last d. Passages that
are alike have equal smallest hashes for most functions, so windows with equal hashes in several documents
are joined: each document's to those of the smallest document, which is the class of the passage. Where the
windows of enough functions overlap in both documents, the passages are compared exactly.

The passages found are linked to classes, and windows are joined again by pairs of functions' hashes that are
smallest in one run, wherever those that have such a pair do not all lie in passages of one class: first those
with the same tokens, and one of each set of tokens with a hub, then all of these that are still of different
classes. Bit maps of the tokens around tell, in the join, which pairs have too
few of them in common to hold a passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_SEPARATORS, Scratch, mix64, read_table, shingles
from tidemark.llm.near_dedup import components

WORDS, PASSAGE_WORDS, SIMILARITY = 5, 50, 75
TOKENS = PASSAGE_WORDS - WORDS + 1
#: Hash functions, and how many of them must agree on a passage (a power of two: the low bits of a key name the function).
FUNCTIONS, ENOUGH = 4, 2
_SEEDS = mix64(np.arange(101, 101 + FUNCTIONS, dtype=np.uint64))
#: Tokens of a run that must be in the other text (at equal sizes the similarity asks for as many).
NEED = -(-2 * SIMILARITY * TOKENS // (100 + SIMILARITY))
#: Tokens of a run that may be in its class's passage but not in this text: of equally many tokens the class's would have no more than a quarter besides.
SPARE = 16
#: Runs whose middle is so near to a stretch of passages have tokens of it; a run outside has its middle farther away.
EDGE = (TOKENS - 1) // 2
#: Longs of a bit map of tokens, and how many tokens it reaches beyond the runs that hold both places.
LONGS, MARGIN = 8, 16
BITS = [f"b{k}" for k in range(LONGS)]


#: Bytes of texts that are hashed at once. A word's hash is a polynomial over its bytes' own random values, A-Z as a-z.
CHUNK = 1 << 18
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.isin(np.arange(256), list(WORD_SEPARATORS.encode()))
_BYTES[_SPACE] = 0


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x)])) for x in (_BASE, _INVERSE))


_POWER, _BACK = _powers(CHUNK)


def tokens_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """The tokens of each text: hashes of its runs of WORDS words, in order."""
    joint, hashes, starts, low = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8), [], [], 0
    space, power, inverse = _SPACE[joint], _POWER, _BACK
    while low < len(joint):
        high = min(low + CHUNK, len(joint))
        high += int(np.argmax(space[high - 1 :]))  # up to a space
        if high - low > len(power):
            power, inverse = _powers(high - low)
        edges = np.flatnonzero(np.diff(space[low:high], prepend=True))
        start, end = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.cumsum(_BYTES[joint[low:high]] * power[: high - low])
            own = (sums[end] - np.where(start > 0, sums[start - 1], np.uint64(0))) * inverse[start]
            hashes.append(mix64(own + (end - start).astype(np.uint64) * _BASE))
        starts.append(start + low)
        low = high
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    upto = np.searchsorted(np.concatenate(starts), ends)
    words, low = np.concatenate(hashes), np.append(0, upto[:-1])
    runs = shingles(words, WORDS)
    return [runs[a : b - WORDS + 1] if b - a >= WORDS else shingles(words[a:b], WORDS) for a, b in zip(low.tolist(), upto.tolist())]


def _slide(x: np.ndarray, size: int, of) -> np.ndarray:
    """of() over every run of `size` values."""
    width = 1
    while 2 * width <= size:
        x = of(x[: len(x) - width], x[width:])
        width *= 2
    return of(x[: len(x) - (size - width)], x[size - width :]) if width < size else x


def compact_windows(values: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least `tokens` values, ties to the left.

    Only places that are smallest in some run of `tokens` values can be centres, and the neighbour
    that bounds a centre's window is such a place too, so the tree is built over these alone.
    """
    n = len(values)
    if n < tokens:
        return (np.zeros(0, np.int64),) * 3
    low = _slide(values, tokens, np.minimum)
    padded = np.concatenate([np.zeros(tokens - 1, values.dtype), low, np.zeros(tokens - 1, values.dtype)])
    places = np.flatnonzero(_slide(padded, tokens, np.maximum) == values)
    left, right = np.empty(len(places), np.int64), np.full(len(places), n, np.int64)
    at, own, stack = places.tolist(), values[places].tolist(), []
    for k, (place, value) in enumerate(zip(at, own)):
        while stack and own[stack[-1]] > value:
            right[stack.pop()] = place
        left[k] = at[stack[-1]] + 1 if stack else 0
        stack.append(k)
    wide = right - left >= tokens
    return left[wide], places[wide], right[wide] - 1


def joined_windows(values: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, d, r) of the compact windows; those of one value that follow each other within `tokens` places are one, with the first place c and the last d.

    A run of `tokens` values that starts in [l, d], reaches c and ends by r holds one of the places, which is its smallest.
    """
    l, c, r = compact_windows(values, tokens)
    if not len(c):
        return l, c, c, r
    new = np.concatenate([[True], (values[c[1:]] != values[c[:-1]]) | (l[1:] != c[:-1] + 1) | (c[1:] - c[:-1] > tokens)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(c)) - 1
    return l[at], c[at], c[last], r[last]


def windows_of(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each function (text's index, key, l, c, d, r) over several texts at once; a smallest value keeps texts apart."""
    runs = [x if len(x) >= TOKENS else x[:0] for x in tokens_of(texts)]
    starts = np.cumsum([0] + [len(r) + 1 for r in runs])
    joint, gaps = np.zeros(starts[-1], np.uint64), starts[1:] - 1
    for k, r in enumerate(runs):
        joint[starts[k] : starts[k] + len(r)] = r
    for f, seed in enumerate(_SEEDS):
        values = mix64(joint ^ seed) | np.uint64(1)
        values[gaps] = 0
        l, c, d, r = joined_windows(values, TOKENS)
        real = values[c] != 0
        l, c, d, r = l[real], c[real], d[real], r[real]
        doc = np.searchsorted(starts, c, "right") - 1
        key = (values[c] & ~np.uint64(FUNCTIONS - 1) | np.uint64(f)).view(np.int64)
        yield doc, key, l - starts[doc], c - starts[doc], d - starts[doc], r - starts[doc]


def _batches_of(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    low = 0
    while low < len(texts):
        total, first = 0, low
        while low < len(texts) and total < 1_000_000:
            total += len(texts[low] or b"")
            low += 1
        yield first, texts[first:low]


def windows(docs: DataFrame) -> DataFrame:
    """(key, id, c, d, l, r): the windows of all texts, with their first and last place and both ends."""
    kind = docs.schema["id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, own in _batches_of(batch.column(1).to_pylist()):
                for doc, key, l, c, d, r in windows_of(own):
                    ids = batch.column(0).take(pa.array(doc + first))
                    yield pa.RecordBatch.from_arrays([pa.array(key), ids, pa.array(c), pa.array(d), pa.array(l), pa.array(r)], names=["key", "id", "c", "d", "l", "r"])

    return docs.mapInArrow(found, f"key long, id {kind}, c long, d long, l long, r long")


def _shared(held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that several ids hold, each with the smallest id."""
    shared = held.groupBy(*keys).agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last")
    return held.join(shared, keys)


def candidates(shared: DataFrame) -> DataFrame:
    """(id, hub, places): pairs of documents that windows of at least ENOUGH functions join, with key, c, l, r and the hub's c, l, r of each."""
    hubs = shared.where("id = hub").groupBy("key").agg(F.min(F.struct("c", "l", "r")).alias("h")).select("key", *(F.col(f"h.{x}").alias(f"h{x}") for x in "clr"))
    rows = shared.where("id <> hub").join(hubs, "key")
    functions = [F.max((F.col("key").bitwiseAND(FUNCTIONS - 1) == f).cast("int")) for f in range(FUNCTIONS)]
    places = F.collect_list(F.struct("key", "c", "l", "r", "hc", "hl", "hr"))
    return rows.groupBy("id", "hub").agg(places.alias("places"), reduce(lambda x, y: x + y, functions).alias("n")).where(F.col("n") >= ENOUGH).drop("n")


def classes(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(tid, known): for each document of passages, in its own right or as a class, the stretches of words s to e that they cover, and the class of each.

    Passages of a document that have a run of PASSAGE_WORDS words in common are one stretch. Stretches that hold a
    passage and its class are linked; a class is what links reach.
    """
    from pyspark.sql import Window

    own = found.select(F.col("id").alias("tid"), F.col("start_word").alias("a"), F.col("end_word").alias("b"))
    own = own.union(found.select("class_id", "class_start", "class_end")).distinct()
    order = Window.partitionBy("tid").orderBy("a", "b")
    own = own.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)) - PASSAGE_WORDS, F.lit(True)))
    own = own.withColumn("k", F.sum(F.col("new").cast("long")).over(order))
    within = Window.partitionBy("tid", "k")
    own = own.select("tid", "a", "b", F.min("a").over(within).alias("s"), F.max("b").over(within).alias("e"))
    own = scratch.write(own.withColumn("node", F.xxhash64("tid", "s")), "stretches")
    of = lambda node: own.select("tid", "a", "b", F.col("node").alias(node))
    links = found.withColumnsRenamed({"id": "tid", "start_word": "a", "end_word": "b"}).join(of("u"), ["tid", "a", "b"])
    links = links.select("u", F.col("class_id").alias("tid"), F.col("class_start").alias("a"), F.col("class_end").alias("b")).join(of("v"), ["tid", "a", "b"]).select("u", "v").distinct()
    labels = components(links, scratch).select("node", "label")
    return own.select("tid", "s", "e", "node").distinct().join(labels, "node").groupBy("tid").agg(F.collect_list(F.struct("s", "e", "label")).alias("known"))


def in_class(rows: DataFrame, known: DataFrame, low, high) -> DataFrame:
    """`rows` with the class of the first stretch that holds the tokens from low to high or has them within EDGE of its ends, null where none does."""
    holds = F.filter("known", lambda k: (k["s"] - EDGE <= low) & (high + WORDS <= k["e"] + EDGE))
    return rows.join(known, F.col("id") == F.col("tid"), "left").withColumn("label", F.get(F.array_sort(holds), F.lit(0))["label"]).drop("tid", "known")


def pairs_of_windows(doc: np.ndarray, key: np.ndarray, c: np.ndarray, d: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(doc, key, key2, l, r, first, last) of windows of two functions that hold a run of TOKENS tokens in common, over several texts at once.

    l and r bound what both hold; such runs start at first to last.
    """
    far = doc << 32
    start, end = far + np.maximum(l, c - TOKENS + 1), far + np.minimum(d, r - TOKENS + 1)  # where such runs of each window start
    of = [np.flatnonzero((key & FUNCTIONS - 1) == f) for f in range(FUNCTIONS)]
    of = [x[np.lexsort((end[x], start[x]))] for x in of]
    rows = [np.zeros((7, 0), np.int64)]
    for f in range(FUNCTIONS):
        for g in range(f + 1, FUNCTIONS):
            x, y = of[f], of[g]
            if not len(x) or not len(y):
                continue
            low = np.searchsorted(np.maximum.accumulate(end[y]), start[x], "left")
            n = np.maximum(0, np.searchsorted(start[y], end[x], "right") - low)
            one = np.repeat(x, n)
            two = y[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            both = end[two] >= start[one]
            one, two = one[both], two[both]
            first, last = np.maximum(start[one], start[two]) - far[one], np.minimum(end[one], end[two]) - far[one]
            rows.append(np.stack([doc[one], key[one], key[two], np.maximum(l[one], l[two]), np.minimum(r[one], r[two]), first, last]))
    table = np.concatenate(rows, axis=1)
    table = table[:, np.lexsort(table[::-1])]
    return table[:, np.concatenate([[True], (table[:, 1:] != table[:, :-1]).any(axis=0)])[: table.shape[1]]]


def _next(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place before and the place after each that have the same value in the same text (of); -1 and far beyond where there is none."""
    order = np.lexsort((values, of))
    again = (values[order[1:]] == values[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    before, after = np.full(len(values), -1), np.full(len(values), 2 * len(values) + TOKENS)
    before[order[1:][again]], after[order[:-1][again]] = order[:-1][again], order[1:][again]
    return before, after


def needs(bins: np.ndarray, of: np.ndarray, *spares: int) -> list[np.ndarray]:
    """For each of `spares`: for each run of TOKENS places, how many different bins are in it at least if any so many of its places are left out. of: the places' texts."""
    n = len(bins)
    before, after = _next(bins, of)
    every = np.arange(n)

    def counted(low: np.ndarray, high: np.ndarray) -> np.ndarray:  # how many of the ranges low to high hold each place
        some = low <= high
        return np.cumsum(np.bincount(low[some], minlength=n + 1) - np.bincount(high[some] + 1, minlength=n + 1)[: n + 1])[:n]

    different = counted(np.maximum(before + 1, every - TOKENS + 1).clip(0), every)
    least, spare = [different] * len(spares), [np.full(n, x) for x in spares]
    own, following = every, after
    for times in range(1, max(spares) + 1):  # those that go with the fewest places first
        low, high = np.maximum(before, own - TOKENS).clip(-1) + 1, np.minimum(every, following - TOKENS)
        if times > 1 and not (low <= high).any():
            break
        alone = counted(low, high)  # bins that are in the run so many times
        for k in range(len(spares)):
            goes = np.minimum(alone, spare[k] // times)
            least[k], spare[k] = least[k] - goes, spare[k] - times * goes
        own = following
        following = np.where(own < n, after[own.clip(max=n - 1)], 2 * n + TOKENS)
    return least


def marks(tokens: np.ndarray, of: np.ndarray, l: np.ndarray, r: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(content, need, loose, must, bits) of pairs of windows, over the tokens of several texts (of).

    content: a hash of the set of tokens of the runs that start at first to last. bits: a bit map of these and MARGIN
    more on each side, as far as the windows reach. need: so many bits at least has each of these runs in common
    with a text that has NEED of its tokens; loose: with one that lacks SPARE. must: a bit that such a text has, or -1:
    that of tokens which fill more places of each run than it may lack.
    """
    bins = (tokens >> np.uint64(40)).astype(np.int64) & 64 * LONGS - 1
    level = np.frexp(last - first + 1)[1] - 1
    ends = []
    for least in needs(bins, of, TOKENS - NEED, SPARE):
        levels = [least]  # of the run that starts here; then the least of 2, 4, ... runs
        for k in range(level.max(initial=0)):
            levels.append(np.minimum(levels[-1], np.append(levels[-1][1 << k :], levels[-1][-1:].repeat(min(1 << k, len(tokens))))))
        table = np.stack(levels)
        ends.append(np.minimum(table[level, first], table[level, last - (1 << level) + 1]))
    need, loose = ends

    # the first bin of each more than TOKENS - NEED times between the last run's first place and the first run's last
    after = _next(bins, of)[1]
    many = np.arange(len(bins))
    for _ in range(TOKENS - NEED):
        many = np.where(many < len(bins), after[many.clip(max=len(bins) - 1)], 2 * len(bins) + TOKENS)
    nearest = np.minimum.accumulate(many[::-1])[::-1]  # where the first such bin from here on is complete
    full = np.full(2 * len(bins) + TOKENS + 1, -1)
    full[many] = bins
    must = np.where((last - first < TOKENS) & (nearest[last] < first + TOKENS), full[nearest[last]], -1)

    before, mixed = _next(tokens, of)[0], mix64(tokens)
    low, high = np.maximum(l, first - MARGIN), np.minimum(r, last + TOKENS - 1 + MARGIN) + 1
    content, bits = np.zeros(len(l), np.uint64), np.zeros((len(l), LONGS), np.int64)
    size, k = high - low, 0
    upto = np.cumsum(size)
    while k < len(l):
        to = max(k + 1, int(np.searchsorted(upto, upto[k] + 500_000, "left")))
        own = size[k:to]
        row = np.repeat(np.arange(len(own)), own)
        place = np.repeat(low[k:to] - np.cumsum(own) + own, own) + np.arange(own.sum())
        held = np.zeros(len(own) * 64 * LONGS, bool)
        held[row * 64 * LONGS + bins[place]] = True
        bits[k:to] = np.packbits(held, bitorder="little").view(np.int64).reshape(-1, LONGS)
        begin, end = first[k:to][row], last[k:to][row] + TOKENS
        once = (place >= begin) & (place < end) & (before[place] < begin)
        with np.errstate(over="ignore"):
            content[k:to] = np.add.reduceat(np.where(once, mixed[place], np.uint64(0)), np.cumsum(own) - own)
        k = to
    return mix64(content).view(np.int64), need, loose, must, bits


def windows_in_pairs(shared: DataFrame, known: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, key2, id, l, r, first, last, content, need, loose, must, bits) for the pairs of hashes of windows that don't all lie in passages of one class."""
    kind = shared.schema["id"].dataType.simpleString()
    names = ["key", "key2", "l", "r", "first", "last", "content", "need", "loose", "must", *BITS]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                lists, runs = batch.column(1), tokens_of(batch.column(2).to_pylist())
                sizes = np.array([len(x) for x in runs])
                starts = np.cumsum(sizes) - sizes
                tokens, flat = np.concatenate(runs), lists.flatten()
                doc = np.repeat(np.arange(len(runs)), lists.value_lengths().to_numpy())
                key, c, d, l, r = (flat.field(k).to_numpy() for k in range(5))
                own = r < sizes[doc]  # rows that repeat an id have the windows of all its texts
                own[own] = (mix64(tokens[(starts[doc] + c)[own]] ^ _SEEDS[key[own] & FUNCTIONS - 1]).view(np.int64) ^ key[own]) & ~np.int64(FUNCTIONS - 1) == 0
                doc, key, key2, l, r, first, last = pairs_of_windows(*(x[own] for x in (doc, key, c, d, l, r)))
                if len(doc):
                    far = starts[doc]
                    content, need, loose, must, bits = marks(tokens, np.repeat(np.arange(len(runs)), sizes), far + l, far + r, far + first, far + last)
                    ids = batch.column(0).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (key, key2, l, r, first, last, content, need, loose, must, *bits.T))], names=["id", *names])

    # the middle of the runs that a pair has lies between these places
    low, high = F.greatest("l", F.col("c") - TOKENS + 1) + (TOKENS - 1) // 2, F.least("d", F.col("r") - TOKENS + 1) + TOKENS // 2
    asked = in_class(shared, known, low, high).groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.col("label").isNull()).alias("free"))
    asked = asked.where("free or low <> high").select("key")
    of_doc = shared.join(asked, "key").groupBy("id").agg(F.collect_list(F.struct("key", "c", "d", "l", "r")).alias("w"), F.count_distinct(F.col("key").bitwiseAND(FUNCTIONS - 1)).alias("n"))
    of_doc = of_doc.where(F.col("n") >= ENOUGH).join(texts, F.col("id") == F.col("tid")).select("id", "w", "text")
    return scratch.write(of_doc.mapInArrow(paired, f"id {kind}, " + ", ".join(f"{n} long" for n in names)), "paired")


PLACES = ["key", "key2", "content", "id", "l", "r", "first", "last"]


def apart(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose pair of hashes several documents of different classes have, with their class; those in no passage are of a class of their own."""
    middle = F.floor((F.col("first") + F.col("last") + TOKENS - 1) / 2)
    rows = in_class(rows, known, middle, middle)
    rows = rows.withColumn("label", F.coalesce("label", F.xxhash64("id", "l", "first", "last", F.lit("alone"))))
    several = rows.groupBy("key", "key2").agg(*(of(x).alias(f"{to}_{x}") for x in ("id", "label") for of, to in ((F.min, "low"), (F.max, "high"))))
    return rows.join(several.where("low_id < high_id and low_label < high_label").select("key", "key2"), ["key", "key2"])


def _met(rows: DataFrame) -> DataFrame:
    """(id, hub, places) from rows (id, l, r, hub, hl, hr)."""
    return rows.groupBy("id", "hub").agg(F.collect_set(F.struct("l", "r", "hl", "hr")).alias("places"))


def _as_hub(rows: DataFrame) -> DataFrame:
    names = {"id": "hub", "l": "hl", "r": "hr", "label": "hlabel", "loose": "hloose", **{b: f"h{b}" for b in BITS}}
    return rows.select("key", "key2", *(F.col(x).alias(to) for x, to in names.items()))


def _hopeful(rows: DataFrame) -> DataFrame:
    """The rows of two classes whose maps have enough bits in common, and the one that must be."""
    common = reduce(lambda x, y: x + y, (F.bit_count(F.col(b).bitwiseAND(F.col(f"h{b}"))) for b in BITS))
    word = reduce(lambda x, k: x.when(F.shiftright("must", 6) == k, F.col(f"hb{k}")), range(LONGS), F.when(F.lit(False), F.lit(0)))
    there = (F.col("must") < 0) | (F.expr("shiftright(word, cast(must & 63 as int))").bitwiseAND(F.lit(1)) == 1)
    rows = rows.where(F.col("label") != F.col("hlabel")).where((common >= F.col("need")) & (common >= F.col("hloose")))
    return rows.withColumn("word", word).where(there).select("id", "l", "r", "hub", "hl", "hr")


def met(rows: DataFrame) -> DataFrame:
    """(id, hub, places) from rows (id, l, r, hub, hl, hr)."""
    return rows.groupBy("id", "hub").agg(F.collect_set(F.struct("l", "r", "hl", "hr")).alias("places"))


def of_same_tokens(rows: DataFrame) -> DataFrame:
    """Windows of one document of each class with those of the smallest document that has the same set of tokens."""
    keys = ["key", "key2", "content"]
    one = rows.groupBy(*keys, "label").agg(F.min(F.struct("id", "l", "r")).alias("x"))
    hubs = one.groupBy(*keys).agg(F.min("x").alias("h"), F.count("*").alias("n")).where("n > 1")
    both = one.join(hubs, keys).where("x.id <> h.id")
    return both.select("x.*", F.col("h.id").alias("hub"), F.col("h.l").alias("hl"), F.col("h.r").alias("hr"))


def one_of_each(rows: DataFrame, paired: DataFrame) -> DataFrame:
    """The rows of the smallest document that has a set of tokens, with the smallest of all that have the pair of hashes (hub)."""
    keys = ["key", "key2", "content"]
    least = rows.groupBy(*keys).agg(F.min("id").alias("id"))
    least = least.join(least.groupBy("key", "key2").agg(F.min("id").alias("hub")), ["key", "key2"])
    return paired.join(rows.join(least, [*keys, "id"]).dropDuplicates(PLACES), PLACES)


def against_hubs(rows: DataFrame) -> DataFrame:
    """Windows with those of the hub of their pair of hashes, where it is of another class."""
    return _hopeful(rows.where("id <> hub").drop("hub").join(_as_hub(rows.where("id = hub").drop("hub")), ["key", "key2"]))


def against_all(rows: DataFrame) -> DataFrame:
    """All pairs of windows of different classes that have a pair of hashes, the smaller id as the hub."""
    return _hopeful(rows.join(_as_hub(rows), ["key", "key2"]).where(F.col("id") > F.col("hub")))


def regions(places: Iterator[tuple[int, ...]]) -> list[tuple[int, int, int, int]]:
    """(l, r, hub l, hub r) where windows of enough functions overlap in both texts. places: (key, c, l, r, hub c, hub l, hub r)."""
    spans = sorted({(c - hc, l, r, hl, hr, key & FUNCTIONS - 1) for key, c, l, r, hc, hl, hr in places})
    out, open_ = [], []
    for shift, l, r, hl, hr, f in spans:  # in order of the shift between the texts
        for o in open_:
            if shift - o[5] <= TOKENS and l <= o[1] and o[0] <= r and hl <= o[3] and o[2] <= hr:
                o[0], o[1], o[2], o[3], o[5] = min(o[0], l), max(o[1], r), min(o[2], hl), max(o[3], hr), shift
                o[4].add(f)
                break
        else:
            open_.append([l, r, hl, hr, {f}, shift])
    for l, r, hl, hr, functions, _ in open_:
        if len(functions) >= ENOUGH:
            out.append((l, r, hl, hr))
    return out


def joint_regions(places: Iterator[tuple[int, ...]]) -> list[tuple[int, int, int, int]]:
    """(l, r, hub l, hub r) of all places (the same); those that overlap in both texts are one."""
    out: list[list[int]] = []
    for box in sorted(set(places)):
        for o in reversed(out):
            if box[0] <= o[1] and o[0] <= box[1] and box[2] <= o[3] and o[2] <= box[3]:
                o[1], o[2], o[3] = max(o[1], box[1]), min(o[2], box[2]), max(o[3], box[3])
                break
        else:
            out.append(list(box))
    return [tuple(o) for o in out]


def _reach(b: np.ndarray, x: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The places of b around low to high that have one of the tokens x (sorted) without a gap: b may have one token at many places."""
    no = np.flatnonzero(x[np.minimum(np.searchsorted(x, b), len(x) - 1)] != b)
    before, after = no[no < low], no[no >= high]
    return int(before[-1]) + 1 if len(before) else 0, int(after[0]) if len(after) else len(b)


def alike(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """Passages of a that are near duplicates of a passage of b, as (start, end, start in b, end in b) of tokens, ends excluded.

    Runs of tokens whose share in b is high enough in every run of TOKENS tokens are the passages;
    each is held against the tokens of b between its first and last match, on full sets.
    """
    if len(a) < TOKENS or len(b) < TOKENS:
        return []
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    where = order[at]
    match = b[where] == a
    sums = np.concatenate([[0], np.cumsum(match)])
    need = -(-2 * percent * TOKENS // (100 + percent))
    good = np.flatnonzero(sums[TOKENS:] - sums[:-TOKENS] >= need)
    out = []
    if not len(good):
        return out
    for run in np.split(good, np.flatnonzero(np.diff(good) > TOKENS) + 1):
        left = np.flatnonzero(match[run[0] : run[-1] + TOKENS]) + run[0]
        while len(left) >= need:  # one alignment of the two after the other, the one with most matches first
            shift = left - where[left]
            ordered = np.sort(shift)
            first = ordered[np.argmax(np.searchsorted(ordered, ordered + TOKENS, "right") - np.arange(len(ordered)))]
            own = (shift >= first) & (shift <= first + TOKENS)
            start, end = int(left[own].min()), int(left[own].max()) + 1
            low, high = int(where[left[own]].min()), int(where[left[own]].max()) + 1
            left, x = left[~own], np.unique(a[start:end])
            if high - low < TOKENS and len(x) < TOKENS:
                low, high = _reach(b, x, low, high)
            y = np.unique(b[low:high])
            both = len(np.intersect1d(x, y, assume_unique=True))
            if min(end - start, high - low) >= TOKENS and 100 * both >= percent * (len(x) + len(y) - both):
                out.append((start, end, low, high))
    return out


def _around(span: dict, tokens: np.ndarray, more: int) -> list[tuple[int, int, int, int]]:
    """Passages, as words, of a span that are alike with a passage of the hub, whose tokens are given; `more` tokens are there on each side."""
    own, first, l, r, hl, hr = np.frombuffer(span["tokens"], np.uint64), *(span[x] for x in ("first", "l", "r", "hl", "hr"))
    found = [(l + a, l + b, hl + c, hl + d) for a, b, c, d in alike(own[l - first : r + 1 - first], tokens[hl : hr + 1])]
    if more and found:
        low = max(0, hl - more)
        wide = [(first + a, first + b, low + c, low + d) for a, b, c, d in alike(own, tokens[low : hr + 1 + more])]
        found = wide + [x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and y[2] <= x[2] and x[3] <= y[3] for y in wide)]
    return [(a, b + WORDS - 1, c, d + WORDS - 1) for a, b, c, d in found]


def verified(pairs: DataFrame, texts: DataFrame, of=regions) -> DataFrame:
    """(id, start_word, end_word, class_id, class_start, class_end) for passages of the pairs that are alike. texts: (tid, text); of: the places' regions.

    Regions, which may be those of few of the windows, are held against each other again with TOKENS tokens more on each side.
    """
    more = TOKENS
    kind = pairs.schema["id"].dataType.simpleString()
    spans = "array<struct<l:long,r:long,hl:long,hr:long,first:long,tokens:binary>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, None
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                out, lists = [], batch.column(2)
                flat, ends = lists.flatten().flatten(), [0, *np.cumsum(lists.value_lengths().to_numpy()).tolist()]
                fields = [x.to_numpy() for x in flat]
                for k, text in enumerate(batch.column(3).to_pylist()):
                    own = of(zip(*(x[ends[k] : ends[k + 1]].tolist() for x in fields)))
                    if own and (tokens is None or text != last):
                        last, tokens = text, tokens_of([text])[0]
                    out.append([{"l": l, "r": r, "hl": hl, "hr": hr, "first": (first := max(0, l - more)), "tokens": tokens[first : r + 1 + more].tobytes()} for l, r, hl, hr in own])
                keep = pa.array([bool(x) for x in out])
                kind_of = pa.list_(pa.struct([("l", pa.int64()), ("r", pa.int64()), ("hl", pa.int64()), ("hr", pa.int64()), ("first", pa.int64()), ("tokens", pa.binary())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind_of)], names=["id", "hub", "spans"]).filter(keep)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, None
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                rows, cols = [], [[] for _ in range(4)]
                for k, (own, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    if tokens is None or text != last:
                        last, tokens = text, tokens_of([text])[0]
                    for s in own:
                        for passage in _around(s, tokens, more):
                            rows.append(k)
                            for col, v in zip(cols, passage):
                                col.append(v)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), *(pa.array(c, pa.int64()) for c in cols[:2]), batch.column(1).take(take), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["id", "start_word", "end_word", "class_id", "class_start", "class_end"],
                )

    with_own = pairs.join(texts, pairs["id"] == texts["tid"]).select("id", "hub", "places", "text")
    slices = with_own.mapInArrow(cut, f"id {kind}, hub {kind}, spans {spans}")
    with_hub = slices.join(texts, slices["hub"] == texts["tid"]).select("id", "hub", "spans", "text")
    return with_hub.mapInArrow(compared, f"id {kind}, start_word long, end_word long, class_id {kind}, class_start long, class_end long")


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage that some other document repeats: id, start_word, end_word, class_id, class_start, class_end.

    Words (A-Z lower-cased) are numbered from 0, ends are excluded. A passage has PASSAGE_WORDS words at
    least; two are near duplicates where the sets of their runs of WORDS words have SIMILARITY per cent
    of their union in common. `class_id` is the smallest document found to hold it, which has a row of
    its own for its passage. Documents without such passages have no row. Null, empty and shorter texts
    and rows without an id have none; rows that repeat an id are searched as texts of that document and
    not held against each other. Empty tables give empty results.

    A repeated run of PASSAGE_WORDS words is always a candidate, also beside passages already found; one
    of the least similarity with probability 0.95 for each run of its TOKENS tokens. Only windows are
    grouped, by sums before the shuffle. A group of n alike holders costs n pairs a round; after two
    rounds, one holder of each set of tokens meets those of other classes. Passages of one class need no
    row for each of their pairs: the rows' links lead from each to every other.
    """
    asked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    scratch, texts = Scratch(docs.sparkSession), asked.withColumnRenamed("id", "tid")
    every = scratch.write(windows(asked), "windows")  # read twice: for the keys that several documents have, and for their windows
    shared = scratch.write(_shared(every, ["key"]), "shared")
    scratch.drop(every)

    def compared(pairs: DataFrame, of=joint_regions) -> DataFrame:
        pairs = scratch.write(pairs, "pairs")
        wanted = pairs.select("id").union(pairs.select("hub")).distinct().withColumnRenamed("id", "tid")
        own = scratch.write(texts.join(wanted, "tid", "left_semi"), "texts")
        out = scratch.write(verified(pairs, own, of), "passages")
        scratch.drop(pairs, own)
        return out

    def known() -> DataFrame:
        return scratch.write(classes(reduce(DataFrame.unionByName, parts), scratch), "known")

    parts = [compared(candidates(shared), regions)]
    at = known()
    paired = windows_in_pairs(shared.drop("hub"), at, texts, scratch)
    rows = scratch.write(apart(paired.select(*PLACES), at), "apart")
    scratch.drop_but(paired, rows, *parts)
    reps = scratch.write(one_of_each(rows, paired), "reps")
    scratch.drop(paired)
    parts.append(compared(met(of_same_tokens(rows).unionByName(against_hubs(reps)))))
    rows = scratch.write(apart(reps.where("id <> hub").drop("hub", "label"), known()), "left")
    parts.append(compared(met(against_all(rows))))
    scratch.drop_but(*parts)
    found = reduce(DataFrame.unionByName, parts)
    hubs = found.select(F.col("class_id").alias("id"), F.col("class_start").alias("start_word"), F.col("class_end").alias("end_word"), "class_id", "class_start", "class_end")
    return found.unionByName(hubs).distinct().withColumnRenamed("id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
