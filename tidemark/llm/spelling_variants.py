"""Spelling variants: pairs of words one edit apart, by composing finite-state machines.

The machine (vocabulary acceptor) o (one-edit transducer) o (vocabulary acceptor) accepts the pairs of words
that differ in one code point. Its states before the edit are those that both words reach together, so it
falls apart by what the words have in common: with the longer word of `m` code points and the edit within
[a, b), both have the first a and the last m - b. Each such context is an initial state of its own; the words
that reach it are one partition, with an acceptor over what lies between. Spark deals the words out by their
contexts; a task builds the minimal acceptors of its partitions, with states shared between them, composes
and enumerates. The contexts of a word are its thirds; a partition with many words, or long ones, is cut into
thirds again, down to single code points, where the alphabet bounds it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read_table

LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 6, 5, 5
#: One run in so many loses a letter, by the checksum of document and run (a fixed value of the query).
SLIP = 199
#: Words a task counts before it hands them on; words of a partition, and code points of what lies between, before it is cut again.
COUNTED, PARTITION_WORDS, PARTITION_LETTERS = 400_000, 20_000, 64
#: States that partitions of a task share.
STATES = 200_000


def slipped(words: list[str], start: int, slip: int) -> list[str]:
    """The runs of one text, some of them without one code point. start: the checksum of what stands before each run."""
    crc32 = zlib.crc32
    hit = {w: h for w in set(words) if not (h := crc32(w.encode(), start)) % slip}
    if not hit:
        return words
    short = {w: w[: h % len(w)] + w[h % len(w) + 1 :] for w, h in hit.items()}
    return [short.get(w, w) for w in words]


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of Latin letters of all texts, A-Z lower-cased, of `least_letters` code points or more.

    A task sums up what it has met, within a bound, before words are shuffled. With `slip`, a run whose
    checksum crc32("<id>:<run>") it divides loses the code point at that checksum modulo its length
    before it is counted; a null id is an empty one.
    """
    runs = re.compile("[a-z\u00c0-\u00ff]{%d,}" % least_letters)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) >= least_letters]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = runs.findall((text.as_py() or b"").lower().decode())  # bytes lower A-Z alone
                counts.update(slipped(words, zlib.crc32(f"{key}:".encode()), slip) if slip else words)
                if len(counts) >= COUNTED:
                    yield handed()
        yield handed()

    asked = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return asked.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptors:
    """Minimal acyclic acceptors of several partitions, with states in common.

    A state is (whether a word may end here, its arcs by letter); equal ones are one. `machine` gives a
    partition's initial state, `pairs` the pairs of words that the composed machine accepts from it.
    """

    def __init__(self, bound: int = STATES):
        self.bound = bound
        self.register: dict[tuple, int] = {}
        self.ends: list[bool] = []
        self.arcs: list[dict[str, int]] = []

    def machine(self, words: list[str]) -> int:
        """The initial state of a partition: the minimal acceptor of `words` (sorted, distinct)."""
        if len(self.arcs) >= self.bound:
            self.register, self.ends, self.arcs = {}, [], []
        return self._state(words)

    def _state(self, words: list[str]) -> int:
        ends = not words[0]
        arcs = {letter: self._state([w[1:] for w in rest]) for letter, rest in groupby(words[ends:], key=lambda w: w[0])}
        key = ends, *arcs.items()
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.arcs)
            self.ends.append(ends)
            self.arcs.append(arcs)
        return found

    def common(self, p: int, q: int, known: dict) -> list[str]:
        """What both states accept: the composed machine after its edit."""
        key = (p, q) if p <= q else (q, p)
        if (out := known.get(key)) is None:
            one, two = self.arcs[p], self.arcs[q]
            out = [""] if self.ends[p] and self.ends[q] else []
            for letter in one.keys() & two.keys():
                out += [letter + s for s in self.common(one[letter], two[letter], known)]
            known[key] = out
        return out

    def pairs(self, initial: int) -> Iterator[tuple[str, str, int]]:
        """(word, word, place of the edit) for words one replaced letter apart, and with one letter less as the second."""
        known: dict = {}
        todo = [(initial, "")]
        while todo:
            state, before = todo.pop()
            arcs = list(self.arcs[state].items())
            for k, (letter, after) in enumerate(arcs):
                for other, there in arcs[k + 1 :]:
                    for rest in self.common(after, there, known):
                        yield before + letter + rest, before + other + rest, len(before)
                for rest in self.common(after, state, known):
                    yield before + letter + rest, before + rest, len(before)
                todo.append((after, before + letter))


class Near:
    """For each word met in a partition: how many near words, and the one of largest n (then the smallest)."""

    def __init__(self):
        self.machines = Acceptors()
        self.columns: tuple[list, list, list, list] = ([], [], [], [])

    def add(self, m: int, a: int, b: int, words: list[str], counts: list[int]) -> None:
        """A partition; words whose contexts differ have met by chance and are taken apart."""
        contexts: dict[tuple[str, str], dict[str, tuple[str, int]]] = {}
        for w, n in zip(words, counts):
            end = len(w) - m + b
            contexts.setdefault((w[:a], w[end:]), {})[w[a:end]] = w, n
        for of in contexts.values():
            if len(of) > 1:
                self._add(m, a, of)

    def _add(self, m: int, a: int, of: dict[str, tuple[str, int]]) -> None:
        found: dict[str, list] = {}
        for x, y, at in self.machines.pairs(self.machines.machine(sorted(of))):
            (one, n), (two, k) = of[x], of[y]
            if len(one) != m or len(two) < m and two[a + at : a + at + 1] == one[a + at]:
                continue  # the longer word's own length and the last place the edit can have: each pair is met once
            for word, other, count in ((one, two, k), (two, one, n)):
                best = found.setdefault(word, [0, count, other])
                best[0] += 1
                if (-count, other) < (-best[1], best[2]):
                    best[1], best[2] = count, other
        for word, (near, count, form) in found.items():
            for column, v in zip(self.columns, (word, near, count, form)):
                column.append(v)

    def handed(self) -> pa.RecordBatch:
        kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds)], names=["word", "near", "form_n", "form"])
        for c in self.columns:
            c.clear()
        return out


def in_contexts(rows: DataFrame, intervals: Column) -> DataFrame:
    """(key, m, a, b, word, n): each word of `rows` in each of `intervals`, structs (m, a, b); the key is a hash of the context."""
    each = rows.select("word", "n", F.explode(intervals).alias("i")).select("word", "n", "i.m", "i.a", "i.b")
    key = F.xxhash64("m", "a", "b", F.left("word", F.col("a")), F.right("word", F.col("m") - F.col("b")))
    return each.select(key.alias("key"), "m", "a", "b", "word", "n")


def thirds(m: Column, a: Column, b: Column) -> Column:
    """[a, b) in three parts, those that are not empty, as structs (m, a, b)."""
    cut = lambda k: (a + F.floor((b - a) * k / 3)).cast("int")
    parts = F.array(*(F.struct(m.cast("int").alias("m"), cut(k).alias("a"), cut(k + 1).alias("b")) for k in range(3)))
    return F.filter(parts, lambda i: i["a"] < i["b"])


def near_in(keyed: DataFrame) -> DataFrame:
    """(word, near, form_n, form) for each word and partition of `keyed` in which it is near another."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Near()
        held: tuple[list, list] = ([], [])
        at: tuple | None = None

        def close() -> None:
            if len(held[0]) > 1:
                near.add(*at[1:], *held)
            for h in held:
                h.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.column(k).to_numpy() for k in range(4)]
            begins = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in fields], axis=0)]))
            sizes = np.diff(np.append(begins, batch.num_rows))
            several = sizes > 1
            several[[0, -1]] = True  # these may go on in another batch
            for low, n in zip(begins[several].tolist(), sizes[several].tolist()):
                own = tuple(int(x[low]) for x in fields)
                if own != at:
                    close()
                    at = own
                held[0].extend(batch.column(4).slice(low, n).to_pylist())
                held[1].extend(batch.column(5).slice(low, n).to_pylist())
            yield near.handed()
        close()
        yield near.handed()

    order = "key", "m", "a", "b"
    return keyed.repartition("key").sortWithinPartitions(*order).mapInArrow(composed, "word string, near long, form_n long, form string")


def near_words(vocabulary: DataFrame, scratch: Scratch, partition_words: int = PARTITION_WORDS, partition_letters: int = PARTITION_LETTERS) -> DataFrame:
    """(word, n_near, best): near words of each word of `vocabulary` (word, n; words are distinct) that has any; best: (-n, word) of the best."""
    size, none = F.char_length("word"), F.lit(0)
    keyed = in_contexts(vocabulary, F.concat(thirds(size, none, size), thirds(size + 1, none, size + 1)))
    place, found = ["key", "m", "a", "b"], []
    while True:
        wide = F.col("b") - F.col("a")
        large = keyed.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).where((wide > 1) & (F.col("size") > 1) & ((F.col("size") > partition_words) | (wide > partition_letters)))
        large = scratch.write(large.drop("size"), "large")
        if large.isEmpty():
            found.append(near_in(keyed))
            break
        found.append(near_in(keyed.join(large, place, "left_anti")))
        keyed = in_contexts(keyed.join(large, place, "left_semi"), thirds(F.col("m"), F.col("a"), F.col("b")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("near"))).alias("best"))


def roots_of(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, twice as far in each round."""
    roots = scratch.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.write(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not after.where("moved").isEmpty()
        scratch.drop(roots)
        roots = after.drop("moved") if not moved else after
        if not moved:
            return roots


def spelling_variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, form_times: int = FORM_TIMES, slip: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", partition_words: int = PARTITION_WORDS, partition_letters: int = PARTITION_LETTERS,
) -> DataFrame:
    """A row for each word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters (A-Z lower-cased) of `least_letters` code points or more that occur
    `least_count` times or more in all texts. Two are near if one inserted, deleted or replaced code point
    makes the one the other; n_near counts a word's. Its form is the near word of largest n (ties: the
    smallest by code points) if that is `form_times` the word's own or more, else null; form_n is the
    form's n. root follows forms to the last; a word without a form is its own. `slip`: see `count_words`.

    Null and empty texts have no words, repeated rows count each time, a null id takes part; an empty table
    has no rows. Only words and counts are shuffled, summed up before. `partition_words` and
    `partition_letters` bound a partition by cutting it again; they don't change the result.
    """
    if partition_words < 128 or form_times < 2:
        raise ValueError("partition_words must be above the size of the alphabet, form_times above 1")
    scratch = Scratch(docs.sparkSession)
    counted = count_words(docs, least_letters, slip, id_col, text_col)
    vocabulary = scratch.write(counted.where(F.col("n") >= least_count), "vocabulary")
    near = vocabulary.join(near_words(vocabulary, scratch, partition_words, partition_letters), "word", "left")
    form_n = -F.col("best.less")
    is_form = form_n >= form_times * F.col("n")
    linked = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, form_n).alias("form_n"))
    linked = scratch.write(linked, "linked")
    roots = roots_of(linked.where("form IS NOT NULL").select("word", "form"), scratch)
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"), slip=SLIP)


QUERIES = {"op11_spelling_variants": op11_spelling_variants}

ORACLES = {
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc_table
), runs AS (
    SELECT doc_id, run, count(*) AS k FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY doc_id, run
), units AS (
    SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS bytes
    FROM runs
), hashed AS (
    SELECT run, k, xor(list_reduce(bytes, lambda c, b: xor(c // 256, crc_table[1 + xor(c, b) % 256]), 4294967295), 4294967295) AS h FROM units, crc
), words AS (
    SELECT word, sum(k)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), holes AS (
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
    SELECT a.word AS a, b.word AS b, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), best AS (
    SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM pairs GROUP BY a
), linked AS (
    SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * words.n THEN form END AS form, CASE WHEN form_n >= 5 * words.n THEN form_n END AS form_n
    FROM words LEFT JOIN best ON a = word
), chain AS (
    SELECT word, word AS root, n AS root_n FROM linked
    UNION ALL SELECT chain.word, linked.form, linked.form_n FROM chain JOIN linked ON linked.word = chain.root WHERE linked.form IS NOT NULL
), roots AS (
    SELECT word, first(root ORDER BY root_n DESC) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN roots USING (word)
""",
}
