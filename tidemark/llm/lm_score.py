"""Language-model scores: a hidden Markov model over word classes, trained by Baum-Welch on all training texts.

The `OWN` most frequent words are classes of their own; every other word belongs to the class of its
ending. A hidden state emits a class, a class emits its words in proportion to their smoothed counts,
with a place for words never seen. Each round of training is one pass over the written class sequences:
tasks add up expected counts, Spark adds those of all tasks, the driver divides. The likelihood of a
text is the scaled forward recursion over its whole sequence.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read_table, words_of

#: Words that are classes of their own, classes of endings, bytes of an ending.
OWN, ENDINGS, ENDING_BYTES = 4096, 1024, 3
#: Most frequent words, at most, whose counts every task holds; counts of the others come by a join.
HELD_WORDS = 65_536
STATES, ROUNDS, SEED = 8, 5, 12
#: Tokens that one recursion holds at once; what is longer goes in segments that carry the recursion on. Tokens that a task sorts by length.
TOKENS_AT_ONCE, TOKENS_SORTED = 1_000_000, 8_000_000
#: Words that a task counts before it hands them on.
COUNT_BOUND = 500_000
END = b""


def held_out_column(doc_id: Column) -> Column:
    """crc32(id as text) mod 7 = 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): tokens of all texts, the end token as an empty word. docs: text as binary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > COUNT_BOUND:
                    yield out()
                    counts.clear()
            counts[END] += batch.num_rows
        if counts:
            yield out()

    return docs.select("text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ending_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


class Codes(dict):
    """A number for each word: its place among the held words, or behind them that of its ending's class."""

    def __init__(self, frequent: list[bytes], bound: int = 400_000):
        super().__init__()
        self.own, self.held, self.bound = {w: k for k, w in enumerate(frequent)}, len(frequent), bound + len(frequent)
        self.update(self.own)
        #: Class of each number.
        self.classes = np.array([k if k < OWN else ending_class(w) for k, w in enumerate(frequent)] + list(range(OWN, OWN + ENDINGS)), "<u2")

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
            self.update(self.own)
        k = self[word] = self.held + ending_class(word) - OWN
        return k


@dataclass
class Hmm:
    first: np.ndarray  # (states,)
    moves: np.ndarray  # (states, states)
    emits: np.ndarray  # (states, classes)

    @staticmethod
    def start(class_counts: np.ndarray, states: int, seed: int) -> Hmm:
        """Every state emits the classes about as they are counted, with an own lean; states like to stay."""
        rng = np.random.default_rng(seed)
        emits = (class_counts + 1e-3) * rng.gamma(2.0, size=(states, len(class_counts)))
        moves = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return Hmm(np.full(states, 1 / states), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))

    def restimated(self, first: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: np.ndarray) -> Hmm:
        """From expected counts; every state keeps a little of the prior so that each class stays possible."""
        states = len(first)
        return Hmm(
            (first + 1 / states) / (first.sum() + 1),
            (moves + 1 / states) / (moves.sum(axis=1, keepdims=True) + 1),
            (emits + prior) / (emits.sum(axis=1, keepdims=True) + prior.sum()),
        )


def lockstep(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sequences, longest first, step by step: (order, classes of all steps in a row, how many run in each step)."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max())
    running = (len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), "right")).tolist()
    begins = np.cumsum([0, *running])
    flat = np.empty(begins[-1], np.int64)
    for rank, k in enumerate(order.tolist()):
        flat[begins[: lengths[k]] + rank] = sequences[k]
    return order, flat, running


def log_likelihoods(hmm: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each whole sequence, by the scaled forward recursion."""
    order, flat, running = lockstep(sequences)
    emits = np.ascontiguousarray(hmm.emits.T)
    total, at, alpha = np.zeros(len(sequences)), 0, None
    for n in running:
        own = emits[flat[at : at + n]]
        alpha = (hmm.first * own) if alpha is None else (alpha[:n] @ hmm.moves) * own
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
        at += n
    out = np.empty(len(sequences))
    out[order] = total
    return out


def segments_of(running: list[int], bound: int) -> list[tuple[int, int]]:
    """Runs of steps [first, last) with `bound` tokens at most, or one step."""
    out, first, held = [], 0, 0
    for t, n in enumerate(running):
        if held and held + n > bound:
            out.append((first, t))
            first, held = t, 0
        held += n
    return [*out, (first, len(running))]


def expected_counts(hmm: Hmm, sequences: list[np.ndarray], bound: int = TOKENS_AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First states, moves and emissions that the sequences are expected to have (forward and backward).

    Where the sequences have more than `bound` tokens, the forward vectors are kept at the ends of
    segments only and made again on the way back, so memory is bounded and counts are those of whole sequences.
    """
    _, flat, running = lockstep(sequences)
    emits, states = np.ascontiguousarray(hmm.emits.T), len(hmm.first)
    back, at = np.ascontiguousarray(hmm.moves.T), np.cumsum([0, *running])
    segments = segments_of(running, bound)

    def forward(first: int, last: int, alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward vectors, scales and emissions of the steps [first, last); alpha: the vectors of the step before."""
        base = at[first]
        own = emits[flat[base : at[last]]]
        out, scale = np.empty_like(own), np.empty(len(own))
        for t in range(first, last):
            n, low = running[t], at[t] - base
            now = out[low : low + n]
            if alpha is None:
                np.multiply(own[low : low + n], hmm.first, out=now)
            else:
                np.matmul(alpha[:n], hmm.moves, out=now)
                now *= own[low : low + n]
            total = now.sum(axis=1)
            scale[low : low + n] = total
            now /= total[:, None]
            alpha = now
        return out, scale, own

    starts: list[np.ndarray | None] = [None]
    for first, last in segments[:-1]:
        starts.append(forward(first, last, starts[-1])[0][at[last - 1] - at[first] :].copy())
    moves, emitted, after = np.zeros((states, states)), np.zeros((states, hmm.emits.shape[1])), None
    for (first, last), start in zip(reversed(segments), reversed(starts)):
        alpha, scale, own = forward(first, last, start)
        own /= scale[:, None]
        for t in range(last - 1, first - 1, -1):
            low = at[t] - at[first]
            now = alpha[low : low + running[t]]  # becomes the states' shares, once the moves are counted
            if after is None:
                after = own[low : low + running[t]].copy()
                continue
            n = len(after)
            moves += now[:n].T @ after
            beta = after @ back
            after = own[low : low + running[t]].copy()
            now[:n] *= beta
            after[:n] *= beta
        for s in range(states):
            emitted[s] += np.bincount(flat[at[first] : at[last]], alpha[:, s], hmm.emits.shape[1])
    return alpha[: running[0]].sum(axis=0), moves * hmm.moves, emitted


def by_length(sequences: list[np.ndarray], tokens: int) -> Iterator[list[np.ndarray]]:
    """Groups of sequences of much the same length, the longest first; `tokens` in each at most, or one sequence."""
    group, held = [], 0
    for s in sorted(sequences, key=len, reverse=True):
        if group and held + len(s) > tokens:
            yield group
            group, held = [], 0
        group.append(s)
        held += len(s)
    if group:
        yield group


def train(coded: DataFrame, class_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Hmm:
    """Baum-Welch over all rows of `coded` (classes as packed 16-bit numbers)."""
    context = coded.sparkSession.sparkContext
    hmm, prior = Hmm.start(class_counts, states, seed), class_counts / class_counts.sum()
    n_classes = len(class_counts)
    for _ in range(rounds):
        shared = context.broadcast(hmm)

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, sums, held, tokens = shared.value, None, [], 0

            def add() -> None:
                nonlocal sums, held, tokens
                for some in by_length(held, TOKENS_AT_ONCE):
                    new = expected_counts(model, some)
                    sums = new if sums is None else tuple(a + b for a, b in zip(sums, new))
                held, tokens = [], 0

            for batch in batches:
                for x in batch.column(0).to_pylist():
                    held.append(np.frombuffer(x, "<u2"))
                    tokens += len(held[-1])
                    if tokens >= TOKENS_SORTED:
                        add()
            add()
            if sums is not None:
                flat = np.concatenate([x.ravel() for x in sums])
                there = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(flat[there])], names=["k", "v"])

        flat = np.zeros(states + states * states + states * n_classes)
        for row in coded.select("classes").mapInArrow(counted, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().itertuples():
            flat[row.k] = row.v
        shared.unpersist()
        first, moves, emits = np.split(flat, [states, states + states * states])
        hmm = hmm.restimated(first, moves.reshape(states, states), emits.reshape(states, n_classes), prior)
    return hmm


def encode(docs: DataFrame, frequent: list[bytes], counts: np.ndarray) -> DataFrame:
    """Rows with class sequences, sums over the held words, and the other words.

    docs: (row, id, held_out, text); `counts` go with `frequent`, the end token among them.
    """
    kind = docs.schema["id"].dataType.simpleString()
    values = np.concatenate([np.log10(counts + 1.0), np.zeros(ENDINGS)])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(frequent)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                split = [[*words_of(text), END] for text in batch.column(2).to_pylist()]
                n = np.array([len(words) for words in split])
                begins = np.cumsum(n) - n
                own = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), np.int64, n.sum())
                classes, logs, known = codes.classes[own], values[own], own < codes.held
                packed = [classes[b : b + k].tobytes() for b, k in zip(begins.tolist(), n.tolist())]
                rare: list[list[bytes]] = [[] for _ in split]
                others = np.flatnonzero(~known)
                doc = np.searchsorted(begins, others, "right") - 1
                for d, k in zip(doc.tolist(), (others - begins[doc]).tolist()):
                    rare[d].append(split[d][k])
                sums = [np.add.reduceat(x, begins) for x in (known.astype(np.int64), logs, np.where(classes >= OWN, logs, 0.0))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n), *map(pa.array, sums), pa.array(packed, pa.binary()), pa.array(rare, pa.list_(pa.binary()))],
                    names=["id", "held_out", "n_tokens", "known", "held_log", "ending_log", "classes", "rare"],
                )

    out = f"id {kind}, held_out boolean, n_tokens long, known long, held_log double, ending_log double, classes binary, rare array<binary>"
    # the number is made before the rows are written, so it stays what it is
    return docs.select("id", "held_out", "text").mapInArrow(encoded, out).withColumn("row", F.monotonically_increasing_id())


def likelihoods(coded: DataFrame, hmm: Hmm, class_logs: np.ndarray) -> DataFrame:
    """log10 of the class sequences' likelihoods, less the class totals that words are divided by."""
    shared = coded.sparkSession.sparkContext.broadcast((hmm, class_logs))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs = shared.value
        for batch in batches:
            packed, out = batch.column(5).to_pylist(), []
            ends = np.cumsum([len(x) // 2 for x in packed])
            low = 0
            while low < len(packed):  # so many tokens at once, or one text
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOKENS_AT_ONCE, "right")))
                sequences = [np.frombuffer(x, "<u2") for x in packed[low:high]]
                low = high
                found = log_likelihoods(model, sequences) / np.log(10)
                out.append(found - [logs[s].sum() for s in sequences])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(np.concatenate(out) if out else [], pa.float64()), batch.column(6)], names=[*batch.schema.names[:5], "chain", batch.schema.names[6]])

    names = ["row", "id", "held_out", "n_tokens", "known", "classes", "held_log"]
    kind = coded.schema["id"].dataType.simpleString()
    asked = coded.select(*names, (F.col("ending_log")).alias("ending_log"))
    asked = asked.select("row", "id", F.col("held_out"), "n_tokens", "known", "classes", F.struct("held_log", "ending_log").alias("logs"))
    return asked.mapInArrow(scored, f"row long, id {kind}, held_out boolean, n_tokens long, known long, chain double, logs struct<held_log:double,ending_log:double>")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Scores of every row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those not held out (`held_out_column`); all of them are counted and trained
    on, as whole sequences. Tokens are the words, A-Z lower-cased, and one end; null and empty texts are an end alone.
    base_score adds log10((c + 1) / (N + V + 1)); score is the model's log10 probability. Repeated
    rows are counted and scored as they come. Without training rows every token is unknown. What
    driver and tasks hold is bounded by OWN, ENDINGS, HELD_WORDS and `states`; counts of all other words
    are joined to the texts' words, which are no hot keys, as each is rarer than HELD_WORDS others.
    """
    asked = docs.select(F.col(id_col).alias("id"), held_out_column(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.write(count_words(asked.where("not held_out")), "vocabulary")
    top = held_words(vocabulary)
    frequent, counts = [bytes(w) for w in top.word], top.c.to_numpy(np.int64) if len(top) else np.zeros(0, np.int64)
    tokens, distinct = (x or 0 for x in vocabulary.agg(F.sum("c"), F.count("*")).first())
    class_counts, class_words = class_totals(vocabulary, frequent)
    coded = scratch.write(encode(asked, frequent, counts), "coded")
    hmm = train(coded.where("not held_out"), class_counts + 1e-6, states, rounds, seed)
    class_logs = np.zeros(OWN + ENDINGS)
    class_logs[OWN:] = np.log10(class_counts[OWN:] + class_words[OWN:] + 1)
    scored = likelihoods(coded, hmm, class_logs)
    rare = coded.select("row", F.explode("rare").alias("word")).join(vocabulary, "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("rare_log"), F.count("*").alias("rare_known"))
    joined = scored.join(rare, "row", "left")
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0).cast("long"))
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + rare_known).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs.held_log") + rare_log - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))).alias("base_score"),
        (F.col("chain") + F.col("logs.ending_log") + rare_log).alias("score"),
    )


def held_words(vocabulary: DataFrame):
    """The HELD_WORDS most frequent words, ties by the word, as pandas rows in order; always with the end token.

    Taken by steps of a logarithmic histogram of the counts: whole steps as they come, the rest from the next one, sorted.
    So only what is held goes to the driver, and only one step is sorted.
    """
    step, is_end = F.floor(F.log2("c") * 16), F.length("word") == 0
    steps = sorted(((r.step, r.n) for r in vocabulary.where(~is_end).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    whole, rest, left = None, None, HELD_WORDS - 1
    for value, n in steps:
        if n > left:
            rest = value
            break
        whole, left = value, left - n
    held = vocabulary.where(is_end if whole is None else (step >= whole) | is_end)
    if rest is not None and left:
        held = held.unionByName(vocabulary.where((step == rest) & ~is_end).orderBy(F.desc("c"), "word").limit(left))
    return held.toPandas().sort_values(["c", "word"], ascending=[False, True])


def class_totals(vocabulary: DataFrame, frequent: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each class."""

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(frequent)
        sums = np.zeros((2, OWN + ENDINGS), np.int64)
        for batch in batches:
            own = codes.classes[np.array([codes[w] for w in batch.column(0).to_pylist()], np.int64)]
            np.add.at(sums[0], own, batch.column(1).to_numpy())
            np.add.at(sums[1], own, 1)
        there = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[0][there]), pa.array(sums[1][there])], names=["k", "c", "words"])

    found = vocabulary.mapInArrow(classed, "k long, c long, words long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("words").alias("words")).toPandas()
    counts, words = np.zeros(OWN + ENDINGS), np.zeros(OWN + ENDINGS)
    counts[found.k.to_numpy(np.int64)], words[found.k.to_numpy(np.int64)] = found.c, found.words
    return counts, words


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_score": op10_lm_score}
