"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line has yes/no features and a label; neighbouring labels have weights of their own. Viterbi decoding
gives the best labels of every line of a document, and the share of its words that stand in content
lines decides whether it stays. The field is fitted on a bounded sample of labelled documents whose
lines have no labels: lines that several of them share are boilerplate, the labels of the others are
found in turn with the field (`fit_field`), where a document's label binds its content share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_SEPARATORS, WordHashes, read_table, shingles

SYMBOLS = "#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1
KNOWN = 16  # the bit of known lines
FEATURES = 17
#: Words in content lines that keep a document, as a share of all.
SHARE = 0.5
#: Sampled documents that make a line a known one, and rounds that label the sample's lines anew.
SHARED_BY, RELABELLINGS = 5, 2
#: Labelled documents that the field is fitted on, at most.
MAX_LABELLED = 4000
_NOTICE = re.compile(r"(?i)copyright|all rights reserved|licen[sc]ed|cookie|subscribe|sign in|log in|click here|terms of (?:use|service)|privacy policy")
_SYMBOL = re.compile("[#*$%&|<>]")
_SENTENCE_END = tuple(".!?:;\"'»”)")


def line_key(line: str) -> int:
    """A hash of a line without the white space at its ends."""
    return xxhash.xxh3_64_intdigest(line.strip(WORD_SEPARATORS)) - (1 << 63)


def line_features(line: str, repeated: bool, known: bool = False) -> int:
    """Yes/no features of a line as bits; bit 0 is always set. known: several documents have the line."""
    words = line.split()
    n = len(words)
    if not n:
        return 1 | 1 << 1 | known << KNOWN
    chars = len(line)
    symbols = len(_SYMBOL.findall(line))
    upper = sum(map(str.isupper, words))
    tail = words[-1]
    return (
        1
        | (n < 4) << 2
        | (n > 40) << 3
        | (symbols * 20 > chars) << 4
        | (symbols * 5 > n) << 5
        | (line.count("|") * 6 > n) << 6
        | (upper * 2 > n) << 7
        | (line.count("!") * 4 > n) << 8
        | (not tail.endswith(_SENTENCE_END)) << 9
        | (sum(map(str.isdigit, line)) * 5 > chars) << 10
        | bool(_NOTICE.search(line)) << 11
        | ("http" in line or "www." in line) << 12
        | (len(set(words)) * 2 < n) << 13
        | repeated << 14
        | (not 2 * n <= chars - line.count(" ") <= 12 * n) << 15
        | known << KNOWN
    )


@dataclass
class Field:
    """Weights of features by label, of label pairs, and of first labels; keys of known lines."""

    features: np.ndarray  # (FEATURES, 2)
    pairs: np.ndarray  # (2, 2)
    first: np.ndarray  # (2,)
    known: frozenset[int] = frozenset()

    def line_score(self, bits: int) -> tuple[float, float]:
        on = [k for k in range(FEATURES) if bits >> k & 1]
        content, boilerplate = self.features[on].sum(axis=0).tolist()
        return content, boilerplate


class Decoder:
    """Viterbi decoding, with the scores of feature sets kept (there are 2 ** FEATURES at most)."""

    def __init__(self, field: Field):
        self.field, self.kept = field, {}
        (self.cc, self.cb), (self.bc, self.bb) = field.pairs.tolist()
        self.first = field.first.tolist()

    def labels(self, lines: list[int], lean: list[float] | None = None) -> list[int]:
        """The best labels; `lean` adds to each line's score as content."""
        if not lines:
            return []
        kept, back = self.kept, []
        content, boilerplate = self.first
        for k, bits in enumerate(lines):
            own = kept.get(bits)
            if own is None:
                own = kept[bits] = self.field.line_score(bits)
            if k:
                to_c, to_b = content + self.cc, content + self.cb
                other_c, other_b = boilerplate + self.bc, boilerplate + self.bb
                back.append((to_c < other_c, to_b < other_b))
                content, boilerplate = max(to_c, other_c), max(to_b, other_b)
            content, boilerplate = content + own[0] + (lean[k] if lean else 0.0), boilerplate + own[1]
        label = int(boilerplate > content)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit(sequences: list[list[int]], labels: list[list[int]], rounds: int = 60, rate: float = 0.5, keep: float = 1e-3, start: Field | None = None) -> Field:
    """Weights by gradient ascent on the mean conditional log likelihood of the labels, with shrinkage; `start` is where to begin.

    Sequences run in lockstep, longest first, so that a round costs as many numpy steps as the longest has lines.
    """
    order = sorted((k for k in range(len(sequences)) if sequences[k]), key=lambda k: -len(sequences[k]))
    field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)) if start is None else Field(start.features.copy(), start.pairs.copy(), start.first.copy())
    if not order:
        return field
    lengths = np.array([len(sequences[k]) for k in order])
    steps, total = lengths[0], lengths.sum()
    active = [int((lengths > t).sum()) for t in range(steps)]
    bits = [np.array([sequences[k][t] for k in order[: active[t]]]) for t in range(steps)]
    x = [(b[:, None] >> np.arange(FEATURES) & 1).astype(float) for b in bits]
    y = [np.array([labels[k][t] for k in order[: active[t]]]) for t in range(steps)]
    seen_f = sum(a.T @ np.eye(2)[c] for a, c in zip(x, y))
    seen_p = sum((np.eye(2)[y[t - 1][: active[t]]].T @ np.eye(2)[y[t]] for t in range(1, steps)), np.zeros((2, 2)))
    seen_s = np.eye(2)[y[0]].sum(axis=0)
    speed = [np.zeros_like(p) for p in (field.features, field.pairs, field.first)]
    for _ in range(rounds):
        own = [a @ field.features for a in x]
        forward = [own[0] + field.first]
        for t in range(1, steps):
            before = forward[-1][: active[t]]
            forward.append(own[t] + np.logaddexp(before[:, :1] + field.pairs[0], before[:, 1:] + field.pairs[1]))
        backward = [np.zeros_like(f) for f in forward]
        want_p = np.zeros((2, 2))
        z = np.zeros(len(order))
        for t in range(steps):
            ended = slice(active[t + 1] if t + 1 < steps else 0, active[t])
            z[ended] = np.logaddexp(forward[t][ended, 0], forward[t][ended, 1])
        for t in range(steps - 1, 0, -1):
            n = active[t]
            after = own[t] + backward[t]
            both = forward[t - 1][:n, :, None] + field.pairs[None] + after[:, None, :] - z[:n, None, None]
            want_p += np.exp(both).sum(axis=0)
            backward[t - 1][:n] = np.logaddexp(field.pairs[:, 0] + after[:, :1], field.pairs[:, 1] + after[:, 1:])
        share = [np.exp(f + b - z[: len(f), None]) for f, b in zip(forward, backward)]
        want_f = sum(a.T @ s for a, s in zip(x, share))
        slopes = (seen_f - want_f) / total, (seen_p - want_p) / total, (seen_s - share[0].sum(axis=0)) / total
        for p, v, slope in zip((field.features, field.pairs, field.first), speed, slopes):
            v *= 0.9
            v += rate * (slope - keep * p)
            p += v
    return field


def lines_with_words(text: str) -> tuple[list[str], list[bool], int]:
    """Lines that have a word, whether each equals an earlier one, and how many do."""
    seen, lines, repeated = set(), [], []
    for line in text.split("\n"):
        if line.strip(WORD_SEPARATORS):
            lines.append(line)
            repeated.append(line in seen)
            seen.add(line)
    return lines, repeated, sum(repeated)


def repeat_words(hashes: np.ndarray, size: int = 3) -> int:
    """Words that lie in some window of `size` words found twice or more."""
    if len(hashes) < size + 1:
        return 0
    _, which, counts = np.unique(shingles(hashes, size), return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(hashes), bool)
    for k in range(size):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


class Judge:
    """Counts and verdict of one text at a time."""

    def __init__(self, field: Field, share: float):
        self.decoder, self.share, self.hashes, self.known = Decoder(field), share, WordHashes(), field.known

    def __call__(self, text: str | None) -> tuple[int, int, int, int, int, bool, bool, int | None, int | None]:
        text = text or ""
        words = text.encode().split()
        n = len(words)
        chars = len(text) - sum(map(text.count, WORD_SEPARATORS))
        lines, repeated, n_repeated = lines_with_words(text)
        repeats = repeat_words(self.hashes.of(words))
        failed = n < 50 or 100 * repeats > 50 * n
        kept, n_content = False, None
        if not failed:
            labels = self.decoder.labels([line_features(x, r, line_key(x) in self.known) for x, r in zip(lines, repeated)])
            own = [x for x, label in zip(lines, labels) if label == CONTENT]
            kept, n_content = sum(len(x.encode().split()) for x in own) >= self.share * n, len(own)
        return n, chars, sum(map(text.count, SYMBOLS)), n_repeated, repeats, failed, kept, None if failed else len(lines), n_content


@dataclass
class Sampled:
    """A labelled document: whether it is good; features, words and key of its lines."""

    good: bool
    bits: list[int]
    words: list[int]
    keys: list[int]


def sample_lines(docs: DataFrame, labels: DataFrame, max_labelled: int) -> list[Sampled]:
    """The lines of at most `max_labelled` labelled documents chosen by hash."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    wanted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], []]
            for text in batch.column(1).to_pylist():
                lines, repeated, _ = lines_with_words(text or "")
                cols[0].append([line_features(x, r) for x, r in zip(lines, repeated)])
                cols[1].append([len(x.encode().split()) for x in lines])
                cols[2].append([line_key(x) for x in lines])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.list_(pa.int64())) for c in cols)], names=["doc_id", "quality", "bits", "words", "keys"])

    kind = wanted.schema["doc_id"].dataType.simpleString()
    rows = wanted.mapInArrow(featured, f"doc_id {kind}, quality int, bits array<long>, words array<long>, keys array<long>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.bits))
    return [Sampled(r.quality != 0, r.bits, r.words, r.keys) for r in rows]


def labels_within(decoder: Decoder, doc: Sampled, share: float) -> list[int]:
    """The best labels under the document's label: content is `share` of a good document's words at least, less of a bad one's.

    Known lines stay boilerplate. Where the best labels break the bound, content gains or loses by the
    word until they keep it.
    """
    known = [-1e6 * (bits >> KNOWN & 1) for bits in doc.bits]
    free = sum(w for w, bits in zip(doc.words, doc.bits) if not bits >> KNOWN & 1)
    need = share * min(sum(doc.words), free) if doc.good else share * sum(doc.words)

    def within(lean: float) -> tuple[list[int], bool]:
        labels = decoder.labels(doc.bits, [k + lean * w for k, w in zip(known, doc.words)])
        content = sum(w for w, label in zip(doc.words, labels) if label == CONTENT)
        return labels, content >= need if doc.good else content < need or not sum(doc.words)

    labels, right = within(0.0)
    low, high = 0.0, 8.0 if doc.good else -8.0
    if not right:
        labels, right = within(high)
        if not right:
            return [CONTENT if doc.good and not bits >> KNOWN & 1 else BOILERPLATE for bits in doc.bits]
        for _ in range(8):
            middle = (low + high) / 2
            found, right = within(middle)
            if right:
                labels, high = found, middle
            else:
                low = middle
    return labels


def fit_field(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, share: float = SHARE) -> Field:
    """The field of a sample of labelled documents, and the lines that SHARED_BY of them or more have.

    At first all lines of good documents count as content, those of bad ones and known lines as
    boilerplate. Then, RELABELLINGS times, the field labels the lines itself, with the share of content
    bound by the document's label (`labels_within`), and is fitted on these labels.
    """
    sample = sample_lines(docs, labels, max_labelled)
    holders = Counter(k for doc in sample for k in set(doc.keys))
    known = frozenset(k for k, n in holders.items() if n >= SHARED_BY)
    for doc in sample:
        doc.bits = [bits | (k in known) << KNOWN for bits, k in zip(doc.bits, doc.keys)]
    sequences = [doc.bits for doc in sample]
    field = fit(sequences, [[CONTENT if doc.good and not bits >> KNOWN & 1 else BOILERPLATE for bits in doc.bits] for doc in sample])
    for _ in range(RELABELLINGS):
        decoder = Decoder(field)
        field = fit(sequences, [labels_within(decoder, doc, share) for doc in sample], rounds=30, start=field)
    return replace(field, known=known)


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long"


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Counts and verdict of every row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    n_lines and n_content_lines count the lines with words, and those of them labelled content; they are
    null where the base rules fail. Null and empty texts have no words and fail the base rules; rows that
    repeat are judged alike; null ids are kept as they come. A narrow map over whole texts, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge_text = Judge(field, share)
        for batch in batches:
            rows = [judge_text(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.bool_() if k in (5, 6) else pa.int64()) for k in range(9)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *(c.split()[0] for c in _OUT.split(", "))])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judged, f"id {kind}, {_OUT}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, field: Field, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns as they were."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge_text = Judge(field, share)
        for batch in batches:
            yield batch.filter(pa.array([judge_text(t)[6] for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, fit_field(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality_rules": op8_quality_rules}
