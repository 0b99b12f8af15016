"""A fast token estimate by classes of characters, over whole batches of texts at once.

Texts are taken as UTF-16 units, as the coefficients are meant: a character outside the basic plane is
two units of no class. Letters of one script and digits form runs; all else counts by the unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of units by their ranges, and what they cost.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)),
    "han": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF)),
    "kana": ((0x3040, 0x30FF),),
    "hangul": ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)),
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "digits": ((0x30, 0x39),),
    "line": ((0x0A, 0x0A), (0x0D, 0x0D)),
    "wide": ((0x3000, 0x303F), (0xFF00, 0xFFEF), (0x2018, 0x2019), (0x201C, 0x201D), (0x2026, 0x2026), (0x2013, 0x2014)),
    "sign": ((0x21, 0x7E),),
    "other": ((0x80, 0xFFFF),),
}
PER_UNIT = {"hangul": 1.4, "cyrillic": 0.55, "arabic": 0.82, "greek": 0.85, "line": 1.0, "wide": 1.0, "sign": 0.6, "other": 2.5}
ENGLISH = ((4, 1.0), (8, 1.1), (13, 1.5))
ENGLISH_MORE = 0.3
ACCENTED = ((3, 1.0), (5, 1.35), (7, 1.85), (9, 2.5), (12, 3.2))
ACCENTED_MORE = 0.32
KANA, KANA_MORE = (1.0, 1.6, 2.65, 3.7), 0.93  # by length, and a unit of runs of five and six
KANA_LONG = 0.95
HAN, HAN_TWO, HAN_FOUR = 1.3, 0.97, 0.94
SAMPLE, WINDOW = 50_000, 100

_NAMES = ["", *RANGES]
_RUNS = ("latin", "han", "kana", "digits")
_CLASS = np.zeros(1 << 16, np.uint8)
for _k, _name in reversed(list(enumerate(RANGES, 1))):  # the first that fits counts
    for _low, _high in RANGES[_name]:
        _CLASS[_low : _high + 1] = _k
_PLAIN, _ACCENT = ((_CLASS == 1) & (x == (np.arange(1 << 16) < 0x80)) for x in (True, False))
_OF = {name: k for k, name in enumerate(_NAMES)}
_COST = np.array([PER_UNIT.get(name, 0.0) for name in _NAMES])
_GAP = 2 * WINDOW + 2


def _by_length(n: np.ndarray, steps: tuple, more: float) -> np.ndarray:
    most, cost = (np.array(x, float) for x in zip(*steps))
    at = np.searchsorted(most, n)
    return np.where(at < len(most), cost[np.minimum(at, len(most) - 1)], cost[-1] + (n - most[-1]) * more)


def _kana(n: np.ndarray) -> np.ndarray:
    return np.where(n <= len(KANA), np.array(KANA)[np.minimum(n, len(KANA)) - 1], np.where(n <= 6, n * KANA_MORE, n * KANA_LONG))


def estimates(texts: list[str | None]) -> np.ndarray:
    """Tokens that each text is likely to have; 0 for none, 1 at least otherwise."""
    raw = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts]
    n = np.array([len(r) // 2 for r in raw], np.int64)
    units = np.frombuffer((b"\0\0" * _GAP).join([*raw, b""]), "<u2") if raw else np.zeros(0, "<u2")
    begins = np.cumsum(n + _GAP) - n - _GAP
    kind = _CLASS[units]
    latin, digits = _OF["latin"], _OF["digits"]

    def joined(at: np.ndarray, of: int) -> None:
        """Signs between two units of a class belong to its run."""
        at = at[(at > 0) & (at < len(units) - 1)]
        kind[at[(kind[at - 1] == of) & (kind[at + 1] == of)]] = of

    commas, dots = np.flatnonzero(units == 0x2C), np.flatnonzero(units == 0x2E)
    joined(np.flatnonzero(units == 0x27), latin)
    joined(np.concatenate([commas, dots]), digits)
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edge = np.concatenate([[0], edge, [len(kind)]]) if len(kind) else np.zeros(1, np.int64)
    first, size = edge[:-1], np.diff(edge)
    of_run = kind[first] if len(first) else kind[:0]
    cost = _COST[of_run] * size
    cost += _latin(units, n, begins, first, size, of_run == latin)
    for name, by in (("han", lambda k: HAN * k * np.where(k >= 4, HAN_FOUR, np.where(k >= 2, HAN_TWO, 1.0))), ("kana", _kana)):
        own = of_run == _OF[name]
        cost[own] = by(size[own])
    own = np.flatnonzero(of_run == digits)
    commas, dots = (np.searchsorted(x, first[own] + size[own]) - np.searchsorted(x, first[own]) for x in (commas, dots))
    plain = size[own] - commas - dots
    cost[own] = np.where(commas > 0, commas * 2 + 1.0, np.where(dots > 0, np.maximum(2.0, plain / 3 + dots * 1.5), np.where(plain <= 3, 1.0, plain / 2.5)))
    # whole millionths, so that the order of adding up decides no half
    total = np.bincount(np.searchsorted(begins, first, "right") - 1, np.rint(cost * 1e6), len(raw)) if len(first) else np.zeros(len(raw))
    return np.where(n > 0, np.maximum(1, (total.astype(np.int64) + 500_000) // 1_000_000), 0)


def _latin(units: np.ndarray, n: np.ndarray, begins: np.ndarray, first: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Costs of the runs of Latin letters: dearer near accents, where a text has enough of them."""
    out = np.zeros(len(first))
    places = np.flatnonzero(_ACCENT[units])
    if not len(places):
        out[own] = _by_length(size[own], ENGLISH, ENGLISH_MORE)
        return out
    heads = begins + np.minimum(n, SAMPLE)
    accents = np.searchsorted(places, heads) - np.searchsorted(places, begins)
    # every text has units after it, so that each pair of bounds is a range
    letters = np.add.reduceat(_PLAIN[units], np.stack([begins, heads], 1).ravel(), dtype=np.int64)[::2] * (n > 0)
    foreign = (letters > 100) & (accents > letters * 0.005)
    doc = np.searchsorted(begins, first[own], "right") - 1
    after = np.searchsorted(places, first[own] - WINDOW)
    there = np.append(places, np.int64(1) << 62)[after] < first[own] + size[own] + WINDOW
    out[own] = np.where(there & foreign[doc], _by_length(size[own], ACCENTED, ACCENTED_MORE), _by_length(size[own], ENGLISH, ENGLISH_MORE))
    return out


def estimate(text: str | None) -> int:
    return int(estimates([text])[0])


def estimate_tokens(c: Column) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.concatenate([estimates(s.iloc[k : k + 256].tolist()) for k in range(0, len(s), 256)] or [np.zeros(0, np.int64)]))

    return run(F.coalesce(c, F.lit("")))
