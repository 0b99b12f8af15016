"""Table functions for SQL users, registered on a session: they take a table argument with PARTITION BY and ORDER BY."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import regex
from pyspark.sql import Row, SparkSession
from pyspark.sql.types import ArrayType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidemark.functions.text import FOLD_FROM, FOLD_TO

_TERM, _FOLD = regex.compile(r"[\p{L}\p{N}]+"), str.maketrans(FOLD_FROM, FOLD_TO)


def _needs(argument: AnalyzeArgument, *names: str) -> StructType:
    if not argument.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    kinds = argument.dataType
    missing = [n for n in names if n not in kinds.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return kinds


class IndexTerms:
    """index_terms(TABLE(id, text)): (id, term, tf, len), a row for each term of each text."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        kinds = _needs(table, "id", "text")
        return AnalyzeResult(StructType().add("id", kinds["id"].dataType).add("term", StringType()).add("tf", LongType()).add("len", LongType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        terms = _TERM.findall((row["text"] or "").lower().translate(_FOLD))
        for term, tf in Counter(terms).items():
            yield row["id"], term, tf, len(terms)


class CanvasBudget:
    """canvas_budget(TABLE(agent, filename, full, short) PARTITION BY (agent) ORDER BY (filename DESC), budget): (agent, used, chosen).

    Rows of a partition come one after the other: a canvas is taken in full where it fits in what is left of the budget,
    else in short form where that fits. chosen tells the files in the opposite order, short ones with `(meta)`.
    """

    def __init__(self):
        self.agent, self.used, self.chosen, self.there = None, 0, [], False

    @staticmethod
    def analyze(table: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        kinds = _needs(table, "agent", "filename", "full", "short")
        if budget.value is None or budget.value < 0:
            raise ValueError("the budget must be a constant of 0 or more")
        return AnalyzeResult(StructType().add("agent", kinds["agent"].dataType).add("used", LongType()).add("chosen", ArrayType(StringType())))

    def eval(self, row: Row, budget: int) -> None:
        self.agent, self.there = row["agent"], True
        for size, form in ((row["full"], ""), (row["short"], "(meta)")):
            if self.used + size <= budget:
                self.used += size
                self.chosen.append(row["filename"] + form)
                break

    def terminate(self) -> Iterator[tuple]:
        if self.there:
            yield self.agent, self.used, self.chosen[::-1]


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, kind in (("index_terms", IndexTerms), ("canvas_budget", CanvasBudget)):
        spark.udtf.register(name, udtf(kind))
