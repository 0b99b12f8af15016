"""Tables laid out by day or by longer spans: retention that drops whole spans, with guards that read counts alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.stores import MOST_EXPIRED
from tidemark.sources.folders import shared_folder


#: Partitions that one append makes at most, as long as a coarser span is left.
MOST_SPANS = 200
#: Characters of an ISO day that name a span: days, months, years, decades, centuries, millennia.
SPANS = (10, 7, 4, 3, 2, 1)


def _span(day: Column, size: int) -> Column:
    return F.when(day == "none", day).otherwise(F.substring(day, 1, size))


def _named(span: str) -> str:
    return "day = '" + span.replace("\\", "\\\\").replace("'", "\\'") + "'"


class DayTable:
    """A table of the session's catalog, partitioned by time, and one with its rows a day beside it.

    A partition is a day, or where an append has more than MOST_SPANS of them, the first span of SPANS that it has fewer
    of: its name `day` is what its days begin with. Rows without a time stand under the day `none` and never expire. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, name: str, time_col: str):
        self.spark, self.name, self.counts_name, self.time_col = spark, name, f"{name}_days", time_col

    def _day(self) -> Column:
        return F.coalesce(F.nullif(F.substring(F.col(self.time_col), 1, 10), F.lit("")), F.lit("none"))

    def _aside(self, rows: DataFrame) -> DataFrame:
        """Rows as written into a folder of their own."""
        path = shared_folder(self.spark, "days")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _own(self, day: str) -> DataFrame:
        """Rows of a day with the names of their spans."""
        spans = [day] if day == "none" else sorted({day[:k] for k in SPANS})
        return self.spark.table(self.name).where(F.col("day").isin(spans) & (self._day() == day))

    def append(self, rows: DataFrame) -> None:
        new = self._aside(rows)  # written once: counts and rows are the same
        counts = self._aside(new.groupBy(self._day().alias("day")).agg(F.count("*").alias("n")))
        spans = counts.agg(*(F.countDistinct(_span(F.col("day"), k)) for k in SPANS)).first()
        size = next((k for k, n in zip(SPANS, spans) if n <= MOST_SPANS), SPANS[-1])
        new.withColumn("day", _span(self._day(), size)).write.mode("append").partitionBy("day").format("parquet").saveAsTable(self.name)
        counts.select("day", "n", _span(F.col("day"), size).alias("span")).write.mode("append").format("parquet").saveAsTable(self.counts_name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("day")

    def counts(self) -> DataFrame:
        """(day, n); a row a day."""
        return self.spark.table(self.counts_name).groupBy("day").agg(F.sum("n").alias("n"))

    def of_day(self, day: str) -> DataFrame:
        """Rows of a day; of the table its spans alone are read."""
        return self._own(day).withColumn("day", self._day())

    def expire(self, cutoff: str, least: int, most: float = MOST_EXPIRED) -> tuple[int, int, str]:
        """(rows before, expired rows, state): rows before the cutoff go, unless the table is small or too many would.

        Guards read the counts, and of the rows only the cutoff's own spans. Earlier spans are dropped as partitions; the
        cutoff's are written anew if some of their rows go.
        """
        day = cutoff[:10]
        if not set(day) <= set("0123456789-"):
            raise ValueError("the cutoff must be an ISO time")
        late = F.col(self.time_col) < cutoff
        partly = {r.day: r["count"] for r in self._own(day).where(late).groupBy("day").count().collect()}  # a row a span
        early = (F.col("day") != "none") & (F.col("day") < day)
        counts = self.spark.table(self.counts_name)
        by_span = {r.span: (r.n, r.early + partly.get(r.span, 0)) for r in counts.groupBy("span").agg(F.sum("n").alias("n"), F.sum(F.when(early, F.col("n")).otherwise(0)).alias("early")).collect()}
        total, expired = (sum(x[k] for x in by_span.values()) for k in range(2))
        if total <= least:
            return total, expired, "skipped"
        if not expired:
            return total, 0, "nothing"
        if expired / total > most:
            return total, expired, "blocked"
        left = counts.where(~early).groupBy("day", "span").agg(F.sum("n").alias("n"))
        gone = F.coalesce(F.create_map(*(F.lit(x) for item in partly.items() for x in item))[F.col("span")], F.lit(0)) if partly else F.lit(0)
        left = left.select("day", (F.col("n") - F.when(F.col("day") == day, gone).otherwise(0)).alias("n"), "span").where("n > 0")
        left = self._aside(left)
        for span in sorted(s for s, (n, k) in by_span.items() if 0 < k < n):
            kept = self._aside(self.spark.table(self.name).where((F.col("day") == span) & ~late).drop("day"))  # a table can't be read and overwritten at once
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION ({_named(span)}) SELECT * FROM {{kept}}", kept=kept)
        if old := sorted(s for s, (n, k) in by_span.items() if k == n):
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS " + ", ".join(f"PARTITION ({_named(s)})" for s in old))
        left.write.mode("overwrite").format("parquet").insertInto(self.counts_name)
        return total, expired, "deleted"
