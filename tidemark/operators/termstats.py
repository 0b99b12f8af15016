"""Corpus statistics of terms kept up to date: deltas with tombstones, folded into one when they are many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

_PARTS = {"docs": "id {id}, terms array<string>, len long, gone boolean, batch long", "df": "term string, df long, batch long", "sums": "n long, known long, total long, batch long"}


def distinct_terms(docs: DataFrame) -> DataFrame:
    """(id, terms, len): each text's distinct terms and how many it has with repeats, null for no text; texts are cut once."""
    every = docs.select("id", T.terms(F.col("text")).alias("every"))  # of its own: an expression in two columns is worked out twice
    return every.select("id", F.array_distinct("every").alias("terms"), F.when(F.col("every").isNotNull(), F.size("every")).cast("long").alias("len"))


class TermStats:
    """Document frequencies and sums of a corpus in a folder, as the sum of the changes of all batches.

    A batch of changes writes the terms of its new texts, tombstones for what went, and what that adds to or takes from
    each term's documents. A batch is written to folders of its number, so a repeated one changes nothing.
    `compact` writes the current state as one batch into a new folder; `deltas` counts the batches.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path, id_type

    def _read(self, name: str, before: int | None = None) -> DataFrame:
        schema = _PARTS[name].format(id=self.id_type)
        self.spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{self.path}/{name}")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _write(self, name: str, rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def current(self, before: int | None = None) -> DataFrame:
        """(id, terms, len) of the documents that there are, each as its last batch has it."""
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("batch")))
        return self._read("docs", before).withColumn("__n", last).where("__n = 1 and not gone").select("id", "terms", "len")

    def apply(self, changed: DataFrame, gone: DataFrame, number: int) -> None:
        """Texts that are new or changed (id, text; ids are distinct) and ids (id) that went, as batch `number`, later than all before."""
        new = distinct_terms(changed).withColumn("gone", F.lit(False))
        none = gone.join(changed.select("id"), "id", "left_anti").select("id", F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("long").alias("len"), F.lit(True).alias("gone"))
        self._write("docs", new.unionByName(none.distinct()), number)
        new = self._read("docs").where(F.col("batch") == number)
        old = self.current(before=number).join(new.select("id"), "id", "left_semi")
        signed = new.where("not gone").select("terms", "len", F.lit(1).alias("sign")).unionByName(old.select("terms", "len", F.lit(-1).alias("sign")))
        each = signed.select(F.explode("terms").alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df"))
        self._write("df", each.where("df <> 0"), number)
        sums = signed.agg(F.sum("sign"), F.sum(F.when(F.col("len").isNotNull(), F.col("sign"))), F.sum(F.col("len") * F.col("sign")))
        self._write("sums", sums.toDF("n", "known", "total").select(*(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "known", "total"))), number)

    def stats(self) -> DataFrame:
        """(term, df, n, avg_len) of all terms that some document has."""
        df = self._read("df").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        one = self._read("sums").agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("known")).alias("avg_len"))
        return df.crossJoin(F.broadcast(one))

    def deltas(self) -> int:
        return self._read("sums").select("batch").distinct().count()

    def compact(self, path: str, most: int = 8) -> TermStats:
        """These statistics, in one batch in a new folder if they have more than `most`."""
        if self.deltas() <= most:
            return self
        new = TermStats(self.spark, path, self.id_type)
        number = self._read("sums").agg(F.max("batch")).first()[0]
        new._write("docs", self.current().withColumn("gone", F.lit(False)), number)
        new._write("df", self._read("df").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), number)
        new._write("sums", self._read("sums").agg(*(F.sum(c).alias(c) for c in ("n", "known", "total"))), number)
        return new


def rebuilt(docs: DataFrame) -> DataFrame:
    """The same statistics from all texts (id, text)."""
    terms = T.terms(F.col("text"))
    df = docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"), F.avg(F.size(terms)).alias("avg_len"))))

