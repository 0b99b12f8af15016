"""Streams with state that goes: sessions that are forgotten unless work is pending, vectors that come later, calls paired with results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.search import usable
from tidemark.streaming.capture import FORGET_MS

#: The state store that lists and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SESSION_ROWS = "session_key string, before long, ids array<long>, times array<long>"


class _Sessions(StatefulProcessor):
    """One session: its newest time, how many rows it has brought, of which `rows` % `n` wait for a batch of `n`, and its timer.

    A call to the state costs more than many rows, so a session reads and writes it once a micro-batch, hands on its new rows
    as one, and moves its timer when that is over half the time too early; else it is put off when it expires.
    """

    def __init__(self, n: int, forget_ms: int):
        self.n, self.forget_ms = n, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "newest long, rows long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest, count, timer = self.cursor.get() or (None, 0, None)
        new = [(r.timestamp, r.id) for r in rows if r.timestamp is not None and (newest is None or r.timestamp > newest)]
        if not new:
            return
        new.sort(key=lambda x: (x[0], x[1] is None, x[1]))
        due = new[-1][0] + self.forget_ms
        if timer is None or not 0 <= due - timer <= self.forget_ms // 2:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.cursor.update((new[-1][0], count + len(new), timer))
        yield Row(session_key=key[0], before=count, ids=[x[1] for x in new], times=[x[0] for x in new])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        newest, count, _ = self.cursor.get()
        due, now = newest + self.forget_ms, timerValues.getCurrentWatermarkInMs()
        if due <= now and count % self.n == 0:
            self.cursor.clear()
        else:  # newer rows have come, or work waits: the session stays, and is looked at again later
            timer = due if due > now else now + self.forget_ms
            self.handle.registerTimer(timer)
            self.cursor.update((newest, count, timer))
        return iter(())

    def close(self) -> None:
        pass


def session_rows(stream: DataFrame, n: int, forget_ms: int = FORGET_MS, late: str = "0 seconds") -> DataFrame:
    """(session_key, id, timestamp, place, batch): rows newer than all before of their session, numbered, `n` to a batch.

    stream: (session_key, id long, ts timestamp). In event time a session's state goes once the watermark has passed its
    newest row by `forget_ms`, unless rows wait for their batch to fill; a session that comes back after that starts anew.
    Rows without a time are left out.
    State is kept by RocksDB, so it may be larger than memory; rows of a session in one micro-batch are held together.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withWatermark("ts", late).withColumn("timestamp", F.unix_millis("ts"))
    packed = rows.groupBy("session_key").transformWithState(
        statefulProcessor=_Sessions(n, forget_ms), outputStructType=_SESSION_ROWS, outputMode="Append", timeMode="EventTime"
    )
    each = packed.select("session_key", "before", F.posexplode(F.arrays_zip("ids", "times")).alias("at", "row"))
    place = (F.col("before") + F.col("at")).alias("place")
    return each.select("session_key", F.col("row.ids").alias("id"), F.col("row.times").alias("timestamp"), place, F.floor(place / n).alias("batch"))


class VectorTable:
    """Rows that are written at once and their vectors, which come later, in folders by micro-batch.

    A batch is written to the folder of its number, replacing what a failed attempt has left there, so a repeated batch
    changes nothing. `rows()` shows the rows with the last usable vector of each; `compact` folds vectors into the rows.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, row_schema: str, vector_type: str = "array<double>"):
        self.spark, self.path, self.key = spark, path, key
        self.row_schema, self.vector_schema = row_schema, f"{key} {dict(c.split() for c in row_schema.split(', '))[key]}, embedding {vector_type}"

    def _write(self, batch: DataFrame, name: str, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def add_rows(self, batch: DataFrame, number: int) -> None:
        self._write(batch, "rows", number)

    def add_vectors(self, batch: DataFrame, number: int) -> None:
        """Vectors by key; unusable ones are left out."""
        self._write(batch.where(usable(F.col("embedding"))).select(self.key, "embedding"), "vectors", number)

    def writing(self, stream: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str):
        """A query that hands each micro-batch of `stream` with its number to `add_rows` or `add_vectors` until the input ends."""
        return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _read(self, name: str, schema: str) -> DataFrame:
        frame = self.spark.createDataFrame([], f"{schema}, batch long")
        frame.limit(0).drop("batch").withColumn("batch", F.lit(-1).cast("long")).write.mode("append").partitionBy("batch").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")

    def rows(self) -> DataFrame:
        """The rows, each with `embedding`, null as long as no usable one has come; vectors without a row are left out."""
        last = self._read("vectors", self.vector_schema).groupBy(self.key).agg(F.max_by("embedding", "batch").alias("embedding"))
        newest = Window.partitionBy(self.key).orderBy(F.desc("batch"))
        rows = self._read("rows", self.row_schema).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "batch")
        return rows.join(last, self.key, "left")


def paired_calls(calls: DataFrame, results: DataFrame, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(session_key, tool_call_id, called, answered, result): each call with its result, or with nulls once `wait` is over.

    calls: (session_key, tool_call_id, called timestamp); results: (session_key, tool_call_id, answered timestamp, result).
    Works alike on streams, as an outer join under both watermarks, and on tables. A result counts from its call to
    `wait` after it; what waits in the state is bounded by that time.
    """
    if calls.isStreaming:
        calls, results = calls.withWatermark("called", late), results.withWatermark("answered", late)
    c, r = calls.alias("c"), results.alias("r")
    met = (F.col("c.session_key") == F.col("r.session_key")) & (F.col("c.tool_call_id") == F.col("r.tool_call_id"))
    in_time = (F.col("r.answered") >= F.col("c.called")) & (F.col("r.answered") <= F.col("c.called") + F.expr(f"INTERVAL {wait}"))
    return c.join(r, met & in_time, "leftOuter").select("c.session_key", "c.tool_call_id", "called", "answered", "result")
