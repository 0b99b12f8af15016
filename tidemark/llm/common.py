"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.folders import shared_folder

#: Bytes that separate words: space and tab to carriage return.
WORD_SEPARATORS = " \t\n\x0b\f\r"

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables of one job, which go when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((table, path))
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        self._drop(lambda t: any(t is x for x in tables))

    def drop_but(self, *tables: DataFrame | None) -> None:
        """Drop all but these."""
        self._drop(lambda t: not any(t is x for x in tables))

    def _drop(self, goes) -> None:
        context = self.spark.sparkContext
        for table, path in self.held:
            if goes(table):
                folder = context._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        self.held = [(t, p) for t, p in self.held if not goes(t)]


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    path = public_tokenizers.path(name)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the words that a task sees again and again.

    Emptied when it holds `bound` words, so that memory stays bounded; results don't depend on it.
    """

    def __init__(self, bound: int = 250_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; null has none."""
    return text.lower().split() if text else []


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, in order; a shorter, non-empty sequence counts as one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, size)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
        for k in range(width):
            h = (h ^ hashes[k : n - width + 1 + k]) * _FOLD
            h ^= h >> np.uint64(29)
    return mix64(h)
