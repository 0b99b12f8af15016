"""Model and embedding steps that the user supplies, run in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.search import normalised, usable

BATCH = 256


def embed(rows: DataFrame, id_col: str, text_col: str, embedder: Callable[[list[str]], np.ndarray], max_chars: int = 5000) -> DataFrame:
    """(id, embedding) of all rows: texts cut to what the embedder takes, at most BATCH a call, vectors cleaned and of length 1."""
    kind = rows.schema[id_col].dataType.simpleString()
    asked = rows.select(F.col(id_col).alias("id"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, max_chars).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), BATCH):
                some = frame.iloc[low : low + BATCH]
                yield pd.DataFrame({"id": some["id"], "v": list(np.asarray(embedder(some["text"].tolist()), dtype=float))})

    return asked.mapInPandas(run, f"id {kind}, v array<double>").select(F.col("id").alias(id_col), normalised(F.col("v")).alias("embedding"))


def fill_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows with vectors that came later; unusable vectors and those of rows that are gone are ignored."""
    late = vectors.where(usable(F.col("embedding"))).select(key, F.col("embedding").alias("__late"))
    return rows.join(late, key, "left").withColumn("embedding", F.coalesce("__late", "embedding")).drop("__late")


def run_model(batches: DataFrame, text_col: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """`batches` with `raw`, the model's answer to each text."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in batches.schema)}, raw string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(raw=model(frame[text_col].tolist()))

    return batches.mapInPandas(run, schema)
