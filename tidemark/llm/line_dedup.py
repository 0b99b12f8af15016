"""Line dedup: drop lines that many documents share, but for one keeper of each.

DataFrame functions only. Normalised lines are exploded as 128-bit hashes and counted over distinct
documents; the few hashes over the threshold come back to their documents, whose lines are put
together again by position.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_SEPARATORS, Scratch, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(WORD_SEPARATORS))
    plain = F.octet_length(bare) == F.char_length(bare)  # lower() has a fast way for these and changes only A-Z
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashed(key: Column) -> Column:
    """128 bits from three unrelated functions."""
    second = F.shiftleft(F.hash(key).cast("long"), 32).bitwiseOR(F.crc32(key))
    return F.struct(F.xxhash64(key).alias("h1"), second.alias("h2"))


def _counting_lines(text: Column, min_chars: int) -> Column:
    keys = F.transform(lines_of(text), lambda line: F.btrim(line, F.lit(WORD_SEPARATORS)))
    return F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_chars), lambda k: _hashed(line_key(k)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """`docs` with shared lines taken out of `text_col`, and `n_lines`, `n_dropped` (replacing columns so named).

    A key of at least `min_chars` code points found in at least `min_docs` distinct ids loses its
    lines everywhere except in the largest id that holds it, where all of them stay. Rows that repeat
    an id count as one document and are treated alike. A row without an id keeps its lines and counts
    for none. Null text: one empty line, and the new text is empty. Empty tables give empty results.
    Counting shuffles 16 bytes of hash and the id per line, partly summed before the shuffle, so one
    line in a third of the documents is no hot group; texts are shuffled once, by id.
    """
    scratch, own, dropped, kept_lines = Scratch(docs.sparkSession), *(f"{name}-{uuid.uuid4().hex}" for name in ("id", "dropped", "kept"))
    seen = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.explode(F.array_distinct(_counting_lines(F.col(text_col), min_chars))).alias("h"))
        .select("id", "h.h1", "h.h2")
    )
    seen = scratch.write(seen, "lines")  # read twice; hashing the lines is the dear part
    # rows bound the distinct ids from above; the exact count follows on what is left
    frequent = seen.groupBy("h1", "h2").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_docs).select("h1", "h2")
    # written, so that the join has nothing above it that needs a key's rows together and a hot key can be split
    hits = scratch.write(seen.join(frequent, ["h1", "h2"]), "hits")
    scratch.drop(seen)
    shared = (
        hits.distinct().groupBy("h1", "h2").agg(F.count("*").alias("ids"), F.max("id").alias("keeper")).where(F.col("ids") >= min_docs)
    )
    gone = hits.join(shared, ["h1", "h2"]).where(F.col("id") != F.col("keeper")).groupBy(F.col("id").alias(own)).agg(F.collect_set(F.struct("h1", "h2")).alias(dropped))
    joined = docs.join(gone, F.col(id_col) == F.col(own), "left")
    lines = lines_of(F.col(text_col))
    kept = F.when(
        F.col(dropped).isNotNull(),
        F.filter(
            lines,
            lambda line: (F.char_length(F.btrim(line, F.lit(WORD_SEPARATORS))) < min_chars)
            | ~F.array_contains(F.col(dropped), _hashed(line_key(line))),
        ),
    ).otherwise(lines)
    out = joined.withColumns({"n_lines": F.size(lines).cast("long"), kept_lines: kept})
    out = out.withColumns({"n_dropped": F.col("n_lines") - F.size(kept_lines), text_col: F.array_join(kept_lines, "\n")})
    return out.drop(own, dropped, kept_lines)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def dedup_sql(table: str, min_chars: int = 40, min_docs: int = 5) -> str:
    """CTEs in DuckDB SQL, ending in `deduped(doc_id, n_lines, n_dropped, text)`; ids must be unique."""
    return f"""
    split_lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM {table}
    ), keyed_lines AS (
        SELECT doc_id, line, pos, translate(trim(line, {_BLANKS}), '{UPPER}', '{LOWER}') AS line_key FROM split_lines
    ), shared_lines AS (
        SELECT line_key, max(doc_id) AS keeper FROM keyed_lines
        WHERE length(line_key) >= {min_chars} GROUP BY line_key HAVING count(DISTINCT doc_id) >= {min_docs}
    ), judged_lines AS (
        SELECT k.doc_id, k.line, k.pos, s.line_key IS NOT NULL AND k.doc_id <> s.keeper AS gone
        FROM keyed_lines k LEFT JOIN shared_lines s USING (line_key)
    ), deduped AS (
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
        FROM judged_lines GROUP BY doc_id
    )"""


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {
    "op6_line_dedup": f"WITH {dedup_sql('documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped"
}
