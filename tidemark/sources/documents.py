"""JSON documents that may be larger than a task: one list, or an object with a list, split at its items.

A file is read as the pieces between closing braces, which Spark cuts into byte ranges as it does with lines.
Whether a piece starts inside a string and how deep it is nested follows from the quotes and brackets before
it: these are summed up within a byte range for both cases, then over the ranges of the file. Where an object
closes at the depth of the list's items an item ends, and the pieces between two ends are one item. No file
and no line is held as a whole; an item is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OPENS, _CLOSES = r"[\[{]", r"[\]}]"


def _list_start(keys: tuple[str, ...]) -> str:
    return rf'(?<!\\)"(?:{"|".join(keys)})"\s*:\s*\[\s*(?=\{{)'


def pieces_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, size, block, line, piece): what stands before each closing brace; block and line order a file's pieces."""
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("piece"))


def forms(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """(file, is_document) of the files of a folder: one list, or one object over several lines or with a list of one of `keys` at its start, or else lines.

    Lines that each hold a list or such an object are lines: there, every line starts after a value's end.
    """
    more = F.col("piece").rlike(r"\n\s*\S")
    between = F.col("piece").rlike(r"^\s*\]?\s*\n\s*[\[{]")
    at = F.struct("block", "line")
    heads = pieces_of(spark, path).groupBy("file").agg(
        F.min_by("piece", at).alias("head"), (F.count_if(more & between) - F.min_by((more & between).cast("int"), at)).alias("lines"), F.count_if(more & ~between).alias("spread")
    )
    head = F.regexp_replace("head", r"^[\s\ufeff]+", "")
    opens = head.startswith("[") | (head.startswith("{") & (head.contains("\n") | head.rlike(_list_start(keys))))
    return heads.select("file", (opens & ((F.col("lines") == 0) | (F.col("spread") > 0))).alias("is_document"))


def _depth(parts: Column, odd: int) -> Column:
    """Brackets opened less closed in every second part."""
    own = F.array_join(F.filter(parts, lambda _, k: k % 2 == odd), "")
    return F.regexp_count(own, F.lit(_OPENS)) - F.regexp_count(own, F.lit(_CLOSES))


def json_items(spark: SparkSession, paths: str | list[str], keys: tuple[str, ...]) -> DataFrame:
    """(file, item_no, item): the objects of each file's list, as JSON texts in order.

    A file holds one list, or an object with one under one of `keys` (several: one after the other). Items that
    are no objects are left out. A document that ends early has the items that are complete.
    """
    start = _list_start(keys)
    bare = F.regexp_replace("piece", r"(?s)\\.", "")  # an escaped quote ends no string
    parts = F.split(bare, '"', -1)
    p = pieces_of(spark, paths).withColumns({"q": F.size(parts) - 1, "d0": _depth(parts, 0), "d1": _depth(parts, 1)})
    here = Window.partitionBy("file", "block").orderBy("line")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    p = p.withColumn("odd", F.coalesce(F.sum("q").over(before), zero) % 2)

    def change(inside: int) -> Column:
        """What the piece and its closing brace add to the depth if its byte range starts in a string or not."""
        at = (F.col("odd") + inside) % 2
        return F.when(at == 0, F.col("d0")).otherwise(F.col("d1")) - F.when((at + F.col("q")) % 2 == 0, 1).otherwise(0)

    p = p.withColumns({"c0": change(0), "c1": change(1)}).withColumns({"r0": F.sum("c0").over(here), "r1": F.sum("c1").over(here)})

    # what the byte ranges before bring: a row for each
    ranges = p.groupBy("file", "block").agg(F.sum("q").alias("q"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.min_by(F.substring("piece", 1, 64), "line").alias("head"),
        F.sum(F.octet_length("piece") + 1).alias("bytes"), F.max("line").alias("last"), F.max("size").alias("size"))
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("q").over(earlier), zero) % 2)
    ranges = ranges.withColumn("deep", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("c0")).otherwise(F.col("c1"))).over(earlier), zero))
    ranges = ranges.withColumn("level", F.when(F.first("head").over(order).rlike(r"^[\s\ufeff]*\["), 1).otherwise(2))
    # the file's last piece has no brace after it where all pieces with one are longer than the file
    of_file = Window.partitionBy("file")
    ranges = ranges.withColumn("open_end", F.when(F.sum("bytes").over(of_file) > F.col("size"), F.max_by("last", "block").over(of_file)))
    p = p.drop("d0", "d1", "size").join(ranges.select("file", "block", "inside", "deep", "level", "open_end"), ["file", "block"])
    own = lambda a, b: F.when(F.col("inside") == 0, F.col(a)).otherwise(F.col(b))
    p = p.withColumns({"after": F.col("deep") + own("r0", "r1"), "open": (F.col("odd") + F.col("inside")) % 2 == 1})
    p = p.withColumns({"at": F.col("after") - own("c0", "c1"), "closed": ((F.col("odd") + F.col("inside") + F.col("q")) % 2 == 0) & ~F.col("line").eqNullSafe(F.col("open_end"))})

    # whether the list of an object is open: where it starts at depth 1, to the bracket after its last item
    lead = F.regexp_extract(bare, rf"(?s)^(.*?){start}", 1)
    starts = ~F.col("open") & bare.rlike(start) & (F.col("at") + _depth(F.split(lead, '"', -1), 0) == 1)
    ends = ~F.col("open") & (F.col("at") == 2) & F.ltrim(F.regexp_replace("piece", r"^\s+", "")).startswith("]")
    p = p.withColumn("event", F.when(F.col("level") == 1, True).when(starts, True).when(ends, False)).withColumn("starts", (F.col("level") == 2) & starts)
    p = p.withColumn("listed", F.last("event", ignorenulls=True).over(here))
    p = p.withColumn("is_end", F.col("closed") & (F.col("after") == F.col("level")))
    carried = p.groupBy("file", "block").agg(F.max_by("listed", "line").alias("last"))
    carried = carried.withColumn("carried", F.coalesce(F.last("last", ignorenulls=True).over(earlier), F.lit(False))).drop("last")
    p = p.join(carried, ["file", "block"]).where(F.coalesce("listed", "carried"))
    counts = p.groupBy("file", "block").agg(F.count_if("is_end").alias("n"))
    counts = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), zero).alias("done"))
    p = p.join(counts, ["file", "block"]).withColumn("item_no", F.col("done") + F.coalesce(F.sum(F.col("is_end").cast("long")).over(before), zero))
    piece = F.when(F.col("starts"), F.regexp_replace("piece", rf"(?s)^.*?{start}", "")).otherwise(F.col("piece"))
    items = p.groupBy("file", "item_no").agg(F.sort_array(F.collect_list(F.struct("block", "line", piece.alias("piece")))).alias("pieces"), F.bool_or("is_end").alias("whole")).where("whole")
    item = F.concat(F.array_join(F.transform("pieces", lambda x: x["piece"]), "}"), F.lit("}"))
    return items.select("file", "item_no", F.regexp_replace(item, r"^[^{]*", "").alias("item"))
