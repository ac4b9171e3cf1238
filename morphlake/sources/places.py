"""JSON lines with their places: the file and number of every line, also of
lines that are no JSON, so that a report can point at them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import stored

PLACE = ("file", "line")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, line, value``: every line of text files, blank ones too, numbered
    from 1 within its file.

    Files are read in ranges of bytes, each by one task and in its order, so a
    line's number is its number in the range and the lines of all ranges before
    it: sums of one count a range.  Lines are written once with their ranges,
    as Spark cuts files by the number of executors, which may change.  A line
    is not shuffled unless the ranges are too many to broadcast.
    """
    raw = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")
    )
    lines = stored(raw, "lines")
    ranges = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = stored(ranges.select("file", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "ranges")
    return lines.join(known, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_placed_json_lines(spark: SparkSession, *paths: str, schema: T.StructType | str) -> DataFrame:
    """``file, line, malformed`` and the fields of ``schema`` for every line that
    is not blank; the fields of malformed lines are null."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    clash = {*PLACE, "malformed"} & set(kind.fieldNames())
    if clash:
        raise ValueError(f"names of places: {sorted(clash)}")
    # what objects of the schema cannot be made of (texts, numbers) is malformed too
    lines = read_lines(spark, *paths).where(F.trim("value") != "")
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    row = F.when(good, F.from_json("value", kind.simpleString())).alias("row")
    return lines.select(*PLACE, (~good).alias("malformed"), row).select(*PLACE, "malformed", "row.*")
