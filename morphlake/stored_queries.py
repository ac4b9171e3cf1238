"""Queries through files: lines with places, commits, streams; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dataset, report
from .sources import places
from .sources.commits import CommittedLines
from .sources.stage import shared_folder
from .streaming import committed

#: Lines of a file.
LINES = 4000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/morphlake/{uuid.uuid4().hex}/{tag}"


# -- lines with places -----------------------------------------------------


def _placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines in files of ``LINES``, every 11th line cut short and
    every 13th blank, read back with their places; ``part`` is the file's number."""
    rows = dataset.numbered(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), [F.col("o_orderkey")])
    text = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))
    line = F.when(F.col("place") % 13 == 12, F.lit("")).when(F.col("place") % 11 == 10, F.substring(text, 1, 20)).otherwise(text)
    path = _folder(spark, "lines")
    # ranges of the order: rows of a file are in one range, in order
    parted = rows.select(F.floor(F.col("place") / LINES).alias("part"), "place", line.alias("value"))
    parted.repartitionByRange("part").sortWithinPartitions("part", "place").drop("place").write.partitionBy("part").text(path)
    read = places.read_placed_json_lines(spark, path, schema="o_orderkey long, o_orderstatus string, o_orderpriority string")
    return read.withColumn("part", F.regexp_extract("file", r"part=(\d+)", 1).cast("long"))


def lines_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed_orders(spark, sf_dir).select("part", "line", "malformed", "o_orderkey", "o_orderstatus")


_LINES = f"""
SELECT *, place // {LINES} AS part, place % {LINES} + 1 AS line, place % 11 = 10 AS malformed
FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place % 13 <> 12"""
_LINES_SQL = f"""
SELECT part, line, malformed, CASE WHEN NOT malformed THEN o_orderkey END AS o_orderkey, CASE WHEN NOT malformed THEN o_orderstatus END AS o_orderstatus FROM ({_LINES})"""


def lines_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each priority the first order in state F and the first in another, by
    file and line."""
    rows = _placed_orders(spark, sf_dir).where(~F.col("malformed")).withColumn("place", F.struct("part", "line"))
    of = lambda kind, test: report.first_match(rows, ["o_orderpriority"], test, "place", ["o_orderkey"]).select(
        "o_orderpriority", F.lit(kind).alias("kind"), "place.part", "place.line", "o_orderkey"
    )
    right = F.col("o_orderstatus") == "F"
    return of("right", right).union(of("wrong", ~right))


_FIRST_SQL = f"""
SELECT o_orderpriority, kind, part, line, o_orderkey FROM (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'right' ELSE 'wrong' END AS kind FROM ({_LINES}) WHERE NOT malformed
) QUALIFY row_number() OVER (PARTITION BY o_orderpriority, kind ORDER BY part, line) = 1"""

# -- commits ---------------------------------------------------------------


def lines_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written in commits: first the even keys, then the odd ones, twice
    under one name; a refused write, and one that fails half-way, leave nothing."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    even = F.col("p_partkey") % 2 == 0
    log = CommittedLines(spark, _folder(spark, "committed"))
    log.write(parts.where(even))
    for _ in range(2):
        log.write(parts.where(~even), "append", "odd")
    try:
        log.write(parts)
    except FileExistsError:
        pass
    return log.read("p_partkey long, p_name string, p_retailprice double")


def lines_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, replaced by those with money, with those without added again."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    log = CommittedLines(spark, _folder(spark, "replaced"))
    log.write(rows)
    log.write(rows.where("s_acctbal > 0"), "overwrite")
    log.write(rows.where("s_acctbal <= 0").withColumn("s_acctbal", F.lit(0.0)), "append")
    return log.read("s_suppkey long, s_acctbal double")


# -- streams ---------------------------------------------------------------

EVENT_PROGRAM = {
    "steps": [
        {"op": "copy", "from": "event_id", "to": "id"},
        {"op": "cast", "from": "mark", "to": "number", "target_type": "integer"},
        {"op": "format_date", "from": "day", "to": "when.day", "input_format": "%Y-%m-%d", "output_format": "%d/%m/%Y"},
        {"op": "map_enum", "from": "event_type", "to": "kind", "mapping": {"error": "bad", "click": "act"}, "default": "other"},
    ]
}
_BAD_MARK, _BAD_DAY = "cannot cast mark to integer", "day is not a date"


def _event_stream(spark: SparkSession, sf_dir: str, run) -> None:
    """The events come in two halves of time, each in several files; ``run``
    starts and ends a query after each, from where the one before ended."""
    key = F.col("event_id")
    events = _table(spark, sf_dir, "events").select(
        "event_id", "event_type", "ts",
        F.when(key % 7 == 3, F.concat(F.lit("n"), key)).otherwise(key.cast("string")).alias("mark"),
        F.when(key % 10 == 4, F.lit("2024-02-30")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
    )
    path, middle = _folder(spark, "events"), F.lit("2024-01-16").cast("timestamp_ntz")
    for half in (F.col("ts") < middle, F.col("ts") >= middle):
        events.where(half).repartitionByRange(6, "ts").write.mode("append").parquet(path)
        run(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(path))


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events transformed as a stream that is stopped half-way."""
    out, checkpoint = _folder(spark, "rows"), _folder(spark, "checkpoint")
    _event_stream(spark, sf_dir, lambda stream: committed.transform_to_lines(stream, EVENT_PROGRAM, out, checkpoint, ["event_id"]).awaitTermination())
    rows = CommittedLines(spark, out).read("event_id long, number long, when struct<day: string>, kind string, error string")
    return rows.select("event_id", "number", F.col("when.day").alias("day"), "kind", "error")


_EVENTS = f"SELECT *, CASE WHEN event_id % 7 = 3 THEN '{_BAD_MARK}' WHEN event_id % 10 = 4 THEN '{_BAD_DAY}' END AS error FROM events"
_STREAM_SQL = f"""
SELECT event_id, CASE WHEN error IS NULL THEN event_id END AS number, CASE WHEN error IS NULL THEN strftime(ts, '%d/%m/%Y') END AS day,
CASE WHEN error IS NULL THEN CASE event_type WHEN 'error' THEN 'bad' WHEN 'click' THEN 'act' ELSE 'other' END END AS kind, error FROM ({_EVENTS})"""


def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by error and day as a stream with state that is stopped
    half-way.  No row is later than half the events, as files come by halves."""
    out, checkpoint = _folder(spark, "counts"), _folder(spark, "checkpoint")
    _event_stream(spark, sf_dir, lambda stream: committed.count_errors(stream, EVENT_PROGRAM, "ts", "1 day", "16 days", out, checkpoint).awaitTermination())
    return committed.read_counts(spark, out).select(committed.wall_clock(F.col("start")).alias("start"), "error", "rows")


_ERRORS_SQL = f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, error, count(*)::BIGINT AS rows FROM ({_EVENTS}) GROUP BY ALL"

QUERIES = {
    "lines_placed": lines_placed,
    "lines_first": lines_first,
    "lines_committed": lines_committed,
    "lines_replaced": lines_replaced,
    "stream_rows": stream_rows,
    "stream_errors": stream_errors,
}
ORACLE_SQL = {
    "lines_placed": _LINES_SQL,
    "lines_first": _FIRST_SQL,
    "lines_committed": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "lines_replaced": "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0.0::DOUBLE END AS s_acctbal FROM supplier",
    "stream_rows": _STREAM_SQL,
    "stream_errors": _ERRORS_SQL,
}
