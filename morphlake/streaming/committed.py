"""Streams into committed lines: every batch is one commit under its number, so
a query that is stopped anywhere and started again from its checkpoint neither
loses nor repeats a row."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.transform import transform
from ..plans.program import Program
from ..sources.commits import CommittedLines
from .apply import error_counts

COUNTS = "batch long, start timestamp, end timestamp, error string, rows long"


def instant(local: Column) -> Column:
    """A time without zone as the instant that has it in UTC, as streams take
    instants only; whatever zone the session has."""
    return F.timestamp_seconds(F.lit(0)) + (local - F.lit("1970-01-01").cast("timestamp_ntz"))


def wall_clock(instant: Column) -> Column:
    """The time of an instant (of whole seconds) in UTC, without zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(instant).cast("decimal(18,6)"))


def _committed(stream: DataFrame, path: str, checkpoint: str, output: str, numbered: bool = False) -> StreamingQuery:
    def commit(rows: DataFrame, batch: int) -> None:
        rows = rows.withColumn("batch", F.lit(batch)) if numbered else rows
        CommittedLines(rows.sparkSession, path).write(rows, "append", f"batch {batch}")

    return stream.writeStream.outputMode(output).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(commit).start()


def transform_to_lines(stream: DataFrame, program: Program | str | dict[str, Any], path: str, checkpoint: str, keep: list[str] | None = None) -> StreamingQuery:
    """What is there to be read of a stream, transformed and committed to
    ``path`` (read it with ``CommittedLines``), bad rows with their ``error``."""
    return _committed(transform(stream, program, "report", keep), path, checkpoint, "append")


def count_errors(stream: DataFrame, program: Program | str | dict[str, Any], time: str, every: str, late: str, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of rows by error (null: none) in windows of event time, committed
    whenever they change.  Counts are the stream's only state; windows leave it
    when no row can come for them, as rows later than ``late`` are dropped.
    Times without zone are taken as UTC."""
    if dict(stream.dtypes)[time] == "timestamp_ntz":
        stream = stream.withColumn(time, instant(F.col(time)))
    made = error_counts(transform(stream, program, "report", [time]).select(time, "error"), time, every, late)
    return _committed(made, path, checkpoint, "update", numbered=True)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The latest count of every window and error."""
    found = CommittedLines(spark, path).read(COUNTS)
    return found.groupBy("start", "end", "error").agg(F.max_by("rows", "batch").alias("rows"))
