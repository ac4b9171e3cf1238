"""Programs over streams: the same projection, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.transform import transform
from ..plans.program import Program


def transform_stream(stream: DataFrame, program: Program | str | dict[str, Any], sink: Callable, checkpoint: str, on_error: str = "report", keep: list[str] | None = None) -> StreamingQuery:
    """Transform a stream and write it with ``sink(writer) -> writer`` (format and
    options).  A program keeps no state, so any trigger and any output mode that
    appends will do; bad rows are reported, not fatal, unless told otherwise."""
    made = transform(stream, program, on_error, keep)
    return sink(made.writeStream.option("checkpointLocation", checkpoint)).start()


def error_counts(reported: DataFrame, time: str, every: str, late: str) -> DataFrame:
    """Errors by kind in windows of event time; rows later than ``late`` after
    the newest are dropped."""
    return (
        reported.withWatermark(time, late)
        .groupBy(F.window(time, every), "error")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("window.start", "window.end", "error", "rows")
    )
