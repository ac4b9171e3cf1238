"""Reading and writing the files round the engine: JSON lines, JSON, CSV,
Markdown, settings.  Paths may be in any store that Spark reads."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, *paths: str, schema: T.StructType | str, limit: int | None = None, text: bool = False) -> DataFrame:
    """Rows of JSON lines files (globs allowed); blank lines are skipped.  With
    ``text`` a first column ``line`` keeps the line itself, for what a schema
    cannot hold."""
    lines = spark.read.text(list(paths)).where(F.trim("value") != "")
    lines = lines if limit is None else lines.limit(limit)
    parsed = F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("row")
    return lines.select(*([F.col("value").alias("line")] if text else []), parsed).select(*(["line"] if text else []), "row.*")


def read_shards(spark: SparkSession, pattern: str, schema: T.StructType | str, order: str) -> DataFrame:
    """All shards that a glob names, in the order of a column."""
    return read_json_lines(spark, pattern, schema=schema).orderBy(order)


def json_line(df: DataFrame) -> Column:
    """Rows as JSON objects with sorted keys; nulls are written."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Refuses to overwrite unless told otherwise; ``append`` keeps a log."""
    df.select(json_line(df).alias("value")).write.mode(mode).text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    """One JSON document."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one document expected")
    return json.loads(rows[0]["value"])


def write_json(spark: SparkSession, value: Any, path: str, mode: str = "errorifexists") -> None:
    text = json.dumps(value, sort_keys=True, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str, mode: str = "errorifexists") -> None:
    """A report, such as ``report.markdown`` makes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def read_settings(spark: SparkSession, path: str) -> dict[str, Any]:
    """Settings from JSON or, where a YAML reader is installed, YAML; the
    document must be a mapping."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is not JSON, and no YAML reader is installed") from e
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a mapping expected")
    return found


def require_columns(df: DataFrame, needed: set[str]) -> None:
    missing = needed - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
