"""Reports over the metrics of several runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_means(metrics: DataFrame, keys: list[str], columns: list[str], weight: str = "samples") -> DataFrame:
    """Means over the splits of each run, weighted by their samples."""
    return metrics.groupBy(*keys).agg(*((F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in columns))


def pivoted(metrics: DataFrame, key: str, across: str, values: list[str], column: str) -> DataFrame:
    """One row for each run, one column for each split."""
    return metrics.groupBy(key).pivot(across, values).agg(F.first(column))


def failure_report(counts: DataFrame, metrics: DataFrame, runs: list[str], splits: list[str]) -> DataFrame:
    """Failures of each run and split with their rates, by falling count, then
    name; runs and splits in the given order."""
    place = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    joined = counts.join(metrics.select("run", "split", "samples"), ["run", "split"])
    return joined.withColumn("rate", F.col("count") / F.col("samples")).orderBy(place("run", runs), place("split", splits), F.desc("count"), "failure_type")


def peaks(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The largest value of a column over all of a run's files, such as memory."""
    return df.groupBy(*keys).agg(F.max(column).alias("peak"))


def summed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms added up over what is not in ``keys``."""
    return counts.groupBy(*keys).agg(F.sum("count").alias("count"))


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def first_match(df: DataFrame, keys: list[str], condition: Column, order: str, columns: list[str]) -> DataFrame:
    """Of each group the first row that meets a condition, in one aggregation."""
    picked = F.min_by(F.struct(order, *columns), F.col(order))
    return df.where(condition).groupBy(*keys).agg(picked.alias("x")).select(*keys, "x.*")


def excerpt(x: Column, most: int = 500) -> Column:
    """One line of at most ``most`` characters."""
    line = F.replace(x, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def grouped(x: Column) -> Column:
    """Whole numbers with thousands separators."""
    return F.format_number(x.cast("long"), 0)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small table as Markdown text."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; reports are for small tables")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"
