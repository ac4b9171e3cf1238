"""Evaluation aggregates over scored completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import stored


#: Bits of a value that one pass of ``percentile_table`` settles.
DIGIT = 16
#: The most ranks (a group and a percentile each) that are broadcast to its values.
MAX_SENT = 100_000


def ordered_bits(x: Column) -> Column:
    """A long that orders as the double does: its bits, turned round for negative
    ones.  Zeros are one; NaN is the largest."""
    shown = F.format_string("%a", F.abs(x) + F.lit(0.0))
    exponent = F.regexp_extract(shown, r"p(-?\d+)$", 1).cast("long")
    mantissa = F.conv(F.rpad(F.regexp_extract(shown, r"\.([0-9a-f]+)p", 1), 13, "0"), 16, 10).cast("long")
    normal = F.when(shown.startswith("0x1"), (exponent + 1023) * F.lit(1 << 52) + mantissa).otherwise(mantissa)
    size = F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(F.abs(x) == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(x < 0, -size).otherwise(size)


def percentile_table(df: DataFrame, keys: list[str], column: str, ps: dict[str, float]) -> DataFrame:
    """For each of ``ps`` (column name: p) the value at rank ``round((n - 1) * p)``
    of the group's sorted values, halves to even; nulls are no values.

    Radix selection, all groups and ranks at once.  Values are written once with
    bits that order as they do, so ``df`` is read once, and no value is shuffled.
    Each of four passes counts the next 16 bits of the values that share those
    settled so far (at most 65,536 counts for a group and rank, added up in tasks
    first) and settles the bits in which the rank falls.

    Ranks are written after each pass and go to the values, never the other way
    round: values that repeat are small files, which Spark would broadcast.  Beyond
    MAX_SENT ranks both sides are shuffled by group."""
    names = [f"k{i}" for i in range(len(keys))]
    value = F.col(column).cast("double")
    kept = stored(df.where(F.col(column).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, names)), value.alias("v"), ordered_bits(value).alias("bits")), "values")
    sizes = kept.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    last = F.col("n") - 1
    rank = lambda p: F.least(F.greatest(F.bround(last * F.lit(p), 0).cast("long"), F.lit(0)), last)
    wanted = sizes.select(*names, F.inline(F.array(*(F.struct(F.lit(name).alias("name"), rank(p).alias("rank")) for name, p in ps.items()))))
    state = stored(wanted.withColumn("prefix", F.lit(0).cast("long")), "ranks")
    few = state.count() <= MAX_SENT
    # the sign's bit is turned, so that digits of negative values come first
    turned = F.col("bits").bitwiseXOR(F.lit(-(1 << 63)))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        above = F.shiftrightunsigned(turned, shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        rows = kept.select(*(F.col(n).alias(f"_{n}") for n in names), above.alias("above"), digit.alias("digit"), "v")
        same = F.col("above") == F.col("prefix")
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
        met = rows.join(F.broadcast(state), same) if few else rows.hint("merge").join(state, same)
        counts = met.groupBy(*names, "name", "rank", "prefix", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        upto = F.sum("n").over(Window.partitionBy(*names, "name").orderBy("digit"))
        hit = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        settled = (F.shiftleft(F.col("prefix"), DIGIT) + F.col("digit")).alias("prefix")
        state = stored(hit.select(*names, "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), settled, *(["v"] if not shift else [])), "ranks")
    picked = [F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ps]
    return state.groupBy(*names).agg(*picked).select(*(F.col(n).alias(k) for k, n in zip(keys, names)), *ps)


def share(flag: Column) -> Column:
    """Aggregate: the share of rows with the flag; 0 without rows."""
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def micro_f1(agree: Column, found: Column, wanted: Column) -> Column:
    """F1 of pooled leaf counts."""
    precision, recall = ratio(agree, found), ratio(agree, wanted)
    return ratio(2 * precision * recall, precision + recall)


def split_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics of each split of scored completions.

    ``rows`` has the columns of ``score_table`` and ``n_hidden`` (hidden cases),
    ``n_gold`` (leaves of all of them), ``is_json`` (the completion is a JSON
    object), ``is_edge``, ``completion_tokens`` and ``latency_ms``.
    """
    cases = F.col("cases")
    done = F.size(cases)
    total = lambda f: F.aggregate(cases, F.lit(0).cast("long"), lambda s, c: s + f(c))
    flag = lambda name: total(lambda c: F.when(c[name], 1).otherwise(0).cast("long"))
    per_row = rows.select(
        *keys,
        F.coalesce("is_json", F.lit(False)).alias("is_json"),
        F.col("program").isNotNull().alias("is_program"),
        ((done > 0) & (done == F.col("n_hidden")) & ~F.exists(cases, lambda c: c["error"].isNotNull())).alias("is_executable"),
        flag("passed").alias("passed"),
        flag("schema_pass").alias("conform"),
        ((done > 0) & (done == F.col("n_hidden")) & F.forall(cases, lambda c: c["passed"])).alias("exact"),
        ratio(F.aggregate(cases, F.lit(0.0), lambda s, c: s + c["field_f1"]), done).alias("f1"),
        total(lambda c: c["n_agree"]).alias("agree"),
        total(lambda c: c["n_found"]).alias("found"),
        "n_hidden",
        "n_gold",
        "is_edge",
        "completion_tokens",
        "latency_ms",
    )
    totals = per_row.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        share(F.col("is_json")).alias("json_parse_rate"),
        share(F.col("is_program")).alias("schema_conformance_rate"),
        share(F.col("is_executable")).alias("executable_rate"),
        ratio(F.sum("conform"), F.sum("n_hidden")).alias("target_schema_pass_rate"),
        ratio(F.sum("passed"), F.sum("n_hidden")).alias("hidden_case_pass_rate"),
        share(F.col("exact")).alias("problem_exact_pass_rate"),
        micro_f1(F.sum("agree"), F.sum("found"), F.sum("n_gold")).alias("field_micro_f1"),
        F.avg("f1").alias("field_macro_f1"),
        ratio(F.count_if(F.col("is_edge") & F.col("exact")), F.count_if("is_edge")).alias("edge_case_pass_rate"),
        F.avg("completion_tokens").alias("mean_completion_tokens"),
    )
    ranks = percentile_table(rows, keys, "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    return totals.join(ranks, keys, "left").fillna(0, ["latency_p50_ms", "latency_p95_ms"])


def final_failure(failure: Column, finish_reason: Column, exact: Column) -> Column:
    """A completion that was cut off and is not exact counts as truncated."""
    return F.when((finish_reason == "length") & ~exact, F.lit("truncated_output")).otherwise(failure)


def failure_histogram(rows: DataFrame, keys: list[str], failure: str = "failure_type") -> DataFrame:
    return rows.where(F.col(failure).isNotNull()).groupBy(*keys, failure).agg(F.count(F.lit(1)).alias("count"))


def failures(rows: DataFrame, failure: str = "failure_type") -> DataFrame:
    return rows.where(F.col(failure).isNotNull())


def paired(a: Column, b: Column) -> Column:
    """Items of two arrays side by side, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), n)


def rescore(stored: DataFrame, dataset: DataFrame, old: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Metrics recomputed from stored rows and the dataset they came from, with
    the columns that cannot be recomputed carried over from the old metrics."""
    return split_metrics(stored.join(dataset, "sample_id"), keys).join(old.select(*keys, *carried), keys, "left").withColumn("rescored", F.lit(True))
