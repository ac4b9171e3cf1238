"""Queries over scored completions, each with its SQL.

Every order is a problem with two hidden cases and a completion whose kind is
its key modulo 8, so SQL knows what scoring must find: 0 right, 1 not JSON,
2 no program, 3 and 4 paths that the source or target does not have, 5 a field
missing from the target, 6 an error while running, 7 one wrong field of three.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dataset, metrics, report, score
from .sources.stage import spread, stored

_OBJECT = {"type": "object", "additionalProperties": False}
SOURCE = json.dumps(_OBJECT | {"properties": {"id": {"type": "integer"}, "price": {"type": "integer"}, "status": {"type": "string"}}, "required": ["id", "price", "status"]})
TARGET = json.dumps(_OBJECT | {"properties": {"id": {"type": "integer"}, "twice": {"type": "number"}, "tag": {"type": "string"}}, "required": ["id", "twice", "tag"]})
_ID = {"op": "copy", "from": "id", "to": "id"}
_TWICE = {"op": "scale", "from": "price", "to": "twice", "factor": 2}
_TAG = {"op": "copy", "from": "status", "to": "tag"}
COMPLETIONS = [
    json.dumps({"steps": [_ID, _TWICE, _TAG]}),
    '{"steps": [',
    '{"steps": [{"op": "python", "code": "1"}]}',
    json.dumps({"steps": [_ID, _TWICE, _TAG | {"from": "state"}]}),
    json.dumps({"steps": [_ID, _TWICE, _TAG | {"to": "label"}]}),
    json.dumps({"steps": [_ID, _TWICE]}),
    json.dumps({"steps": [_ID, _TWICE, {"op": "split", "from": "status", "to": "tag", "separator": ",", "index": 3}]}),
    json.dumps({"steps": [_ID, _TWICE, {"op": "constant", "to": "tag", "value": "Z"}]}),
]


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, split, completion`` and what scoring and metrics read beside it."""
    key = F.col("o_orderkey")

    def case(more: int) -> Column:
        price = F.pmod(key, F.lit(1000)) + more
        given = F.struct((key + more).alias("id"), price.alias("price"), F.col("o_orderstatus").alias("status"))
        wanted = F.struct((key + more).alias("id"), (price * 2.0).alias("twice"), F.col("o_orderstatus").alias("tag"))
        return F.struct(given.alias("input"), wanted.alias("expected"))

    return spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")).select(
        key.alias("sample_id"),
        F.col("o_orderstatus").alias("split"),
        F.element_at(F.array(*map(F.lit, COMPLETIONS)), (F.pmod(key, F.lit(8)) + 1).cast("int")).alias("completion"),
        F.lit(SOURCE).alias("source_schema"),
        F.lit(TARGET).alias("target_schema"),
        F.to_json(F.array(case(0), case(1))).alias("hidden_tests"),
        F.when(key % 10 == 0, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"),
        (key % 3 == 0).alias("is_edge"),
        (key % 50).alias("completion_tokens"),
        (key % 977).cast("double").alias("latency_ms"),
    )


def _scored(spark: SparkSession, d: str, mode: str = "dense") -> DataFrame:
    return score.score_table(problems(spark, d), mode)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Rows as an evaluation keeps them: written once, read by every metric."""
    exact = (F.size("cases") > 0) & F.forall("cases", lambda c: c["passed"])
    made = _scored(spark, d).withColumns(
        {
            "failure_type": metrics.final_failure(F.col("failure_type"), F.col("finish_reason"), exact),
            "n_hidden": F.coalesce(F.json_array_length("hidden_tests"), F.lit(0)),
            "n_gold": score.gold_leaves("hidden_tests"),
            "is_json": F.try_parse_json("completion").isNotNull() & F.ltrim("completion").startswith("{"),
        }
    )
    return stored(made, "rows")


_KIND = "(o_orderkey % 8)"
_FAILURE = f"""CASE {_KIND} WHEN 1 THEN 'json_parse_error' WHEN 2 THEN 'dsl_schema_error' WHEN 3 THEN 'invalid_source_path' WHEN 4 THEN 'invalid_target_path'
 WHEN 5 THEN 'target_schema_error' WHEN 6 THEN 'runtime_error' WHEN 7 THEN 'partial_value_mismatch' END"""
_FINAL = f"CASE WHEN o_orderkey % 10 = 0 AND {_KIND} <> 0 THEN 'truncated_output' ELSE {_FAILURE} END"
_REWARD = f"CASE {_KIND} WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 7 THEN 0.5 WHEN 5 THEN 0.2 WHEN 6 THEN 0.2 ELSE 0.1 END::DOUBLE"


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_RANK = "list_sort(list((o_orderkey % 977)::DOUBLE))[round_even((count(*) - 1) * {}, 0)::BIGINT + 1]"
_METRICS = f"""o_orderstatus AS split, count(*)::BIGINT AS samples,
 round({_count(_KIND + ' <> 1')} / count(*), 9) AS json_parse_rate, round({_count(_KIND + ' NOT IN (1, 2)')} / count(*), 9) AS schema_conformance_rate,
 round({_count(_KIND + ' IN (0, 7)')} / count(*), 9) AS executable_rate, round({_count(_KIND + ' IN (0, 7)')} / count(*), 9) AS target_schema_pass_rate,
 round({_count(_KIND + ' = 0')} / count(*), 9) AS hidden_case_pass_rate, round({_count(_KIND + ' = 0')} / count(*), 9) AS problem_exact_pass_rate,
 round(2 * (3 * {_count(_KIND + ' = 0')} + 2 * {_count(_KIND + ' = 7')}) / (3 * {_count(_KIND + ' IN (0, 7)')} + 3 * count(*)), 9) AS field_micro_f1,
 round(({_count(_KIND + ' = 0')} + {_count(_KIND + ' = 7')} * 2 / 3) / count(*), 9) AS field_macro_f1,
 round({_count(_KIND + ' = 0 AND o_orderkey % 3 = 0')} / {_count('o_orderkey % 3 = 0')}, 9) AS edge_case_pass_rate,
 round(avg(o_orderkey % 50), 9) AS mean_completion_tokens, {_RANK.format(0.5)} AS latency_p50_ms, {_RANK.format(0.95)} AS latency_p95_ms"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" and not c.startswith("latency") else F.col(c) for c, t in df.dtypes))


def _rescored(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows without what the dataset knows, the dataset, and old metrics
    with what cannot be computed again."""
    rows = _stored(spark, d)
    known = rows.select("sample_id", "n_hidden", "n_gold", "is_edge")
    old = rows.groupBy("split").agg(F.max("completion_tokens").cast("double").alias("wall_seconds"), F.max("latency_ms").alias("peak_vram_gb"))
    made = metrics.rescore(rows.drop("n_hidden", "n_gold", "is_edge"), known, old, ["split"], ["wall_seconds", "peak_vram_gb"])
    return _rounded(made)


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of which one in 97 expects a field that its target does not have."""
    rows = stored(dataset.generate(spark), "candidates")
    more = F.replace("validation_cases", F.lit('"expected": {'), F.lit('"expected": {"not_there": 1, '))
    broken = rows.withColumn("validation_cases", F.when(F.col("global_index") % 97 == 5, more).otherwise(F.col("validation_cases")))
    return dataset.faults(broken).join(rows.select("sample_id", "global_index"), "sample_id").select("global_index")


QUERIES = {
    "score_dense": lambda s, d: _scored(s, d).select("sample_id", F.round("reward", 9).alias("reward"), "failure_type", F.size("components").cast("long").alias("parts"), F.round(F.col("components")["parse_schema"], 9).alias("parsed"), F.round(F.col("components")["reference_validity"], 9).alias("valid")),
    "score_binary": lambda s, d: _scored(s, d, "binary").select("sample_id", "reward", "failure_type"),
    "score_cases": lambda s, d: _scored(s, d).select("sample_id", F.explode_outer("cases").alias("c")).where(F.col("c").isNotNull()).select("sample_id", F.col("c.index").cast("long").alias("place"), "c.passed", "c.schema_pass", F.round("c.field_f1", 9).alias("field_f1"), F.col("c.error").isNotNull().alias("failed")),
    "score_rates": lambda s, d: _rounded(score.rates(_scored(s, d), "sample_id")),
    "score_reward_log": lambda s, d: score.rewards(problems(s, d)).select("sample_id", "completion", F.round("reward", 9).alias("reward"), "failure_type"),
    "score_stages": lambda s, d: _scored(s, d).groupBy("failure_type").agg(F.count(F.lit(1)).alias("rows"), F.count("program").alias("programs"), F.sum(F.size("cases")).alias("cases")),
    "metrics_by_split": lambda s, d: _rounded(metrics.split_metrics(_stored(s, d), ["split"])),
    "metrics_rescored": _rescored,
    "metrics_failures": lambda s, d: metrics.failures(_stored(s, d)).select("split", "sample_id", "failure_type"),
    "metrics_histogram": lambda s, d: metrics.failure_histogram(_stored(s, d), ["split"]),
    "metrics_histogram_sum": lambda s, d: report.summed(metrics.failure_histogram(_stored(s, d), ["split"]), ["failure_type"]),
    "metrics_zip": lambda s, d: problems(s, d).select("sample_id", F.explode(metrics.paired(F.sequence(F.lit(1), F.pmod("sample_id", F.lit(4)) + 1), F.sequence(F.lit(10), F.lit(12)))).alias("p")).select("sample_id", F.col("p.a").cast("long").alias("a"), F.col("p.b").cast("long").alias("b")),
    "report_peaks": lambda s, d: report.peaks(problems(s, d), ["split"], "latency_ms"),
    "dataset_columns": lambda s, d: dataset.generate(s).select("global_index", "partition", "graph_signature", "path_prefix", "seed"),
    "dataset_planted_faults": _planted,
    "dataset_split_leakage": lambda s, d: dataset.leakage(dataset.all_splits(stored(dataset.generate(s), "candidates"))).where("check in ('sample_id_overlap_train_test', 'compositional_signature_overlap_train')"),
}

ORACLE_SQL = {
    "score_dense": f"SELECT o_orderkey AS sample_id, {_REWARD} AS reward, {_FAILURE} AS failure_type, CASE {_KIND} WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 5 END::BIGINT AS parts, CASE WHEN {_KIND} <> 1 THEN 0.1 END::DOUBLE AS parsed, CASE WHEN {_KIND} IN (3, 4) THEN 0.0 WHEN {_KIND} NOT IN (1, 2) THEN 0.1 END::DOUBLE AS valid FROM orders",
    "score_binary": f"SELECT o_orderkey AS sample_id, CASE WHEN {_KIND} = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, {_FAILURE} AS failure_type FROM orders",
    "score_cases": f"SELECT o_orderkey AS sample_id, place, {_KIND} = 0 AS passed, {_KIND} IN (0, 7) AS schema_pass, CASE {_KIND} WHEN 0 THEN 1.0 WHEN 7 THEN round(2 / 3, 9) ELSE 0.0 END::DOUBLE AS field_f1, {_KIND} IN (5, 6) AS failed FROM orders, (VALUES (0::BIGINT), (1::BIGINT)) v(place) WHERE {_KIND} IN (0, 5, 6, 7)",
    "score_rates": f"SELECT o_orderkey AS sample_id, CASE WHEN {_KIND} = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_rate, CASE WHEN {_KIND} IN (0, 7) THEN 1.0 ELSE 0.0 END::DOUBLE AS schema_rate, CASE {_KIND} WHEN 0 THEN 1.0 WHEN 7 THEN round(2 / 3, 9) ELSE 0.0 END::DOUBLE AS mean_f1, {_KIND} = 0 AS problem_exact FROM orders",
    "score_reward_log": f"SELECT o_orderkey AS sample_id, ({COMPLETIONS!r})[{_KIND} + 1] AS completion, {_REWARD} AS reward, {_FAILURE} AS failure_type FROM orders",
    "score_stages": f"SELECT {_FAILURE} AS failure_type, count(*)::BIGINT AS rows, {_count(_KIND + ' NOT IN (1, 2)')}::BIGINT AS programs, (2 * {_count(_KIND + ' IN (0, 5, 6, 7)')})::BIGINT AS cases FROM orders GROUP BY 1",
    "metrics_by_split": f"SELECT {_METRICS} FROM orders GROUP BY 1",
    "metrics_rescored": f"SELECT {_METRICS}, max(o_orderkey % 50)::DOUBLE AS wall_seconds, max(o_orderkey % 977)::DOUBLE AS peak_vram_gb, true AS rescored FROM orders GROUP BY 1",
    "metrics_failures": f"SELECT * FROM (SELECT o_orderstatus AS split, o_orderkey AS sample_id, {_FINAL} AS failure_type FROM orders) WHERE failure_type IS NOT NULL",
    "metrics_histogram": f"SELECT o_orderstatus AS split, {_FINAL} AS failure_type, count(*)::BIGINT AS count FROM orders WHERE {_FINAL} IS NOT NULL GROUP BY 1, 2",
    "metrics_histogram_sum": f"SELECT {_FINAL} AS failure_type, count(*)::BIGINT AS count FROM orders WHERE {_FINAL} IS NOT NULL GROUP BY 1",
    "metrics_zip": "SELECT o_orderkey AS sample_id, k::BIGINT AS a, (k + 9)::BIGINT AS b FROM orders, generate_series(1, 3) t(k) WHERE k <= o_orderkey % 4 + 1",
    "report_peaks": "SELECT o_orderstatus AS split, max(o_orderkey % 977)::DOUBLE AS peak FROM orders GROUP BY 1",
    "dataset_planted_faults": "SELECT i::BIGINT AS global_index FROM generate_series(0, 19999) t(i) WHERE i % 97 = 5",
    "dataset_split_leakage": "SELECT 'sample_id_overlap_train_test' AS check, 0::BIGINT AS overlap UNION ALL SELECT 'compositional_signature_overlap_train', 0::BIGINT",
}
