"""Comparison, scoring, dataset, metrics and reports."""

import json

import pytest
from pyspark.sql import functions as F

from morphlake.operators import dataset, metrics, report
from morphlake.operators.compare import equal, equal_columns, f1_of, field_f1, field_f1_table, leaves
from morphlake.operators.dynamic import transform_rows
from morphlake.operators.score import rates, score, score_table
from morphlake.sources import files

PROGRAM = json.dumps({"steps": [{"op": "cast", "from": "a", "to": "b", "target_type": "integer"}]})
SOURCE = {"type": "object", "properties": {"a": {"type": "string"}}}
TARGET = {"type": "object", "properties": {"b": {"type": "integer"}}, "required": ["b"], "additionalProperties": False}
GOOD, WRONG, FAILS = ({"input": {"a": a}, "expected": {"b": 1}} for a in ("1", "2", "x"))


@pytest.mark.parametrize(
    "a,b,same",
    [(1, 1.0, True), (1, 1 + 1e-7, True), (1e9, 1e9 + 100, True), (0, 1e-7, True), (0, 1e-5, False), (True, 1, False), (None, None, True), (None, 0, False), ("1", 1, False), ([1, 2], [1, 2.0], True), ([1], [1, 1], False), ({"a": 1}, {"a": 1, "b": None}, False), (float("nan"), float("nan"), False), (float("inf"), float("inf"), True)],
)
def test_equality(a, b, same):
    assert equal(a, b) is same and equal(b, a) is same


def test_leaves():
    assert leaves({"a": {"b": 1, "c": []}, "d": [{"e": None}, 2]}) == {"a.b": 1, "d[0].e": None, "d[1]": 2}
    assert leaves({"a.b": 1}) == leaves({"a": {"b": 1}}) and field_f1({}, {}) == 1.0 and field_f1({}, {"a": 1}) == 0.0
    assert field_f1({"a": 1, "b": 2}, {"a": 1, "c": 3, "b": 5}) == f1_of(1, 2, 3) == pytest.approx(0.4)


def test_typed_comparison(spark):
    kind = "struct<a:double,b:array<int>,c:string>"
    rows = [((1.0, [1, 2], "x"), (1.0 + 1e-8, [1, 2], "x")), ((1.0, [1], None), (1.0, [1], None)), ((1.0, [1], "x"), (1.0, [1, 1], "x")), ((float("nan"), [], "x"), (float("nan"), [], "x")), ((float("inf"), None, "x"), (float("inf"), None, "x")), (None, None), ((1.0, [], "x"), None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"id int, p {kind}, g {kind}")
    got = df.select("id", equal_columns(F.col("p"), df.schema["p"].dataType, F.col("g"), df.schema["g"].dataType).alias("same")).collect()
    assert [r.same for r in sorted(got)] == [True, True, False, False, True, True, False]
    f1 = {r.id: r.field_f1 for r in field_f1_table(df, ["id"], "p", "g").collect()}
    assert f1[0] == 1.0 and f1[2] == pytest.approx(field_f1({"a": 1.0, "b": [1], "c": "x"}, {"a": 1.0, "b": [1, 1], "c": "x"})) and f1[3] == pytest.approx(0.5)


@pytest.mark.parametrize(
    "completion,cases,failure,dense",
    [
        ("{", [GOOD], "json_parse_error", 0.0),
        ("[]", [GOOD], "dsl_schema_error", 0.1),
        (PROGRAM.replace('"a"', '"q"'), [GOOD], "invalid_source_path", 0.1),
        (PROGRAM.replace('"b"', '"q"'), [GOOD], "invalid_target_path", 0.1),
        (PROGRAM.replace("integer", "string"), [GOOD], "target_schema_error", 0.2),
        (PROGRAM, [FAILS], "runtime_error", 0.2),
        (PROGRAM, [WRONG], "partial_value_mismatch", 0.4),
        (PROGRAM, [WRONG, FAILS, GOOD], "partial_value_mismatch", 0.2 + 0.2 * 2 / 3 + 0.45 / 3 + 0.15 / 3),
        (PROGRAM, [GOOD], None, 1.0),
        (PROGRAM, [], None, 0.2),
    ],
)
def test_failure_classes(completion, cases, failure, dense):
    got = score(completion, SOURCE, TARGET, cases, "dense")
    assert got.failure_type == failure and got.reward == pytest.approx(dense)
    assert score(completion, SOURCE, TARGET, cases, "binary").reward == float(bool(cases) and failure is None)
    with pytest.raises(ValueError):
        score(completion, SOURCE, TARGET, cases, "other")


def test_crashing_programs_are_row_errors():
    for step in ({"op": "split", "from": "a", "to": "b", "separator": "", "index": 0}, {"op": "cast", "from": "a", "to": "b", "target_type": "integer"}):
        assert score({"steps": [step]}, {}, {}, [{"input": {"a": float("inf")}, "expected": {}}]).failure_type in ("invalid_source_path", "runtime_error")
    schema = {"type": "object", "properties": {"a": {}, "b": {}}}
    assert score({"steps": [{"op": "cast", "from": "a", "to": "b", "target_type": "integer"}]}, schema, schema, [{"input": {"a": float("inf")}, "expected": {}}]).failure_type == "runtime_error"


def test_score_table_and_rates(spark):
    rows = [("x", PROGRAM, json.dumps([GOOD, WRONG])), ("y", "{", json.dumps([GOOD])), ("z", PROGRAM, None), ("n", None, "[]")]
    df = spark.createDataFrame(rows, "sample_id string, completion string, hidden_tests string").withColumns({"source_schema": F.lit(json.dumps(SOURCE)), "target_schema": F.lit(json.dumps(TARGET))})
    scored = score_table(df)
    got = {r.sample_id: r for r in scored.collect()}
    assert got["x"].failure_type == "partial_value_mismatch" and got["y"].failure_type == got["n"].failure_type == "json_parse_error" and len(got["x"].cases) == 2
    recomputed = {r.sample_id: (r.exact_rate, r.problem_exact) for r in rates(scored, "sample_id").collect()}
    assert recomputed["x"] == (0.5, False) and recomputed["z"] == (0.0, False)
    extra = scored.withColumns({"split": F.lit("s"), "n_hidden": F.lit(2), "n_gold": F.lit(2), "is_json": F.col("failure_type") != "json_parse_error", "is_edge": F.lit(True), "completion_tokens": F.lit(4), "latency_ms": F.lit(1.5)})
    made = metrics.split_metrics(extra, ["split"]).collect()[0]
    assert made.samples == 4 and made.hidden_case_pass_rate == 1 / 8 and made.edge_case_pass_rate == 0 and made.latency_p95_ms == 1.5 and made.json_parse_rate == 0.25


def test_programs_as_data(spark):
    df = spark.createDataFrame([(PROGRAM, '{"a": "3"}'), (PROGRAM, '{"a": "x"}'), ("{", "{}"), (PROGRAM, None)], "program string, record string")
    got = transform_rows(df).collect()
    assert [r.target for r in got] == ['{"b": 3}', None, None, None] and all(r.error for r in got[1:])


def test_dataset(spark):
    counts = {(r.measure, r.value): r["count"] for r in dataset.quality(dataset.index_table(spark)).collect()}
    assert [counts["level", str(k)] for k in range(5)] == [3408, 10184, 4408, 500, 1500]
    assert (counts["has_array", "true"], counts["has_condition", "true"], counts["has_null", "true"]) == (4408, 5862, 4864)
    assert counts["pattern", "cast_default"] == 1455 and counts["pattern", "map_array"] == 1454 and counts["partition", "compositional"] == 2500
    per_split = {(r.split, r.graph_signature): r["count"] for r in dataset.all_splits(dataset.index_table(spark)).groupBy("split", "graph_signature").count().collect()}
    assert per_split["test_structural_ood", "struct_deep_nest"] == 166 and per_split["test_iid", "nest_flatten"] == 90 and per_split["sft_6k", "map_array"] == 545 and per_split["grpo", "scale_date"] == 363
    rows = dataset.generate(spark, 60)
    assert dataset.faults(rows).count() == 0 and dataset.repeated_keys(rows, "sample_id").count() == 0 and dataset.index_check(rows).first().complete
    assert dataset.candidate(7) == dataset.candidate(7) and dataset.leaking_prompts(dataset.prompts(rows)).count() == 0
    hidden = dataset.hidden_cases(rows.limit(3), "grpo").collect()
    assert all(len(json.loads(r.hidden_tests)) == 8 for r in hidden)


def test_all_patterns(spark):
    """Every pattern's program gives a target that fits its schema, and scores 1."""
    for index in [*range(11), *range(16_000, 16_005), *range(18_500, 18_503)]:
        row = dataset.candidate(index)
        assert score(row["reference_program"], row["source_schema"], row["target_schema"], json.loads(row["validation_cases"])).reward == pytest.approx(1.0)


def test_percentiles(spark):
    values = [float(v) for v in range(101)] * 2 + [None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)], "k string, v double")
    got = {r.k: (r.p50, r.p95) for r in metrics.percentile_table(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    ordered = sorted(v for v in values if v is not None)
    assert got == {"a": (ordered[round(201 * 0.5)], ordered[round(201 * 0.95)]), "b": (5.0, 5.0)}


def test_reports_and_files(spark, tmp_path):
    df = spark.createDataFrame([("r", "x", 3, None), ("r", "y", 1, "t|u")], "run string, name string, n int, note string")
    assert report.markdown(df).splitlines()[3] == "| r | y | 1 | t\\|u |"
    files.write_json_lines(df, str(tmp_path / "j"))
    with pytest.raises(Exception, match="exist"):
        files.write_json_lines(df, str(tmp_path / "j"))
    files.write_json_lines(df, str(tmp_path / "j"), "append")
    lines = [r.value for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert '{"n":3,"name":"x","note":null,"run":"r"}' in lines and len(lines) == 4
    back = files.read_json_lines(spark, str(tmp_path / "j"), schema="run string, n int", text=True, limit=3)
    assert back.columns == ["line", "run", "n"] and back.count() == 3
    files.write_json(spark, {"b": 1, "a": [2]}, str(tmp_path / "d"))
    assert files.read_json(spark, str(tmp_path / "d")) == files.read_settings(spark, str(tmp_path / "d")) == {"a": [2], "b": 1}
    with pytest.raises(ValueError):
        files.require_columns(df, {"run", "gone"})
    assert spark.createDataFrame([("a\n" + "b" * 600,)], "t string").select(report.excerpt(F.col("t"))).first()[0] == "a\\n" + "b" * 494 + "..."


def test_stream(spark, tmp_path):
    from morphlake.streaming.apply import transform_stream

    spark.createDataFrame([(1, "5"), (2, "x")], "id long, a string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, a string").parquet(str(tmp_path / "in"))
    query = transform_stream(stream, PROGRAM, lambda w: w.format("memory").queryName("made").outputMode("append"), str(tmp_path / "cp"), keep=["id"])
    query.processAllAvailable()
    query.stop()
    got = {r.id: (r.b, r.error is None) for r in spark.table("made").collect()}
    assert got == {1: (5, True), 2: (None, False)}
