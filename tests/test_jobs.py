"""The jobs from end to end on a small dataset."""

import json

import pytest
from pyspark.sql import functions as F

from morphlake import jobs
from morphlake.operators import dataset
from morphlake.sources import files

SMALL = {
    "sft_1k": ("base", 0, 4, None), "sft_6k": ("base", 0, 12, None), "grpo": ("base", 12, 6, "grpo"), "dev": ("base", 18, 3, "evaluation"), "test_iid": ("base", 21, 4, "evaluation"),
    "test_linguistic_ood": ("linguistic", 0, 3, "evaluation"), "test_compositional_ood": ("compositional", 0, 5, "evaluation"), "test_structural_ood": ("structural", 0, 3, "evaluation"),
}


def test_jobs(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "data")
    monkeypatch.setattr(dataset, "SPLITS", SMALL)
    picked = [i for first in (0, 15_000, 16_000, 18_500) for i in range(first, first + (30 if not first else 5))]
    rows = spark.createDataFrame([(json.dumps(dataset.candidate(i)),) for i in picked], "j string").select(F.from_json("j", dataset.CANDIDATE).alias("r")).select("r.*")
    files.write_json_lines(rows, f"{root}/candidates")
    with pytest.raises(ValueError, match="incomplete"):
        jobs.split(spark, root)
    monkeypatch.setattr(dataset, "index_check", lambda df: df.agg(F.count("*").alias("rows")).withColumn("complete", F.lit(True)))
    manifest = jobs.split(spark, root)
    assert manifest["counts"]["sft_6k"] == 12 and not any(manifest["leakage_checks"].values())
    assert files.read_json(spark, f"{root}/manifests/data_manifest")["status"] == "PASS"
    assert not any(jobs.validate(spark, root).values())
    tests = jobs._rows(spark, f"{root}/test/*")
    assert tests.count() == 15
    answer = F.when(F.col("split") == "test_iid", F.lit("{")).when(F.col("split") == "test_structural_ood", F.lit('{"steps": []}')).otherwise(F.col("reference_program"))
    completions = tests.select("sample_id", answer.alias("completion"), F.lit("stop").alias("finish_reason"), F.lit(1).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), F.lit(3.0).alias("latency_ms"))
    files.write_json_lines(completions, str(tmp_path / "completions"))
    got = {r.split: r for r in jobs.evaluate(spark, root, str(tmp_path / "completions"), str(tmp_path / "run"), "e").collect()}
    assert got["test_compositional_ood"].problem_exact_pass_rate == got["test_compositional_ood"].field_micro_f1 == 1.0
    assert got["test_iid"].json_parse_rate == 0 and got["test_structural_ood"].json_parse_rate == 1 and got["test_structural_ood"].schema_conformance_rate == 0
    text = jobs.summarize(spark, {"e": str(tmp_path / "run")}, str(tmp_path / "reports"))
    assert "json_parse_error" in text and "| e | 0.000 | 1.000 | 1.000 | 0.000 |" in text
    failed = spark.read.option("header", True).csv(str(tmp_path / "reports/failure_summary")).collect()
    assert [(r.split, r.failure_type, r.rate) for r in failed] == [("test_iid", "json_parse_error", "1.0"), ("test_structural_ood", "dsl_schema_error", "1.0")]
