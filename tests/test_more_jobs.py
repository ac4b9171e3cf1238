"""Shards, authored examples, token budgets, rescoring with the dataset, run checks."""

import json
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from morphlake import jobs
from morphlake.operators import dataset
from morphlake.sources import files


def test_shards_go_by_stride(spark):
    made = dataset.generate(spark, 11, partitions=4).select("global_index", F.spark_partition_id().alias("k")).collect()
    assert sorted(r.global_index for r in made) == list(range(11))
    assert all(r.global_index % 4 == r.k for r in made)
    assert dataset.generate(spark, 2, partitions=4).count() == 2


def test_examples(spark, tmp_path):
    steps = [{"op": "copy", "from": "crate", "to": "box"}]
    rows = [{"index": 0, "instruction": "Rename it.", "input": {"crate": 3}, "steps": steps, "expected": {"box": 3}}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    jobs.examples(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"))
    (made,) = files.read_json_lines(spark, str(tmp_path / "out"), schema=dataset.EXAMPLE).collect()
    assert made.sample_id == "core_example_00" and json.loads(made.hidden_tests) == [{"input": {"crate": 3}, "expected": {"box": 3}}]
    (tmp_path / "bad.jsonl").write_text(json.dumps(rows[0] | {"expected": {"box": 4}}))
    with pytest.raises(Exception, match="example 0: the program gives another result"):
        jobs.examples(spark, str(tmp_path / "bad.jsonl"), str(tmp_path / "none"))


def test_token_budget(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    words = tokenizers.Tokenizer(tokenizers.models.WordLevel({"?": 0}, unk_token="?"))
    words.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    words.save(str(tmp_path / "words.json"))
    for k, folder in enumerate(["sft/sft_6k", "grpo/prompts", "dev/dev", *(f"test/{t}" for t in jobs.TESTS)]):
        rows = [(f"{folder}{i}", 10 + i, "a " * (5 if i else 2), "b b" if k == 0 else None) for i in range(3)]
        files.write_json_lines(spark.createDataFrame(rows, "sample_id string, seed long, prompt string, completion string"), f"{tmp_path}/d/{folder}")
    got = jobs.token_budget(spark, f"{tmp_path}/d", str(tmp_path / "words.json"), 6, 2, "x {} y", " end")
    assert got == {
        "rows": 21, "max_prompt_tokens": 7, "max_prompt_sample_id": "sft/sft_6k1", "max_completion_tokens": 3, "max_completion_sample_id": "sft/sft_6k0",
        "prompt_limit": 6, "completion_limit": 2, "status": "FAIL",
    }
    assert jobs.token_budget(spark, f"{tmp_path}/d", str(tmp_path / "words.json"), 7, 3, "x {} y", " end")["status"] == "PASS"


def test_rescore_verify_summarize(spark, tmp_path):
    root, run = str(tmp_path / "data"), str(tmp_path / "run")
    first = spark.createDataFrame([(json.dumps(dataset.candidate(i)),) for i in (0, 1, 2)], "j string").select(F.from_json("j", dataset.CANDIDATE).alias("r")).select("r.*")
    files.write_json_lines(dataset.evaluation_rows(first, "test_iid"), f"{root}/test/test_iid")
    answer = F.when(F.col("seed") % 1000 == 1, F.lit("no\njson")).otherwise(F.col("reference_program"))
    given = first.select("sample_id", answer.alias("completion"), F.lit("stop").alias("finish_reason"), F.lit(1).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), F.lit(3.0).alias("latency_ms"))
    files.write_json_lines(given, str(tmp_path / "completions"))
    before = jobs.evaluate(spark, root, str(tmp_path / "completions"), run, "e").first().asDict()
    files.write_json_lines(spark.createDataFrame([("e", "test_iid", 12.5, 2048.0)], jobs.MEASURED), str(tmp_path / "measured"))
    after = jobs.rescore(spark, run, root, str(tmp_path / "measured")).first().asDict()
    assert after == before | {"generation_wall_seconds": 12.5, "peak_vram_mb": 2048.0, "rescored": True}
    assert before["problem_exact_pass_rate"] == pytest.approx(2 / 3)
    assert jobs.verify(spark, {run: 3}) == {run: 3}
    with pytest.raises(ValueError, match="3 rows, 4 expected"):
        jobs.verify(spark, {run: 4})
    text = jobs.summarize(spark, {"e": run}, str(tmp_path / "reports"))
    assert "2048.000" in text and "| test_iid | wrong |" in text and "no\\njson" in text and "| test_iid | right |" in text
    shown = [line.split(" | ") for line in text.splitlines() if "| test_iid | wrong |" in line or "| test_iid | right |" in line]
    for line in shown:
        file, number = line[5].rsplit(":", 1)
        there = json.loads(open(unquote(file.removeprefix("file:"))).read().splitlines()[int(number) - 1])
        assert there["sample_id"] == line[3]
    assert len(shown) == 2
    (tmp_path / "broken.jsonl").write_text('\n{"sample_id": "a"}\n{"sample_id": \n')
    with pytest.raises(Exception, match="broken.jsonl:3"):
        jobs.completion_rows(spark, str(tmp_path / "broken.jsonl")).collect()
    files.write_json_lines(dataset.evaluation_rows(first.where("global_index > 0"), "test_iid"), f"{tmp_path}/less/test/test_iid")
    with pytest.raises(ValueError, match="1 stored rows are not in the dataset"):
        jobs.rescore(spark, run, f"{tmp_path}/less")
