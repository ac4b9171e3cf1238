"""The jobs of a run, each reading and writing folders: generate, examples,
split, validate, token budget, evaluate, rescore, verify, summarize."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dataset, metrics, report, score
from .sources import files, places

METRICS = (
    "json_parse_rate schema_conformance_rate executable_rate target_schema_pass_rate hidden_case_pass_rate problem_exact_pass_rate "
    "field_micro_f1 field_macro_f1 edge_case_pass_rate mean_completion_tokens latency_p50_ms latency_p95_ms"
).split()
TESTS = ("test_iid", "test_linguistic_ood", "test_compositional_ood", "test_structural_ood")


def generate(spark: SparkSession, out: str, n: int = dataset.CANDIDATES, seed: int = dataset.SEED, shards: int = 4) -> None:
    """Candidates as JSON lines, one file for each shard; shards go by stride."""
    files.write_json_lines(dataset.generate(spark, n, seed, shards), f"{out}/candidates")


def examples(spark: SparkSession, authored: str, out: str) -> None:
    """Authored examples (JSON lines of ``dataset.examples``' columns), checked
    and run, as rows of the dataset."""
    given = files.read_json_lines(spark, authored, schema="index long, instruction string, input string, steps string, expected string")
    files.write_json_lines(dataset.examples(given), out)


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """All shards; rows know their place by index, so nothing is sorted."""
    return files.read_json_lines(spark, f"{root}/candidates", schema=dataset.CANDIDATE)


def split(spark: SparkSession, root: str) -> dict:
    """Write every split with what belongs to it, the manifest and the quality
    counts.  Raises if indexes have gaps or training rows leak into tests."""
    whole = dataset.index_check(candidates(spark, root)).first()
    if not whole["complete"]:
        raise ValueError(f"candidates are incomplete: {whole.asDict()}")
    # JSON is parsed once; splits are read by folder from here on
    dataset.all_splits(candidates(spark, root)).write.mode("overwrite").partitionBy("split").parquet(f"{root}/staged/splits")
    splits = spark.read.parquet(f"{root}/staged/splits")
    leaks = {r["check"]: r["overlap"] for r in dataset.leakage(splits).collect()}
    if any(leaks.values()):
        raise ValueError(f"training rows leak into tests: {leaks}")
    for name, (_, _, _, hidden) in dataset.SPLITS.items():
        part = splits.where(F.col("split") == name)
        if name.startswith("sft"):
            files.write_json_lines(dataset.sft_rows(part), f"{root}/sft/{name}")
        elif hidden == "grpo":
            files.write_json_lines(dataset.prompts(part), f"{root}/grpo/prompts")
            files.write_json_lines(dataset.hidden_cases(part, hidden), f"{root}/grpo/hidden_tests")
            files.write_json_lines(part.select("sample_id", "reference_program"), f"{root}/grpo/references")
        else:
            files.write_json_lines(dataset.evaluation_rows(part, name), f"{root}/{'dev' if name == 'dev' else 'test'}/{name}")
    counts = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}
    manifest = {"candidate_count": whole["rows"], "counts": counts, "hidden_cases": dataset.HIDDEN_CASES, "leakage_checks": leaks, "status": "PASS"}
    files.write_json(spark, manifest, f"{root}/manifests/data_manifest")
    quality: dict[str, dict[str, int]] = {}
    for r in dataset.quality(candidates(spark, root)).collect():
        quality.setdefault(r["measure"], {})[r["value"]] = r["count"]
    files.write_json(spark, quality, f"{root}/manifests/data_quality_summary")
    return manifest


_PUBLIC = "sample_id string, source_schema string, target_schema string, prompt string, reference_program string, hidden_tests string, split string, difficulty struct<has_null:boolean,has_array:boolean,has_condition:boolean>"


def _rows(spark: SparkSession, path: str, schema: str = _PUBLIC) -> DataFrame:
    return files.read_json_lines(spark, path, schema=schema)


def validate(spark: SparkSession, root: str) -> dict[str, int]:
    """Faults by check over the written splits; all 0 in a good dataset."""
    sft = _rows(spark, f"{root}/sft/sft_6k")
    prompts, hidden, references = (_rows(spark, f"{root}/grpo/{n}") for n in ("prompts", "hidden_tests", "references"))
    joined = prompts.drop("hidden_tests", "reference_program").join(hidden.select("sample_id", "hidden_tests"), "sample_id").join(references.select("sample_id", "reference_program"), "sample_id")
    found = {
        "sft_repeated_ids": dataset.repeated_keys(sft, "sample_id").count(),
        "sft_leaking_prompts": dataset.leaking_prompts(sft).count(),
        "sft_1k_outside_6k": _rows(spark, f"{root}/sft/sft_1k").join(sft, "sample_id", "left_anti").count(),
        "grpo_key_differences": dataset.key_differences(prompts, hidden, "sample_id").count() + dataset.key_differences(prompts, references, "sample_id").count(),
        "grpo_leaking_prompts": dataset.leaking_prompts(prompts).count(),
        "grpo_faults": dataset.faults(joined, "hidden_tests").count(),
        "grpo_case_counts": _other_counts(joined, dataset.HIDDEN_CASES["grpo"]).count(),
    }
    for name in TESTS:
        rows = _rows(spark, f"{root}/test/{name}")
        found[f"{name}_faults"] = dataset.faults(rows, "hidden_tests").count()
        found[f"{name}_case_counts"] = _other_counts(rows, dataset.HIDDEN_CASES["evaluation"]).count()
        found[f"{name}_leaking_prompts"] = dataset.leaking_prompts(rows).count()
    return found


def _other_counts(rows: DataFrame, n: int) -> DataFrame:
    """Rows that have another number of hidden cases."""
    return rows.where(~F.json_array_length("hidden_tests").eqNullSafe(F.lit(n)))


COMPLETION = "sample_id string, completion string, finish_reason string, prompt_tokens long, completion_tokens long, latency_ms double"


def completion_rows(spark: SparkSession, path: str) -> DataFrame:
    """Completions from JSON lines with the file and line of each; a line that is
    no JSON object is an error that names its place."""
    found = places.read_placed_json_lines(spark, path, schema=COMPLETION)
    told = F.raise_error(F.concat_ws(":", "file", "line")).cast("string")
    return found.withColumn("sample_id", F.when(F.col("malformed"), told).otherwise(F.col("sample_id"))).drop("malformed")


def raw_rows(spark: SparkSession, completions: DataFrame, rows: DataFrame, run_id: str) -> DataFrame:
    """Completions scored against the rows of their split, with what the metrics
    need beside the scores and, where it is known, the place of each."""
    scored = score.score_table(completions.join(rows.drop("prompt"), "sample_id"))
    exact = (F.size("cases") > 0) & F.forall("cases", lambda c: c["passed"])
    return scored.select(
        F.lit(run_id).alias("run"), "split", "sample_id", "completion", "program", "components", "cases", "reward",
        metrics.final_failure(F.col("failure_type"), F.col("finish_reason"), exact).alias("failure_type"),
        "prompt_tokens", "completion_tokens", "latency_ms",
        *_known(), *(c for c in places.PLACE if c in completions.columns),
        (F.try_parse_json("completion").isNotNull() & F.ltrim("completion").startswith("{")).alias("is_json"),
    )


def evaluate(spark: SparkSession, root: str, completions: str, out: str, run_id: str) -> DataFrame:
    """Score the completions of a run over all test splits; writes raw rows,
    failures, metrics and the failure summary.  What was measured while
    generating comes in by ``rescore``."""
    rows = _rows(spark, f"{root}/test/*")
    raw_rows(spark, completion_rows(spark, completions), rows, run_id).write.parquet(f"{out}/raw")
    return _tables(spark, spark.read.parquet(f"{out}/raw"), out)


def _tables(spark: SparkSession, raw: DataFrame, out: str, made: DataFrame | None = None) -> DataFrame:
    made = metrics.split_metrics(raw, ["run", "split"]) if made is None else made
    made.write.mode("overwrite").parquet(f"{out}/metrics")
    metrics.failure_histogram(raw, ["run", "split"]).write.mode("overwrite").parquet(f"{out}/failure_summary")
    files.write_json_lines(metrics.failures(raw).select("run", "split", "sample_id", "completion", "failure_type"), f"{out}/failures", "overwrite")
    return spark.read.parquet(f"{out}/metrics")


MEASURED = "run string, split string, generation_wall_seconds double, peak_vram_mb double"


def rescore(spark: SparkSession, out: str, root: str | None = None, measured: str | None = None) -> DataFrame:
    """Metrics and summaries from the stored rows of a run.  With ``root`` what
    the dataset knows (hidden cases, leaves, edge flags) is read from it anew, and
    a row without its problem is an error; ``measured`` names JSON lines with
    ``MEASURED``, which is carried over, as it cannot be computed again."""
    raw = spark.read.parquet(f"{out}/raw")
    if root is None and measured is None:
        return _tables(spark, raw, out)
    if root is None:
        known = raw.select("sample_id", "n_hidden", "n_gold", "is_edge")
    else:
        rows = _rows(spark, f"{root}/test/*")
        missing = raw.join(rows, "sample_id", "left_anti").count()
        if missing:
            raise ValueError(f"{missing} stored rows are not in the dataset")
        known = rows.select("sample_id", *_known())
    empty = spark.createDataFrame([], MEASURED)
    old = files.read_json_lines(spark, measured, schema=MEASURED) if measured else empty
    carried = ["generation_wall_seconds", "peak_vram_mb"]
    return _tables(spark, raw, out, metrics.rescore(raw.drop("n_hidden", "n_gold", "is_edge"), known, old, ["run", "split"], carried))


def _known() -> list[Column]:
    """What metrics need of a problem."""
    return [
        F.coalesce(F.json_array_length("hidden_tests"), F.lit(0)).alias("n_hidden"),
        score.gold_leaves("hidden_tests").alias("n_gold"),
        (F.col("difficulty.has_null") | F.col("difficulty.has_array") | F.col("difficulty.has_condition")).alias("is_edge"),
    ]


def token_budget(spark: SparkSession, root: str, tokenizer: str, most_prompt: int, most_completion: int, prompt_form: str = "{}", end: str = "") -> dict:
    """The longest prompt and completion in tokens over all splits, the first of
    equals by file and index, and whether both keep within their limits.
    ``tokenizer`` is a file of the tokenizers library; ``prompt_form`` puts a
    prompt into the form of a model, ``end`` ends a completion."""
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        known = Tokenizer.from_str(text)
        for batch in batches:
            yield pd.Series([len(x.ids) for x in known.encode_batch(batch.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    before, after = prompt_form.split("{}")
    folders = ["sft/sft_6k", "grpo/prompts", "dev/dev", *(f"test/{t}" for t in TESTS)]
    found = None
    for place, folder in enumerate(folders):
        rows = _rows(spark, f"{root}/{folder}", "sample_id string, seed long, prompt string, completion string").withColumn("place", F.lit(place))
        found = rows if found is None else found.unionByName(rows)
    counted = found.select(
        "sample_id",
        F.struct(-F.col("place"), -F.col("seed")).alias("first"),
        tokens(F.concat(F.lit(before), "prompt", F.lit(after))).alias("prompt"),
        F.when(F.col("completion").isNotNull(), tokens(F.concat("completion", F.lit(end)))).alias("completion"),
    )
    top = lambda c: F.max_by("sample_id", F.when(F.col(c) > 0, F.struct(c, "first")))
    got = counted.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("prompt"), F.lit(0)).alias("max_prompt_tokens"), top("prompt").alias("max_prompt_sample_id"),
        F.coalesce(F.max("completion"), F.lit(0)).alias("max_completion_tokens"), top("completion").alias("max_completion_sample_id"),
    ).first().asDict()
    kept = got["max_prompt_tokens"] <= most_prompt and got["max_completion_tokens"] <= most_completion
    return got | {"prompt_limit": most_prompt, "completion_limit": most_completion, "status": "PASS" if kept else "FAIL"}


RAW_COLUMNS = set("run split sample_id completion program components cases failure_type prompt_tokens completion_tokens latency_ms".split())


def verify(spark: SparkSession, runs: dict[str, int]) -> dict[str, int]:
    """Runs (folder of ``evaluate``: rows expected) that are whole: every column
    of the raw rows and as many rows as expected; anything else raises."""
    found = {}
    for folder, wanted in runs.items():
        raw = spark.read.parquet(f"{folder}/raw")
        files.require_columns(raw, RAW_COLUMNS)
        found[folder] = raw.count()
        if found[folder] != int(wanted):
            raise ValueError(f"{folder}: {found[folder]} rows, {wanted} expected")
    return found


def summarize(spark: SparkSession, runs: dict[str, str], out: str) -> str:
    """Reports over several runs (name: folder of ``evaluate``): means, exact
    rates by split, peak memory where it was measured, failures, the four most
    frequent ones, and the first right and wrong completion of each run and split
    by file and line (by sample, where rows were stored without)."""

    def read(kind: str) -> DataFrame:
        tables = [spark.read.parquet(f"{folder}/{kind}") for folder in runs.values()]
        whole = tables[0]
        for more in tables[1:]:
            whole = whole.unionByName(more, allowMissingColumns=True)
        return whole

    table, histogram, raw = read("metrics"), read("failure_summary"), read("raw")
    means = report.weighted_means(table, ["run"], list(METRICS))
    exact = report.pivoted(table, "run", "split", list(TESTS), "problem_exact_pass_rate")
    benchmark = exact.join(means, "run")
    if "peak_vram_mb" in table.columns:
        benchmark = benchmark.join(report.peaks(table, ["run"], "peak_vram_mb").withColumnRenamed("peak", "peak_vram_mb"), "run", "left")
    benchmark = benchmark.orderBy("run")
    files.write_csv(benchmark.coalesce(1), f"{out}/benchmark_summary")
    failed = report.failure_report(histogram, table, list(runs), list(TESTS))
    files.write_csv(failed.coalesce(1), f"{out}/failure_summary")
    # of equally frequent failures the one met first, by split and then name
    met = F.min(F.array_position(F.array(*map(F.lit, TESTS)), F.col("split"))).alias("met")
    summed = histogram.groupBy("run", "failure_type").agg(F.sum("count").alias("count"), met)
    top = report.top_per_group(summed, ["run"], 4, F.desc("count"), F.col("met"), F.col("failure_type")).drop("met")
    shown = benchmark.select("run", *(report.fixed(F.col(c), 3).alias(c) for c in benchmark.columns if c != "run"))
    right = (F.size("cases") > 0) & (F.size("cases") == F.col("n_hidden")) & F.forall("cases", lambda c: c["passed"])
    for column, kind in zip(places.PLACE, ("string", "long")):
        if column not in raw.columns:
            raw = raw.withColumn(column, F.lit(None).cast(kind))
    raw = raw.withColumn("place", F.struct(*places.PLACE, "sample_id"))
    shots = [
        report.first_match(raw, ["run", "split"], right if good else ~right, "place", ["completion", "failure_type"]).select(
            "run", "split", F.lit("right" if good else "wrong").alias("kind"), F.col("place.sample_id").alias("sample_id"), "failure_type",
            F.concat_ws(":", "place.file", "place.line").alias("place"), report.excerpt(F.col("completion")).alias("completion"),
        )
        for good in (True, False)
    ]
    text = "\n".join(
        [
            f"# Runs\n\n{report.markdown(shown)}",
            f"# Most frequent failures\n\n{report.markdown(top.orderBy('run', 'rank'))}",
            f"# Examples\n\n{report.markdown(shots[0].unionByName(shots[1]).orderBy('run', 'split', 'kind'))}",
        ]
    )
    files.write_text(spark, text, f"{out}/report")
    return text
