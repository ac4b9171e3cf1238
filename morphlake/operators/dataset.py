"""The synthetic dataset: candidates, splits, leakage and quality checks.

Which partition and pattern an index has is arithmetic on the index, in Spark.
Candidates come from seeds of their own, so any partitioning and any retry
gives the same rows.  Random draws follow a stream of our own: same patterns
and ranges, other values.
"""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import variant as V
from ..plans import conform, native
from ..plans.analyze import check
from ..plans.program import parse
from ..plans.records import compiled
from ..plans.schema import first_breach, infer, infer_one
from ..sources.stage import stored
from . import score
from .compare import TOLERANCE, equal
from .instructions import family_of, instruction, prompt
from .patterns import CANDIDATES, PARTITIONS, PATTERNS, filled, prefixed

SEED = 42
SCHEMA_EXAMPLES, VALIDATION_CASES = 12, 2
#: What is added to a row's seed for each use of its record generator.
OFFSETS = {"schema": 1000, "validation": 2000, "visible": 3000, "grpo": 4000, "evaluation": 5000}
HIDDEN_CASES = {"grpo": 8, "evaluation": 32}
#: Split: partition, first place within it (by index), rows, kind of hidden cases.
SPLITS = {
    "sft_1k": ("base", 0, 1000, None),
    "sft_6k": ("base", 0, 6000, None),
    "grpo": ("base", 6000, 4000, "grpo"),
    "dev": ("base", 10_000, 500, "evaluation"),
    "test_iid": ("base", 10_500, 1000, "evaluation"),
    "test_linguistic_ood": ("linguistic", 0, 500, "evaluation"),
    "test_compositional_ood": ("compositional", 0, 1000, "evaluation"),
    "test_structural_ood": ("structural", 0, 500, "evaluation"),
}
PUBLIC = ["sample_id", "source_schema", "target_schema", "instruction", "visible_examples", "difficulty", "graph_signature", "instruction_template_family", "seed"]


# -- index arithmetic ------------------------------------------------------


def partition_of(index: Column) -> Column:
    out = None
    for name, (first, _) in sorted(PARTITIONS.items(), key=lambda x: -x[1][0]):
        out = F.when(index >= first, F.lit(name)) if out is None else out.when(index >= first, F.lit(name))
    return out


def pattern_of(index: Column) -> Column:
    out = None
    for name, (_, patterns) in PARTITIONS.items():
        names = F.array(*(F.lit(p.name) for p in patterns))
        picked = F.element_at(names, (F.pmod(index, F.lit(len(patterns))) + 1).cast("int"))
        test = partition_of(index) == name
        out = F.when(test, picked) if out is None else out.when(test, picked)
    return out


def traits(pattern: Column, partition: Column) -> dict[str, Column]:
    """Level and flags, which go by pattern and partition alone."""

    def one_of(value) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for p in PATTERNS.values() for x in (p.name, value(p)))), pattern)

    steps = one_of(lambda p: len(p.steps))
    return {
        "level": F.when(partition == "structural", F.lit(4)).otherwise(F.least(F.lit(4), F.greatest(F.lit(0), steps - 1))),
        "has_array": one_of(lambda p: p.has_array),
        "has_null": one_of(lambda p: bool(p.nullable)),
        "has_condition": one_of(lambda p: p.has_condition),
    }


def index_table(spark: SparkSession, n: int = CANDIDATES) -> DataFrame:
    """``global_index, partition, graph_signature`` and traits of each candidate."""
    ids = spark.range(n).select(F.col("id").alias("global_index"))
    named = ids.withColumn("partition", partition_of(F.col("global_index"))).withColumn("graph_signature", pattern_of(F.col("global_index")))
    return named.withColumns(traits(F.col("graph_signature"), F.col("partition")))


def shard(df: DataFrame, k: int, n: int, index: str = "global_index") -> DataFrame:
    """The rows of shard k of n: every n-th."""
    return df.where(F.pmod(F.col(index), F.lit(n)) == k)


# -- candidates ------------------------------------------------------------


def _partition(index: int) -> str:
    return max((first, name) for name, (first, _) in PARTITIONS.items() if index >= first)[1]


def _records(pattern: str, prefix: str, seed: int, offset: int, n: int) -> list[dict[str, Any]]:
    made = (PATTERNS[pattern].record(random.Random(seed + offset + k)) for k in range(n))
    return [{prefix + name: value for name, value in r.items()} for r in made]


def _cases(run, records: list[dict[str, Any]]) -> list[dict[str, Any]]:
    return [{"input": r, "expected": run(r)} for r in records]


def candidate(index: int, base_seed: int = SEED) -> dict[str, Any]:
    """One row of the dataset; nested values as JSON text."""
    partition, seed = _partition(index), base_seed * 1_000_000 + index
    patterns = PARTITIONS[partition][1]
    pattern = patterns[index % len(patterns)]
    parameters = pattern.parameters(random.Random(seed))
    prefix = f"s{index:05d}_"
    payload = {"steps": prefixed(filled(pattern.steps, parameters), prefix)}
    program = parse(payload)
    run = compiled(program)
    sources = _records(pattern.name, prefix, seed, OFFSETS["schema"], SCHEMA_EXAMPLES)
    source, target = infer(sources), infer(map(run, sources))
    for name in pattern.nullable:
        source["properties"][prefix + name]["type"] = ["null", "string"]
    fault = check(program, source, target)
    if fault is not None:
        raise ValueError(f"candidate {index}: {fault}")
    validation = _cases(run, _records(pattern.name, prefix, seed, OFFSETS["validation"], VALIDATION_CASES))
    visible = _cases(run, _records(pattern.name, prefix, seed, OFFSETS["visible"], index % 3))
    source_text, target_text = json.dumps(source), json.dumps(target)
    operations = {s.op for s in program.steps}
    family = family_of(index, partition)
    canonical = json.dumps({"program": payload, "source_schema": source, "target_schema": target}, sort_keys=True, separators=(",", ":"))
    structural = partition == "structural"
    return {
        "sample_id": f"sample_{index:05d}",
        "global_index": index,
        "partition": partition,
        "source_schema": source_text,
        "target_schema": target_text,
        "instruction": instruction(payload["steps"], family),
        "visible_examples": json.dumps([{"input": c["input"], "output": c["expected"]} for c in visible]),
        "reference_program": json.dumps(payload),
        "difficulty": {
            "level": 4 if structural else min(4, len(program.steps) - 1),
            "num_source_fields": source_text.count('"type"') - 1,
            "num_target_fields": target_text.count('"type"') - 1,
            "num_steps": len(program.steps),
            "nesting_depth": 4 if structural else 2 if operations & {"nest", "map_array"} else 1,
            "has_null": '"null"' in source_text,
            "has_array": '"array"' in source_text,
            "has_condition": bool(operations & {"conditional", "filter_array"}),
        },
        "graph_signature": pattern.name,
        "graph_fingerprint": hashlib.sha256(canonical.encode()).hexdigest(),
        "instruction_template_family": family,
        "seed": seed,
        "path_prefix": prefix,
        "generator_spec": json.dumps({"pattern": pattern.name, "params": parameters}),
        "validation_cases": json.dumps(validation),
    }


CANDIDATE = """sample_id string, global_index long, partition string, source_schema string, target_schema string, instruction string,
 visible_examples string, reference_program string, difficulty struct<level:long,num_source_fields:long,num_target_fields:long,
 num_steps:long,nesting_depth:long,has_null:boolean,has_array:boolean,has_condition:boolean>, graph_signature string,
 graph_fingerprint string, instruction_template_family string, seed long, path_prefix string, generator_spec string, validation_cases string"""


def generate_at(indexes: DataFrame, base_seed: int = SEED) -> DataFrame:
    """The candidates of these indexes (one column of longs)."""
    arrow = to_arrow_schema(indexes.sparkSession.createDataFrame([], CANDIDATE).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([candidate(i, base_seed) for i in batch.column(0).to_pylist()], schema=arrow)

    return indexes.mapInArrow(run, CANDIDATE)


def generate(spark: SparkSession, n: int = CANDIDATES, base_seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """All candidates below index n."""
    if partitions is None:
        return generate_at(spark.range(n), base_seed)
    # task k of m makes its own indexes k, k + m, ...: shards by stride without a shuffle
    firsts = spark.range(0, partitions, 1, partitions).where(F.col("id") < n)
    return generate_at(firsts.select(F.explode(F.sequence("id", F.lit(n - 1), F.lit(partitions))).alias("id")), base_seed)


EXAMPLE = "sample_id string, source_schema string, target_schema string, instruction string, visible_examples string, reference_program string, hidden_tests string"


def examples(given: DataFrame) -> DataFrame:
    """Authored examples (``index, instruction, input, steps, expected``, the last
    three JSON texts) as rows of the dataset, one hidden case each.  A program
    that does not check or does not give what is expected raises."""

    def made(index: int, instruction: str, record: Any, steps: Any, expected: Any) -> tuple[str, ...]:
        program = parse({"steps": steps})
        source, target = infer_one(record), infer_one(expected)
        found = compiled(program)(record)
        wrong = check(program, source, target) or first_breach(found, target) or (None if equal(found, expected) else "the program gives another result")
        if wrong:
            raise ValueError(f"example {index}: {wrong}")
        case = {"input": record, "expected": expected}
        return (f"core_example_{index:02d}", json.dumps(source), json.dumps(target), instruction, "[]", json.dumps({"steps": steps}), json.dumps([case]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in EXAMPLE.split(", ")]
        for batch in batches:
            rows = [made(i, text, *map(json.loads, rest)) for i, text, *rest in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)

    return given.select("index", "instruction", "input", "steps", "expected").mapInArrow(run, EXAMPLE)


def hidden_cases(rows: DataFrame, kind: str) -> DataFrame:
    """``sample_id, hidden_tests``: cases from the row's own generator, as JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for program, pattern, prefix, seed in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                out.append(json.dumps(_cases(compiled(parse(program)), _records(pattern, prefix, seed, OFFSETS[kind], HIDDEN_CASES[kind]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["sample_id", "hidden_tests"])

    return rows.select("sample_id", "reference_program", "graph_signature", "path_prefix", "seed").mapInArrow(run, "sample_id string, hidden_tests string")


def _fault_facts(program: str, source_schema: str, target_schema: str) -> dict[str, Any]:
    return {"plan": native.plan(parse(program)), "source": conform.rules(json.loads(source_schema)), "target": conform.rules(json.loads(target_schema))}


def faults(rows: DataFrame, cases: str = "validation_cases") -> DataFrame:
    """``sample_id, fault``: rows whose program does not give what its cases
    expect, or whose cases break the schemas; of several faults that of the first
    case.  Distinct programs and schemas become data, cases are run by
    expressions.  A row without cases has no fault."""
    fields = f"plan:{native.PLAN},source:{conform.RULES},target:{conform.RULES}"
    given = rows.select("sample_id", "reference_program", "source_schema", "target_schema", F.col(cases).alias("cases"))
    made, few = score.with_facts(given, [F.col(c) for c in ("reference_program", "source_schema", "target_schema")], _fault_facts, fields, "facts")
    made = made.select("sample_id", "facts", F.col("facts.plan").alias("plan"), V.items(F.parse_json(F.coalesce("cases", F.lit("[]")))).alias("pairs"))
    made = made.withColumns({"inputs": F.transform("pairs", lambda c: V.get(c, "$['input']")), "wanted": F.transform("pairs", lambda c: V.get(c, "$['expected']"))})
    made = score.run_programs(made, "facts", few, "plan", "inputs", "outcomes")
    schemas = {side: few and {k: f[side] for k, f in few.items()} for side in ("source", "target")}
    broken = lambda v, side: V.let(score.breach(v, F.col("facts")[side], F.col("facts.which"), schemas[side]), lambda b: F.coalesce(b["unsupported"], F.concat(b["path"], F.lit(": "), b["what"])))
    differs = lambda o, wanted: F.when(o["error"].isNotNull(), F.concat(F.lit("the program fails: "), o["error"])).when(
        ~V.nodes_equal(V.nodes(o["target"]), V.nodes(wanted), TOLERANCE), F.lit("the program gives another result")
    )
    fault = lambda x: F.coalesce(broken(x["inputs"], "source"), broken(x["wanted"], "target"), differs(x["outcomes"], x["wanted"]))
    found = F.filter(F.transform(F.arrays_zip("inputs", "wanted", "outcomes"), fault), lambda f: f.isNotNull())
    # no filter that the optimizer can move below all stages and so run them twice; it makes one of an inner explode too
    return made.select("sample_id", F.explode_outer(F.slice(found, 1, 1)).alias("fault")).where(F.col("fault").isNotNull())


# -- splits ----------------------------------------------------------------


def numbered(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """``df`` in total order with ``place``, each row's number from 0.

    Rows are dealt to tasks by ranges of the order and sorted there; a row's
    number is its number in the range and the rows of all ranges before, which
    are sums of as many counts as there are ranges.  The dealt rows are written
    once, so places stay what they are.  Equal rows go by where they come from,
    so that ranges can cut through any number of them."""
    spark = df.sparkSession
    tie, at = native.spare_name(df, "tie"), native.spare_name(df, "at")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *order, F.col(tie)).sortWithinPartitions(*order, F.col(tie))
    dealt = stored(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()), "numbered")
    range_of, within = F.shiftrightunsigned(F.col(at), 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["range"], r["count"]) for r in dealt.groupBy(range_of.alias("range")).count().collect())  # a row a range
    starts, before = [], 0
    for k, size in sizes:
        starts += [F.lit(k), F.lit(before)]
        before += size
    start = F.try_element_at(F.create_map(*starts), range_of) if starts else F.lit(None)
    return dealt.withColumn(place, (start + within).cast("long")).drop(at)


def placed(df: DataFrame, partition: str = "partition", index: str = "global_index") -> DataFrame:
    """``df`` and ``place``, the row's number within its partition from 0, in the
    order of the index; indexes may have gaps and repeat."""
    whole, name, first = (native.spare_name(df, n) for n in ("whole", "of", "first"))
    at = numbered(df, [F.col(partition), F.col(index)], whole)
    firsts = at.groupBy(F.col(partition).alias(name)).agg(F.min(whole).alias(first))
    joined = at.join(firsts, F.col(partition).eqNullSafe(F.col(name)))
    return joined.withColumn("place", F.col(whole) - F.col(first)).drop(whole, name, first)


def split(df: DataFrame, name: str) -> DataFrame:
    """The rows of a split, given ``placed`` rows."""
    partition, first, n, _ = SPLITS[name]
    return df.where((F.col("partition") == partition) & (F.col("place") >= first) & (F.col("place") < first + n))


def all_splits(df: DataFrame) -> DataFrame:
    """Every row once for each split that it is in, with ``split``."""
    at = placed(df)
    named = [F.when((F.col("partition") == p) & (F.col("place") >= a) & (F.col("place") < a + n), F.lit(name)) for name, (p, a, n, _) in SPLITS.items()]
    return at.withColumn("split", F.explode(F.array_compact(F.array(*named))))


def public(df: DataFrame) -> DataFrame:
    return df.select(*PUBLIC)


def prompts(df: DataFrame) -> DataFrame:
    return df.select(*PUBLIC, prompt().alias("prompt"))


def sft_rows(df: DataFrame) -> DataFrame:
    return df.select(*PUBLIC, "reference_program", prompt().alias("prompt"), F.col("reference_program").alias("completion"))


def evaluation_rows(df: DataFrame, name: str) -> DataFrame:
    hidden = hidden_cases(df, "evaluation")
    return df.select(*PUBLIC, "reference_program", prompt().alias("prompt"), F.lit(name).alias("split")).join(hidden, "sample_id")


# -- checks ----------------------------------------------------------------


def index_check(df: DataFrame, index: str = "global_index") -> DataFrame:
    """One row: rows, distinct indexes, and whether they are 0 to n - 1."""
    n, least, most = F.count(F.lit(1)), F.min(index), F.max(index)
    distinct = df.groupBy(index).agg(F.count(F.lit(1)).alias("n"))
    sums = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), n.alias("distinct"), least.alias("least"), most.alias("most"))
    whole = (F.col("rows") == F.col("distinct")) & (F.col("least") == 0) & (F.col("most") == F.col("distinct") - 1)
    return sums.withColumn("complete", F.coalesce(whole, F.lit(True)))


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the distinct values that both sides have."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


def overlaps(df: DataFrame, checks: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """``check, overlap``: for each check (is a row on the one side, on the other,
    its value) how many distinct values both sides have; nulls count as none.

    All checks share one exchange: a row brings one bit for each side it is on,
    bits of a value are joined in each task and again where the value meets, and
    values with both bits are counted.  A value that many rows have is one row a task."""
    side = lambda a, b: F.when(F.coalesce(a, F.lit(False)), 1).otherwise(0) + F.when(F.coalesce(b, F.lit(False)), 2).otherwise(0)
    marks = F.array(*(F.struct(F.lit(name).alias("check"), value.cast("string").alias("value"), side(a, b).alias("side")) for name, (a, b, value) in checks.items()))
    bits = df.select(F.inline(marks)).where("side > 0 and value is not null").groupBy("check", "value").agg(F.bit_or("side").alias("side"))
    counted = bits.groupBy("check").agg(F.count_if(F.col("side") == 3).alias("overlap"))
    every = df.sparkSession.createDataFrame([(name,) for name in checks], "check string")
    return every.join(counted, "check", "left").select("check", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


TESTS = ("test_iid", "test_linguistic_ood", "test_compositional_ood", "test_structural_ood")


def leakage(splits: DataFrame) -> DataFrame:
    """One row for each way in which training rows could leak into tests."""
    of = lambda *names: F.col("split").isin(*names)
    train = of("sft_6k", "grpo")
    return overlaps(
        splits,
        {
            "sample_id_overlap_train_test": (train, of(*TESTS), F.col("sample_id")),
            "graph_fingerprint_overlap_train_test": (train, of(*TESTS), F.col("graph_fingerprint")),
            "compositional_signature_overlap_train": (train, of("test_compositional_ood"), F.col("graph_signature")),
            "linguistic_template_overlap_train": (train, of("test_linguistic_ood"), F.col("instruction_template_family")),
        },
    )


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that one side alone has, and which side that is."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    alone = left.join(right, key, "full").where(F.col("in_a").isNull() | F.col("in_b").isNull())
    return alone.select(key, F.when(F.col("in_a"), F.lit("a")).otherwise(F.lit("b")).alias("only_in"))


def prefix_differences(short: DataFrame, long: DataFrame, key: str, place: str) -> DataFrame:
    """Rows of ``short`` that are not at the same place of ``long``."""
    return short.select(key, place).join(long.select(F.col(key).alias("other"), place), place, "left").where(~F.col(key).eqNullSafe(F.col("other")))


def leaking_prompts(df: DataFrame, column: str = "prompt") -> DataFrame:
    """Prompts that name what must stay hidden."""
    return df.where(F.col(column).contains("hidden_tests") | F.col(column).contains("reference_program"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def quality(df: DataFrame) -> DataFrame:
    """``measure, value, count`` over candidates or ``index_table`` rows, in one
    pass; flags count rows that have them, zeros included."""
    level = F.col("difficulty.level") if "difficulty" in df.columns else F.col("level")
    flag = (lambda n: F.col(f"difficulty.{n}")) if "difficulty" in df.columns else F.col
    measure = lambda name, value, n=1: F.struct(F.lit(name).alias("measure"), value.alias("value"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n"))
    named = [measure("partition", F.col("partition")), measure("pattern", F.col("graph_signature")), measure("level", level.cast("string"))]
    named += [measure(n, F.lit("true"), F.when(flag(n), 1).otherwise(0)) for n in ("has_array", "has_null", "has_condition")]
    return df.select(F.inline(F.array(*named))).groupBy("measure", "value").agg(F.sum("n").alias("count"))


def longest(df: DataFrame, key: str, length: Column, order: Column) -> DataFrame:
    """One row: the longest of all rows, the first of equals."""
    return df.agg(F.max_by(F.struct(key, length.alias("length")), F.struct(length, -order)).alias("x")).select("x.*")

