"""Scoring completions: parse, check, run on hidden cases, compare, reward.

Programs and schemas differ from row to row.  Python sees each distinct triple
of program, source schema and target schema once, and makes data of it: the
class of what is wrong with it, or the steps and rules that fixed expressions
follow (``plans.native``, ``plans.conform``).  Running the cases, checking
targets, comparing and rewarding are columns; cases never leave the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import variant as V
from ..plans import conform, native
from ..plans.analyze import check
from ..plans.program import Program, parse
from ..plans.records import RowError, compiled
from ..plans.schema import SchemaError, first_breach
from ..sources.stage import stored
from .compare import TOLERANCE, equal, f1_column, field_f1, leaf_counts

MODES = ("binary", "dense")
#: Shares of the dense reward.
PARSED, VALID, SCHEMA, EXACT, FIELDS = 0.10, 0.10, 0.20, 0.45, 0.15

_CASE = "struct<index:int,passed:boolean,schema_pass:boolean,field_f1:double,n_agree:int,n_found:int,n_wanted:int,predicted:string,error:string>"
SCORE = f"reward double, components map<string,double>, failure_type string, detail string, program string, cases array<{_CASE}>"


@dataclass
class Score:
    reward: float = 0.0
    components: dict[str, float] = field(default_factory=dict)
    failure_type: str | None = None
    detail: str | None = None
    program: Any = None
    cases: list[dict[str, Any]] = field(default_factory=list)


@lru_cache(maxsize=4096)
def _parsed(text: str) -> Program | Exception:
    try:
        return parse(text)
    except (ValueError, RecursionError) as e:
        return e


@lru_cache(maxsize=4096)
def _schema(text: str) -> dict[str, Any]:
    return json.loads(text)


def _as_text(x: Any) -> str:
    return x if isinstance(x, str) else json.dumps(x)


def run_case(run, case: dict[str, Any], target_schema: dict[str, Any], index: int) -> tuple[dict[str, Any], str | None]:
    """What came of one case, and its failure class."""
    out: dict[str, Any] = {"index": index, "passed": False, "schema_pass": False, "field_f1": 0.0, "n_agree": 0, "n_found": 0, "n_wanted": leaf_counts(None, case["expected"])[2], "predicted": None, "error": None}
    try:
        made = run(case["input"])
        if (breach := first_breach(made, target_schema)) is not None:
            return out | {"error": f"target schema error at {breach}"}, "target_schema_error"
    except (RowError, SchemaError) as e:
        return out | {"error": str(e)}, "runtime_error"
    agree, found, wanted = leaf_counts(made, case["expected"])
    passed = equal(made, case["expected"])
    out |= {"passed": passed, "schema_pass": True, "field_f1": field_f1(made, case["expected"]), "n_agree": agree, "n_found": found, "n_wanted": wanted, "predicted": json.dumps(made, sort_keys=True)}
    return out, None if passed else "partial_value_mismatch"


def score(completion: str | dict[str, Any], source_schema: Any, target_schema: Any, cases: list[dict[str, Any]], mode: str = "dense") -> Score:
    """Score one completion.  The first failing stage, and of the cases the
    first that fails, names the failure."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    dense = mode == "dense"
    program = _parsed(_as_text(completion))
    if isinstance(program, json.JSONDecodeError):
        return Score(failure_type="json_parse_error", detail=str(program))
    if isinstance(program, Exception):
        return Score(PARSED if dense else 0.0, {"parse_schema": PARSED}, "dsl_schema_error", str(program))
    payload = json.loads(completion) if isinstance(completion, str) else completion
    source, target = (_schema(_as_text(s)) for s in (source_schema, target_schema))
    fault = check(program, source, target)
    if fault is not None:
        return Score(PARSED if dense else 0.0, {"parse_schema": PARSED, "reference_validity": 0.0}, fault.failure, f"invalid {fault.kind} path: {fault.path}", payload)
    run = compiled(program)
    done = [run_case(run, case, target, k) for k, case in enumerate(cases)]
    results, failures = [c for c, _ in done], [f for _, f in done if f]
    n = max(1, len(results))
    exact, conform, fields = (sum(c[k] for c in results) / n for k in ("passed", "schema_pass", "field_f1"))
    if not dense:
        reward = float(bool(results) and all(c["passed"] for c in results))
        return Score(reward, {"all_hidden_cases": reward}, failures[0] if failures else None, None, payload, results)
    components = {"parse_schema": PARSED, "reference_validity": VALID, "target_schema": SCHEMA * conform, "hidden_exact": EXACT * exact, "field_f1": FIELDS * fields}
    return Score(min(1.0, max(0.0, sum(components.values()))), components, failures[0] if failures else None, None, payload, results)


# -- tables ----------------------------------------------------------------

_FACTS = f"failure_type:string,detail:string,program:string,plan:{native.PLAN},rules:{conform.RULES}"


def facts(completion: str, source_schema: str, target_schema: str) -> dict[str, Any]:
    """What is known of a completion before it runs: its failure, or how to run it."""
    program = _parsed(completion)
    if isinstance(program, json.JSONDecodeError):
        return {"failure_type": "json_parse_error", "detail": str(program)}
    if isinstance(program, Exception):
        return {"failure_type": "dsl_schema_error", "detail": str(program)}
    shown = json.dumps(json.loads(completion), sort_keys=True)
    source, target = _schema(source_schema), _schema(target_schema)
    fault = check(program, source, target)
    if fault is not None:
        return {"failure_type": fault.failure, "detail": f"invalid {fault.kind} path: {fault.path}", "program": shown}
    return {"program": shown, "plan": native.plan(program), "rules": conform.rules(target)}


def known(texts: DataFrame, make, fields: str) -> DataFrame:
    """``texts`` (distinct rows of strings, the first a key) and a struct ``facts``
    of what ``make`` says of the others."""
    kind = T._parse_datatype_string(f"struct<{fields}>")
    schema = T.StructType([texts.schema[0], T.StructField("facts", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema).field("facts").type
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(1, batch.num_columns)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([native.arrow_ready(make(*row), kind) for row in rows], arrow)], ["key", "facts"])

    return texts.mapInArrow(run, schema)


#: Distinct texts, and steps of all their programs, that count as few: each program
#: becomes an expression of its own, so the plan grows with them.
FEW, FEW_STEPS = 16, 48


def with_facts(df: DataFrame, texts: list[Column], make, fields: str, name: str) -> tuple[DataFrame, dict[int, dict[str, Any]] | None]:
    """``df`` and ``name``: what ``make`` says of its texts.  Python gets distinct
    texts only.  What it says is written once, so that its size is known when the
    join is planned: rows stay where they are if it is small enough to broadcast,
    and meet it by digest if it is not.

    If the texts are few, also what is said of those that have a plan, by the
    number that is in ``name`` as ``which``; else None."""
    key = native.spare_name(df, "digest")
    digest = F.coalesce(F.sha2(F.to_json(F.array(*texts)), 256), F.lit(""))  # never null: no filter of nulls
    distinct = df.select(digest.alias("key"), *(t.alias(f"text{k}") for k, t in enumerate(texts))).distinct()
    told = stored(known(distinct, make, fields), "facts")
    few, which = None, F.lit(None).cast("int")
    if told.count() <= FEW:
        rows = told.orderBy("key").collect()
        plans = {k: r["facts"].asDict(True) for k, r in enumerate(rows) if r["facts"]["plan"] is not None}
        if sum(1 + len(step["children"]) for p in plans.values() for step in p["plan"]["steps"]) <= FEW_STEPS:
            few = plans
            which = F.array_position(F.lit([r["key"] for r in rows]).cast("array<string>"), F.col("key")).cast("int") - 1
    told = told.select(F.col("key").alias(key), F.col("facts").withField("which", which).alias(name))
    return df.withColumn(key, digest).join(told, key).drop(key), few


def breach(v: Column, rules: Column, which: Column, few: dict[int, list[dict[str, Any]]] | None) -> Column:
    """``conform.breach``, null where a known schema is certainly kept."""
    if few is None:
        return conform.breach(v, rules)
    kept = F.lit(False)
    for schema, numbers in _alike(few):
        kept = F.when(which.isin(*numbers), conform.fits(v, schema)).otherwise(kept)
    return F.when(~kept, conform.breach(v, rules))


def _alike(few: dict[int, list[dict[str, Any]]]) -> list[tuple[list[dict[str, Any]], list[int]]]:
    """Distinct schemas, and the numbers that have each."""
    found: dict[str, tuple[list[dict[str, Any]], list[int]]] = {}
    for k, schema in few.items():
        found.setdefault(json.dumps(schema), (schema, []))[1].append(k)
    return list(found.values())


def run_programs(df: DataFrame, facts: str, few: dict[int, dict[str, Any]] | None, plan: str, records: str, out: str) -> DataFrame:
    """``native.run`` by the column ``plan``, or one expression for each program if they are few."""
    if few is None:
        return native.run(df, plan, records, out)
    return native.run_few(df, F.col(f"`{facts}`")["which"], {k: f["plan"] for k, f in few.items()}, records, out)


def _judged(found: Column, rules: Column, which: Column, few: dict[int, list[dict[str, Any]]] | None) -> Column:
    """Of one case: nodes of both sides and the first breach."""
    made = found["target"]
    return F.struct(
        found["error"].alias("error"),
        made.alias("made"),
        V.nodes(found["expected"]).alias("wanted"),
        F.when(made.isNotNull(), V.nodes(made)).alias("got"),
        F.when(made.isNotNull(), breach(made, rules, which, few)).alias("breach"),
    )


def _counted(c: Column) -> Column:
    message = F.coalesce(c["error"], c["breach"]["unsupported"], F.concat(F.lit("target schema error at "), c["breach"]["path"], F.lit(": "), c["breach"]["what"]))

    def known(k: Column) -> Column:
        fine = c["made"].isNotNull() & k["message"].isNull()
        return F.struct(
            k["message"].alias("error"),
            (k["message"].isNotNull() & c["error"].isNull() & c["breach"]["unsupported"].isNull()).alias("unfit"),
            V.leaves(c["wanted"]).alias("wanted"),
            F.when(fine, V.leaves(c["got"])).alias("got"),
            F.when(fine, V.nodes_equal(c["got"], c["wanted"], TOLERANCE)).otherwise(F.lit(False)).alias("passed"),
            F.when(fine, V.spaced_json(c["made"])).alias("predicted"),
        )

    def counted(k: Column) -> Column:
        # equal values have the same leaves
        agree = F.when(k["passed"], F.size(k["got"])).when(k["got"].isNotNull(), V.agreeing(k["got"], k["wanted"], TOLERANCE)).otherwise(F.lit(0))
        found = F.when(k["got"].isNull(), F.lit(0)).otherwise(F.size(k["got"]))
        return F.struct(k["error"], k["unfit"], k["passed"], agree.alias("n_agree"), found.alias("n_found"), F.size(k["wanted"]).alias("n_wanted"), k["predicted"])

    return V.let(V.let(F.struct(message.alias("message")), known), counted)


def _result(c: Column, index: Column) -> Column:
    agree, found, wanted = (c[n].cast("double") for n in ("n_agree", "n_found", "n_wanted"))
    f1 = F.when(c["error"].isNotNull(), F.lit(0.0)).otherwise(f1_column(agree, found, wanted))
    return F.struct(index.cast("int").alias("index"), c["passed"].alias("passed"), c["error"].isNull().alias("schema_pass"), f1.alias("field_f1"), *(c[n].alias(n) for n in ("n_agree", "n_found", "n_wanted")), c["predicted"].alias("predicted"), c["error"].alias("error")).cast(_CASE)


def score_table(df: DataFrame, mode: str = "dense", completion: str = "completion", source_schema: str = "source_schema", target_schema: str = "target_schema", cases: str = "hidden_tests") -> DataFrame:
    """``df`` and the fields of ``SCORE``.  Schemas are JSON texts; ``cases`` is
    the JSON text of a list of ``{"input", "expected"}``.  A null or empty completion
    is not JSON; null or empty schemas are open, null or empty cases none.  The
    first failing stage, and of the cases the first that fails, names the failure.

    ``df`` is read twice, first for its distinct texts; store it where it is dear
    to make."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    text = lambda c, default: F.when(F.col(f"`{c}`") == "", F.lit(default)).otherwise(F.coalesce(F.col(f"`{c}`"), F.lit(default)))
    names = {n: native.spare_name(df, n) for n in ("facts", "plan", "pairs", "inputs", "outcomes", "judged")}
    known_, plan, pairs, inputs, outcomes, judged = names.values()
    col = lambda n: F.col(f"`{n}`")
    made, few = with_facts(df, [text(completion, ""), text(source_schema, "{}"), text(target_schema, "{}")], facts, _FACTS, known_)
    side = lambda name: lambda c: V.get(c, f"$['{name}']")
    made = made.withColumn(plan, col(known_)["plan"]).withColumn(pairs, F.when(col(plan).isNotNull(), V.items(F.parse_json(text(cases, "[]")))))
    made = made.withColumn(inputs, F.transform(col(pairs), side("input")))
    made = run_programs(made, known_, few, plan, inputs, outcomes)
    schemas = few and {k: f["rules"] for k, f in few.items()}
    both = F.zip_with(col(outcomes), F.transform(col(pairs), side("expected")), lambda o, e: o.withField("expected", e))
    made = made.withColumn(judged, F.transform(both, lambda c: _judged(c, col(known_)["rules"], col(known_)["which"], schemas))).withColumn(judged, F.transform(col(judged), _counted))
    results = F.coalesce(F.transform(col(judged), _result), F.array().cast(f"array<{_CASE}>"))
    failed = F.transform(col(judged), lambda c: F.when(c["unfit"], F.lit("target_schema_error")).when(c["error"].isNotNull(), F.lit("runtime_error")).when(~c["passed"], F.lit("partial_value_mismatch")))
    failure = F.coalesce(col(known_)["failure_type"], F.get(F.filter(failed, lambda f: f.isNotNull()), F.lit(0)))
    made = made.withColumns({"cases": results, "failure_type": failure, "detail": col(known_)["detail"], "program": col(known_)["program"], outcomes: col(known_)["failure_type"]})
    return _rewarded(made, mode, col(outcomes)).select(*df.columns, "reward", "components", "failure_type", "detail", "program", "cases")


def _rewarded(df: DataFrame, mode: str, before: Column) -> DataFrame:
    """``reward`` and ``components``.  before: the class of a failure before any
    case was run."""
    n = F.greatest(F.size("cases"), F.lit(1))
    rate = lambda value: F.aggregate("cases", F.lit(0.0), lambda s, c: s + value(c)) / n
    flag = lambda name: lambda c: F.when(c[name], 1.0).otherwise(0.0)
    parts = lambda **shares: F.create_map(*(x for name, share in shares.items() for x in (F.lit(name), share)))
    early = (
        F.when(before == "json_parse_error", F.create_map().cast("map<string,double>"))
        .when(before == "dsl_schema_error", parts(parse_schema=F.lit(PARSED)))
        .when(before.isNotNull(), parts(parse_schema=F.lit(PARSED), reference_validity=F.lit(0.0)))
    )
    if mode == "binary":
        reward = F.when(before.isNull() & (F.size("cases") > 0) & F.forall("cases", lambda c: c["passed"]), F.lit(1.0)).otherwise(F.lit(0.0))
        return df.withColumns({"reward": reward, "components": F.coalesce(early, parts(all_hidden_cases=reward))})
    shares = {"target_schema": F.lit(SCHEMA) * rate(flag("schema_pass")), "hidden_exact": F.lit(EXACT) * rate(flag("passed")), "field_f1": F.lit(FIELDS) * rate(lambda c: c["field_f1"])}
    total = F.lit(PARSED + VALID) + shares["target_schema"] + shares["hidden_exact"] + shares["field_f1"]
    reward = F.when(before == "json_parse_error", F.lit(0.0)).when(before.isNotNull(), F.lit(PARSED)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
    return df.withColumns({"reward": reward, "components": F.coalesce(early, parts(parse_schema=F.lit(PARSED), reference_validity=F.lit(VALID), **shares))})


def gold_leaves(cases: Column | str) -> Column:
    """Leaves of all expected targets in the JSON text of a list of cases."""
    text = F.col(cases) if isinstance(cases, str) else cases
    found = V.items(F.parse_json(F.when(text == "", F.lit("[]")).otherwise(F.coalesce(text, F.lit("[]")))))
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, c: n + F.size(V.leaves(V.nodes(V.get(c, "$['expected']")))))


def rewards(df: DataFrame, mode: str = "dense", **columns: str) -> DataFrame:
    """The batch reward callback's table: sample, completion, reward and why."""
    scored = score_table(df, mode, **columns)
    return scored.select(*[c for c in df.columns if c not in ("source_schema", "target_schema", "hidden_tests")], "reward", "components", "failure_type")


def rates(scored: DataFrame, key: str) -> DataFrame:
    """The rates over all cases of each row, recomputed from its stored cases."""
    case = scored.select(key, F.explode_outer("cases").alias("c"))
    return case.groupBy(key).agg(
        F.coalesce(F.avg(F.col("c.passed").cast("double")), F.lit(0.0)).alias("exact_rate"),
        F.coalesce(F.avg(F.col("c.schema_pass").cast("double")), F.lit(0.0)).alias("schema_rate"),
        F.coalesce(F.avg("c.field_f1"), F.lit(0.0)).alias("mean_f1"),
        F.coalesce(F.bool_and("c.passed"), F.lit(False)).alias("problem_exact"),
    )
