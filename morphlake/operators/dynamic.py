"""Programs as data: every row brings its own program and its own record."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V
from ..plans import native
from ..plans.program import parse
from .score import run_programs, with_facts


def _facts(text: str) -> dict[str, Any]:
    try:
        return {"plan": native.plan(parse(text))}
    except (ValueError, RecursionError) as e:
        return {"fault": str(e)}


def transform_rows(df: DataFrame, program: str = "program", record: str = "record", target: str = "target", error: str = "error") -> DataFrame:
    """``df`` and the target of each row's program as JSON text (names in order),
    null with the reason in ``error`` where the program or the record fails.

    Distinct program texts are parsed in Python, once each; records are read and
    targets made by expressions.  ``df`` is read twice."""
    facts, plan, records, outcomes = (native.spare_name(df, n) for n in ("facts", "plan", "records", "outcomes"))
    col = lambda n: F.col(f"`{n}`")
    made, few = with_facts(df, [F.coalesce(col(program), F.lit(""))], _facts, f"fault:string,plan:{native.PLAN}", facts)
    made = made.withColumn(plan, col(facts)["plan"]).withColumn(records, F.when(col(plan).isNotNull(), F.array(F.try_parse_json(F.coalesce(col(record), F.lit("null"))))))
    made = run_programs(made, facts, few, plan, records, outcomes)
    found = F.get(col(outcomes), F.lit(0))
    made = made.withColumns({target: V.spaced_json(found["target"]), error: F.coalesce(col(facts)["fault"], found["error"])})
    return made.select(*df.columns, target, error)
