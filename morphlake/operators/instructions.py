"""Wording of instructions and prompts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: one clause for each operation, and the introductions
CLAUSES = {
    "copy": "copy `{from}` to `{to}`",
    "constant": "set `{to}` to the constant {value!r}",
    "cast": "cast `{from}` to {target_type} and store it at `{to}`",
    "default": "copy `{from}` to `{to}`, using {value!r} when it is missing or null",
    "coalesce": "store the first non-null value among {sources!r} at `{to}`",
    "map_enum": "map `{from}` through {mapping!r} into `{to}`, defaulting to {default!r}",
    "scale": "store `{from}` × {factor} + {offset} at `{to}`",
    "format_date": "reformat `{from}` from {input_format!r} to {output_format!r} at `{to}`",
    "concat": "join {sources!r} with {separator!r} into `{to}`",
    "split": "split `{from}` on {separator!r} and store item {index} at `{to}`",
    "nest": "create `{to}` with target-to-source fields {fields!r}",
    "flatten": "flatten object `{from}` under `{to}`",
    "conditional": "set `{to}` from {then!r} when `{condition[path]}` {condition[operator]} {condition[value]!r}, otherwise from {otherwise!r}",
    "map_array": "map array `{from}` to `{to}` and for each item {clauses}",
    "filter_array": "filter array `{from}` into `{to}` keeping items where `{condition[path]}` {condition[operator]} {condition[value]!r}",
}
PLAIN = (
    "Transform the source JSON as follows: ",
    "Build the target JSON by applying these operations: ",
    "Apply the following ordered mapping rules: ",
    "Return a target object that will ",
)
VARIED = (
    "Produce the destination object by carrying out these rules in order: ",
    "Translate each source record into the requested target shape. Specifically, ",
    "Construct only the target JSON described here: ",
)
_DEFAULTS = {"default": None, "offset": 0.0, "separator": ""}


def family_of(index: int, partition: str) -> str:
    return f"{'ling' if partition == 'linguistic' else 'train'}_{index % 4}"


def clause(step: dict[str, Any]) -> str:
    given = _DEFAULTS | step
    if "condition" in given:
        given["condition"] = {"value": None} | given["condition"]
    if "steps" in given:
        given["clauses"] = "; ".join(map(clause, given["steps"]))
    return CLAUSES[step["op"]].format_map(given)


def instruction(steps: list[dict[str, Any]], family: str) -> str:
    varied = family.startswith("ling_")
    choices = VARIED if varied else PLAIN
    return choices[sum(map(ord, family)) % len(choices)] + ("; then " if varied else "; ").join(map(clause, steps)) + "."


def prompt() -> Column:
    """What a model is given: five labelled sections."""
    sections = (("Source schema", "source_schema"), ("Target schema", "target_schema"), ("Instruction", "instruction"), ("Examples", "visible_examples"))
    parts = [x for label, c in sections for x in (F.lit(f"{label}:\n"), F.coalesce(F.col(c), F.lit("")), F.lit("\n\n"))]
    return F.concat(*parts, F.lit("Answer:\nReturn only the JSON program."))
