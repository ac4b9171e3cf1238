"""The subset of JSON Schema that describes records: ``type``, ``properties``,
``required``, ``items``, ``additionalProperties``; Spark types for it, inference
from examples, and checks of values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .program import path_parts

KEYWORDS = {"type", "properties", "required", "items", "additionalProperties"}
_SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "null": T.NullType()}


class SchemaError(ValueError):
    """A schema that says more than the subset, or a value that breaks one."""


def types_of(schema: dict[str, Any]) -> set[str]:
    said = schema.get("type", [])
    return {said} if isinstance(said, str) else set(said)


def to_spark(schema: dict[str, Any]) -> T.DataType:
    """The Spark type of a schema; what no one type can hold is a variant."""
    kinds = types_of(schema) - {"null"}
    if kinds == {"integer", "number"}:
        return T.DoubleType()
    if len(kinds) > 1 or not types_of(schema):
        return T.VariantType()
    kind = next(iter(kinds), "null")
    if kind == "object":
        return T.StructType([T.StructField(k, to_spark(v)) for k, v in schema.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(to_spark(schema.get("items", {})))
    return _SCALARS[kind]


def from_spark(kind: T.DataType) -> dict[str, Any]:
    """The schema of a Spark type; every field is there and may be null."""
    if isinstance(kind, T.StructType):
        return {
            "type": "object",
            "properties": {f.name: _nullable(from_spark(f.dataType)) for f in kind},
            "required": sorted(f.name for f in kind),
            "additionalProperties": False,
        }
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _nullable(from_spark(kind.elementType))}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.IntegralType):
        return {"type": "integer"}
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return {"type": "number"}
    if isinstance(kind, T.NullType):
        return {"type": "null"}
    return {} if isinstance(kind, T.VariantType) else {"type": "string"}


def _nullable(schema: dict[str, Any]) -> dict[str, Any]:
    kinds = types_of(schema)
    return schema if not kinds or "null" in kinds else {**schema, "type": sorted(kinds | {"null"})}


# -- inference -------------------------------------------------------------


def _kind(x: Any) -> str:
    if x is None:
        return "null"
    for kind, classes in (("boolean", bool), ("integer", int), ("number", float), ("string", str), ("array", list), ("object", dict)):
        if isinstance(x, classes):
            return kind
    raise SchemaError(f"not a JSON value: {x!r}")


def infer(examples: Iterable[Any]) -> dict[str, Any]:
    """The schema that the examples have in common.  Nulls count only among
    scalars; fields are required if every object has them; whole numbers merge
    into numbers only where nothing else occurs; other mixes are open."""
    values = list(examples)
    kinds = {_kind(v) for v in values}
    solid = [v for v in values if v is not None]
    if not solid:
        return {"type": "null"}
    if kinds <= {"object", "null"}:
        names = sorted({k for v in solid for k in v})
        return {
            "type": "object",
            "properties": {k: infer(v[k] for v in solid if k in v) for k in names},
            "required": [k for k in names if all(k in v for v in solid)],
            "additionalProperties": False,
        }
    if kinds <= {"array", "null"}:
        items = [x for v in solid for x in v]
        return {"type": "array", "items": infer(items) if items else {}}
    if kinds & {"object", "array"}:
        return {}
    if kinds == {"integer", "number"}:
        return {"type": "number"}
    return {"type": next(iter(kinds)) if len(kinds) == 1 else sorted(kinds)}


def infer_one(example: Any) -> dict[str, Any]:
    """The schema of one example; arrays go by their first item."""
    kind = _kind(example)
    if kind == "object":
        return {"type": "object", "properties": {k: infer_one(v) for k, v in example.items()}, "required": list(example), "additionalProperties": False}
    if kind == "array":
        return {"type": "array", "items": infer_one(example[0]) if example else {}}
    return {"type": kind}


# -- paths -----------------------------------------------------------------


def child(schema: dict[str, Any], path: str) -> dict[str, Any] | None:
    """The schema at a path (arrays are looked through), or None."""
    at = schema
    for part in path_parts(path):
        if at.get("type") == "array":
            at = at.get("items", {})
        at = at.get("properties", {}).get(part)
        if at is None:
            return None
    return at


# -- checks ----------------------------------------------------------------


def _fits(x: Any, kind: str) -> bool:
    if kind == "number":
        return isinstance(x, (int, float)) and not isinstance(x, bool)
    if kind == "integer":
        return (isinstance(x, int) and not isinstance(x, bool)) or (isinstance(x, float) and x.is_integer())
    return _kind(x) == kind


def breaches(x: Any, schema: dict[str, Any], at: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """Where and how a value breaks a schema."""
    if schema.keys() - KEYWORDS:
        raise SchemaError(f"unsupported keywords {sorted(schema.keys() - KEYWORDS)}")
    kinds = types_of(schema)
    if kinds and not any(_fits(x, k) for k in kinds):
        yield at, f"{_kind(x)} is not of type {', '.join(sorted(kinds))}"
    if isinstance(x, dict):
        fields = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in x:
                yield at, f"{name} is required"
        for name, value in x.items():
            if name in fields:
                yield from breaches(value, fields[name], (*at, name))
            elif schema.get("additionalProperties") is False:
                yield at, f"{name} is not allowed"
            elif isinstance(extra := schema.get("additionalProperties"), dict):
                yield from breaches(value, extra, (*at, name))
    if isinstance(x, list) and "items" in schema:
        for k, value in enumerate(x):
            yield from breaches(value, schema["items"], (*at, k))


def first_breach(x: Any, schema: dict[str, Any]) -> str | None:
    """The breach that comes first by position, as text."""
    found = sorted(breaches(x, schema), key=lambda b: [str(p) for p in b[0]])
    return f"{'.'.join(map(str, found[0][0])) or '$'}: {found[0][1]}" if found else None


def conforms(col: Column, kind: T.DataType, schema: dict[str, Any]) -> Column:
    """A typed column's values fit a schema.  Columns are always there, so a
    missing field can only be one that the type does not have."""
    kinds = types_of(schema)
    null_ok = not kinds or "null" in kinds
    if isinstance(kind, T.NullType):
        return F.lit(null_ok)
    inner = F.lit(True)
    if isinstance(kind, T.StructType):
        names, fields = {f.name for f in kind}, schema.get("properties", {})
        static = (not kinds or "object" in kinds) and set(schema.get("required", ())) <= names and not (schema.get("additionalProperties") is False and names - fields.keys())
        inner = F.lit(static)
        for f in kind:
            if f.name in fields:
                inner = inner & conforms(col.getField(f.name), f.dataType, fields[f.name])
    elif isinstance(kind, T.ArrayType):
        inner = F.lit(not kinds or "array" in kinds)
        if "items" in schema:
            inner = inner & F.forall(col, lambda x: conforms(x, kind.elementType, schema["items"]))
    elif kinds:
        mine = from_spark(kind)["type"]
        if mine in kinds or (mine == "integer" and "number" in kinds):
            inner = F.lit(True)
        elif mine == "number" and "integer" in kinds:
            inner = (col == F.floor(col)) & ~F.isnan(col)
        else:
            inner = F.lit(False)
    return F.when(col.isNull(), F.lit(null_ok)).otherwise(F.coalesce(inner, F.lit(False)))
