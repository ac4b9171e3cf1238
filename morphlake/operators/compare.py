"""Comparing targets: tolerant equality, leaves, and the F1 of their fields.

For JSON values as plain functions, for typed columns as expressions.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variant as V
from ..functions.text import is_number

TOLERANCE = 1e-6


# -- JSON values -----------------------------------------------------------


def _numeric(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def equal(a: Any, b: Any, tolerance: float = TOLERANCE) -> bool:
    """Numbers within the tolerance, relative or absolute; switches only equal
    switches; objects by their key sets; arrays in order."""
    if _numeric(a) and _numeric(b):
        return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(v, b[k], tolerance) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(lambda x, y: equal(x, y, tolerance), a, b))
    return a == b


def leaves(x: Any) -> dict[str, Any]:
    """Scalars by path (``a.b``, ``a[0]``); empty objects and arrays have none."""
    out: dict[str, Any] = {}
    todo = [("", x)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, value[k]) for k in sorted(value, reverse=True)]
        elif isinstance(value, list):
            todo += [(f"{path}[{k}]", value[k]) for k in reversed(range(len(value)))]
        else:
            out[path] = value
    return out


def leaf_counts(found: Any, wanted: Any, tolerance: float = TOLERANCE) -> tuple[int, int, int]:
    """Leaves that agree, leaves found, leaves wanted."""
    a, b = leaves(found), leaves(wanted)
    return sum(p in b and equal(v, b[p], tolerance) for p, v in a.items()), len(a), len(b)


def f1_of(agree: int, found: int, wanted: int) -> float:
    if not found and not wanted:
        return 1.0
    if not found or not wanted or not agree:
        return 0.0
    precision, recall = agree / found, agree / wanted
    return 2 * precision * recall / (precision + recall)


def field_f1(found: Any, wanted: Any, tolerance: float = TOLERANCE) -> float:
    return f1_of(*leaf_counts(found, wanted, tolerance))


# -- typed columns ---------------------------------------------------------


def equal_columns(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType, tolerance: float = TOLERANCE) -> Column:
    """The same equality between two typed columns; never null."""
    if isinstance(a_kind, T.NullType) or isinstance(b_kind, T.NullType):
        return a.isNull() & b.isNull()
    if is_number(a_kind) and is_number(b_kind):
        x, y = a.cast("double"), b.cast("double")
        near = F.abs(x - y) <= F.greatest(F.greatest(F.abs(x), F.abs(y)) * tolerance, F.lit(tolerance))
        finite = (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
        same = ((x == y) | (finite & near)) & ~F.isnan(x) & ~F.isnan(y)
    elif isinstance(a_kind, T.StructType) and isinstance(b_kind, T.StructType):
        same = F.lit(set(a_kind.fieldNames()) == set(b_kind.fieldNames()))
        if set(a_kind.fieldNames()) == set(b_kind.fieldNames()):
            for f in a_kind:
                same = same & equal_columns(a.getField(f.name), f.dataType, b.getField(f.name), b_kind[f.name].dataType, tolerance)
    elif isinstance(a_kind, T.ArrayType) and isinstance(b_kind, T.ArrayType):
        pairs = F.zip_with(a, b, lambda x, y: equal_columns(x, a_kind.elementType, y, b_kind.elementType, tolerance))
        same = (F.size(a) == F.size(b)) & F.forall(pairs, lambda x: x)
    else:
        same = a == b if type(a_kind) is type(b_kind) else F.lit(False)
    return F.when(a.isNull() & b.isNull(), F.lit(True)).when(a.isNull() | b.isNull(), F.lit(False)).otherwise(F.coalesce(same, F.lit(False)))


_LEAF = "array<struct<path:string,number:double,text:string,kind:string>>"


def leaf_column(x: Column, kind: T.DataType, path: Column | str = "") -> Column:
    """Typed values' leaves as an array of ``path, number, text, kind``."""
    at = F.lit(path) if isinstance(path, str) else path
    empty = F.array().cast(_LEAF)
    if isinstance(kind, T.StructType):
        dot = F.when(at == "", at).otherwise(F.concat(at, F.lit(".")))
        parts = [leaf_column(x.getField(f.name), f.dataType, F.concat(dot, F.lit(f.name))) for f in sorted(kind, key=lambda f: f.name)]
        inner = F.concat(*parts) if parts else empty
    elif isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(x, lambda v, k: leaf_column(v, kind.elementType, F.concat(at, F.lit("["), k.cast("string"), F.lit("]")))))
    else:
        number = x.cast("double") if is_number(kind) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_number(kind) else x.cast("string")
        name = "number" if is_number(kind) else kind.typeName()
        return F.array(F.struct(at.alias("path"), number.alias("number"), text.alias("text"), F.when(x.isNull(), F.lit("null")).otherwise(F.lit(name)).alias("kind"))).cast(_LEAF)
    null = F.array(F.struct(at.alias("path"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text"), F.lit("null").alias("kind"))).cast(_LEAF)
    return F.when(x.isNull(), null).otherwise(F.coalesce(inner, empty))


def leaf_table(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row for each leaf of ``column``, beside ``keys``."""
    kind = df.schema[column].dataType
    return df.select(*keys, F.explode(leaf_column(F.col(f"`{column}`"), kind)).alias("leaf")).select(*keys, "leaf.*")


def leaf_count(x: Column, kind: T.DataType) -> Column:
    """How many leaves a typed value has; never null."""
    if isinstance(kind, T.StructType):
        inner = sum((leaf_count(x.getField(f.name), f.dataType) for f in kind), F.lit(0))
    elif isinstance(kind, T.ArrayType):
        inner = F.aggregate(x, F.lit(0), lambda n, v: n + leaf_count(v, kind.elementType))
    else:
        return F.lit(1)
    return F.when(x.isNull(), F.lit(1)).otherwise(inner)


def agreeing_leaves(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType, tolerance: float = TOLERANCE) -> Column:
    """How many leaves of two typed values have the same path and agree; never
    null.  Both types are known, so paths are followed, not built."""
    neither = a.isNull() & b.isNull()
    if isinstance(a_kind, T.StructType) and isinstance(b_kind, T.StructType):
        shared = [f for f in a_kind if f.name in b_kind.fieldNames()]
        inner = sum((agreeing_leaves(a.getField(f.name), f.dataType, b.getField(f.name), b_kind[f.name].dataType, tolerance) for f in shared), F.lit(0))
    elif isinstance(a_kind, T.ArrayType) and isinstance(b_kind, T.ArrayType):
        both = F.least(F.size(a), F.size(b))
        pairs = F.zip_with(F.slice(a, F.lit(1), both), F.slice(b, F.lit(1), both), lambda x, y: agreeing_leaves(x, a_kind.elementType, y, b_kind.elementType, tolerance))
        inner = F.aggregate(pairs, F.lit(0), lambda n, k: n + k)
    elif isinstance(a_kind, (T.StructType, T.ArrayType)) or isinstance(b_kind, (T.StructType, T.ArrayType)):
        return neither.cast("int")
    elif is_number(a_kind) and is_number(b_kind):
        return equal_columns(a, a_kind, b, b_kind, tolerance).cast("int")
    elif a_kind.typeName() == b_kind.typeName():
        return a.cast("string").eqNullSafe(b.cast("string")).cast("int")
    else:
        return neither.cast("int")
    return F.when(neither, F.lit(1)).when(a.isNull() | b.isNull(), F.lit(0)).otherwise(inner)


def field_f1_table(df: DataFrame, keys: list[str], found: str, wanted: str, tolerance: float = TOLERANCE) -> DataFrame:
    """``keys, n_agree, n_found, n_wanted, field_f1`` of each row: both values
    are in it, so their leaves are counted there and nothing is shuffled."""
    a, b = F.col(f"`{found}`"), F.col(f"`{wanted}`")
    a_kind, b_kind = df.schema[found].dataType, df.schema[wanted].dataType
    counted = df.select(
        *keys,
        agreeing_leaves(a, a_kind, b, b_kind, tolerance).cast("long").alias("n_agree"),
        leaf_count(a, a_kind).cast("long").alias("n_found"),
        leaf_count(b, b_kind).cast("long").alias("n_wanted"),
    )
    return counted.withColumn("field_f1", f1_column(F.col("n_agree"), F.col("n_found"), F.col("n_wanted")))


# -- JSON columns of unknown shape -----------------------------------------


def json_value(text: Column) -> Column:
    """JSON text as a VARIANT; null where it is none."""
    return F.try_parse_json(text)


def json_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """``equal`` of two VARIANT columns; two absent values are equal, one is not."""
    both = V.nodes_equal(V.nodes(a), V.nodes(b), tolerance)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)


def json_leaf_table(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row for each leaf of a VARIANT column: ``path``, ``kind`` and ``value``
    (the text; null for JSON's null), beside ``keys``."""
    kinds = F.create_map(*(F.lit(x) for pair in {V.NULL: "null", V.BOOLEAN: "boolean", V.INTEGER: "integer", V.STRING: "string"}.items() for x in pair))
    leaf = df.select(*keys, F.explode(V.leaves(V.nodes(F.col(f"`{column}`")))).alias("leaf"))
    kind = F.coalesce(F.try_element_at(kinds, V.kind(F.col("leaf.v"))), F.lit("number"))
    return leaf.select(*keys, "leaf.path", kind.alias("kind"), F.when(kind != "null", V.text(F.col("leaf.v"))).alias("value"))


def json_f1_table(df: DataFrame, keys: list[str], found: str, wanted: str, tolerance: float = TOLERANCE) -> DataFrame:
    """``keys, same, n_agree, n_found, n_wanted, field_f1`` of two VARIANT columns of
    any shape.  Both are opened level by level within the row: nothing is
    shuffled or sent to Python.  An absent value has no leaves."""
    a, b = F.col(f"`{found}`"), F.col(f"`{wanted}`")
    none = F.array().cast(V.NODES)
    nodes = lambda v: F.when(v.isNull(), none).otherwise(V.nodes(v))
    opened = df.select(*keys, a.isNull().alias("no_a"), b.isNull().alias("no_b"), nodes(a).alias("a"), nodes(b).alias("b"))
    same = F.when(F.col("no_a") | F.col("no_b"), F.col("no_a") & F.col("no_b")).otherwise(V.nodes_equal(F.col("a"), F.col("b"), tolerance))
    leaves = opened.select(*keys, same.alias("same"), V.leaves(F.col("a")).alias("a"), V.leaves(F.col("b")).alias("b"))
    counted = leaves.select(
        *keys, "same", V.agreeing(F.col("a"), F.col("b"), tolerance).cast("long").alias("n_agree"), F.size("a").cast("long").alias("n_found"), F.size("b").cast("long").alias("n_wanted")
    )
    return counted.withColumn("field_f1", f1_column(F.col("n_agree"), F.col("n_found"), F.col("n_wanted")))


def f1_column(agree: Column, found: Column, wanted: Column) -> Column:
    precision, recall = agree / found, agree / wanted
    return F.when((found == 0) & (wanted == 0), F.lit(1.0)).when(agree == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
