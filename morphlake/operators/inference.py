"""The schema that any number of JSON values have in common, in one pass.

Every value says, for each place in it, which kind of value is there; counts of
(place, kind) are all that a schema needs: a field is required where it occurs
as often as the objects around it.  Counts add up, in tasks first, and over
tables that were counted apart; the schema itself is as small as the places are
few, and is put together from their counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V

_OPEN = "array<struct<place:array<string>,v:variant>>"
_SEEN = "array<struct<place:array<string>,kind:string>>"
#: How a place goes on into the items of an array; names of fields begin with a dot.
ITEMS = "[]"
_KINDS = {V.NULL: "null", V.BOOLEAN: "boolean", V.INTEGER: "integer", V.STRING: "string", V.OBJECT: "object", V.ARRAY: "array"}


def places(v: Column) -> Column:
    """Place and kind of a VARIANT and of everything in it, level by level."""
    names = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    kind = lambda x: F.coalesce(F.try_element_at(names, V.kind(x)), F.lit("number"))

    def below(p: Column) -> Column:
        named = F.transform(V.fields(p["v"]), lambda e: F.struct(F.concat(p["place"], F.array(F.concat(F.lit("."), e["key"]))).alias("place"), e["value"].alias("v")))
        listed = F.transform(V.items(p["v"]), lambda x: F.struct(F.concat(p["place"], F.array(F.lit(ITEMS))).alias("place"), x.alias("v")))
        return F.coalesce(named, listed, F.array().cast(_OPEN))

    def level(state: Column, _: Column) -> Column:
        seen = F.transform(state["open"], lambda p: F.struct(p["place"].alias("place"), kind(p["v"]).alias("kind")))
        onward = F.flatten(F.transform(state["open"], below))
        return F.struct(onward.cast(_OPEN).alias("open"), F.concat(state["seen"], seen).cast(_SEEN).alias("seen"))

    root = F.array(F.struct(F.array().cast("array<string>").alias("place"), v.alias("v"))).cast(_OPEN)
    start = F.struct(root.alias("open"), F.array().cast(_SEEN).alias("seen"))
    return F.aggregate(F.sequence(F.lit(0), V.depth(v)), start, level, lambda state: state["seen"])


def kind_counts(df: DataFrame, column: str) -> DataFrame:
    """``place, kind, n`` over the values of a VARIANT column; absent values (SQL
    null) count nowhere.  Tables of counts add up by ``place`` and ``kind``."""
    v = F.col(f"`{column}`")
    return df.where(v.isNotNull()).select(F.inline(places(v))).groupBy("place", "kind").agg(F.count(F.lit(1)).alias("n"))


def added(*counts: DataFrame) -> DataFrame:
    """Counts of several tables as one."""
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("place", "kind").agg(F.sum("n").alias("n"))


def field_table(counts: DataFrame) -> DataFrame:
    """One row for each place: its ``path`` (``$`` for the whole), ``kinds`` in
    order, how often it occurs (``n``), and whether it is ``required``: a field
    that every object around it has."""
    joined = F.concat_ws(",", F.array_sort(F.collect_set("kind")))
    by_place = counts.groupBy("place").agg(joined.alias("kinds"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "object", F.col("n"))), F.lit(0)).alias("objects"))
    around = by_place.select(F.col("place").alias("around"), F.col("objects").alias("of"))
    inside = F.slice("place", F.lit(1), F.greatest(F.size("place") - 1, F.lit(0)))
    found = by_place.join(around, (inside == F.col("around")) & (F.size("place") > 0), "left")
    path = F.when(F.size("place") == 0, F.lit("$")).otherwise(F.concat(F.lit("$"), F.array_join("place", "")))
    last = F.element_at("place", F.lit(-1))
    required = F.when((F.size("place") > 0) & (last != ITEMS), F.col("n") == F.col("of")).otherwise(F.lit(False))
    return found.select(path.alias("path"), "kinds", "n", required.alias("required"))


def schema_of(counts: Iterable[tuple[tuple[str, ...], str, int]]) -> dict[str, Any]:
    """The schema that (place, kind, n) describe: what ``plans.schema.infer`` says
    of the values themselves."""
    at: dict[tuple[str, ...], dict[str, int]] = {}
    below: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for place, kind, n in counts:
        place = tuple(place)
        at.setdefault(place, {})[kind] = n
        if place:
            below.setdefault(place[:-1], set()).add(place)

    def of(place: tuple[str, ...]) -> dict[str, Any]:
        kinds = at.get(place, {})
        solid = kinds.keys() - {"null"}
        if not solid:
            return {"type": "null"}
        if solid == {"object"}:
            fields = sorted(p for p in below.get(place, ()) if p[-1] != ITEMS)
            whole = [p[-1][1:] for p in fields if sum(at[p].values()) == kinds["object"]]
            return {"type": "object", "properties": {p[-1][1:]: of(p) for p in fields}, "required": whole, "additionalProperties": False}
        if solid == {"array"}:
            return {"type": "array", "items": of((*place, ITEMS)) if (*place, ITEMS) in at else {}}
        if solid & {"object", "array"}:
            return {}
        if kinds.keys() == {"integer", "number"}:
            return {"type": "number"}
        return {"type": next(iter(kinds)) if len(kinds) == 1 else sorted(kinds)}

    return of(())


def infer_schema(df: DataFrame, column: str) -> dict[str, Any]:
    """The schema of a VARIANT column.  The driver gets a row for each place and
    kind, however many values there are."""
    return schema_of((tuple(r["place"]), r["kind"], r["n"]) for r in kind_counts(df, column).collect())
