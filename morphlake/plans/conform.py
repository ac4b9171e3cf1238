"""Schemas as data: JSON of unknown shape checked against schemas by Spark's own
expressions, with the first breach.

A schema becomes an array of rules (type ``RULES``), one for each place in it:
how to get there (names, items, further names), and what must hold there.  One
fixed expression follows every rule through a VARIANT and lists what breaks it,
so a schema may be a literal or differ from row to row.  Breaches come in the
order of their paths, as in ``plans.schema.first_breach``.
"""

from __future__ import annotations

import json
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import variant as V
from .schema import KEYWORDS, SchemaError, types_of

_RULE = (
    "struct<way:array<struct<items:boolean,name:string,known:array<string>>>,kinds:array<string>,required:array<string>,"
    "known:array<string>,closed:boolean,unsupported:string>"
)
RULES = f"array<{_RULE}>"
_LAST = 2**31 - 1
_PLACES = "array<struct<at:array<string>,v:variant>>"
_NAMES = {V.NULL: "null", V.BOOLEAN: "boolean", V.INTEGER: "integer", V.STRING: "string", V.OBJECT: "object", V.ARRAY: "array"}


def rules(schema: dict[str, Any], way: tuple[dict[str, Any], ...] = ()) -> list[dict[str, Any]]:
    """The rules of a schema, outer places first."""
    if not isinstance(schema, dict):
        raise SchemaError(f"a schema is an object, not {schema!r}")
    fields, more = schema.get("properties", {}), schema.get("additionalProperties")
    known = sorted(fields)
    odd = sorted(schema.keys() - KEYWORDS)
    own = {
        "way": list(way),
        "kinds": sorted(types_of(schema)),
        "required": list(schema.get("required", ())),
        "known": known,
        "closed": more is False,
        "unsupported": f"unsupported keywords {odd}" if odd else None,
    }
    if odd:
        return [own]
    below = [({"items": False, "name": name, "known": None}, fields[name]) for name in known]
    if isinstance(more, dict):
        below.append(({"items": False, "name": None, "known": known}, more))
    if "items" in schema:
        below.append(({"items": True, "name": None, "known": None}, schema["items"]))
    return [own, *(rule for step, inner in below for rule in rules(inner, (*way, step)))]


def _reached(v: Column, rule: Column) -> Column:
    """The values at a rule's place, and their paths."""

    def onward(now: Column, step: Column) -> Column:
        def below(p: Column) -> Column:
            listed = F.transform(V.items(p["v"]), lambda x, i: F.struct(F.concat(p["at"], F.array(i.cast("string"))).alias("at"), x.alias("v")))
            wanted = lambda e: F.when(step["name"].isNotNull(), e["key"] == step["name"]).otherwise(~F.array_contains(step["known"], e["key"]))
            named = F.transform(F.filter(V.fields(p["v"]), wanted), lambda e: F.struct(F.concat(p["at"], F.array(e["key"])).alias("at"), e["value"].alias("v")))
            return F.coalesce(F.when(step["items"], listed).otherwise(named), F.array().cast(_PLACES))

        return F.flatten(F.transform(now, below)).cast(_PLACES)

    return F.aggregate(rule["way"], F.array(F.struct(F.array().cast("array<string>").alias("at"), v.alias("v"))).cast(_PLACES), onward)


def _fits(kind: Column, v: Column, wanted: Column) -> Column:
    d = V.double(v)
    real = kind.isin(*V.NUMBER)
    return (
        F.when(wanted == "number", real | (kind == V.INTEGER))
        .when(wanted == "integer", (kind == V.INTEGER) | (real & (d % 1 == 0)))
        .otherwise(F.when(real, F.lit(False)).otherwise(F.coalesce(F.try_element_at(_names(), kind) == wanted, F.lit(False))))
    )


def _names() -> Column:
    return F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair))


def _broken(place: Column, rule: Column) -> Column:
    """What a value breaks: its kind, then what it lacks, then what it has too much."""
    fields, kind = V.fields(place["v"]), V.kind(place["v"])
    fault = lambda rank, what: F.struct(place["at"].alias("at"), (rank if isinstance(rank, Column) else F.lit(rank)).alias("rank"), what.alias("what"))
    named = F.coalesce(F.try_element_at(_names(), kind), F.lit("number"))
    own = F.when((F.size(rule["kinds"]) > 0) & ~F.exists(rule["kinds"], lambda k: _fits(kind, place["v"], k)), F.array(fault(-1, F.concat(named, F.lit(" is not of type "), F.array_join(rule["kinds"], ", ")))))
    absent = F.filter(rule["required"], lambda r: ~F.exists(fields, lambda e: e["key"] == r))
    lacking = F.transform(absent, lambda r, i: fault(i, F.concat(r, F.lit(" is required"))))
    surplus = F.transform(F.filter(fields, lambda e: rule["closed"] & ~F.array_contains(rule["known"], e["key"])), lambda e: fault(_LAST, F.concat(e["key"], F.lit(" is not allowed"))))
    none = F.array().cast("array<struct<at:array<string>,rank:int,what:string>>")
    return F.concat(F.coalesce(own, none), F.when(fields.isNotNull(), F.concat(lacking, surplus)).otherwise(none))


def breach(v: Column, schema: Column) -> Column:
    """``path``, ``what`` (null if nothing is broken) and ``unsupported`` (a keyword
    on the way that is not known) of a VARIANT; schema: of type ``RULES``."""

    def told(r: Column) -> Column:
        places = _reached(v, r)
        return V.let(places, lambda p: F.struct(F.flatten(F.transform(p, lambda x: _broken(x, r))).alias("faults"), F.when(F.size(p) > 0, r["unsupported"]).alias("unsupported")))

    def first(found: Column) -> Column:
        least = F.array_min(F.flatten(F.transform(found, lambda f: f["faults"])))
        path = F.when(F.size(least["at"]) == 0, F.lit("$")).otherwise(F.array_join(least["at"], "."))
        odd = F.get(F.filter(F.transform(found, lambda f: f["unsupported"]), lambda u: u.isNotNull()), F.lit(0))
        return F.struct(F.when(least.isNotNull(), path).alias("path"), least["what"].alias("what"), odd.alias("unsupported"))

    return V.let(F.transform(schema, told), first)


def fits(v: Column, schema: list[dict[str, Any]]) -> Column:
    """Whether a VARIANT breaks none of the rules of a schema that is known when
    the job is planned; false where only ``breach`` can tell (items, further
    names, keywords that are not known)."""
    held = F.lit(True)
    for rule in schema:
        names = [step["name"] for step in rule["way"]]
        if rule["unsupported"] or any(n is None or ("'" in n and '"' in n) for n in names):
            return F.lit(False)
        held = held & _keeps(V.get(v, "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in names)) if names else v, rule)
    return held


def _keeps(v: Column, rule: dict[str, Any]) -> Column:
    """Whether a value keeps a rule; what is not there does."""
    kinds, required, known = rule["kinds"] or [], rule["required"] or [], rule["known"] or []

    def of(x: Column) -> Column:
        keys = x["keys"]
        shape = {"object": keys.isNotNull(), "array": V.items(x["v"]).isNotNull()}
        right = F.lit(not kinds)
        for k in kinds:
            right = right | (shape[k] if k in shape else V.let(V.kind(x["v"]), lambda kind: _fits(kind, x["v"], F.lit(k))))
        for name in required:
            right = right & (keys.isNull() | F.array_contains(keys, name))
        if rule["closed"]:
            right = right & (keys.isNull() | F.forall(keys, lambda k: k.isin(*known)))
        return x["v"].isNull() | right

    return V.let(F.struct(v.alias("v"), F.map_keys(F.try_variant_get(v, F.lit("$"), "map<string,variant>")).alias("keys")), of)


@lru_cache(maxsize=256)
def _literal(text: str) -> str:
    return json.dumps(rules(json.loads(text)))


def first_breach(v: Column, schema: dict[str, Any]) -> Column:
    """``path: what`` of the first breach of a VARIANT, null if it fits; absent
    values (SQL null) have no breach to tell."""
    if any(r["unsupported"] for r in rules(schema)):
        raise SchemaError("the schema has unsupported keywords")
    found = breach(v, F.from_json(F.lit(_literal(json.dumps(schema))), RULES))
    return F.when(v.isNotNull(), V.let(found, lambda b: F.concat(b["path"], F.lit(": "), b["what"])))
