"""Programs held in a column, run by Spark's own expressions.

A program that differs from row to row cannot be compiled into the plan.  It is
made data instead: every distinct program text is parsed once and becomes a
value of type ``PLAN``, an array of steps with their paths, literals and
patterns ready for use.  One fixed expression then runs any plan on any record,
a VARIANT: all steps read the record, so they are a ``transform`` over the
plan, and what they write is put together afterwards.  Records and targets
never leave the JVM.

Where no target path of a program lies at or above another, writes simply stand
side by side; else they are folded in order, with what objects and nulls do
below them.  The target is built from its deepest level upwards.

Beside ``plans.records`` the differences are few: integers are 64 bits (beyond
that casts fail and JSON integers are numbers); texts of objects list their
names in order; names with both kinds of quotes cannot be read; date formats
know the directives of ``functions.text``; arrays inside arrays have no order.

Where a table has few programs (``run_few``), each becomes an expression of its
own, with its paths and literals in it; rows choose theirs by number.
"""

from __future__ import annotations

import json
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import variant as V
from .program import ARRAY_OPS, Condition, Program, Step, path_parts

_TEST = "struct<path:string,name:string,operator:string,value:string>"
_SCALAR = (
    "struct<op:string,`to`:string,parts:array<string>,paths:array<string>,names:array<string>,value:string,other:string,"
    "then_path:string,else_path:string,mapping:map<string,string>,text:string,"
    f"factor:double,offset:double,`index`:int,pattern:string,groups:map<string,int>,pieces:array<string>,test:{_TEST}>"
)
#: A step: ``own``, what it does to one record, or ``children``, what it does to
#: each item of the array that ``own`` names.
PLAN = f"struct<plain:boolean,steps:array<struct<own:{_SCALAR},plain:boolean,children:array<{_SCALAR}>>>>"


# -- programs as data ------------------------------------------------------


#: A path at which nothing is.
_NOWHERE = "$['\x00']"


def variant_path(path: str) -> str | None:
    """A path as VARIANT functions take it; None if no name can be quoted."""
    out = "$"
    for part in path_parts(path):
        if "'" in part and '"' in part:
            return None
        out += f'["{part}"]' if "'" in part else f"['{part}']"
    return out


def _test(c: Condition | None) -> dict[str, Any] | None:
    return c and {"path": variant_path(c.path), "name": c.path, "operator": c.operator, "value": json.dumps(c.value)}


def _apart(steps: list[dict[str, Any]]) -> bool:
    """No step writes at, above or below what another writes."""
    paths = [s["parts"] for s in steps]
    if any(s["op"] == "flatten" for s in steps) or not all(paths):
        return False
    return not any(i != j and q[: len(p)] == p for i, p in enumerate(paths) for j, q in enumerate(paths))


def _simple(op: str, to: str, sources: list[str], **more: Any) -> dict[str, Any]:
    return {"op": op, "to": to, "parts": list(path_parts(to)), "paths": [variant_path(p) for p in sources], "names": sources, **more}


def _scalar(s: Step) -> list[dict[str, Any]]:
    """A step as data.  Nesting is written as what it does: an empty object, and
    then copies into it."""
    o, op = s.options, s.op
    if op == "nest":
        inside = [_simple("copy", f"{s.to}.{name}", [path]) if path_parts(name) else _simple("copy", name, [path]) for name, path in o["fields"].items()]
        return [_simple("constant", s.to, [], value="{}"), *inside]
    out = _simple(op, s.to, list(s.sources), test=_test(s.condition), factor=o.get("factor"), offset=o.get("offset"))
    if op in ("constant", "default"):
        out["value"] = json.dumps(o["value"])
    if op == "map_enum":
        out |= {"value": json.dumps(o["default"]), "mapping": {k: json.dumps(v) for k, v in o["mapping"].items()}}
    if op == "cast":
        out["text"] = o["target_type"]
    if op == "concat":
        out["text"] = o["separator"]
    if op == "split":
        out["index"] = max(-(2**31), min(2**31 - 1, o["index"]))
        out["text"] = "\\Q" + o["separator"].replace("\\E", "\\E\\\\E\\Q") + "\\E" if o["separator"] else None
    if op == "conditional":
        for side, literal, path in (("then", "value", "then_path"), ("otherwise", "other", "else_path")):
            x = o[side]
            out |= {literal: json.dumps(x.value)} if x.path is None else {path: variant_path(x.path) or _NOWHERE}
        out["names"] = [o[side].path or "" for side in ("then", "otherwise")]
    if op == "format_date":
        try:
            pattern, groups = X.date_pattern(o["input_format"])
            out |= {"pattern": pattern, "groups": groups, "pieces": X.date_pieces(o["output_format"])}
        except X.DateFormatError:
            pass  # no date follows the format
    return [out]


def _settled(steps: list[dict[str, Any]]) -> tuple[list[dict[str, Any]], bool]:
    """Steps, and whether they write apart; then what only clears a place goes."""
    kept = [s for k, s in enumerate(steps) if not (s["op"] == "constant" and s.get("value") == "{}" and k + 1 < len(steps) and steps[k + 1]["parts"][: len(s["parts"])] == s["parts"] != steps[k + 1]["parts"])]
    return (kept, True) if _apart(kept) else (steps, _apart(steps))


def plan(program: Program) -> dict[str, Any]:
    """The value of type ``PLAN`` that says what the program says."""
    own: list[dict[str, Any]] = []
    inner: dict[int, tuple[list[dict[str, Any]], bool]] = {}
    for s in program.steps:
        made = _scalar(s)
        if s.op == "map_array":
            inner[id(made[0])] = _settled([c for child in s.steps for c in _scalar(child)])
        if s.op == "filter_array":
            inner[id(made[0])] = [_simple("conditional", "keep", [], test=_test(s.condition), value="true", other="false")], True
        own += made
    steps, plain = _settled(own)
    return {"plain": plain, "steps": [{"own": s, "plain": inner.get(id(s), ([], True))[1], "children": inner.get(id(s), ([], True))[0]} for s in steps]}


def arrow_ready(x: Any, kind: T.DataType) -> Any:
    """Maps as lists of pairs and absent fields as nulls, for Arrow."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: arrow_ready(x.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [arrow_ready(v, kind.elementType) for v in x]
    return list(x.items()) if isinstance(kind, T.MapType) else x


# -- conditions ------------------------------------------------------------

_NUMERIC = (V.INTEGER, *V.NUMBER, V.BOOLEAN)


def same(a: Column, b: Column) -> Column:
    """Equality as conditions have it: 1 equals 1.0 and true."""
    kinds = F.struct(V.kind(a).alias("a"), V.kind(b).alias("b"))
    nested = lambda k: k["a"].isin(V.OBJECT, V.ARRAY) & (k["a"] == k["b"])
    return V.let(kinds, lambda k: F.when(nested(k), V.nodes_equal(V.nodes(a), V.nodes(b), 0.0, True)).otherwise(V.scalars_equal(a, b, 0.0, True)))


def _ordered(operator: Column, a: Column, b: Column) -> Column:
    """Order of scalars; false where the kinds have none."""

    def by(x: Column, y: Column) -> Column:
        return F.when(operator == "gt", x > y).when(operator == "ge", x >= y).when(operator == "lt", x < y).otherwise(x <= y)

    kinds = F.struct(V.kind(a).alias("a"), V.kind(b).alias("b"))
    numbers = F.struct(V.double(a).alias("a"), V.double(b).alias("b"))
    return V.let(
        kinds,
        lambda k: F.when((k["a"] == V.INTEGER) & (k["b"] == V.INTEGER), by(V.whole(a), V.whole(b)))
        .when(k["a"].isin(*_NUMERIC) & k["b"].isin(*_NUMERIC), V.let(numbers, lambda d: by(d["a"], d["b"]) & ~F.isnan(d["a"]) & ~F.isnan(d["b"])))
        .when((k["a"] == V.STRING) & (k["b"] == V.STRING), by(V.string(a), V.string(b)))
        .otherwise(F.lit(False)),
    )


_ORDERS, _EQUALITIES, _MEMBERSHIPS = ("gt", "ge", "lt", "le"), ("eq", "ne"), ("in", "contains")


def compared(x: Column, y: Column, operator: Column) -> Column:
    """The pairs that a condition asks about, and whether each is equal: the two
    values for equality, the item with each item of the container for
    membership, items at the same place of two arrays for order."""
    item, container = F.when(operator == "contains", y).otherwise(x), F.when(operator == "contains", x).otherwise(y)
    xs, ys = V.items(x), V.items(y)
    n = F.least(F.size(xs), F.size(ys))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    pairs = (
        F.when(operator.isin(*_EQUALITIES), F.array(pair(x, y)))
        .when(operator.isin(*_MEMBERSHIPS), F.transform(V.items(container), lambda c: pair(item, c)))
        .when(operator.isin(*_ORDERS) & xs.isNotNull() & ys.isNotNull(), F.zip_with(F.slice(xs, F.lit(1), n), F.slice(ys, F.lit(1), n), pair))
    )
    return F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), same(p["a"], p["b"]).alias("same")))


def predicate(x: Column, y: Column, operator: Column, pairs: Column) -> Column:
    """A condition's operator on a value; false where kinds do not allow it.
    pairs: what ``compared`` says."""
    item, container = F.when(operator == "contains", y).otherwise(x), F.when(operator == "contains", x).otherwise(y)
    equal = F.exists(pairs, lambda p: p["same"])
    differ = F.get(F.filter(pairs, lambda p: ~p["same"]), F.lit(0))
    sizes = F.struct(F.size(V.items(x)).cast("variant").alias("a"), F.size(V.items(y)).cast("variant").alias("b"))
    sides = F.when(pairs.isNull(), F.struct(x.alias("a"), y.alias("b"))).when(differ.isNull(), sizes).otherwise(F.struct(differ["a"], differ["b"]))
    within = (
        F.when(V.kind(item) != V.STRING, F.lit(False))
        .when(V.kind(container) == V.STRING, F.contains(V.string(container), V.string(item)))
        .otherwise(F.exists(V.fields(container), lambda e: e["key"] == V.string(item)))
    )
    held = (
        F.when(operator == "exists", F.lit(True))
        .when(operator.isin(*_EQUALITIES), equal == (operator == "eq"))
        .when(operator.isin(*_MEMBERSHIPS), F.coalesce(equal, within))
        .otherwise(V.let(sides, lambda p: _ordered(operator, p["a"], p["b"])))
    )
    return F.coalesce(held, F.lit(False))


# -- targets ---------------------------------------------------------------

_ENTRIES = "array<struct<p:array<string>,v:variant>>"


def _entries() -> Column:
    return F.array().cast(_ENTRIES)


def _under(p: Column, q: Column) -> Column:
    """``p`` lies at or below ``q``."""
    return F.slice(p, F.lit(1), F.size(q)) == q


def _opened(entries: Column, q: Column) -> Column:
    """What stands above ``q`` as its fields, where it is an object or null."""

    def level(now: Column, k: Column) -> Column:
        def parts(e: Column) -> Column:
            fields = F.when(V.kind(e["v"]) == V.NULL, _entries()).otherwise(F.transform(V.fields(e["v"]), lambda f: F.struct(F.concat(e["p"], F.array(f["key"])).alias("p"), f["value"].alias("v"))))
            return F.when(e["p"] == F.slice(q, F.lit(1), k), F.coalesce(fields, F.array(e))).otherwise(F.array(e))

        return F.flatten(F.transform(now, parts)).cast(_ENTRIES)

    return F.when(F.size(q) > 1, F.aggregate(F.sequence(F.lit(1), F.size(q) - 1), entries, level)).otherwise(entries)


def spare_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


_STATE = f"struct<entries:{_ENTRIES},error:string>"


def _state(entries: Column, error: Column) -> Column:
    return F.struct(entries.alias("entries"), error.cast("string").alias("error")).cast(_STATE)


def _put(state: Column, write: Column) -> Column:
    q = write["p"]

    def placed(now: Column) -> Column:
        blocked = F.exists(now, lambda e: (F.size(e["p"]) < F.size(q)) & _under(q, e["p"]))
        rest = F.filter(now, lambda e: ~_under(e["p"], q))
        return F.when(blocked, _state(now, F.concat(F.array_join(q, "."), F.lit(" has no room below a value")))).otherwise(_state(F.concat(rest, F.array(write)), F.lit(None)))

    return (
        F.when(state["error"].isNotNull(), state)
        .when(F.size(q) == 0, _state(_entries(), F.lit("nowhere to write: the target path is empty")))
        .otherwise(V.let(_opened(state["entries"], q), placed))
    )


def built(entries: Column) -> Column:
    """The object that has these fields, from the deepest level upwards."""

    def closed(now: Column, k: Column) -> Column:
        def heads(deep: Column) -> Column:
            above = F.array_distinct(F.transform(deep, lambda e: F.slice(e["p"], F.lit(1), k - 1)))
            whole = lambda h: F.to_variant_object(F.map_from_entries(F.transform(F.filter(deep, lambda e: _under(e["p"], h)), lambda e: F.struct(F.element_at(e["p"], -1), e["v"]))))
            return F.transform(above, lambda h: F.struct(h.alias("p"), whole(h).alias("v")))

        return F.concat(F.filter(now, lambda e: F.size(e["p"]) < k), V.let(F.filter(now, lambda e: F.size(e["p"]) == k), heads)).cast(_ENTRIES)

    deepest = F.coalesce(F.array_max(F.transform(entries, lambda e: F.size(e["p"]))), F.lit(0))
    flat = V.let(deepest, lambda d: F.when(d > 1, F.aggregate(F.sequence(d, F.lit(2), F.lit(-1)), entries, closed)).otherwise(entries))
    return V.let(flat, lambda now: F.to_variant_object(F.map_from_entries(F.transform(now, lambda e: F.struct(F.get(e["p"], F.lit(0)), e["v"])))))


# -- steps -----------------------------------------------------------------


def _cast(v: Column, shown: Column, to: Column) -> Column:
    """Null where the value cannot be cast."""
    string, real = T.StringType(), T.DoubleType()
    by_kind = lambda k, s, n, i: F.when(k == V.STRING, s).when(k.isin(*V.NUMBER), n).when(k == V.INTEGER, i)
    return V.let(
        F.struct(V.kind(v).alias("k"), V.string(v).alias("s"), V.double(v).alias("d"), V.whole(v).alias("i")),
        lambda x: F.when(to == "string", shown.cast("variant"))
        .when(to == "integer", by_kind(x["k"], X.to_integer(x["s"], string), X.to_integer(x["d"], real), x["i"]).cast("variant"))
        .when(to == "number", by_kind(x["k"], X.to_number(x["s"], string), x["d"], x["d"]).cast("variant"))
        .when(x["k"] == V.BOOLEAN, v)
        .otherwise(by_kind(x["k"], X.to_boolean(x["s"], string), X.to_boolean(x["d"], real), X.to_boolean(x["d"], real)).cast("variant")),
    )


#: Operations that read texts, all of which have to be there.
_TEXTUAL = ("map_enum", "format_date", "concat", "split", "cast")


def _read(s: Column, record: Column) -> Column:
    """Values of a step's sources, with their texts where it needs them."""
    textual = s["op"].isin(*_TEXTUAL) & ((s["op"] != "cast") | (s["text"] == "string"))
    return F.transform(s["paths"], lambda p: V.let(V.get(record, p), lambda v: F.struct(v.alias("v"), F.when(textual, V.text(v)).alias("t"))))


def _value(s: Column, record: Column, read: Column, holds: Column) -> Column:
    """What a step with one result writes; null where it fails."""
    op, v, shown = s["op"], F.get(read, F.lit(0))["v"], F.get(read, F.lit(0))["t"]
    solid = F.get(F.filter(read, lambda x: x["v"].isNotNull() & ~F.is_variant_null(x["v"])), F.lit(0))["v"]
    chosen = lambda path, literal: F.when(path.isNotNull(), V.get(record, path)).otherwise(F.parse_json(literal))
    item = lambda parts: F.get(parts, F.when(s["index"] >= 0, s["index"]).otherwise(F.size(parts) + s["index"])).cast("variant")
    texts = F.transform(read, lambda x: x["t"])
    return (
        F.when(op == "copy", v)
        .when(op == "constant", F.parse_json(s["value"]))
        .when(op == "cast", _cast(v, shown, s["text"]))
        .when(op == "default", F.coalesce(solid, F.parse_json(s["value"])))
        .when(op == "coalesce", solid)
        .when(op == "map_enum", F.when(shown.isNotNull(), F.parse_json(F.coalesce(F.try_element_at(s["mapping"], shown), s["value"]))))
        .when(op == "scale", F.when(V.kind(v).isin(V.INTEGER, *V.NUMBER), (V.double(v) * s["factor"] + s["offset"]).cast("variant")))
        .when(op == "format_date", V.let(X.read_date_by(shown, s["pattern"], s["groups"]), lambda d: X.write_date_by(d, s["pieces"]).cast("variant")))
        .when(op == "concat", F.when(~F.exists(texts, lambda t: t.isNull()), F.call_function("array_join", texts, s["text"]).cast("variant")))
        .when(op == "split", V.let(F.split(shown, s["text"], F.lit(-1)), item))
        .when(op == "conditional", F.when(holds, chosen(s["then_path"], s["value"])).when(~holds, chosen(s["else_path"], s["other"])))
    )


#: Operations for which an absent source is no error by itself.
_LENIENT = ("constant", "default", "coalesce", "conditional")


def _complaint(s: Column, record: Column, holds: Column) -> Column:
    """Why a step fails.  holds: of a conditional, whether its condition does."""
    absent = F.get(F.filter(F.arrays_zip(s["paths"], s["names"]), lambda p: V.get(record, p["paths"]).isNull()), F.lit(0))["names"]
    untested = V.get(record, s["test"]["path"]).isNull()
    chosen = F.when(untested, s["test"]["name"]).when(holds, F.get(s["names"], F.lit(0))).otherwise(F.get(s["names"], F.lit(1)))
    name = F.when(~s["op"].isin(*_LENIENT), absent).when(s["op"] == "conditional", chosen)
    failed = F.concat(F.lit("cannot "), s["op"], F.lit(" "), F.array_join(s["names"], ", "), F.lit(" to "), s["to"])
    return F.coalesce(F.concat(F.lit("missing source path "), name), failed)


_WRITES = f"struct<w:{_ENTRIES},e:string>"


def _wrote(s: Any, record: Column, value: Column, holds: Column | None = None, complaint: Column | None = None) -> Column:
    """A step's writes (``w``), or why it has none (``e``)."""

    def spread(e: Column) -> Column:
        full = F.when(s["to"] == "", e["key"]).otherwise(F.concat(s["to"], F.lit("."), e["key"]))
        return F.struct(F.when(full.isin("", "$"), F.array().cast("array<string>")).otherwise(F.split(full, "\\.", -1)).alias("p"), e["value"].alias("v"))

    fields = V.fields(V.get(record, F.get(s["paths"], F.lit(0))))
    single = lambda v: F.when(v.isNotNull(), F.array(F.struct(s["parts"].alias("p"), v.alias("v"))).cast(_ENTRIES))
    why = _complaint(s, record, F.lit(None).cast("boolean") if holds is None else holds) if complaint is None else complaint
    writes = F.when(s["op"] == "flatten", F.transform(fields, spread).cast(_ENTRIES)).otherwise(V.let(value, single))
    return V.let(writes, lambda w: F.struct(F.coalesce(w, _entries()).alias("w"), F.when(w.isNull(), why).alias("e")).cast(_WRITES))


def _outcome(done: Column, plain: Column) -> Column:
    """``target`` and ``error``, one of them null, of what steps wrote."""

    def together(d: Column) -> Column:
        error = F.get(F.filter(F.transform(d, lambda x: x["e"]), lambda e: e.isNotNull()), F.lit(0))
        # a fault in placing what earlier steps wrote comes before it
        sound = F.aggregate(d, F.struct(_entries().alias("w"), F.lit(None).cast("string").alias("e")), lambda s, x: F.when(s["e"].isNotNull(), s).otherwise(F.struct(F.concat(s["w"], x["w"]).alias("w"), x["e"].alias("e"))).cast(_WRITES), lambda s: s["w"])
        in_order = F.aggregate(sound, _state(_entries(), F.lit(None)), lambda s, w: _put(s, w).cast(_STATE))
        beside = _state(F.flatten(F.transform(d, lambda x: x["w"])), error)
        return F.when(plain, beside).otherwise(V.let(in_order, lambda s: _state(s["entries"], F.coalesce(s["error"], error))))

    finished = lambda f: F.struct(F.when(f["error"].isNull(), built(f["entries"])).alias("target"), f["error"].alias("error"))
    return V.let(V.let(done, together), finished)


def _jobs(program: Column, record: Column, r: Column) -> Column:
    """What has to be done for a record: a step on it is one job, a step on an
    array one for each item and child step.  ``r, k, i`` say which record, step
    and item a job belongs to."""

    def of_step(s: Column, k: Column) -> Column:
        job = lambda c, on, i: F.struct(r.alias("r"), k.alias("k"), i.alias("i"), c.alias("s"), on.alias("on"))
        items = V.items(V.get(record, F.get(s["own"]["paths"], F.lit(0))))
        each = F.transform(items, lambda x, i: F.transform(s["children"], lambda c: job(c, x, i)))
        return F.when(s["own"]["op"].isin(*ARRAY_OPS), F.coalesce(F.flatten(each), F.array())).otherwise(F.array(job(s["own"], record, F.lit(0))))

    return F.flatten(F.transform(program["steps"], of_step))


def _gathered(s: Column, record: Column, done: Column) -> Column:
    """What a step wrote; done: what its jobs wrote."""
    own = s["own"]
    items = V.items(V.get(record, F.get(own["paths"], F.lit(0))))
    targets = F.transform(items, lambda _, i: _outcome(F.filter(done, lambda d: d["i"] == i), s["plain"])["target"])
    mapped = V.let(targets, lambda t: F.when(~F.exists(t, lambda v: v.isNull()), F.to_variant_object(t)))
    kept = F.filter(F.arrays_zip(done.alias("d"), items.alias("x")), lambda z: V.string(F.get(z["d"]["w"], F.lit(0))["v"]) == "true")
    filtered = F.when(~F.exists(done, lambda d: d["e"].isNotNull()), F.to_variant_object(F.transform(kept, lambda z: z["x"])))
    value = F.when(items.isNull(), V.none()).when(own["op"] == "map_array", mapped).otherwise(filtered)
    alone = F.get(done, F.lit(0))
    return F.when(own["op"].isin(*ARRAY_OPS), _wrote(own, record, value)).otherwise(F.struct(alone["w"].alias("w"), alone["e"].alias("e")).cast(_WRITES))


@lru_cache(maxsize=64)
def _stages(session: int, program: str, records: str, jobs: str, tests: str, pairs: str, holds: str, values: str, out: str) -> list[tuple[str, Column]]:
    """Names and expressions of the projections; they depend on names only, and
    are many small calls, so a session makes them once.

    Arrays beside ``jobs`` say what is known of each; they are zipped where they
    meet, as ``transform`` copies all that its function returns."""
    plan, record_list = F.col(f"`{program}`"), F.col(f"`{records}`")
    col = lambda n: F.col(f"`{n}`")
    zipped = lambda *names: F.arrays_zip(*(col(n).alias(short) for n, short in names))
    j, t, p, h, v = (jobs, "j"), (tests, "t"), (pairs, "p"), (holds, "h"), (values, "v")
    operator = lambda z: z["j"]["s"]["test"]["operator"]
    asked = lambda z, what: F.when((z["j"]["s"]["op"] == "conditional") & z["t"]["x"].isNotNull(), what)
    tested = lambda j: F.when(j["s"]["op"] == "conditional", F.struct(V.get(j["on"], j["s"]["test"]["path"]).alias("x"), F.parse_json(j["s"]["test"]["value"]).alias("y")))
    valued = lambda z: V.let(_read(z["j"]["s"], z["j"]["on"]), lambda read: _value(z["j"]["s"], z["j"]["on"], read, z["h"]))
    wrote = lambda z: V.let(
        _wrote(z["j"]["s"], z["j"]["on"], z["v"], z["h"]), lambda w: F.struct(z["j"]["r"].alias("r"), z["j"]["k"].alias("k"), z["j"]["i"].alias("i"), w["w"].alias("w"), w["e"].alias("e"))
    )
    # bound by ``let``: the optimizer would move what makes them into the inner function
    gathered = lambda done: F.transform(record_list, lambda record, r: F.transform(plan["steps"], lambda s, k: _gathered(s, record, F.filter(done, lambda d: (d["r"] == r) & (d["k"] == k)))))
    failed = F.struct(V.none().alias("target"), F.lit("the record is not JSON").alias("error"))
    return [
        (jobs, F.flatten(F.transform(record_list, lambda record, r: _jobs(plan, record, r)))),
        (tests, F.transform(col(jobs), tested)),
        (pairs, F.transform(zipped(j, t), lambda z: asked(z, compared(z["t"]["x"], z["t"]["y"], operator(z))))),
        (holds, F.transform(zipped(j, t, p), lambda z: asked(z, predicate(z["t"]["x"], z["t"]["y"], operator(z), z["p"])))),
        (values, F.transform(zipped(j, h), valued)),
        (values, F.transform(zipped(j, h, v), wrote)),
        (values, V.let(col(values), gathered)),
        (out, F.transform(col(values), lambda d, r: F.when(F.get(record_list, r).isNull(), failed).otherwise(_outcome(d, plan["plain"])))),
    ]


def run(df: DataFrame, program: str, records: str, out: str) -> DataFrame:
    """``df`` and ``out``, an array: for each of ``records`` (an array of VARIANT)
    its ``target`` and ``error``, one of them null, by the row's ``program``, a
    column of type ``PLAN``.  The error is that of the first step in order that
    fails; a null record is no JSON; without a program there is no result.

    Each stage is a projection; together they are one pass over the rows."""
    own = [spare_name(df, n) for n in ("jobs", "tests", "pairs_", "holds", "values_")]
    for name, made in _stages(id(df.sparkSession.sparkContext), program, records, *own, out):
        df = df.withColumn(name, made)
    return df.drop(*own)


# -- programs known when the job is planned ---------------------------------


def _fixed_test(s: dict[str, Any], record: Column) -> Column:
    """Whether a step's condition holds; null where its path leads nowhere."""
    test, operator = s["test"], F.lit(s["test"]["operator"])
    x, y = V.get(record, test["path"] or _NOWHERE), F.parse_json(F.lit(test["value"]))
    return V.let(x, lambda x: F.when(x.isNotNull(), V.let(compared(x, y, operator), lambda pairs: predicate(x, y, operator, pairs))))


def _fixed_value(step: dict[str, Any], record: Column) -> Column:
    """What a step writes; null where it fails."""
    s, op = step["own"], step["own"]["op"]
    reads = [V.get(record, p or _NOWHERE) for p in s["paths"]]
    literal = lambda text: F.parse_json(F.lit(text))
    solid = lambda v: V.let(v, lambda v: F.when(~F.is_variant_null(v), v))
    texts = [V.let(v, V.text) for v in reads] if op in _TEXTUAL else []
    if op == "copy":
        return reads[0]
    if op == "constant":
        return literal(s["value"])
    if op == "cast":
        return texts[0].cast("variant") if s["text"] == "string" else V.let(reads[0], lambda v: _cast(v, F.lit(None).cast("string"), F.lit(s["text"])))
    if op == "default":
        return F.coalesce(solid(reads[0]), literal(s["value"]))
    if op == "coalesce":
        return F.coalesce(*map(solid, reads))
    if op == "map_enum":
        known = F.create_map(*(F.lit(x) for pair in s["mapping"].items() for x in pair)) if s["mapping"] else F.lit(None).cast("map<string,string>")
        return V.let(texts[0], lambda t: F.when(t.isNotNull(), F.parse_json(F.coalesce(F.try_element_at(known, t), F.lit(s["value"])))))
    if op == "scale":
        return V.let(reads[0], lambda v: F.when(V.kind(v).isin(V.INTEGER, *V.NUMBER), (V.double(v) * F.lit(s["factor"]) + F.lit(s["offset"])).cast("variant")))
    if op == "format_date":
        return V.none() if s["pattern"] is None else V.let(X.read_date_at(texts[0], s["pattern"], s["groups"]), lambda d: X.write_date_at(d, s["pieces"]).cast("variant"))
    if op == "concat":
        return V.let(F.array(*texts), lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.array_join(t, s["text"]).cast("variant")))
    if op == "split":
        at = lambda parts: F.get(parts, F.lit(s["index"]) if s["index"] >= 0 else F.size(parts) + s["index"]).cast("variant")
        return V.none() if s["text"] is None else V.let(F.split(texts[0], s["text"], -1), at)
    if op == "conditional":
        chosen = lambda path, text: V.get(record, path) if path is not None else literal(text)
        return V.let(_fixed_test(s, record), lambda h: F.when(h, chosen(s["then_path"], s["value"])).when(~h, chosen(s["else_path"], s["other"])))
    items = V.items(reads[0])
    if op == "map_array":
        inner = {"plain": step["plain"], "steps": [{"own": c} for c in step["children"]]}
        targets = F.transform(items, lambda x: _fixed_outcome(inner, x)["target"])
        return V.let(targets, lambda t: F.when(~F.exists(t, lambda v: v.isNull()), F.to_variant_object(t)))
    tested = F.transform(items, lambda x: F.struct(x.alias("x"), _fixed_test(step["children"][0], x).alias("keep")))
    kept = lambda z: F.to_variant_object(F.transform(F.filter(z, lambda i: i["keep"]), lambda i: i["x"]))
    return V.let(tested, lambda z: F.when(~F.exists(z, lambda i: i["keep"].isNull()), kept(z)))


def _fixed_complaint(s: dict[str, Any], record: Column) -> Column:
    """Why a step fails, as in ``_complaint``."""
    absent = lambda path: V.get(record, path or _NOWHERE).isNull()
    named = F.lit(None).cast("string")
    if s["op"] == "conditional":
        chosen = F.when(_fixed_test(s, record), F.lit(s["names"][0])).otherwise(F.lit(s["names"][1]))
        named = F.when(absent(s["test"]["path"]), F.lit(s["test"]["name"])).otherwise(chosen)
    elif s["op"] not in _LENIENT:
        named = F.coalesce(named, *(F.when(absent(p), F.lit(name)) for p, name in zip(s["paths"], s["names"])))
    return F.coalesce(F.concat(F.lit("missing source path "), named), F.lit(f"cannot {s['op']} {', '.join(s['names'])} to {s['to']}"))


def _fixed_outcome(program: dict[str, Any], record: Column) -> Column:
    """``target`` and ``error``, one of them null, of a program that is known."""
    steps = [step["own"] for step in program["steps"]]
    if not program["plain"]:
        literals = lambda s: {"to": F.lit(s["to"]), "parts": F.lit(s["parts"]).cast("array<string>"), "paths": F.array(*(F.lit(p) for p in s["paths"])).cast("array<string>"), "op": F.lit(s["op"])}
        value = lambda step: V.none() if step["own"]["op"] == "flatten" else _fixed_value(step, record)
        return _outcome(F.array(*(_wrote(literals(step["own"]), record, value(step), complaint=_fixed_complaint(step["own"], record)) for step in program["steps"])), F.lit(False))
    tree: dict[str, Any] = {}
    for k, s in enumerate(steps):
        at = tree
        for name in s["parts"][:-1]:
            at = at.setdefault(name, {})
        at[s["parts"][-1]] = k

    def whole(at: dict[str, Any], values: Column) -> Column:
        return F.named_struct(*(x for name, k in at.items() for x in (F.lit(name), whole(k, values) if isinstance(k, dict) else values[f"v{k}"])))

    def finished(values: Column) -> Column:
        failed = [F.when(values[f"v{k}"].isNull(), _fixed_complaint(s, record)) for k, s in enumerate(steps)]
        return V.let(F.coalesce(*failed), lambda e: F.struct(F.when(e.isNull(), F.to_variant_object(whole(tree, values))).alias("target"), e.alias("error")))

    return V.let(F.struct(*(_fixed_value(step, record).alias(f"v{k}") for k, step in enumerate(program["steps"]))), finished)


def run_few(df: DataFrame, which: Column, programs: dict[int, dict[str, Any]], records: str, out: str) -> DataFrame:
    """What ``run`` does where the programs are few: ``which`` is the number of the
    row's program in ``programs`` (values of type ``PLAN``), and each of these is
    an expression of its own, without a look at what its steps are."""
    failed = F.struct(V.none().alias("target"), F.lit("the record is not JSON").alias("error"))
    made = lambda p: F.transform(f"`{records}`", lambda record: F.when(record.isNull(), failed).otherwise(_fixed_outcome(p, record)))
    found = F.lit(None).cast("array<struct<target:variant,error:string>>")
    for k, p in programs.items():
        found = F.when(which == k, made(p)).otherwise(found)
    return df.withColumn(out, found)
