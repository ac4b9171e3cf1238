"""JSON values of unknown shape as VARIANT columns: kinds, texts, nodes, comparison.

A value that is not there is SQL null, JSON's null is a variant null.  Nothing
here knows a schema: values are opened level by level inside the row, as deep as
they go, so neither rows are exploded nor anything is shuffled or sent to Python.

Numbers with a point or an exponent are ``number``, others ``integer``; beyond
64 bits those are numbers too.  Objects list their names in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

#: What ``kind`` says: the first letters of Spark's name for a variant's type.
NULL, BOOLEAN, INTEGER, STRING, OBJECT, ARRAY = "VO", "BO", "BI", "ST", "OB", "AR"
NUMBER = ("DE", "DO", "FL")


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` evaluated once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def none() -> Column:
    return F.lit(None).cast("variant")


def get(v: Column, path: Column | str) -> Column:
    """What is at a path such as ``$['a']['b']``; null where nothing is."""
    return F.try_variant_get(v, path if isinstance(path, Column) else F.lit(path), "variant")


def kind(v: Column) -> Column:
    """One of the kinds above; null for null."""
    return F.substring(F.schema_of_variant(v), 1, 2)


def fields(v: Column) -> Column:
    """Entries of an object; null for anything else."""
    return F.map_entries(F.try_variant_get(v, F.lit("$"), "map<string,variant>"))


def items(v: Column) -> Column:
    return F.try_variant_get(v, F.lit("$"), "array<variant>")


def string(v: Column) -> Column:
    return F.try_variant_get(v, F.lit("$"), "string")


def double(v: Column) -> Column:
    return F.try_variant_get(v, F.lit("$"), "double")


def whole(v: Column) -> Column:
    return F.try_variant_get(v, F.lit("$"), "bigint")


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = _STRING + '|[^"]+'


def _shown(v: Column) -> Column:
    """An object or array as the language shows it (names in order, numbers as
    JSON has them)."""

    def quoted(token: Column) -> Column:
        plain = F.replace(F.replace(string(F.parse_json(token)), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        plain = F.replace(F.replace(plain, F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
        double_quotes = plain.contains("'") & ~plain.contains('"')
        return let(plain, lambda p: F.when(double_quotes, F.concat(F.lit('"'), p, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(p, F.lit("'"), F.lit("\\'")), F.lit("'"))))

    def bare(token: Column) -> Column:
        for old, new in (("true", "True"), ("false", "False"), ("null", "None"), (",", ", "), (":", ": ")):
            token = F.replace(token, F.lit(old), F.lit(new))
        return token

    tokens = F.regexp_extract_all(_plain_numbers(F.to_json(v)), F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"'), quoted(t)).otherwise(bare(t))), "")


def text(v: Column) -> Column:
    """The text of a value in the language; null where there is none."""
    return let(
        kind(v),
        lambda k: F.when(k.isin(STRING, INTEGER), string(v))
        .when(k.isin(*NUMBER), let(double(v), lambda d: X.as_text(d, T.DoubleType())))
        .when(k == BOOLEAN, F.initcap(string(v)))
        .when(k == NULL, F.lit("None"))
        .when(k.isNotNull(), _shown(v)),
    )


def _plain_numbers(json_text: Column) -> Column:
    """JSON text with numbers as the language writes them, which has exponents
    below 1e-4 and from 1e16 on only."""
    number = r"-?[0-9][0-9.]*E-?[0-9]+"
    tokens = F.regexp_extract_all(json_text, F.lit(f'{_STRING}|{number}|[^"0-9-]++|[0-9.-]++'), F.lit(0))
    shown = lambda t: F.when(t.rlike(f"^{number}$"), X.as_text(t.cast("double"), T.DoubleType())).otherwise(t)
    return F.array_join(F.transform(tokens, shown), "")


def spaced_json(v: Column) -> Column:
    """JSON text with a blank after commas and colons."""

    def spaced(t: Column) -> Column:
        # a run that no comma or colon ends is the last; the blank after it goes
        runs = F.regexp_replace(t, rf'((?:{_STRING}|[^",:]++)++)([,:]?)', "$1$2 ")
        return F.substring(runs, F.lit(1), F.length(runs) - 1)

    powered = lambda t: F.when(t.contains("E") & t.rlike(r"[0-9]E-?[0-9]"), _plain_numbers(t)).otherwise(t)
    return let(let(F.to_json(v), powered), spaced)


# -- nodes -----------------------------------------------------------------

#: The type of ``nodes``.
NODES = "array<struct<path:string,exact:string,v:variant>>"


def depth(v: Column) -> Column:
    """How deep objects and arrays are nested; 0 for scalars."""
    # a choice that is repeated takes stack for each character; this repeats without
    brackets = F.regexp_replace(F.regexp_replace(F.to_json(v), _STRING, ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, c: Column) -> Column:
        now = at["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), start, step, lambda at: at["most"])


def nodes(v: Column) -> Column:
    """Scalars and empty objects and arrays of a value, in order: ``path``
    (``a.b``, ``a[0]``), ``exact`` (a path that tells names with dots apart), ``v``."""

    def opened(n: Column) -> Column:
        named = F.transform(
            fields(n["v"]),
            lambda e: F.struct(
                F.when(n["path"] == "", e["key"]).otherwise(F.concat(n["path"], F.lit("."), e["key"])).alias("path"),
                F.concat(n["exact"], F.lit("\x01"), e["key"]).alias("exact"),
                e["value"].alias("v"),
            ),
        )
        numbered = F.transform(
            items(n["v"]),
            lambda x, i: F.struct(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.concat(n["exact"], F.lit("\x02"), i.cast("string")).alias("exact"), x.alias("v")),
        )
        return let(F.coalesce(named, numbered), lambda inner: F.when(F.size(inner) > 0, inner).otherwise(F.array(n)))

    root = F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("exact"), v.alias("v"))).cast(NODES)
    deep = let(depth(v), lambda d: F.when(d > 0, F.aggregate(F.sequence(F.lit(1), d), root, lambda now, _: F.flatten(F.transform(now, opened)).cast(NODES))).otherwise(root))
    # most objects hold scalars only, and need no look at their depth
    flat = lambda f: (F.size(f) > 0) & ~F.exists(f, lambda e: kind(e["value"]).isin(OBJECT, ARRAY))
    named = lambda f: F.transform(f, lambda e: F.struct(e["key"].alias("path"), F.concat(F.lit("\x01"), e["key"]).alias("exact"), e["value"].alias("v"))).cast(NODES)
    return let(fields(v), lambda f: F.when(flat(f), named(f)).otherwise(deep))


def leaves(found: Column) -> Column:
    """Of ``nodes`` the scalars; where names with dots give a path twice, the last."""
    scalars = F.filter(found, lambda n: ~kind(n["v"]).isin(OBJECT, ARRAY))

    def unique(x: Column) -> Column:
        paths = F.transform(x, lambda n: n["path"])
        last = F.filter(x, lambda n, i: F.array_position(F.reverse(paths), n["path"]) == F.size(x) - i)
        return F.when(F.size(F.array_distinct(paths)) == F.size(x), x).otherwise(last)

    return let(scalars, unique)


# -- comparison ------------------------------------------------------------


def _numbers_equal(a: Column, b: Column, tolerance: float) -> Column:
    if not tolerance:
        return (a == b) & ~F.isnan(a) & ~F.isnan(b)
    near = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * tolerance, F.lit(tolerance))
    finite = (F.abs(a) != float("inf")) & (F.abs(b) != float("inf"))
    return ((a == b) | (finite & near)) & ~F.isnan(a) & ~F.isnan(b)


def scalars_equal(a: Column, b: Column, tolerance: float = 0.0, loose: bool = False) -> Column:
    """Equality of scalars (and of empty objects and arrays); never null.
    loose: true equals 1, as in conditions."""
    kinds = F.struct(kind(a).alias("a"), kind(b).alias("b"))
    numeric = (INTEGER, *NUMBER, BOOLEAN) if loose else (INTEGER, *NUMBER)
    numbers = F.struct(double(a).alias("a"), double(b).alias("b"))
    same = lambda k: (
        F.when((k["a"] == k["b"]) & k["a"].isin(*((STRING, BOOLEAN) if tolerance else (STRING, BOOLEAN, INTEGER))), string(a) == string(b))
        .when(k["a"].isin(*numeric) & k["b"].isin(*numeric), let(numbers, lambda d: _numbers_equal(d["a"], d["b"], tolerance)))
        .otherwise(k["a"] == k["b"])
    )
    return F.coalesce(let(kinds, same), F.lit(False))


def nodes_equal(a: Column, b: Column, tolerance: float = 0.0, loose: bool = False) -> Column:
    """Whether two values are equal, from their ``nodes``: objects list their
    names in order, so nodes of equal values stand side by side."""

    def equal(s: Column) -> Column:
        pairs = F.zip_with(s["a"], s["b"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        same = F.forall(pairs, lambda p: F.when(p["x"]["exact"] == p["y"]["exact"], scalars_equal(p["x"]["v"], p["y"]["v"], tolerance, loose)).otherwise(F.lit(False)))
        return F.when(F.size(s["a"]) == F.size(s["b"]), same).otherwise(F.lit(False))

    return let(F.struct(a.alias("a"), b.alias("b")), equal)


def agreeing(found: Column, wanted: Column, tolerance: float) -> Column:
    """How many of ``found`` leaves are in ``wanted`` and agree."""
    by_path = F.map_from_entries(F.transform(wanted, lambda n: F.struct(n["path"], n["v"])))
    hits = lambda m: F.size(F.filter(found, lambda n: let(F.try_element_at(m, n["path"]), lambda w: w.isNotNull() & scalars_equal(n["v"], w, tolerance))))
    return let(by_path, hits)
