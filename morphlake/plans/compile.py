"""Compiling a program against a Spark type: one expression for the whole target.

Every step becomes columns; nothing is interpreted row by row and steps do not
chain, because all of them read the source.  What a step writes goes into a
tree of target names, so that writes over, into and beside earlier ones are
settled here.  Each step also says when a row is an error; the row's error is
the first in program order.

Typed records have all their columns, so an absent path is a fault of the
program (``CompileError``), and null stands for JSON null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .program import Condition, Origin, Program, Step, path_parts


class CompileError(ValueError):
    """The program cannot run on records of this type."""


@dataclass(frozen=True)
class Value:
    """A column, its type, and when it is an error (a text, else null)."""

    col: Column
    kind: T.DataType
    error: Column | None = None


#: A target: a value, or names and what is below them.
Tree = dict[str, Any]


@dataclass
class Compiled:
    tree: Tree
    errors: list[Column]

    def error(self) -> Column:
        """The row's error, null if it has none."""
        return F.coalesce(*self.errors) if self.errors else F.lit(None).cast("string")

    def value(self) -> Value:
        return _built(self.tree)


def _built(node: Value | Tree) -> Value:
    if isinstance(node, Value):
        return node
    parts = {name: _built(below) for name, below in node.items()}
    return Value(F.struct(*(v.col.alias(n) for n, v in parts.items())), T.StructType([T.StructField(n, v.kind) for n, v in parts.items()]))


# -- values ----------------------------------------------------------------


def literal(x: Any) -> Value:
    """A JSON value as a column; lists of mixed types become variants."""
    if x is None:
        return Value(F.lit(None), T.NullType())
    if isinstance(x, bool):
        return Value(F.lit(x), T.BooleanType())
    if isinstance(x, int):
        return Value(F.lit(x).cast("bigint"), T.LongType()) if -(2**63) <= x < 2**63 else variant(Value(F.lit(json.dumps(x)), T.StringType()), parse=True)
    if isinstance(x, float):
        return Value(F.lit(x), T.DoubleType())
    if isinstance(x, str):
        return Value(F.lit(x), T.StringType())
    if isinstance(x, dict) and x:
        return _built({k: literal(v) for k, v in x.items()})
    items = [literal(v) for v in x] if isinstance(x, list) else []
    kind = common([v.kind for v in items])
    if not items or isinstance(kind, T.VariantType):
        return Value(F.parse_json(F.lit(json.dumps(x))), T.VariantType())
    return Value(F.array(*(converted(v, kind).col for v in items)), T.ArrayType(kind))


def variant(x: Value, parse: bool = False) -> Value:
    if isinstance(x.kind, T.VariantType):
        return x
    if parse:
        return Value(F.parse_json(x.col), T.VariantType(), x.error)
    if isinstance(x.kind, T.NullType):
        return Value(F.parse_json(F.lit("null")), T.VariantType(), x.error)
    wrapped = F.to_variant_object(F.struct(x.col.alias("v")))
    return Value(F.variant_get(wrapped, "$.v", "variant"), T.VariantType(), x.error)


def common(kinds: list[T.DataType]) -> T.DataType:
    """The type that values of several branches share: their own if they agree,
    double for numbers, else a variant."""
    solid = [k for k in kinds if not isinstance(k, T.NullType)]
    if not solid:
        return T.NullType()
    first = solid[0]
    if all(k == first for k in solid):
        return first
    if all(map(X.is_number, solid)):
        return T.LongType() if all(map(X.is_integer, solid)) else T.DoubleType()
    if all(isinstance(k, T.StructType) for k in solid) and all([f.name for f in k] == [f.name for f in first] for k in solid):
        fields = [T.StructField(f.name, common([k[f.name].dataType for k in solid])) for f in first]
        return T.VariantType() if any(isinstance(f.dataType, T.VariantType) for f in fields) else T.StructType(fields)
    return T.VariantType()


def converted(x: Value, kind: T.DataType) -> Value:
    if x.kind == kind:
        return x
    if isinstance(kind, T.VariantType):
        return variant(x)
    return Value(x.col.cast(kind), kind, x.error)


# -- programs --------------------------------------------------------------


class Compiler:
    """Steps over records of one type; ``root`` is the record."""

    def __init__(self, root: Column | None, kind: T.StructType) -> None:
        self.root, self.kind = root, kind

    def _field(self, name: str) -> Column:
        return F.col(f"`{name.replace('`', '``')}`") if self.root is None else self.root.getField(name)

    def read(self, path: str) -> Value:
        parts = path_parts(path)
        if not parts:
            whole = F.struct(*(self._field(f.name).alias(f.name) for f in self.kind)) if self.root is None else self.root
            return Value(whole, self.kind)
        at: T.DataType = self.kind
        col = None
        missing: Column | None = None
        for part in parts:
            if not isinstance(at, T.StructType) or part not in at.fieldNames():
                raise CompileError(f"missing source path {path}")
            if col is not None:
                gone = F.when(col.isNull(), F.lit(f"missing source path {path}"))
                missing = gone if missing is None else F.coalesce(missing, gone)
            col = self._field(part) if col is None else col.getField(part)
            at = at[part].dataType
        return Value(col, at, missing)

    def origin(self, x: Origin) -> Value:
        return literal(x.value) if x.path is None else self.read(x.path)

    def run(self, steps: tuple[Step, ...]) -> Compiled:
        out = Compiled({}, [])
        for step in steps:
            getattr(self, f"_{step.op}")(step, out)
        return out

    def _write(self, out: Compiled, path: str, value: Value) -> None:
        parts = path.split(".")
        if path in ("", "$"):
            raise CompileError(f"cannot write to {path!r}")
        if value.error is not None:
            out.errors.append(value.error)
        at = out.tree
        for part in parts[:-1]:
            below = at.get(part)
            if isinstance(below, Value):
                if isinstance(below.kind, T.StructType):
                    below = {f.name: Value(below.col.getField(f.name), f.dataType) for f in below.kind}
                elif isinstance(below.kind, T.NullType):
                    below = {}
                else:
                    raise CompileError(f"{path} collides with scalar {part}")
            at[part] = below = {} if below is None else below
            at = below
        at[parts[-1]] = Value(value.col, value.kind)

    def _failing(self, bad: Column, what: str, *before: Column | None) -> Column:
        own = F.when(bad, F.lit(what))
        earlier = [b for b in before if b is not None]
        return F.coalesce(*earlier, own) if earlier else own

    def _copy(self, step: Step, out: Compiled) -> None:
        self._write(out, step.to, self.read(step.source))

    def _constant(self, step: Step, out: Compiled) -> None:
        self._write(out, step.to, literal(step.options["value"]))

    def _cast(self, step: Step, out: Compiled) -> None:
        x, target = self.read(step.source), step.options["target_type"]
        if target == "string":
            return self._write(out, step.to, Value(X.as_text(x.col, x.kind), T.StringType(), x.error))
        make, kind = {"integer": (X.to_integer, T.LongType()), "number": (X.to_number, T.DoubleType()), "boolean": (X.to_boolean, T.BooleanType())}[target]
        made = make(x.col, x.kind)
        self._write(out, step.to, Value(made, kind, self._failing(made.isNull(), f"cannot cast {step.source} to {target}", x.error)))

    def _default(self, step: Step, out: Compiled) -> None:
        x, other = self.read(step.source), literal(step.options["value"])
        kind = common([x.kind, other.kind])
        picked = F.when(x.col.isNull(), converted(other, kind).col).otherwise(converted(x, kind).col)
        self._write(out, step.to, Value(picked, kind))

    def _coalesce(self, step: Step, out: Compiled) -> None:
        values = [self.read(p) for p in step.sources]
        kind = common([v.kind for v in values])
        picked = F.coalesce(*(F.when(v.col.isNotNull(), converted(v, kind).col) for v in values))
        none = F.lit(True)
        for v in values:
            none = none & v.col.isNull()
        self._write(out, step.to, Value(picked, kind, self._failing(none, "all sources are null")))

    def _map_enum(self, step: Step, out: Compiled) -> None:
        x, mapping = self.read(step.source), step.options["mapping"]
        given = {k: literal(v) for k, v in mapping.items()}
        other = literal(step.options["default"])
        kind = common([*(v.kind for v in given.values()), other.kind])
        text = X.as_text(x.col, x.kind)
        picked = None
        for key, value in given.items():
            test, made = text == key, converted(value, kind).col
            picked = F.when(test, made) if picked is None else picked.when(test, made)
        rest = converted(other, kind).col
        self._write(out, step.to, Value(rest if picked is None else picked.otherwise(rest), kind, x.error))

    def _scale(self, step: Step, out: Compiled) -> None:
        x = self.read(step.source)
        if not X.is_number(x.kind):
            return self._write(out, step.to, Value(F.lit(None).cast("double"), T.DoubleType(), F.lit(f"{step.source} is not a number")))
        made = x.col.cast("double") * F.lit(step.options["factor"]) + F.lit(step.options["offset"])
        self._write(out, step.to, Value(made, T.DoubleType(), self._failing(x.col.isNull(), f"{step.source} is not a number", x.error)))

    def _format_date(self, step: Step, out: Compiled) -> None:
        x = self.read(step.source)
        try:
            read = X.read_date(X.as_text(x.col, x.kind), step.options["input_format"])
            made = X.write_date(read, step.options["output_format"])
        except X.DateFormatError as e:
            raise CompileError(str(e)) from e
        self._write(out, step.to, Value(made, T.StringType(), self._failing(made.isNull(), f"{step.source} is not a date", x.error)))

    def _concat(self, step: Step, out: Compiled) -> None:
        values = [self.read(p) for p in step.sources]
        made = F.concat_ws(step.options["separator"], *(X.as_text(v.col, v.kind) for v in values))
        errors = [v.error for v in values if v.error is not None]
        self._write(out, step.to, Value(made, T.StringType(), F.coalesce(*errors) if errors else None))

    def _split(self, step: Step, out: Compiled) -> None:
        x, separator = self.read(step.source), step.options["separator"]
        if not separator:
            return self._write(out, step.to, Value(F.lit(None).cast("string"), T.StringType(), F.lit("empty separator")))
        made = X.split_item(X.as_text(x.col, x.kind), separator, step.options["index"])
        self._write(out, step.to, Value(made, T.StringType(), self._failing(made.isNull(), f"{step.source} has no such item", x.error)))

    def _nest(self, step: Step, out: Compiled) -> None:
        made = Compiled({}, out.errors)
        for name, path in step.options["fields"].items():
            self._write(made, name, self.read(path))
        self._write(out, step.to, made.value())
        # keep the tree open, so that later steps can write below
        at = out.tree
        *above, last = step.to.split(".")
        for part in above:
            at = at[part]
        at[last] = made.tree

    def _flatten(self, step: Step, out: Compiled) -> None:
        x = self.read(step.source)
        if not isinstance(x.kind, T.StructType):
            raise CompileError(f"{step.source} is not an object")
        bad = self._failing(x.col.isNull(), f"{step.source} is not an object", x.error) if path_parts(step.source) else x.error
        if bad is not None:
            out.errors.append(bad)
        for f in x.kind:
            self._write(out, f"{step.to}.{f.name}" if step.to else f.name, Value(x.col.getField(f.name), f.dataType))

    def _conditional(self, step: Step, out: Compiled) -> None:
        test, fault = self.test(step.condition)
        yes, no = self.origin(step.options["then"]), self.origin(step.options["otherwise"])
        kind = common([yes.kind, no.kind])
        picked = F.when(test, converted(yes, kind).col).otherwise(converted(no, kind).col)
        none = F.lit(None).cast("string")
        branch = None
        if yes.error is not None or no.error is not None:
            branch = F.when(test, none if yes.error is None else yes.error).otherwise(none if no.error is None else no.error)
        errors = [e for e in (fault, branch) if e is not None]
        self._write(out, step.to, Value(picked, kind, F.coalesce(*errors) if errors else None))

    # -- arrays ------------------------------------------------------------

    def _items(self, step: Step) -> tuple[Value, T.DataType]:
        x = self.read(step.source)
        if not isinstance(x.kind, T.ArrayType):
            raise CompileError(f"{step.source} is not an array")
        return x, x.kind.elementType

    def _map_array(self, step: Step, out: Compiled) -> None:
        x, item = self._items(step)
        if not isinstance(item, T.StructType):
            raise CompileError(f"items of {step.source} are not objects")
        run = lambda v: Compiler(v, item).run(step.steps)
        shape = run(F.col("x"))
        errors = [self._failing(x.col.isNull(), f"{step.source} is not an array", x.error)]
        if shape.errors:
            faults = F.filter(F.transform(x.col, lambda v: run(v).error()), lambda e: e.isNotNull())
            errors.append(F.get(faults, F.lit(0)))
        made = F.transform(x.col, lambda v: run(v).value().col)
        self._write(out, step.to, Value(made, T.ArrayType(shape.value().kind), F.coalesce(*errors)))

    def _filter_array(self, step: Step, out: Compiled) -> None:
        x, item = self._items(step)
        inner = lambda v: _Scalar(v, item) if not isinstance(item, T.StructType) else Compiler(v, item)
        _, fault = inner(F.col("x")).test(step.condition)
        errors = [self._failing(x.col.isNull(), f"{step.source} is not an array", x.error)]
        if fault is not None:
            errors.append(F.get(F.filter(F.transform(x.col, lambda v: inner(v).test(step.condition)[1]), lambda e: e.isNotNull()), F.lit(0)))
        made = F.filter(x.col, lambda v: inner(v).test(step.condition)[0])
        self._write(out, step.to, Value(made, x.kind, F.coalesce(*errors)))

    # -- conditions --------------------------------------------------------

    def test(self, condition: Condition) -> tuple[Column, Column | None]:
        x = self.read(condition.path)
        return F.coalesce(predicate(x, condition.operator, condition.value), F.lit(False)), x.error


class _Scalar(Compiler):
    """Items that are not objects: only the root can be read."""

    def read(self, path: str) -> Value:
        if path_parts(path):
            raise CompileError(f"missing source path {path}")
        return Value(self.root, self.kind)


def _same(x: Value, y: Any) -> Column:
    """Equality with a JSON value, without Spark's conversions: a text never
    equals a number, true equals 1, NaN equals nothing."""
    if y is None:
        return x.col.isNull()
    if isinstance(x.kind, T.NullType):
        return F.lit(False)
    number = isinstance(y, (bool, int, float))
    if isinstance(x.kind, T.BooleanType) and number:
        return x.col.eqNullSafe(F.lit(bool(y))) if y in (0, 1) else F.lit(False)
    if X.is_number(x.kind) and number:
        same = x.col.eqNullSafe(F.lit(float(y) if isinstance(y, float) else int(y)))
        return same & ~F.isnan(x.col.cast("double")) if not X.is_integer(x.kind) else same
    if isinstance(x.kind, T.StringType) and isinstance(y, str):
        return x.col.eqNullSafe(F.lit(y))
    if isinstance(x.kind, T.ArrayType) and isinstance(y, list):
        tests = [F.size(x.col) == len(y)] + [_same(Value(F.get(x.col, F.lit(k)), x.kind.elementType), v) for k, v in enumerate(y)]
    elif isinstance(x.kind, T.StructType) and isinstance(y, dict):
        if set(x.kind.fieldNames()) != set(y):
            return F.lit(False)
        tests = [x.col.isNotNull()] + [_same(Value(x.col.getField(f.name), f.dataType), y[f.name]) for f in x.kind]
    else:
        return F.lit(False)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def _less(x: Value, operator: str, y: Any) -> Column:
    if isinstance(x.kind, T.ArrayType) and isinstance(y, list):
        return F.coalesce(_list_less(x, operator, y, 0), F.lit(False))
    numbers = isinstance(y, (bool, int, float)) and (X.is_number(x.kind) or isinstance(x.kind, T.BooleanType))
    texts = isinstance(y, str) and isinstance(x.kind, T.StringType)
    if not (numbers or texts):
        return F.lit(False)
    col = x.col.cast("int") if isinstance(x.kind, T.BooleanType) else x.col
    bound = F.lit(int(y) if isinstance(y, bool) else y)
    made = {"gt": col > bound, "ge": col >= bound, "lt": col < bound, "le": col <= bound}[operator]
    if isinstance(x.kind, (T.DoubleType, T.FloatType)):
        made = made & ~F.isnan(col)
    return made


def _list_less(x: Value, operator: str, y: list, k: int) -> Column:
    """Arrays in order of their first items that differ, shorter ones first."""
    size = F.size(x.col)
    if k == len(y):
        equal, longer = F.lit(operator in ("ge", "le")), F.lit(operator in ("gt", "ge"))
        return F.when(size == k, equal).otherwise(longer)
    item = Value(F.get(x.col, F.lit(k)), x.kind.elementType)
    strict = "lt" if operator in ("lt", "le") else "gt"
    return F.when(size == k, F.lit(strict == "lt")).when(_same(item, y[k]), _list_less(x, operator, y, k + 1)).otherwise(_less(item, strict, y[k]))


def predicate(x: Value, operator: str, y: Any) -> Column:
    """A condition on a value; false where the types do not allow it."""
    if operator == "exists":
        return F.lit(True)
    if operator in ("eq", "ne"):
        same = _same(x, y)
        return same if operator == "eq" else ~same
    if operator in ("gt", "ge", "lt", "le"):
        return _less(x, operator, y)
    if operator == "in":
        if isinstance(y, list):
            made = F.lit(False)
            for item in y:
                made = made | _same(x, item)
            return made
        if isinstance(y, str):
            return F.contains(F.lit(y), x.col) if isinstance(x.kind, T.StringType) else F.lit(False)
        return x.col.isin(list(y)) if isinstance(y, dict) and y and isinstance(x.kind, T.StringType) else F.lit(False)
    if isinstance(x.kind, T.StringType):
        return F.contains(x.col, F.lit(y)) if isinstance(y, str) else F.lit(False)
    if isinstance(x.kind, T.ArrayType):
        return F.exists(x.col, lambda v: F.coalesce(_same(Value(v, x.kind.elementType), y), F.lit(False)))
    if isinstance(x.kind, T.StructType):
        return F.lit(isinstance(y, str) and y in x.kind.fieldNames()) & x.col.isNotNull()
    return F.lit(False)


def compile_program(program: Program, kind: T.StructType) -> Compiled:
    """The target of a program over the columns of a DataFrame of this type."""
    return Compiler(None, kind).run(program.steps)
