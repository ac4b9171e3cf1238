"""Programs: a strict parser from JSON to frozen steps.

A program is an ordered list of steps, each a small operation on a record.  The
parser accepts exactly the documented keys and reports everything else; numbers
and switches are read leniently (``"2"`` is a number, ``1.0`` an index).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

PREDICATES = ("exists", "eq", "ne", "gt", "ge", "lt", "le", "in", "contains")
CAST_TARGETS = ("string", "integer", "number", "boolean")


class ProgramError(ValueError):
    """The text is not a valid program."""


@dataclass(frozen=True)
class Condition:
    path: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Origin:
    """Where a value comes from: a path of the record, or a literal."""

    path: str | None = None
    value: Any = None


@dataclass(frozen=True)
class Step:
    """One operation.  ``sources`` holds what it reads (one path for most
    operations), ``to`` what it writes, ``options`` the rest."""

    op: str
    to: str
    sources: tuple[str, ...] = ()
    options: dict[str, Any] = field(default_factory=dict, hash=False)
    steps: tuple[Step, ...] = ()
    condition: Condition | None = None

    @property
    def source(self) -> str:
        return self.sources[0]


@dataclass(frozen=True)
class Program:
    steps: tuple[Step, ...]


# -- fields ----------------------------------------------------------------


def _text(x: Any) -> str:
    if not isinstance(x, str):
        raise ProgramError(f"text expected, not {x!r}")
    return x


def _number(x: Any) -> float:
    if isinstance(x, (bool, int, float)):
        return float(x)
    if isinstance(x, str):
        try:
            return float(x)
        except ValueError:
            pass
    raise ProgramError(f"number expected, not {x!r}")


def _index(x: Any) -> int:
    if isinstance(x, int):
        return int(x)
    if isinstance(x, float) and math.isfinite(x) and x == int(x):
        return int(x)
    if isinstance(x, str):
        try:
            return int(x)
        except ValueError:
            pass
    raise ProgramError(f"whole number expected, not {x!r}")


def _texts(x: Any) -> tuple[str, ...]:
    if not isinstance(x, (list, tuple)) or not x:
        raise ProgramError("a list of at least one path expected")
    return tuple(map(_text, x))


def _mapping(x: Any) -> dict[str, Any]:
    if not isinstance(x, dict):
        raise ProgramError("an object expected")
    return dict(x)


def _fields(x: Any) -> dict[str, str]:
    if not isinstance(x, dict) or not x:
        raise ProgramError("an object of at least one field expected")
    return {_text(k): _text(v) for k, v in x.items()}


def _choice(*allowed: str) -> Callable[[Any], str]:
    def read(x: Any) -> str:
        if x not in allowed or not isinstance(x, str):
            raise ProgramError(f"one of {', '.join(allowed)} expected, not {x!r}")
        return x

    return read


def _any(x: Any) -> Any:
    return x


_NEEDED = object()


def _object(x: Any, what: str) -> dict[str, Any]:
    if not isinstance(x, dict):
        raise ProgramError(f"{what} must be an object")
    return x


def _aliased(x: dict[str, Any]) -> dict[str, Any]:
    """``from_`` may stand for ``from``, but not beside it."""
    if "from_" not in x:
        return x
    if "from" in x:
        raise ProgramError("both from and from_ are given")
    return {("from" if k == "from_" else k): v for k, v in x.items()}


def _origin(x: Any) -> Origin:
    given = _aliased(_object(x, "a branch"))
    if len(given) != 1 or not given.keys() <= {"from", "value"}:
        raise ProgramError("a branch has exactly one of from and value")
    if "value" in given:
        return Origin(value=given["value"])
    path = given["from"]
    return Origin(path="" if path is None else _text(path))


def _condition(x: Any) -> Condition:
    given = _object(x, "a condition")
    if not given.keys() <= {"path", "operator", "value"} or not {"path", "operator"} <= given.keys():
        raise ProgramError("a condition has path, operator and value")
    return Condition(_text(given["path"]), _choice(*PREDICATES)(given["operator"]), given.get("value"))


#: Of each operation the keys besides op and to: reader and default.
GRAMMAR: dict[str, dict[str, tuple[Callable[[Any], Any], Any]]] = {
    "copy": {"from": (_text, _NEEDED)},
    "constant": {"value": (_any, _NEEDED)},
    "cast": {"from": (_text, _NEEDED), "target_type": (_choice(*CAST_TARGETS), _NEEDED)},
    "default": {"from": (_text, _NEEDED), "value": (_any, _NEEDED)},
    "coalesce": {"sources": (_texts, _NEEDED)},
    "map_enum": {"from": (_text, _NEEDED), "mapping": (_mapping, _NEEDED), "default": (_any, None)},
    "scale": {"from": (_text, _NEEDED), "factor": (_number, _NEEDED), "offset": (_number, 0.0)},
    "format_date": {"from": (_text, _NEEDED), "input_format": (_text, _NEEDED), "output_format": (_text, _NEEDED)},
    "concat": {"sources": (_texts, _NEEDED), "separator": (_text, "")},
    "split": {"from": (_text, _NEEDED), "separator": (_text, _NEEDED), "index": (_index, _NEEDED)},
    "nest": {"fields": (_fields, _NEEDED)},
    "flatten": {"from": (_text, _NEEDED)},
    "conditional": {"condition": (_condition, _NEEDED), "then": (_origin, _NEEDED), "otherwise": (_origin, _NEEDED)},
    "map_array": {"from": (_text, _NEEDED), "steps": (_any, _NEEDED)},
    "filter_array": {"from": (_text, _NEEDED), "condition": (_condition, _NEEDED)},
}
ARRAY_OPS = ("map_array", "filter_array")


def _step(x: Any, scalar_only: bool) -> Step:
    given = _aliased(_object(x, "a step"))
    op = given.get("op")
    if not isinstance(op, str) or op not in GRAMMAR or (scalar_only and op in ARRAY_OPS):
        raise ProgramError(f"unknown operation {op!r}")
    keys = GRAMMAR[op]
    extra = given.keys() - keys.keys() - {"op", "to"}
    if extra:
        raise ProgramError(f"{op}: unknown keys {sorted(extra)}")
    if "to" not in given:
        raise ProgramError(f"{op}: to is missing")
    read: dict[str, Any] = {}
    for key, (reader, default) in keys.items():
        if key in given:
            read[key] = reader(given[key])
        elif default is _NEEDED:
            raise ProgramError(f"{op}: {key} is missing")
        else:
            read[key] = default
    sources = (read.pop("from"),) if "from" in read else read.pop("sources", ())
    children = _steps(read.pop("steps"), True) if "steps" in read else ()
    return Step(op, _text(given["to"]), tuple(sources), read, children, read.pop("condition", None))


def _steps(x: Any, scalar_only: bool) -> tuple[Step, ...]:
    if not isinstance(x, list) or not x:
        raise ProgramError("a list of at least one step expected")
    return tuple(_step(s, scalar_only) for s in x)


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ProgramError("duplicate keys")
    return out


def parse(source: str | dict[str, Any]) -> Program:
    """A program from JSON text or an object.  ``json.JSONDecodeError`` for text
    that is not JSON, ``ProgramError`` for anything else that is wrong."""
    given = json.loads(source, object_pairs_hook=_unique) if isinstance(source, str) else source
    if _object(given, "a program").keys() != {"steps"}:
        raise ProgramError("a program has steps and nothing else")
    return Program(_steps(given["steps"], False))


def path_parts(path: str) -> tuple[str, ...]:
    """Names along a path; none for the record itself."""
    return () if path in ("", "$") else tuple(path.split("."))
