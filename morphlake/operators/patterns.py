"""The transformation patterns of the synthetic dataset, as data.

A pattern has the fields of its records, the steps of its program, and the
parameters that the program draws.  In steps ``{"$": name}`` stands for a
parameter.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from typing import Any

WORDS = ("alpha", "beta", "gamma", "delta", "omega")


@dataclass(frozen=True)
class Kind:
    """How values of a field are drawn."""

    how: str
    args: tuple = ()

    def draw(self, rng: random.Random) -> Any:
        a = self.args
        match self.how:
            case "word":
                return rng.choice(WORDS)
            case "maybe":
                return rng.choice((None, a[0].draw(rng)))
            case "one":
                return rng.choice(a)
            case "whole":
                return rng.randint(*a)
            case "real":
                return rng.uniform(*a)
            case "code":
                return f"{a[0]}{rng.randint(0, a[1])}"
            case "pair":
                return f"{rng.choice(WORDS)}{a[0]}{rng.randint(0, a[1])}"
            case "date":
                return f"{rng.randint(2000, 2030):04d}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
            case "object":
                return {k: v.draw(rng) for k, v in a[0].items()}
            case "list":
                return [a[2].draw(rng) for _ in range(rng.randint(a[0], a[1]))]
        raise ValueError(self.how)


def _k(how: str, *args: Any) -> Kind:
    return Kind(how, args)


WORD, DATE = _k("word"), _k("date")


@dataclass(frozen=True)
class Pattern:
    name: str
    fields: dict[str, Kind]
    steps: list[dict[str, Any]]
    choices: dict[str, tuple]

    def record(self, rng: random.Random) -> dict[str, Any]:
        return {name: kind.draw(rng) for name, kind in self.fields.items()}

    def parameters(self, rng: random.Random) -> dict[str, Any]:
        return {name: rng.choice(values) for name, values in self.choices.items()}

    @property
    def nullable(self) -> tuple[str, ...]:
        return tuple(n for n, k in self.fields.items() if k.how == "maybe")

    @property
    def has_array(self) -> bool:
        return any(k.how == "list" for k in self.fields.values())

    @property
    def has_condition(self) -> bool:
        """Of the top-level steps alone."""
        return any(s["op"] in ("conditional", "filter_array") for s in self.steps)


def filled(x: Any, parameters: dict[str, Any]) -> Any:
    """A template with its parameters in place."""
    if isinstance(x, dict):
        return parameters[x["$"]] if x.keys() == {"$"} else {k: filled(v, parameters) for k, v in x.items()}
    return [filled(v, parameters) for v in x] if isinstance(x, list) else x


def _p(name: str, fields: dict[str, Kind], *steps: dict[str, Any], **choices: tuple) -> Pattern:
    return Pattern(name, fields, list(steps), choices)


def _step(op: str, to: str, source: str | None = None, **rest: Any) -> dict[str, Any]:
    return {"op": op, "to": to, **({} if source is None else {"from": source}), **rest}


def _when(to: str, path: str, operator: str, value: Any, yes: Any, no: Any) -> dict[str, Any]:
    return _step("conditional", to, condition={"path": path, "operator": operator, "value": value}, then={"value": yes}, otherwise={"value": no})


def _v(name: str) -> dict[str, str]:
    return {"$": name}


# fixed values: names, records, steps and parameters of the 19 patterns, in order
BASE = (
    _p("copy_constant", {"patient_id": _k("code", "p", 99999), "unused_id": _k("code", "x", 999)},
       _step("copy", "subject_id", "patient_id"), _step("constant", "kind", value=_v("kind")), kind=("person", "sample", "event")),
    _p("cast_default", {"age_text": _k("code", "", 100), "nickname": _k("maybe", WORD)},
       _step("cast", "age", "age_text", target_type="integer"), _step("default", "display_name", "nickname", value=_v("default")), default=("unknown", "anonymous", "n/a")),
    _p("coalesce_enum", {"primary_code": _k("maybe", WORD), "secondary_code": WORD, "sex": _k("one", "M", "F", "U", "X")},
       _step("coalesce", "code", sources=["primary_code", "secondary_code"]),
       _step("map_enum", "gender", "sex", mapping={"M": "male", "F": "female", "U": "unknown"}, default="unknown")),
    _p("scale_date", {"measurement": _k("real", -100, 10000), "date": DATE},
       _step("scale", "scaled", "measurement", factor=_v("factor")),
       _step("format_date", "formatted_date", "date", input_format="%Y-%m-%d", output_format="%d/%m/%Y"), factor=(0.453592, 2.54, 0.001)),
    _p("concat_split", {"first": WORD, "last": WORD, "compound": _k("pair", ":", 999)},
       _step("concat", "full", sources=["first", "last"], separator=_v("separator")), _step("split", "suffix", "compound", separator=":", index=1), separator=(" ", "-", "/")),
    _p("nest_flatten", {"identifier": _k("code", "p", 9998), "details": _k("object", {"city": WORD, "zip": _k("code", "", 99998)})},
       _step("nest", "subject", fields={"identifier": "identifier", "location.city": "details.city"}), _step("flatten", "address", "details")),
    _p("conditional_copy", {"identifier": _k("code", "i", 9998), "score": _k("whole", 0, 100)},
       _step("copy", "identifier", "identifier"), _when("band", "score", "ge", _v("threshold"), "high", "low"), threshold=(18, 50, 75)),
    _p("map_array", {"measurements": _k("list", 1, 4, _k("object", {"value": _k("real", -10, 100), "unit": _k("one", "mg", "kg", "cm")}))},
       _step("map_array", "normalized", "measurements", steps=[_step("scale", "value", "value", factor=_v("factor")), _step("copy", "unit", "unit")]), factor=(0.1, 2.0, 10.0)),
    _p("filter_array", {"items": _k("list", 1, 6, _k("object", {"value": _k("whole", -10, 10), "name": WORD}))},
       _step("filter_array", "kept", "items", condition={"path": "value", "operator": "gt", "value": _v("threshold")}), threshold=(-1, 0, 5)),
    _p("copy_enum_scale", {"identifier": _k("code", "i", 9998), "status": _k("one", "Y", "N", "U"), "amount": _k("real", -20, 100)},
       _step("copy", "identifier", "identifier"), _step("map_enum", "active", "status", mapping={"Y": True, "N": False}, default=False),
       _step("scale", "amount", "amount", factor=_v("factor")), factor=(1.5, 10.0, 100.0)),
    _p("default_concat_conditional", {"middle": _k("maybe", WORD), "first": WORD, "last": WORD, "enabled": _k("one", True, False)},
       _step("default", "middle", "middle", value=_v("fallback")), _step("concat", "label", sources=["first", "last"], separator=", "),
       _when("state", "enabled", "eq", True, "enabled", "disabled"), fallback=("NA", "missing", "none")),
)
COMPOSITIONAL = (
    _p("comp_copy_scale_conditional", {"identifier": _k("code", "c", 9998), "amount": _k("real", -20, 30)},
       _step("copy", "identifier", "identifier"), _step("scale", "scaled_amount", "amount", factor=_v("factor")),
       _when("class", "amount", "gt", _v("threshold"), "positive", "non_positive"), factor=(0.5, 2.5), threshold=(0, 10)),
    _p("comp_coalesce_concat_nest", {"preferred": _k("maybe", WORD), "fallback": WORD, "prefix": WORD, "code": _k("code", "", 999), "source": _k("one", "A", "B")},
       _step("coalesce", "name", sources=["preferred", "fallback"]), _step("concat", "label", sources=["prefix", "code"], separator="-"),
       _step("nest", "meta", fields={"source": "source", "code": "code"})),
    _p("comp_date_split_constant_copy", {"date": DATE, "code": _k("pair", "-", 99), "value": _k("real", -1, 1)},
       _step("format_date", "date", "date", input_format="%Y-%m-%d", output_format="%Y%m%d"), _step("split", "prefix", "code", separator="-", index=0),
       _step("constant", "kind", value=_v("kind")), _step("copy", "value", "value"), kind=("A", "B")),
    _p("comp_map_mixed", {"items": _k("list", 1, 4, _k("object", {"name": WORD, "status": _k("one", "on", "off", "unknown"), "value": _k("real", -50, 50)}))},
       _step("map_array", "items", "items", steps=[_step("copy", "label", "name"), _step("map_enum", "active", "status", mapping={"on": True, "off": False}, default=False),
                                                   _step("scale", "scaled", "value", factor=_v("factor"))]), factor=(0.25, 4.0)),
    _p("comp_filter_copy_constant", {"items": _k("list", 1, 6, _k("object", {"value": _k("whole", -2, 11), "name": WORD})), "identifier": _k("code", "f", 9998)},
       _step("filter_array", "selected", "items", condition={"path": "value", "operator": "ge", "value": _v("threshold")}),
       _step("copy", "identifier", "identifier"), _step("constant", "filtered", value=True), threshold=(1, 3, 7)),
)
STRUCTURAL = (
    _p("struct_long_nested", {"identifier": _k("code", "s", 9998), "status": _k("one", "Y", "N", "X"), "amount": _k("real", -50, 100), "date": DATE},
       _step("copy", "record.identifier", "identifier"), _step("map_enum", "record.active", "status", mapping={"Y": True, "N": False}, default=False),
       _step("scale", "record.scaled", "amount", factor=_v("factor")), _step("format_date", "record.date", "date", input_format="%Y-%m-%d", output_format="%d-%b-%Y"),
       _when("record.tier", "amount", "ge", _v("threshold"), "upper", "lower"), factor=(1.1, 3.0), threshold=(5, 20)),
    _p("struct_deep_nest", {"identifier": _k("code", "d", 9998), "city": WORD, "postal": _k("code", "", 99998), "first": WORD, "last": WORD, "category": _k("one", "A", "B", "C")},
       _step("nest", "envelope", fields={"identity.primary.value": "identifier", "location.address.city": "city", "location.address.postal": "postal"}),
       _step("concat", "envelope.display.full", sources=["first", "last"], separator=" "), _step("copy", "envelope.classification.category", "category")),
    _p("struct_array_rich", {"batch_id": _k("code", "b", 9998), "items": _k("list", 3, 8, _k("object", {"name": WORD, "value": _k("real", -100, 100), "status": _k("one", "ok", "bad", "unknown")}))},
       _step("map_array", "payload.rows", "items", steps=[
           _step("copy", "identity.name", "name"), _step("scale", "measurement.value", "value", factor=_v("factor")),
           _step("map_enum", "state.active", "status", mapping={"ok": True, "bad": False}, default=False), _when("measurement.sign", "value", "lt", 0, "negative", "non_negative")]),
       _step("copy", "payload.batch.identifier", "batch_id"), factor=(0.01, 10.0)),
)
#: Partition: its first index and its patterns.
PARTITIONS = {"base": (0, BASE), "linguistic": (15_000, BASE), "compositional": (16_000, COMPOSITIONAL), "structural": (18_500, STRUCTURAL)}
CANDIDATES = 20_000
PATTERNS = {p.name: p for p in (*BASE, *COMPOSITIONAL, *STRUCTURAL)}


def prefixed(steps: list[dict[str, Any]], prefix: str) -> list[dict[str, Any]]:
    """Steps whose top-level names, read or written, begin with ``prefix``; names
    inside items and inside nested objects stay."""

    def one(step: dict[str, Any]) -> dict[str, Any]:
        out = {k: prefix + v if k in ("from", "to") and v else v for k, v in step.items()}
        if "sources" in out:
            out["sources"] = [prefix + s for s in out["sources"]]
        if step["op"] == "nest":
            out["fields"] = {k: prefix + v for k, v in out["fields"].items()}
        if step["op"] == "conditional":
            out["condition"] = out["condition"] | {"path": prefix + out["condition"]["path"]}
            for branch in ("then", "otherwise"):
                out[branch] = {k: prefix + v if k == "from" and v else v for k, v in out[branch].items()}
        return out

    return [one(s) for s in steps]
