"""Programs: parser, goldens in both modes, operators' edges, predicates."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphlake.operators.score import score
from morphlake.operators.transform import transform
from morphlake.plans.analyze import check
from morphlake.plans.compile import CompileError
from morphlake.plans.program import ProgramError, parse
from morphlake.plans.records import RowError, compiled
from morphlake.plans.schema import SchemaError, first_breach, infer, infer_one, to_spark


def s(op, to, source=None, **rest):
    return {"op": op, "to": to, **({} if source is None else {"from": source}), **rest}


def when(to, path, operator, value, yes, no):
    return s("conditional", to, condition={"path": path, "operator": operator, "value": value}, then=yes, otherwise=no)


GOLDENS = [
    ([s("copy", "shelf", "bay")], {"bay": 17}, {"shelf": 17}),
    ([s("copy", "crate.owner.name", "lot.buyer")], {"lot": {"buyer": "Okoro"}}, {"crate": {"owner": {"name": "Okoro"}}}),
    ([s("constant", "meta.origin", value=["depot", "yard"])], {"x": 1}, {"meta": {"origin": ["depot", "yard"]}}),
    ([s("cast", "pallets", "pallets", target_type="integer")], {"pallets": " 0310 "}, {"pallets": 310}),
    ([s("cast", "sealed", "sealed", target_type="boolean")], {"sealed": "Yes"}, {"sealed": True}),
    ([s("cast", "mass", "mass", target_type="string")], {"mass": 2.50}, {"mass": "2.5"}),
    ([s("default", "carrier", "carrier", value="none yet")], {"carrier": None}, {"carrier": "none yet"}),
    ([s("default", "carrier", "carrier", value="none yet")], {"carrier": ""}, {"carrier": ""}),
    ([s("coalesce", "dock", sources=["gate.first", "gate.second", "spare"])], {"gate": {"first": None, "second": False}, "spare": True}, {"dock": False}),
    ([s("map_enum", "lane", "hue", mapping={"red": 4, "blue": 6}, default=-1)], {"hue": "green"}, {"lane": -1}),
    ([s("map_enum", "lane", "hue", mapping={"red": {"n": 4}})], {"hue": "red"}, {"lane": {"n": 4}}),
    ([s("scale", "litres", "gallons", factor=3.5, offset=-0.5)], {"gallons": 6}, {"litres": 20.5}),
    ([s("format_date", "due", "due", input_format="%d/%m/%Y", output_format="%Y%m%d")], {"due": "07/11/2031"}, {"due": "20311107"}),
    ([s("concat", "label", sources=["zone", "row", "zone"], separator="/")], {"row": 8, "zone": "N"}, {"label": "N/8/N"}),
    ([s("split", "tail", "route", separator="::", index=-2)], {"route": "Riga::Oslo::Bergen"}, {"tail": "Oslo"}),
    ([s("nest", "box", fields={"size.w": "width", "tag": "mark"})], {"mark": "fragile", "width": 44}, {"box": {"size": {"w": 44}, "tag": "fragile"}}),
    ([s("flatten", "all", "stock.left")], {"stock": {"left": {"bolts": 5, "nuts": None}}}, {"all": {"bolts": 5, "nuts": None}}),
    ([when("tier", "units", "lt", 50, {"value": "small"}, {"from": "big_name"})], {"big_name": "bulk", "units": 50}, {"tier": "bulk"}),
    ([when("tier", "tags", "contains", "cold", {"value": 1}, {"value": 0})], {"tags": ["dry", "cold"]}, {"tier": 1}),
    ([s("map_array", "out", "legs", steps=[s("concat", "hop", sources=["a", "b"], separator=">"), s("scale", "km", "m", factor=0.001)])], {"legs": [{"a": "p", "b": "q", "m": 1500.0}, {"a": "q", "b": "r", "m": 0.0}]}, {"out": [{"hop": "p>q", "km": 1.5}, {"hop": "q>r", "km": 0.0}]}),
    ([s("filter_array", "late", "legs", condition={"path": "day", "operator": "in", "value": [3, 5]})], {"legs": [{"day": 5}, {"day": 4}, {"day": 3}]}, {"late": [{"day": 5}, {"day": 3}]}),
    ([s("copy", "who", "driver"), s("constant", "who2", value=None), s("split", "van", "plate", separator=" ", index=0), s("scale", "hours", "minutes", factor=0.25)], {"driver": "Ines", "minutes": 90, "plate": "KX 204"}, {"who": "Ines", "who2": None, "van": "KX", "hours": 22.5}),
]


@pytest.mark.parametrize("steps,record,target", GOLDENS)
def test_goldens_record_by_record(steps, record, target):
    assert compiled(parse({"steps": steps}))(record) == target
    for mode in ("binary", "dense"):
        got = score(json.dumps({"steps": steps}), infer_one(record), infer_one(target), [{"input": record, "expected": target}], mode)
        assert got.reward == pytest.approx(1.0) and got.failure_type is None


def test_goldens_as_projections(spark):
    for steps, record, target in GOLDENS:
        df = spark.createDataFrame([(json.dumps(record),)], "j string").select(F.from_json("j", to_spark(infer_one(record))).alias("r")) if record else spark.range(1)
        made = transform(df.select("r.*") if record else df, {"steps": steps})
        assert made.collect()[0].asDict(True) == target


@pytest.mark.parametrize(
    "text",
    [
        '{"steps": []}',
        '{"steps": [{"op": "python"}]}',
        '{"steps": [{"op": "copy", "from": "a", "to": "b", "more": 1}]}',
        '{"steps": [{"op": "copy", "from": "a", "from_": "a", "to": "b"}]}',
        '{"steps": [{"op": "copy", "to": "b"}]}',
        '{"steps": [{"op": "copy", "from": "a", "to": "b"}], "steps": []}',
        '{"steps": [{"op": "split", "from": "a", "to": "b", "separator": ",", "index": 1.5}]}',
        '{"steps": [{"op": "cast", "from": "a", "to": "b", "target_type": "date"}]}',
        '{"steps": [{"op": "coalesce", "sources": [], "to": "b"}]}',
        '{"steps": [{"op": "nest", "fields": {}, "to": "b"}]}',
        '{"steps": [{"op": "map_array", "from": "a", "to": "b", "steps": [{"op": "filter_array", "from": "a", "to": "b", "condition": {"path": "x", "operator": "eq"}}]}]}',
        '{"steps": [{"op": "conditional", "to": "b", "condition": {"path": "x", "operator": "eq"}, "then": {"from": "a", "value": 1}, "otherwise": {"value": 1}}]}',
        '{"steps": [{"op": "conditional", "to": "b", "condition": {"path": "x", "operator": "like"}, "then": {"value": 1}, "otherwise": {"value": 1}}]}',
        "[]",
    ],
)
def test_parser_rejects(text):
    with pytest.raises(ProgramError):
        parse(text)


def test_parser_reads_leniently():
    steps = parse('{"steps": [{"op": "scale", "from_": "a", "to": "b", "factor": "2", "offset": true}, {"op": "split", "from": "a", "to": "c", "separator": ",", "index": "1"}, {"op": "split", "from": "a", "to": "d", "separator": ",", "index": 1.0}, {"op": "conditional", "to": "e", "condition": {"path": "", "operator": "exists"}, "then": {"value": null}, "otherwise": {"from": null}}]}').steps
    assert steps[0].options == {"factor": 2.0, "offset": 1.0} and steps[1].options["index"] == steps[2].options["index"] == 1
    assert steps[3].options["then"].path is None and steps[3].options["otherwise"].path == ""
    with pytest.raises(json.JSONDecodeError):
        parse("{")


CASTS = [
    ("integer", [" 42 ", "1_000", "12.5", "1__0", "", -2.7, True, 7], [42, 1000, None, None, None, -2, None, 7]),
    ("number", [" 4.2 ", "1_0", "1d", "inf", ".5", 3, True], [4.2, 10.0, None, float("inf"), 0.5, 3.0, None]),
    ("boolean", ["YES", "t", " true", "0", 1.0, 2, False], [True, None, None, False, True, None, False]),
    ("string", [True, 1e16, 1e-5, 1e7, 0.001, -0.0, 12], ["True", "1e+16", "1e-05", "10000000.0", "0.001", "-0.0", "12"]),
]


@pytest.mark.parametrize("target,values,expected", CASTS)
def test_casts_agree(spark, target, values, expected):
    program = parse({"steps": [s("cast", "b", "a", target_type=target)]})
    run = compiled(program)
    for kind, name in ((str, "string"), (bool, "boolean"), (int, "long"), (float, "double")):
        chosen = [(v, e) for v, e in zip(values, expected) if type(v) is kind]
        got = [r.b for r in transform(spark.createDataFrame([(v,) for v, _ in chosen], f"a {name}"), program, "report").collect()] if chosen else []
        assert got == [e for _, e in chosen]
    for v, e in zip(values, expected):
        if e is None:
            with pytest.raises(RowError):
                run({"a": v})
        else:
            assert run({"a": v}) == {"b": e}


@pytest.mark.parametrize("text,ok", [("2024-2-9", True), ("24-02-09", False), ("2024-02-30", False), ("2024-02-29x", False), ("2024-12-31", True)])
@pytest.mark.parametrize("form", ["%d/%m/%Y", "%Y%m%d", "%d-%b-%Y"])
def test_dates_agree(spark, text, ok, form):
    program = parse({"steps": [s("format_date", "b", "a", input_format="%Y-%m-%d", output_format=form)]})
    got = transform(spark.createDataFrame([(text,)], "a string"), program, "report").collect()[0]
    assert (got.error is None) == ok
    if ok:
        assert compiled(program)({"a": text}) == {"b": got.b}
    else:
        with pytest.raises(RowError):
            compiled(program)({"a": text})


PREDICATE_VALUES = [None, True, False, 0, 1, 2, 1.0, 2.5, "a", "abc", "5", ["a", 1, None], [2.5], {"a": 1}]


@pytest.mark.parametrize("operator", ["exists", "eq", "ne", "gt", "ge", "lt", "le", "in", "contains"])
def test_predicates_agree(spark, operator):
    """Typed columns decide as the record runner does."""
    rows = {"long": [0, 1, 2, 5, None], "double": [1.0, 2.5, float("nan"), None], "string": ["a", "abc", "", "5", None], "boolean": [True, False, None], "array<string>": [["a"], [], None], "struct<a:int>": [(1,), None]}
    for kind, values in rows.items():
        df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
        steps = [when(f"r{k}", "x", operator, v, {"value": True}, {"value": False}) for k, v in enumerate(PREDICATE_VALUES)]
        got = transform(df, {"steps": steps}).collect()
        run = compiled(parse({"steps": steps}))
        for row, value in zip(got, values):
            record = {"x": {"a": value[0]} if isinstance(value, tuple) else value}
            assert row.asDict() == run(record), (operator, kind, value)


def test_splits_and_errors(spark):
    df = spark.createDataFrame([("a.b.c",), ("x",), (None,)], "a string")
    program = {"steps": [s("split", "last", "a", separator=".", index=-1), s("split", "second", "a", separator=".", index=1)]}
    got = transform(df, program, "report").collect()
    assert [tuple(r)[:2] for r in got] == [("c", "b"), (None, None), (None, None)] and got[1].error and got[2].error
    assert [tuple(r) for r in transform(df, program, "null").collect()] == [("c", "b"), (None, None), (None, None)]
    with pytest.raises(Exception, match="no such item"):
        transform(df, program).collect()
    assert transform(df, {"steps": [s("split", "b", "a", separator="", index=0)]}, "report").collect()[0].error
    with pytest.raises(ValueError, match="on_error"):
        transform(df, program, "ignore")


def test_writes(spark):
    df = spark.createDataFrame([("v", ("w", 1))], "a string, d struct<p:string,q:int>")
    steps = [s("constant", "n", value=None), s("copy", "n.x", "a"), s("nest", "o", fields={"k.l": "a"}), s("flatten", "o", "d"), s("copy", "o.k.m", "a"), s("copy", "c", "d"), s("constant", "c.q", value="z"), s("copy", "a", "a"), s("constant", "a", value=3)]
    want = {"n": {"x": "v"}, "o": {"k": {"l": "v", "m": "v"}, "p": "w", "q": 1}, "c": {"p": "w", "q": "z"}, "a": 3}
    assert transform(df, {"steps": steps}).collect()[0].asDict(True) == want
    assert compiled(parse({"steps": steps}))({"a": "v", "d": {"p": "w", "q": 1}}) == want
    for bad in ([s("copy", "a.b", "a"), s("copy", "a", "a"), s("copy", "a.b.c", "a")], [s("copy", "", "a")], [s("copy", "x", "missing")], [s("copy", "x", "a.b")]):
        with pytest.raises(CompileError):
            transform(df, {"steps": bad})
    with pytest.raises(RowError):
        compiled(parse({"steps": [s("copy", "a", "a"), s("copy", "a.b", "a")]}))({"a": "v"})


def test_only_the_chosen_branch_is_read():
    run = compiled(parse({"steps": [when("b", "a", "eq", 1, {"value": "one"}, {"from": "gone"})]}))
    assert run({"a": 1}) == {"b": "one"}
    with pytest.raises(RowError):
        run({"a": 2})
    with pytest.raises(RowError):  # an absent path in a condition is an error, for exists too
        compiled(parse({"steps": [when("b", "gone", "exists", None, {"value": 1}, {"value": 2})]}))({"a": 1})


def test_one_projection_and_pruning(spark, tmp_path):
    spark.createDataFrame([(1, "x", 2.0)], "a long, b string, c double").write.parquet(str(tmp_path / "t"))
    made = transform(spark.read.parquet(str(tmp_path / "t")), {"steps": [s("copy", "k.a", "a"), s("scale", "c", "c", factor=2)]}, "null")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") == 1 and "struct<a:bigint,c:double>" in plan


def test_schemas():
    rows = [{"a": 1, "b": [1, 2.5], "c": None}, {"a": 2, "b": [], "c": "x", "d": {"e": True}}]
    schema = infer(rows)
    assert schema["properties"]["c"]["type"] == ["null", "string"] and schema["required"] == ["a", "b", "c"] and schema["properties"]["b"]["items"] == {"type": "number"}
    assert all(first_breach(r, schema) is None for r in rows)
    assert "required" in first_breach({"a": 1}, schema) and "allowed" in first_breach(rows[0] | {"z": 1}, schema)
    assert first_breach({"a": True, "b": [], "c": None}, schema).startswith("a:") and first_breach({"a": 1.0, "b": [], "c": None}, schema) is None
    with pytest.raises(SchemaError):
        first_breach(1, {"minimum": 3})


def test_static_paths():
    source = {"type": "object", "properties": {"a": {"type": "string"}, "l": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "integer"}}}}}}
    fault = lambda steps: check(parse({"steps": steps}), source, source)
    assert fault([s("copy", "a", "a")]) is None
    assert fault([s("copy", "a", "q")]).failure == "invalid_source_path" and fault([s("copy", "q", "a")]).failure == "invalid_target_path"
    assert fault([s("copy", "my_source", "a")]).failure == "invalid_source_path"
    assert fault([s("filter_array", "l", "l", condition={"path": "q", "operator": "exists"})]).failure == "invalid_target_path"
    assert fault([s("map_array", "l", "l", steps=[s("copy", "x", "x")])]) is None


scalars = st.one_of(st.none(), st.integers(-(10**6), 10**6), st.text("ab:1. ", max_size=6))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(scalars.filter(lambda x: isinstance(x, (int, type(None)))), st.text("ab:1. ", max_size=6)), min_size=1, max_size=6))
def test_typed_and_record_modes_agree(spark, rows):
    steps = [
        s("copy", "n.x", "x"),
        s("default", "n.d", "x", value=-1),
        s("concat", "c", sources=["x", "y"], separator="|"),
        s("cast", "t", "y", target_type="string"),
        s("map_enum", "e", "x", mapping={"1": "one", "None": "none"}, default="other"),
        when("w", "x", "ge", 0, {"from": "y"}, {"value": "neg"}),
        when("q", "y", "contains", "a", {"value": True}, {"value": False}),
        s("split", "p", "y", separator=":", index=0),
    ]
    run = compiled(parse({"steps": steps}))
    got = [r.asDict(True) for r in transform(spark.createDataFrame(rows, "x long, y string"), {"steps": steps}).collect()]
    assert got == [run({"x": x, "y": y}) for x, y in rows]
