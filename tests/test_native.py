"""Programs, schemas and comparison as expressions over VARIANT, held against the
plain functions for single values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from morphlake.functions import variant as V
from morphlake.operators import compare, score
from morphlake.plans import conform, native, records
from morphlake.plans.program import parse
from morphlake.plans.schema import SchemaError, first_breach

VALUES = [
    1, 1.0, 0, -3, True, False, None, "", "a", "it's", "x,y", [], {}, 1e20, 0.1, 1.1000000001, "[{", [1, [2, 3]], [1.0], [True], [None], {"a": [None]}, {"k": 'q"]}'},
    {"a": {"b": 1, "c": [1, {"d": "x y"}, []]}, "a.b": 2, "e": {}}, {"a.b": 1, "a": {"b": 2}}, 2**62, -(2**53) - 1, 12.5,
]


def test_nodes_text_equality_and_leaves(spark):
    rows = [(i, j, json.dumps(x), json.dumps(y)) for i, x in enumerate(VALUES) for j, y in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "i int, j int, x string, y string").repartition(4).withColumns({"a": F.parse_json("x"), "b": F.parse_json("y")})
    made = df.select("i", "j", V.text(F.col("a")).alias("text"), V.spaced_json(F.col("a")).alias("json"), compare.json_equal(F.col("a"), F.col("b")).alias("equal"), native.same(F.col("a"), F.col("b")).alias("same"))
    for r in made.collect():
        x, y = VALUES[r.i], VALUES[r.j]
        assert (r.equal, r.same) == (compare.equal(x, y), x == y), (x, y)
        assert isinstance(x, (dict, list)) or r.text == str(x)
        assert json.loads(r.json) == x
    counted = compare.json_f1_table(df, ["i", "j"], "a", "b").collect()
    for r in counted:
        assert (r.n_agree, r.n_found, r.n_wanted) == compare.leaf_counts(VALUES[r.i], VALUES[r.j]), (VALUES[r.i], VALUES[r.j])
        assert r.field_f1 == pytest.approx(compare.field_f1(VALUES[r.i], VALUES[r.j]))


def test_text_of_objects(spark):
    df = spark.createDataFrame([('{"b": "it\'s", "a": [1, true, null, "x:,y"]}',)], "x string")
    assert df.select(V.text(F.parse_json("x"))).first()[0] == """{'a': [1, True, None, 'x:,y'], 'b': "it's"}"""


def test_absent_values(spark):
    df = spark.createDataFrame([(None, "1"), ("1", None), (None, None), ("{", "1")], "x string, y string").select(F.try_parse_json("x").alias("a"), F.try_parse_json("y").alias("b"))
    assert [r[0] for r in df.select(compare.json_equal(F.col("a"), F.col("b"))).collect()] == [False, False, True, False]
    assert [(r.same, r.n_found, r.n_wanted) for r in compare.json_f1_table(df, [], "a", "b").collect()] == [(False, 0, 1), (False, 1, 0), (True, 0, 0), (False, 0, 1)]


# -- programs --------------------------------------------------------------

RECORDS = [
    {"a": 1, "b": "x,y", "c": {"d": 2.5, "e": None, "f": {"g": "h"}}, "n": None, "l": [{"q": 1, "w": "u"}, {"q": 7, "w": "v"}], "t": True, "dt": "2024-02-09", "s": "12_0", "fl": 3.0, "o'k": 4, 'o"k': 5},
    {"a": "5", "b": "", "c": {}, "n": 0, "l": [], "t": False, "dt": "2024-13-01", "s": " yes"},
    {"l": [1, 2, "x"], "c": 5, "a": [1, 2], "b": 1.5, "t": "true", "dt": "2024-2-9"},
    {"c": None},
    [1],
    7,
]


def _s(op, to, source=None, **rest):
    return {"op": op, "to": to, **({} if source is None else {"from": source}), **rest}


def _c(path, operator, value=None):
    return {"path": path, "operator": operator, "value": value}


STEPS = [
    _s("copy", "x", "a"), _s("copy", "", "a"), _s("copy", "$", "a"), _s("copy", "x.y", "c"), _s("copy", "x", ""), _s("copy", "x", "c.f.g"), _s("copy", "x", "l.q"), _s("copy", "x", "o'k"), _s("copy", "x", 'o"k'),
    _s("constant", "k", value={"z": [1, None]}),
    *(_s("cast", "x", p, target_type=t) for p in "abnstc" for t in ("string", "integer", "number", "boolean") if (p, t) != ("c", "string")),
    _s("cast", "x", "fl", target_type="integer"), _s("default", "x", "n", value=7), _s("default", "x", "zz", value="d"), _s("default", "x", "t", value=1),
    _s("coalesce", "x", sources=["zz", "n", "b"]), _s("coalesce", "x", sources=["zz"]),
    _s("map_enum", "x", "a", mapping={"1": "one", "5": None}, default="other"), _s("map_enum", "x", "t", mapping={"True": 1}),
    _s("scale", "x", "a", factor=2), _s("scale", "x", "fl", factor=0.1, offset=3),
    *(_s("format_date", "x", "dt", input_format="%Y-%m-%d", output_format=f) for f in ("%d/%m/%Y", "%Y%m%d", "%d-%b-%Y", "", "%%")),
    _s("format_date", "x", "b", input_format="x,y", output_format="%Y"),
    _s("concat", "x", sources=["a", "b", "n"], separator="-"), _s("concat", "x", sources=["t", "fl"]),
    *(_s("split", "x", "b", separator=sep, index=i) for sep, i in ((",", 0), (",", -1), (",", 5), (",", -3), ("", 0), ("\\E.", 0))),
    _s("nest", "x", fields={"p.q": "a", "p.r": "b"}), _s("nest", "x", fields={"p": "a", "p.r": "b"}), _s("nest", "x", fields={"p": "c", "p.r": "b"}), _s("nest", "x.y", fields={"p": "b"}),
    _s("flatten", "x", "c"), _s("flatten", "", "c"), _s("flatten", "", "zz"), _s("flatten", "x", "a"),
    *(
        _s("conditional", "x", condition=_c(p, o, v), then={"from": "b"}, otherwise={"value": [1]})
        for p in ("a", "t", "n", "l", "c", "b")
        for o, v in (("exists", None), ("eq", 1), ("eq", [1, 2]), ("eq", {}), ("ne", None), ("gt", 0), ("ge", [1, 1]), ("lt", "6"), ("lt", [1, 2, 3]), ("le", 1.0), ("in", [1, "5", None]), ("in", "xx5"), ("in", {"5": 1}), ("in", 5), ("contains", "x"), ("contains", "d"), ("contains", 2))
    ),
    _s("map_array", "m", "l", steps=[_s("copy", "z.y", "q"), _s("default", "z.w", "w", value=0)]),
    _s("map_array", "m", "l", steps=[_s("flatten", "", ""), _s("copy", "q.r", "w")]),
    _s("map_array", "m", "l", steps=[_s("nest", "z", fields={"a.b": "q"}), _s("copy", "z.a.c", "w")]),
    _s("filter_array", "f", "l", condition=_c("q", "gt", 3)), _s("filter_array", "f", "l", condition=_c("", "gt", 1)), _s("filter_array", "f", "a", condition=_c("", "eq", 1)),
]
ORDERED = [
    [_s("copy", "o", "n"), _s("copy", "o.p", "b")], [_s("copy", "o.p", "b"), _s("copy", "o", "a")], [_s("copy", "o", "b"), _s("copy", "o.p", "b")],
    [_s("flatten", "o", "c"), _s("copy", "o.d", "a"), _s("copy", "o.f.z", "b")], [_s("copy", "o", "c"), _s("flatten", "o", "c")], [_s("copy", "o", "b"), _s("copy", "o.p", "b"), _s("copy", "q", "zz")],
    [_s("copy", "q", "zz"), _s("copy", "o", "b"), _s("copy", "o.p", "b")], [_s("constant", "o", value={}), _s("copy", "p", "b")],
]


def _programs():
    rng = random.Random(1)
    places = ["u", "u.v", "w", "w.x.y", "u.v.z"]
    mixed = [[rng.choice(STEPS) | {"to": rng.choice(places)} for _ in range(rng.randint(2, 4))] for _ in range(250)]
    return [[s] for s in STEPS] + ORDERED + mixed


def test_programs_against_single_records(spark):
    from morphlake.operators.dynamic import transform_rows

    programs = _programs()
    rows = [(k, i, json.dumps({"steps": p}), json.dumps(r)) for k, p in enumerate(programs) for i, r in enumerate(RECORDS)]
    got = transform_rows(spark.createDataFrame(rows, "k int, i int, program string, record string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        try:
            want = records.compiled(parse({"steps": programs[r.k]}))(json.loads(json.dumps(RECORDS[r.i])))
        except records.RowError as e:
            want = None
            if str(e).startswith("missing source path"):
                assert "map_array" in r.program or "filter_array" in r.program or r.error == str(e), (r, str(e))
        assert (r.error is None) == (want is not None), (r, want)
        assert (None if r.target is None else json.loads(r.target)) == want, (r, want)


def test_rows_whose_columns_clash_and_broken_rows(spark):
    from morphlake.operators.dynamic import transform_rows

    program = json.dumps({"steps": [_s("copy", "b", "a")]})
    rows = [(program, '{"a": 1}', 1), (program, "{", 2), (program, None, 3), (None, "{}", 4), ("[]", "{}", 5), (program, '{"a": 1, "a": 2}', 6)]
    df = spark.createDataFrame(rows, "program string, record string, jobs int").withColumns({"plan": F.lit("p"), "facts": F.lit("f"), "outcomes": F.lit(0), "digest": F.lit("d")})
    made = transform_rows(df)
    assert made.columns == [*df.columns, "target", "error"]
    got = {r.jobs: (r.target, r.error is None) for r in made.collect()}
    assert got == {1: ('{"b": 1}', True), **{k: (None, False) for k in (2, 3, 4, 5, 6)}}
    assert transform_rows(df.where("false")).count() == 0


def test_python_sees_distinct_programs_only(spark, monkeypatch):
    """What goes to Python is one row for each distinct text, whatever repeats."""
    program = json.dumps({"steps": [_s("copy", "b", "a")]})
    df = spark.createDataFrame([(program, json.dumps({"a": k})) for k in range(500)], "program string, record string")
    sent = []
    known = score.known
    monkeypatch.setattr(score, "known", lambda texts, *rest: sent.append(texts.count()) or known(texts, *rest))
    from morphlake.operators.dynamic import transform_rows

    made = transform_rows(df)
    assert sent == [1] and made.count() == 500
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


# -- schemas ---------------------------------------------------------------

SCHEMAS = [
    {}, {"type": "object"}, {"type": ["integer", "null"]}, {"type": "number"}, {"type": "integer"}, {"type": "array", "items": {"type": "integer"}},
    {"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "string"}, "c": {"type": "array", "items": {"type": ["integer", "object"], "properties": {"d": {"type": "integer"}}}}}, "required": ["z", "b"]}}, "additionalProperties": False},
    {"type": "object", "properties": {"e": {}}, "additionalProperties": {"type": "integer"}}, {"properties": {"a": {"type": "boolean"}}, "items": {"type": "null"}}, {"type": "object", "required": ["x", "a"], "additionalProperties": False},
]


@pytest.mark.parametrize("schema", SCHEMAS, ids=range(len(SCHEMAS)))
def test_first_breach(spark, schema):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, x string")
    for r in df.select("i", conform.first_breach(F.parse_json("x"), schema).alias("b")).collect():
        assert r.b == first_breach(VALUES[r.i], schema), (VALUES[r.i], schema)


def test_unsupported_keywords(spark):
    with pytest.raises(SchemaError):
        conform.first_breach(F.lit(None), {"type": "object", "properties": {"a": {"minimum": 1}}})
    made = [r["unsupported"] for r in conform.rules({"properties": {"a": {"minimum": 1}}})]
    assert made == [None, "unsupported keywords ['minimum']"]


# -- scoring ---------------------------------------------------------------


@pytest.mark.parametrize("mode", score.MODES)
def test_score_table_equals_single_scores(spark, mode):
    rng = random.Random(2)
    open_schema = {"type": "object", "properties": {n: {"properties": {m: {} for m in "bcdefgvwxyz"}} for n in "abclntuwx"} | {"dt": {}, "fl": {}, "s": {}}}
    closed = {"type": "object", "properties": {"u": {"type": "string"}}, "required": ["u"], "additionalProperties": False}
    odd = {"type": "object", "properties": {"u": {"minimum": 3}}}
    rows = []
    for k in range(120):
        steps = [rng.choice(STEPS) | {"to": rng.choice(["u", "u.v", "w"])} for _ in range(rng.randint(1, 3))]
        target = rng.choice([open_schema, open_schema, closed, odd])
        cases = []
        for _ in range(rng.randint(0, 3)):
            given = rng.choice(RECORDS)
            try:
                wanted = records.compiled(parse({"steps": steps}))(json.loads(json.dumps(given)))
            except records.RowError:
                wanted = {"u": 1}
            if rng.random() < 0.3:
                wanted = wanted | {"u": "changed"}
            cases.append({"input": given, "expected": wanted})
        text = rng.choice([json.dumps({"steps": steps})] * 6 + ["{", "[]", '{"steps": []}'])
        rows.append((k, text, json.dumps(open_schema), json.dumps(target), json.dumps(cases)))
    df = spark.createDataFrame(rows, "k int, completion string, source_schema string, target_schema string, hidden_tests string")
    got = {r.k: r for r in score.score_table(df, mode).collect()}
    classes = set()
    for k, text, source, target, cases in rows:
        want, r = score.score(text, source, target, json.loads(cases), mode), got[k]
        classes.add(want.failure_type)
        assert r.reward == pytest.approx(want.reward) and r.failure_type == want.failure_type, (rows[k], want)
        assert r.components == pytest.approx(want.components) and (r.program is None) == (want.program is None)
        assert len(r.cases) == len(want.cases)
        for c, w in zip(r.cases, want.cases):
            assert (c["index"], c.passed, c.schema_pass, c.n_agree, c.n_found, c.n_wanted) == tuple(w[n] for n in ("index", "passed", "schema_pass", "n_agree", "n_found", "n_wanted")), (rows[k], c, w)
            assert c.field_f1 == pytest.approx(w["field_f1"]) and (c.error is None) == (w["error"] is None)
            assert (c.predicted is None) == (w["predicted"] is None) and (c.predicted is None or json.loads(c.predicted) == json.loads(w["predicted"]))
    assert {None, "json_parse_error", "dsl_schema_error", "target_schema_error", "runtime_error", "partial_value_mismatch"} <= classes
    counted = df.select("k", score.gold_leaves("hidden_tests").alias("n")).collect()
    assert {r.k: r.n for r in counted} == {row[0]: sum(compare.leaf_counts(None, c["expected"])[2] for c in json.loads(row[4])) for row in rows}


def test_components_of_binary_mode():
    record = {"input": {"a": 1}, "expected": {"a": 1}}
    schema = {"type": "object", "properties": {"a": {"type": "integer"}}}
    done = score.score({"steps": [_s("copy", "a", "a")]}, schema, schema, [record], "binary")
    assert done.components == {"all_hidden_cases": 1.0} and done.reward == 1.0
    assert set(score.score({"steps": [_s("copy", "a", "a")]}, schema, schema, [record]).components) == {"parse_schema", "reference_validity", "target_schema", "hidden_exact", "field_f1"}


def test_numbers_in_json_and_texts_have_no_needless_exponent(spark):
    values = [12000001.0, 1e15, 1e16, 0.001, 0.00001, -12345678.5, {"s": "1.5E7, or 2E-3: no", "v": 72000001.0}, [-2.5e20, "a\"E,5E7\\"], "E1E5," * 4000]
    powered = ["1.2000001E7", "1E15", "1E16", "1E-3", "1E-5", "-1.23456785E7", '{"v": 7.2000001E7, "s": "1.5E7, or 2E-3: no"}', '[-2.5E20, "a\\"E,5E7\\\\"]', json.dumps("E1E5," * 4000)]
    df = spark.createDataFrame([*enumerate(powered)], "i int, x string").select("i", F.try_parse_json("x").alias("v"))
    for r in df.select("i", V.spaced_json(F.col("v")).alias("json"), V.text(F.col("v")).alias("text")).collect():
        assert r.json == json.dumps(values[r.i])
        assert r.text == str(values[r.i]) or isinstance(values[r.i], (dict, list))


def test_values_of_large_keys(spark, tmp_path):
    """programs_in_column on keys that make numbers of ten million and more."""
    from morphlake.json_queries import QUERIES

    keys = [k + 16 * 600_000 for k in range(16)]
    spark.createDataFrame([(k, 7, "F", 150000.5) for k in keys], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").withColumn("o_orderdate", F.to_timestamp(F.lit("2024-02-09"))).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.v for r in QUERIES["programs_in_column"](spark, str(tmp_path)).collect()}
    assert got[keys[6]] == f"{keys[6] * 2 + 1}.0" and got[keys[0]] == "7" and got[keys[2]] == "150000" and got[keys[15]] is None


def test_few_programs_against_single_records(spark):
    """Programs that are few become expressions of their own, with the same results."""
    from morphlake.operators.dynamic import transform_rows

    chosen = [*({s["op"]: [s] for s in STEPS}.values()), ORDERED[3], ORDERED[5], [STEPS[7], STEPS[3] | {"to": "x2.y"}]]
    for few in (chosen[::2], chosen[1::2]):
        rows = [(k, i, json.dumps({"steps": p}), json.dumps(r)) for k, p in enumerate(few) for i, r in enumerate(RECORDS)]
        made = transform_rows(spark.createDataFrame(rows, "k int, i int, program string, record string"))
        for r in made.collect():
            try:
                want = records.compiled(parse({"steps": few[r.k]}))(json.loads(json.dumps(RECORDS[r.i])))
            except records.RowError as e:
                want = None
                if str(e).startswith("missing source path"):
                    assert "map_array" in r.program or "filter_array" in r.program or r.error == str(e), (r, str(e))
            assert (r.error is None) == (want is not None), (r, want)
            assert (None if r.target is None else json.loads(r.target)) == want, (r, want)


def test_faults_are_looked_for_once(spark):
    """No filter before the faults are listed, as that runs every case twice."""
    from morphlake.operators import dataset

    program = json.dumps({"steps": [_s("copy", "b", "a")]})
    schema = json.dumps({"type": "object", "properties": {n: {"type": "integer"} for n in "ab"}, "additionalProperties": False})
    rows = [(k, program, schema, schema, json.dumps([{"input": {"a": k}, "expected": {"b": k % 2}}])) for k in range(4)]
    made = dataset.faults(spark.createDataFrame(rows, "sample_id int, reference_program string, source_schema string, target_schema string, validation_cases string"))
    assert {(r.sample_id, r.fault) for r in made.collect()} == {(k, "the program gives another result") for k in (2, 3)}
    assert "Filter (size(" not in made._jdf.queryExecution().optimizedPlan().toString()
