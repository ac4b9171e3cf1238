"""Places, overlaps, percentiles and inferred schemas against plain Python."""

import json
import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from morphlake.operators import dataset, inference, metrics
from morphlake.plans.schema import infer


def test_places_with_gaps_repeats_and_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 300, 7)]), k) for k in range(500)] + [("hot", 5, 1000 + k) for k in range(700)]
    df = spark.createDataFrame(rows, "part string, idx long, row long").repartition(6)
    got = dataset.placed(df, "part", "idx").collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["part", "idx", "row", "place"]
    for part in ("a", "b", None, "hot"):
        mine = sorted((r for r in got if r.part == part), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(sum(p == part for p, *_ in rows)))
        order = [(r.idx is not None, r.idx or 0) for r in mine]
        assert order == sorted(order)


def test_numbers_do_not_change_and_no_task_holds_equal_rows(spark):
    df = spark.range(2000).select(F.lit(1).alias("same"), "id")
    made = dataset.numbered(df, [F.col("same")])
    assert sorted(r.place for r in made.collect()) == list(range(2000))
    assert {r.id: r.place for r in made.collect()} == {r.id: r.place for r in made.collect()}
    assert max(r["count"] for r in made.groupBy(F.input_file_name()).count().collect()) < 1500
    assert dataset.numbered(df.where("false"), [F.col("same")]).count() == 0


def test_overlaps(spark):
    rows = [("train", 1, "x"), ("train", 2, "y"), ("test", 2, "x"), ("test", 3, None), ("train", None, None), ("test", None, "z"), (None, 1, "y")] + [("train", 9, "h")] * 50 + [("test", 9, "h")] * 50
    df = spark.createDataFrame(rows, "split string, k long, v string").repartition(4)
    of = lambda s: F.col("split") == s
    made = dataset.overlaps(df, {"k": (of("train"), of("test"), F.col("k")), "v": (of("train"), of("test"), F.col("v")), "none": (of("train"), of("gone"), F.col("v"))})
    assert {r.check: r.overlap for r in made.collect()} == {"k": 2, "v": 2, "none": 0}
    plan = made.select("*")._jdf.queryExecution().executedPlan().toString()  # not run, so told once
    assert len(re.findall(r"Exchange hashpartitioning\(check#\d+, value#\d+", plan)) == 1 and plan.count("REPARTITION_BY_NUM") == 1


def _bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x) + 0.0))[0]
    return (1 << 63) - 1 if math.isnan(x) else -n if x < 0 else n


def test_bits_order_as_doubles_do(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 0.1, 1 / 3, -1e-310]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(metrics.ordered_bits(F.col("v")).alias("b")).collect()
    assert [r.b for r in got] == [_bits(v) for v in values]


def test_percentiles_of_groups(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.gauss(0, 1e3), -0.0, 0.0, rng.uniform(-1e-300, 1e-300), 7.0, 1e300, None])) for g in ["a"] * 400 + ["b"] * 3 + [None] * 50 + ["c"]]
    rows += [("hot", 7.0)] * 900 + [("nothing", None)]
    ps = {"least": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "most": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: tuple(r)[1:] for r in metrics.percentile_table(df, ["k"], "v", ps).collect()}
    want = {}
    for g in {k for k, _ in rows}:
        mine = sorted(v for k, v in rows if k == g and v is not None)
        if mine:
            want[g] = tuple(mine[min(len(mine) - 1, max(0, round((len(mine) - 1) * p)))] for p in ps.values())
    assert got == want
    assert metrics.percentile_table(df, [], "v", {"p50": 0.5}).count() == 1
    assert metrics.percentile_table(df.where("false"), ["k"], "v", {"p50": 0.5}).count() == 0


EXAMPLES = [
    [1, 2.5], [1, None, 2.5], [None], [{}], [{"a": 1}, {"a": None, "b": [1, "x"]}, None], [[], [1, None], None], [[], []], [{"a": 1}, [1]], [1, "x", True], [{"a.b": 1, "a": {"b": 2}}, {"a": {"c": []}, "a.b": 3}],
    [{"x": [{"y": 1}, {"y": 2, "z": None}]}, {"x": [{"y": 1.5}]}],
]


@pytest.mark.parametrize("values", EXAMPLES, ids=range(len(EXAMPLES)))
def test_inferred_schema_is_that_of_the_values(spark, values):
    df = spark.createDataFrame([(json.dumps(v),) for v in values] + [("{broken",)], "t string").select(F.try_parse_json("t").alias("v"))
    assert inference.infer_schema(df, "v") == infer(values)
    halves = [inference.kind_counts(df.where(F.to_json("v").isin(*part)), "v") for part in ([json.dumps(v, separators=(",", ":")) for v in values[:1]], [])]
    assert inference.added(*halves).count() <= inference.kind_counts(df, "v").count()


def test_counts_of_parts_add_up(spark):
    whole = spark.createDataFrame([(k, json.dumps({"a": k} if k % 2 else {"b": [k, str(k)]})) for k in range(40)], "k int, t string").select("k", F.parse_json("t").alias("v"))
    parts = [inference.kind_counts(whole.where(F.col("k") % 3 == r), "v") for r in range(3)]
    as_rows = lambda df: sorted((tuple(r.place), r.kind, r.n) for r in df.collect())
    assert as_rows(inference.added(*parts)) == as_rows(inference.kind_counts(whole, "v"))
    assert inference.kind_counts(whole.where("false"), "v").count() == 0 and inference.infer_schema(whole.where("false"), "v") == {"type": "null"}


@pytest.mark.parametrize("most", [metrics.MAX_SENT, 0])
def test_values_that_repeat_are_not_broadcast(spark, monkeypatch, most):
    """Such values are a small file of many rows; ranks go to them, or both are shuffled."""
    plans = []
    kept = metrics.stored
    monkeypatch.setattr(metrics, "stored", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or kept(df, tag))
    monkeypatch.setattr(metrics, "MAX_SENT", most)
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 977).cast("double").alias("v"))
    got = {r.k: (r.p50, r.p95) for r in metrics.percentile_table(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {k: tuple(sorted(float(i % 977) for i in range(k, 200_000, 2))[round(99_999 * p)] for p in (0.5, 0.95)) for k in (0, 1)}
    passes = [plan for tag, plan in plans if tag == "ranks"][1:]
    assert len(passes) == 4
    assert all(("BuildRight" in p and "SortMergeJoin" not in p) if most else "SortMergeJoin" in p for p in passes)
    assert not any("BuildLeft" in p for p in passes)
