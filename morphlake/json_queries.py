"""Queries over JSON of unknown shape: programs in a column, schema checks,
leaves and comparison, inferred schemas; each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import variant as V
from .operators import compare, dynamic
from .plans import conform
from .sources.stage import spread

# -- programs in a column --------------------------------------------------


def _p(*steps: dict) -> str:
    return json.dumps({"steps": list(steps)})


def _s(op: str, source: str | None = None, to: str = "v", **rest) -> dict:
    return {"op": op, "to": to, **({} if source is None else {"from": source}), **rest}


_BIG = {"path": "price", "operator": "gt", "value": 100_000}
#: Of an order's key modulo 16: its program, and the text of ``v`` in SQL (null: an error).
PROGRAMS: list[tuple[str, str]] = [
    (_p(_s("copy", "who.id")), "o_custkey::VARCHAR"),
    (_p(_s("constant", value="fixed")), "'fixed'"),
    (_p(_s("cast", "price", target_type="integer")), "trunc(o_totalprice)::BIGINT::VARCHAR"),
    (_p(_s("default", "none", value=7)), "'7'"),
    (_p(_s("coalesce", sources=["gone", "none", "status"])), "o_orderstatus"),
    (_p(_s("map_enum", "status", mapping={"F": "done", "O": "open"}, default="other")), "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END"),
    (_p(_s("scale", "key", factor=2, offset=1), _s("cast", "key", "w", target_type="string")), "(o_orderkey * 2 + 1)::VARCHAR || '.0'"),
    (_p(_s("format_date", "date", input_format="%Y-%m-%d", output_format="%d/%m/%Y")), "strftime(o_orderdate, '%d/%m/%Y')"),
    (_p(_s("concat", sources=["status", "key", "none"], separator="-")), "o_orderstatus || '-' || o_orderkey || '-None'"),
    (_p(_s("split", "date", separator="-", index=-1)), "strftime(o_orderdate, '%d')"),
    (_p(_s("nest", to="deep", fields={"a.b": "key"}), _s("copy", "status", "deep.c"), _s("copy", "key", "v")), "o_orderkey::VARCHAR"),
    (_p(_s("flatten", "who", to="w"), _s("concat", sources=["who.id", "who.tag"])), "o_custkey || 'c'"),
    (_p(_s("conditional", condition=_BIG, then={"from": "status"}, otherwise={"value": "small"})), "CASE WHEN o_totalprice > 100000 THEN o_orderstatus ELSE 'small' END"),
    (_p(_s("map_array", "parts", to="m", steps=[_s("scale", "n", "n", factor=10)]), _s("constant", value="mapped")), "'mapped'"),
    (_p(_s("filter_array", "parts", to="m", condition={"path": "n", "operator": "ge", "value": 2}), _s("constant", value="kept")), "'kept'"),
    (_p(_s("cast", "status", target_type="number")), "NULL"),
]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    part = lambda n: F.struct((key % n).alias("n"))
    record = F.struct(
        key.alias("key"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.struct(F.col("o_custkey").alias("id"), F.lit("c").alias("tag")).alias("who"),
        F.lit(None).cast("string").alias("none"),
        F.array(part(3), part(4), part(5)).alias("parts"),
    )
    program = F.element_at(F.array(*(F.lit(p) for p, _ in PROGRAMS)), (F.pmod(key, F.lit(len(PROGRAMS))) + 1).cast("int"))
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey"))
    return orders.select(key, program.alias("program"), F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def programs_in_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dynamic.transform_rows(_orders(spark, sf_dir))
    parts = F.coalesce(F.from_json(F.get_json_object("target", "$.m"), "array<struct<n:double>>"), F.array())
    return made.select(
        "o_orderkey",
        # the text of the value: get_json_object writes numbers from 10 million on with an exponent
        V.let(V.get(F.parse_json("target"), "$['v']"), lambda v: F.when(~F.is_variant_null(v), V.text(v))).alias("v"),
        F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["n"]).alias("items"),
        F.col("error").isNotNull().alias("failed"),
    )


_KIND = f"(o_orderkey % {len(PROGRAMS)})"
_ITEMS = "CASE {k} WHEN 13 THEN 10 * (o_orderkey % 3 + o_orderkey % 4 + o_orderkey % 5) WHEN 14 THEN {f} ELSE 0 END".format(
    k=_KIND, f=" + ".join(f"CASE WHEN o_orderkey % {n} >= 2 THEN o_orderkey % {n} ELSE 0 END" for n in (3, 4, 5))
)
_PROGRAMS_SQL = f"SELECT o_orderkey, CASE {_KIND} {' '.join(f'WHEN {k} THEN {v}' for k, (_, v) in enumerate(PROGRAMS))} END AS v, ({_ITEMS})::DOUBLE AS items, {_KIND} = {len(PROGRAMS) - 1} AS failed FROM orders"

# -- schema checks ---------------------------------------------------------

SCHEMA = {
    "type": "object",
    "properties": {
        "k": {"type": "integer"},
        "tags": {"type": "array", "items": {"type": ["null", "string"]}},
        "in": {"type": "object", "properties": {"x": {"type": "number"}}, "required": ["x"], "additionalProperties": {"type": "boolean"}},
    },
    "required": ["k"],
    "additionalProperties": False,
}
#: Of an event's id modulo 12: what takes the place of ``props``, written with its
#: value of k, and the first breach.
PLANTED: list[tuple[str, str | None]] = [
    ('{"k": @}', None),
    ('{"k": @.5}', "k: number is not of type integer"),
    ('{"k": @.0, "tags": ["a", null]}', None),
    ('{"tags": []}', "$: k is required"),
    ('{"k": @, "more": 1}', "$: more is not allowed"),
    ('{"k": @, "tags": ["a", @]}', "tags.1: integer is not of type null, string"),
    ('{"k": @, "in": {"x": 1, "y": true}}', None),
    ('{"k": @, "in": {"y": true}}', "in: x is required"),
    ('{"k": @, "in": {"x": "1", "y": 2}}', "in.x: string is not of type number"),
    ('{"k": null, "in": {"x": 1, "y": 2}}', "in.y: integer is not of type boolean"),
    ("[@]", "$: array is not of type object"),
    ("{broken", None),
]


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    text = F.element_at(F.array(*(F.lit(t) for t, _ in PLANTED)), (F.pmod("event_id", F.lit(len(PLANTED))) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.try_parse_json(F.replace(text, F.lit("@"), k)).alias("v"))


def json_schema_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted(spark, sf_dir).select("event_id", F.col("v").isNotNull().alias("is_json"), conform.first_breach(F.col("v"), SCHEMA).alias("breach"))


_CASE = " ".join(f"WHEN {k} THEN '{b}'" for k, (_, b) in enumerate(PLANTED) if b)
_BREACH_SQL = f"SELECT event_id, event_id % {len(PLANTED)} <> {len(PLANTED) - 1} AS is_json, CASE event_id % {len(PLANTED)} {_CASE} END AS breach FROM events"

# -- leaves and comparison -------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``props`` in a wider record, and the same with changes by the event's id."""
    k, n = F.get_json_object("props", "$.k"), F.pmod("event_id", F.lit(5))

    def record(k: Column, tail: str, deep: Column) -> Column:
        return F.concat(F.lit('{"a": {"k": '), k, F.lit(', "t": [1, {"z": '), deep, F.lit("}]}, \"b.c\": true, "), F.lit(tail))

    wanted = record(k, '"e": {}}', F.lit("null"))
    changed = (
        F.when(n == 0, record(F.concat(k, F.lit(".0")), '"e": {}}', F.lit("null")))
        .when(n == 1, record(k, '"e": []}', F.lit('"x"')))
        .when(n == 2, record(F.concat(F.lit('"'), k, F.lit('"')), '"e": {}}', F.lit("null")))
        .when(n == 3, record(k, '"e": {"more": [2, 3]}}', F.lit("null")))
        .otherwise(F.lit("{}"))
    )
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.try_parse_json(changed).alias("found"), F.try_parse_json(wanted).alias("wanted"))


def json_field_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compare.json_f1_table(_pairs(spark, sf_dir), ["event_id"], "found", "wanted")
    return made.withColumn("field_f1", F.round("field_f1", 9))


_AGREE = "(CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END)"
_FOUND = "(CASE event_id % 5 WHEN 3 THEN 6 WHEN 4 THEN 0 ELSE 4 END)"
_F1_SQL = f"SELECT event_id, event_id % 5 = 0 AS same, {_AGREE}::BIGINT AS n_agree, {_FOUND}::BIGINT AS n_found, 4::BIGINT AS n_wanted, round(CASE WHEN {_AGREE} = 0 THEN 0.0 ELSE 2.0 * {_AGREE} / ({_FOUND} + 4) END, 9)::DOUBLE AS field_f1 FROM events"


def json_leaf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.json_leaf_table(_pairs(spark, sf_dir), ["event_id"], "found")


_LEAVES_SQL = """
WITH e AS (SELECT event_id, event_id % 5 AS n, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 5 < 4)
SELECT event_id, 'a.k' AS path, CASE n WHEN 0 THEN 'number' WHEN 2 THEN 'string' ELSE 'integer' END AS kind, CASE n WHEN 0 THEN k || '.0' ELSE k END AS value FROM e
UNION ALL SELECT event_id, 'a.t[0]', 'integer', '1' FROM e
UNION ALL SELECT event_id, 'a.t[1].z', CASE n WHEN 1 THEN 'string' ELSE 'null' END, CASE n WHEN 1 THEN 'x' END FROM e
UNION ALL SELECT event_id, 'b.c', 'boolean', 'True' FROM e
UNION ALL SELECT event_id, 'e.more[' || i || ']', 'integer', (i + 2)::VARCHAR FROM e, generate_series(0, 1) g(i) WHERE n = 3
"""

QUERIES = {
    "programs_in_column": programs_in_column,
    "json_schema_breaches": json_schema_breaches,
    "json_field_f1": json_field_f1,
    "json_leaf_rows": json_leaf_rows,
}
ORACLE_SQL = {
    "programs_in_column": _PROGRAMS_SQL,
    "json_schema_breaches": _BREACH_SQL,
    "json_field_f1": _F1_SQL,
    "json_leaf_rows": _LEAVES_SQL,
}
