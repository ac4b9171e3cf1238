"""Registered queries over the test tables, each with its SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import json_queries, scored_queries, stored_queries, table_queries
from .operators import compare, dataset, dynamic, metrics, report
from .operators.patterns import PATTERNS
from .operators.transform import transform
from .plans.schema import conforms
from .sources.stage import spread, stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _program(name: str, table: str, steps: list[dict], sql: str, fields: dict[str, str] | None = None, before: Callable[[DataFrame], DataFrame] | None = None, **options) -> None:
    """A query that runs one program over one table.  fields: flat names for
    what lies deeper in the target; before: what makes the source of the table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = _table(spark, sf_dir, table)
        made = transform(before(source) if before else source, {"steps": steps}, **options)
        return made.select(*(F.expr(path).alias(flat) for flat, path in fields.items())) if fields else made

    _add(name, query, sql)


def _s(op: str, to: str, source: str | None = None, **rest) -> dict:
    return {"op": op, "to": to, **({} if source is None else {"from": source}), **rest}


def _if(to: str, path: str, operator: str, value, yes: dict, no: dict) -> dict:
    return _s("conditional", to, condition={"path": path, "operator": operator, "value": value}, then=yes, otherwise=no)


# -- scalar operators ------------------------------------------------------

_program(
    "flagship",
    "orders",
    [
        _s("copy", "identifier", "o_orderkey"),
        _s("map_enum", "active", "o_orderstatus", mapping={"F": True, "O": False}, default=False),
        _s("scale", "amount", "o_totalprice", factor=100.0),
    ],
    "SELECT o_orderkey AS identifier, o_orderstatus = 'F' AS active, o_totalprice * 100.0::DOUBLE + 0.0::DOUBLE AS amount FROM orders",
)
_program("op_copy", "customer", [_s("copy", "id", "c_custkey"), _s("copy", "name", "c_name")], "SELECT c_custkey AS id, c_name AS name FROM customer")
_program("op_constant", "customer", [_s("copy", "id", "c_custkey"), _s("constant", "kind", value="customer"), _s("constant", "weight", value=1.5)], "SELECT c_custkey AS id, 'customer' AS kind, 1.5::DOUBLE AS weight FROM customer")
_program("op_cast_integer", "orders", [_s("copy", "id", "o_orderkey"), _s("cast", "whole", "o_totalprice", target_type="integer")], "SELECT o_orderkey AS id, trunc(o_totalprice)::BIGINT AS whole FROM orders")
_program("op_cast_number", "documents", [_s("copy", "id", "doc_id"), _s("cast", "size", "n_chars", target_type="number")], "SELECT doc_id AS id, n_chars::DOUBLE AS size FROM documents")
_program("op_cast_string", "part", [_s("copy", "id", "p_partkey"), _s("cast", "size", "p_size", target_type="string")], "SELECT p_partkey AS id, p_size::VARCHAR AS size FROM part")
_program("op_cast_string_double", "events", [_s("copy", "id", "event_id"), _s("cast", "shown", "value", target_type="string")], "SELECT event_id AS id, value::VARCHAR AS shown FROM events")
_program("op_cast_boolean", "labels", [_s("copy", "id", "doc_id"), _s("cast", "toxic", "toxic", target_type="boolean")], "SELECT doc_id AS id, toxic = 1 AS toxic FROM labels")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id", "left")


_LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
_add(
    "op_default",
    lambda spark, d: transform(_labelled(spark, d), {"steps": [_s("copy", "id", "doc_id"), _s("default", "quality", "quality", value=-1)]}),
    f"SELECT d.doc_id AS id, coalesce(l.quality, -1)::BIGINT AS quality FROM {_LABELLED}",
)
_add(
    "op_coalesce",
    lambda spark, d: transform(
        _labelled(spark, d).withColumn("toxic", F.when(F.col("toxic") == 1, F.col("toxic"))).withColumn("spare", F.lit(9)),
        {"steps": [_s("copy", "id", "doc_id"), _s("coalesce", "first", sources=["toxic", "quality", "spare"])]},
    ),
    f"SELECT d.doc_id AS id, coalesce(CASE WHEN l.toxic = 1 THEN 1 END, l.quality, 9)::INTEGER AS first FROM {_LABELLED}",
)
_program(
    "op_map_enum",
    "orders",
    [_s("copy", "id", "o_orderkey"), _s("map_enum", "status", "o_orderstatus", mapping={"F": "finished", "O": "open", "P": None}, default="other")],
    "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN NULL ELSE 'other' END AS status FROM orders",
)
_program(
    "op_scale",
    "lineitem",
    [_s("copy", "id", "l_orderkey"), _s("scale", "scaled", "l_extendedprice", factor=0.453592, offset=32)],
    "SELECT l_orderkey AS id, l_extendedprice * 0.453592::DOUBLE + 32.0::DOUBLE AS scaled FROM lineitem",
)
for _name, _out in (("slashes", "%d/%m/%Y"), ("compact", "%Y%m%d"), ("month_name", "%d-%b-%Y")):
    _program(
        f"op_format_date_{_name}",
        "orders",
        [_s("copy", "id", "o_orderkey"), _s("format_date", "day", "day", input_format="%Y-%m-%d", output_format=_out)],
        f"SELECT o_orderkey AS id, strftime(o_orderdate, '{_out}') AS day FROM orders",
        before=lambda df: df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")),
    )
_program("op_concat", "part", [_s("copy", "id", "p_partkey"), _s("concat", "label", sources=["p_brand", "p_type", "p_size"], separator="-")], "SELECT p_partkey AS id, p_brand || '-' || p_type || '-' || p_size::VARCHAR AS label FROM part")
for _name, _at, _sql in (("first", 0, "split_part(p_name, ' ', 1)"), ("second", 1, "split_part(p_name, ' ', 2)"), ("last", -1, "string_split(p_name, ' ')[-1]")):
    _program(
        f"op_split_{_name}",
        "part",
        [_s("copy", "id", "p_partkey"), _s("split", "word", "p_name", separator=" ", index=_at)],
        f"SELECT p_partkey AS id, CASE WHEN len(string_split(p_name, ' ')) > {max(_at, 0)} THEN {_sql} END AS word, "
        f"CASE WHEN len(string_split(p_name, ' ')) <= {max(_at, 0)} THEN 'p_name has no such item' END AS error "
        "FROM part".replace("SELECT p_partkey AS id", "SELECT p_partkey AS id"),
        on_error="report",
        before=lambda df: df.select("p_partkey", "p_name"),
    )
    ORACLE_SQL[f"op_split_{_name}"] = (
        f"SELECT CASE WHEN ok THEN id END AS id, CASE WHEN ok THEN word END AS word, CASE WHEN NOT ok THEN 'p_name has no such item' END AS error "
        f"FROM (SELECT p_partkey AS id, {_sql} AS word, len(string_split(p_name, ' ')) > {max(_at, 0)} AS ok FROM part)"
    )
_program(
    "op_nest",
    "customer",
    [_s("nest", "subject", fields={"identifier": "c_custkey", "location.nation": "c_nationkey"}), _s("copy", "subject.location.segment", "c_mktsegment")],
    "SELECT c_custkey AS identifier, c_nationkey AS nation, c_mktsegment AS segment FROM customer",
    {"identifier": "subject.identifier", "nation": "subject.location.nation", "segment": "subject.location.segment"},
)
_program(
    "op_flatten",
    "customer",
    [_s("copy", "flat.id", "c_custkey"), _s("flatten", "flat", "details")],
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer",
    {"id": "flat.id", "name": "flat.name", "balance": "flat.balance"},
    before=lambda df: df.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("details")),
)

# -- conditions ------------------------------------------------------------

_HIGH, _LOW = {"value": "high"}, {"value": "low"}
for _op, _value, _test in (
    ("gt", 25, "l_quantity > 25"),
    ("ge", 25, "l_quantity >= 25"),
    ("lt", 25, "l_quantity < 25"),
    ("le", 25, "l_quantity <= 25"),
    ("eq", 25, "l_quantity = 25"),
    ("in", [1, 2.0, "3", None], "l_quantity IN (1, 2)"),
    ("exists", None, "true"),
):
    _program(
        f"op_conditional_{_op}",
        "lineitem",
        [_s("copy", "id", "l_orderkey"), _if("band", "l_quantity", _op, _value, _HIGH, _LOW)],
        f"SELECT l_orderkey AS id, CASE WHEN {_test} THEN 'high' ELSE 'low' END AS band FROM lineitem",
    )
_program(
    "op_conditional_contains",
    "events",
    [_s("copy", "id", "event_id"), _if("kind", "event_type", "contains", "i", {"from": "event_type"}, {"value": "none"})],
    "SELECT event_id AS id, CASE WHEN contains(event_type, 'i') THEN event_type ELSE 'none' END AS kind FROM events",
)
_program(
    "op_conditional_in_text",
    "events",
    [_s("copy", "id", "event_id"), _if("kind", "event_type", "in", "click and view", {"value": True}, {"value": False})],
    "SELECT event_id AS id, contains('click and view', event_type) AS kind FROM events",
)
_add(
    "op_conditional_ne",
    lambda spark, d: transform(_labelled(spark, d), {"steps": [_s("copy", "id", "doc_id"), _if("other", "quality", "ne", 1, {"value": True}, {"value": False})]}),
    f"SELECT d.doc_id AS id, l.quality IS DISTINCT FROM 1 AS other FROM {_LABELLED}",
)

# -- arrays ----------------------------------------------------------------


def _with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array, in a fixed order."""
    line = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag")))).alias("items")
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "items")


_ITEMS = "orders JOIN lineitem ON o_orderkey = l_orderkey"


def _array_query(name: str, steps: list[dict], fields: dict[str, str], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = transform(_with_items(spark, sf_dir), {"steps": [_s("copy", "id", "o_orderkey"), *steps]})
        return made.select("id", F.explode("made").alias("x")).select("id", *(F.expr(f"x.{p}").alias(n) for n, p in fields.items()))

    _add(name, query, sql)


_array_query(
    "op_map_array",
    [
        _s(
            "map_array",
            "made",
            "items",
            steps=[
                _s("copy", "line", "line"),
                _s("scale", "price.cents", "price", factor=100),
                _s("map_enum", "returned", "flag", mapping={"R": True}, default=False),
                _if("size", "quantity", "lt", 10, {"value": "small"}, {"value": "large"}),
            ],
        )
    ],
    {"line": "line", "cents": "price.cents", "returned": "returned", "size": "size"},
    f"SELECT o_orderkey AS id, l_linenumber AS line, l_extendedprice * 100.0::DOUBLE + 0.0::DOUBLE AS cents, l_returnflag = 'R' AS returned, CASE WHEN l_quantity < 10 THEN 'small' ELSE 'large' END AS size FROM {_ITEMS}",
)
for _op, _path, _value, _test in (
    ("gt", "quantity", 25, "l_quantity > 25"),
    ("ge", "quantity", 25, "l_quantity >= 25"),
    ("lt", "quantity", 25, "l_quantity < 25"),
    ("le", "quantity", 25, "l_quantity <= 25"),
    ("eq", "flag", "R", "l_returnflag = 'R'"),
    ("ne", "flag", "R", "l_returnflag IS DISTINCT FROM 'R'"),
    ("in", "flag", ["R", "A"], "l_returnflag IN ('R', 'A')"),
    ("contains", "flag", "N", "contains(l_returnflag, 'N')"),
    ("exists", "flag", None, "true"),
):
    _array_query(
        f"op_filter_array_{_op}",
        [_s("filter_array", "made", "items", condition={"path": _path, "operator": _op, "value": _value})],
        {"line": "line", "quantity": "quantity"},
        f"SELECT o_orderkey AS id, l_linenumber AS line, l_quantity AS quantity FROM {_ITEMS} WHERE {_test}",
    )

# -- patterns: the 19 programs with fixed parameters, on table columns -----

_PARAMETERS = {
    "copy_constant": {"kind": "person"}, "cast_default": {"default": "unknown"}, "scale_date": {"factor": 2.54}, "concat_split": {"separator": "-"},
    "conditional_copy": {"threshold": 18}, "map_array": {"factor": 2.0}, "filter_array": {"threshold": 5}, "copy_enum_scale": {"factor": 1.5},
    "default_concat_conditional": {"fallback": "NA"}, "comp_copy_scale_conditional": {"factor": 2.5, "threshold": 10}, "comp_date_split_constant_copy": {"kind": "A"},
    "comp_map_mixed": {"factor": 4.0}, "comp_filter_copy_constant": {"threshold": 3}, "struct_long_nested": {"factor": 3.0, "threshold": 20}, "struct_array_rich": {"factor": 10.0},
}


def _pattern(name: str, source: Callable[[SparkSession, str], DataFrame], fields: dict[str, str], sql: str, explode: str | None = None) -> None:
    from .operators.patterns import filled

    steps = filled(PATTERNS[name].steps, _PARAMETERS.get(name, {}))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = transform(source(spark, sf_dir), {"steps": steps})
        if explode:
            made = made.withColumn("x", F.explode(F.expr(explode)))
        return made.select(*(F.expr(p).alias(n) for n, p in fields.items()))

    _add(f"pattern_{name}", query, sql)


def _from(table: str, **columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _table(spark, d, table).select(*(F.expr(e).alias(n) for n, e in columns.items()))


def _items(**fields: str) -> Callable[[SparkSession, str], DataFrame]:
    struct = ", ".join(f"'{n}', {e}" for n, e in fields.items())
    return lambda spark, d: _with_items(spark, d).selectExpr("concat('i', o_orderkey) AS identifier", "concat('i', o_orderkey) AS batch_id", f"transform(items, x -> named_struct({struct})) AS items")


_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"
_pattern("copy_constant", _from("customer", patient_id="c_name", unused_id="c_mktsegment"), {"subject_id": "subject_id", "kind": "kind"}, "SELECT c_name AS subject_id, 'person' AS kind FROM customer")
_pattern("cast_default", _from("part", age_text="cast(p_size AS string)", nickname="nullif(p_brand, 'Brand#11')"), {"age": "age", "display_name": "display_name"}, "SELECT p_size::BIGINT AS age, coalesce(nullif(p_brand, 'Brand#11'), 'unknown') AS display_name FROM part")
_pattern(
    "coalesce_enum",
    _from("orders", primary_code="nullif(o_orderstatus, 'F')", secondary_code="o_orderpriority", sex="if(o_orderstatus = 'P', 'M', o_orderstatus)"),
    {"code": "code", "gender": "gender"},
    "SELECT coalesce(nullif(o_orderstatus, 'F'), o_orderpriority) AS code, CASE o_orderstatus WHEN 'P' THEN 'male' WHEN 'F' THEN 'female' ELSE 'unknown' END AS gender FROM orders",
)
_pattern("scale_date", _from("orders", measurement="o_totalprice", date=_DAY), {"scaled": "scaled", "formatted_date": "formatted_date"}, "SELECT o_totalprice * 2.54::DOUBLE + 0.0::DOUBLE AS scaled, strftime(o_orderdate, '%d/%m/%Y') AS formatted_date FROM orders")
_pattern("concat_split", _from("orders", first="o_orderstatus", last="o_orderpriority", compound="concat(o_orderstatus, ':', o_custkey)"), {"full": "full", "suffix": "suffix"}, "SELECT o_orderstatus || '-' || o_orderpriority AS full, o_custkey::VARCHAR AS suffix FROM orders")
_pattern(
    "nest_flatten",
    _from("customer", identifier="c_name", details="named_struct('city', c_mktsegment, 'zip', cast(c_nationkey AS string))"),
    {"identifier": "subject.identifier", "city": "subject.location.city", "address_city": "address.city", "address_zip": "address.zip"},
    "SELECT c_name AS identifier, c_mktsegment AS city, c_mktsegment AS address_city, c_nationkey::VARCHAR AS address_zip FROM customer",
)
_pattern("conditional_copy", _from("part", identifier="p_name", score="p_size"), {"identifier": "identifier", "band": "band"}, "SELECT p_name AS identifier, CASE WHEN p_size >= 18 THEN 'high' ELSE 'low' END AS band FROM part")
_pattern(
    "map_array",
    lambda spark, d: _with_items(spark, d).selectExpr("transform(items, x -> named_struct('value', x.price, 'unit', x.flag)) AS measurements"),
    {"value": "x.value", "unit": "x.unit"},
    f"SELECT l_extendedprice * 2.0::DOUBLE + 0.0::DOUBLE AS value, l_returnflag AS unit FROM {_ITEMS}",
    "normalized",
)
_pattern("filter_array", _items(value="cast(x.quantity AS long)", name="x.flag"), {"value": "x.value", "name": "x.name"}, f"SELECT l_quantity::BIGINT AS value, l_returnflag AS name FROM {_ITEMS} WHERE l_quantity::BIGINT > 5", "kept")
_pattern(
    "copy_enum_scale",
    _from("orders", identifier="cast(o_orderkey AS string)", status="if(o_orderstatus = 'F', 'Y', 'N')", amount="o_totalprice"),
    {"identifier": "identifier", "active": "active", "amount": "amount"},
    "SELECT o_orderkey::VARCHAR AS identifier, o_orderstatus = 'F' AS active, o_totalprice * 1.5::DOUBLE + 0.0::DOUBLE AS amount FROM orders",
)
_pattern(
    "default_concat_conditional",
    _from("orders", middle="nullif(o_orderstatus, 'O')", first="o_orderpriority", last="o_orderstatus", enabled="o_totalprice > 100000"),
    {"middle": "middle", "label": "label", "state": "state"},
    "SELECT coalesce(nullif(o_orderstatus, 'O'), 'NA') AS middle, o_orderpriority || ', ' || o_orderstatus AS label, CASE WHEN o_totalprice > 100000 THEN 'enabled' ELSE 'disabled' END AS state FROM orders",
)
_pattern(
    "comp_copy_scale_conditional",
    _from("customer", identifier="c_name", amount="c_acctbal"),
    {"identifier": "identifier", "scaled_amount": "scaled_amount", "class": "class"},
    "SELECT c_name AS identifier, c_acctbal * 2.5::DOUBLE + 0.0::DOUBLE AS scaled_amount, CASE WHEN c_acctbal > 10 THEN 'positive' ELSE 'non_positive' END AS class FROM customer",
)
_pattern(
    "comp_coalesce_concat_nest",
    _from("part", preferred="nullif(p_brand, 'Brand#11')", fallback="p_type", prefix="p_brand", code="cast(p_size AS string)", source="p_name"),
    {"name": "name", "label": "label", "source": "meta.source", "code": "meta.code"},
    "SELECT coalesce(nullif(p_brand, 'Brand#11'), p_type) AS name, p_brand || '-' || p_size::VARCHAR AS label, p_name AS source, p_size::VARCHAR AS code FROM part",
)
_pattern(
    "comp_date_split_constant_copy",
    _from("orders", date=_DAY, code="concat(o_orderstatus, '-', o_custkey)", value="o_totalprice"),
    {"date": "date", "prefix": "prefix", "kind": "kind", "value": "value"},
    "SELECT strftime(o_orderdate, '%Y%m%d') AS date, o_orderstatus AS prefix, 'A' AS kind, o_totalprice AS value FROM orders",
)
_pattern(
    "comp_map_mixed",
    _items(name="x.flag", status="if(x.flag = 'R', 'on', 'off')", value="x.quantity"),
    {"label": "x.label", "active": "x.active", "scaled": "x.scaled"},
    f"SELECT l_returnflag AS label, l_returnflag = 'R' AS active, l_quantity * 4.0::DOUBLE + 0.0::DOUBLE AS scaled FROM {_ITEMS}",
    "items",
)
_pattern(
    "comp_filter_copy_constant",
    _items(value="cast(x.line AS long)", name="x.flag"),
    {"identifier": "identifier", "filtered": "filtered", "value": "x.value", "name": "x.name"},
    f"SELECT 'i' || o_orderkey::VARCHAR AS identifier, true AS filtered, l_linenumber::BIGINT AS value, l_returnflag AS name FROM {_ITEMS} WHERE l_linenumber >= 3",
    "selected",
)
_pattern(
    "struct_long_nested",
    _from("orders", identifier="cast(o_orderkey AS string)", status="if(o_orderstatus = 'F', 'Y', 'X')", amount="o_totalprice", date=_DAY),
    {n: f"record.{n}" for n in ("identifier", "active", "scaled", "date", "tier")},
    "SELECT o_orderkey::VARCHAR AS identifier, o_orderstatus = 'F' AS active, o_totalprice * 3.0::DOUBLE + 0.0::DOUBLE AS scaled, strftime(o_orderdate, '%d-%b-%Y') AS date, CASE WHEN o_totalprice >= 20 THEN 'upper' ELSE 'lower' END AS tier FROM orders",
)
_pattern(
    "struct_deep_nest",
    _from("customer", identifier="cast(c_custkey AS string)", city="c_mktsegment", postal="cast(c_nationkey AS string)", first="c_name", last="c_mktsegment", category="c_mktsegment"),
    {"value": "envelope.identity.primary.value", "city": "envelope.location.address.city", "postal": "envelope.location.address.postal", "full": "envelope.display.full", "category": "envelope.classification.category"},
    "SELECT c_custkey::VARCHAR AS value, c_mktsegment AS city, c_nationkey::VARCHAR AS postal, c_name || ' ' || c_mktsegment AS full, c_mktsegment AS category FROM customer",
)
_pattern(
    "struct_array_rich",
    _items(name="x.flag", value="x.price - 30000", status="if(x.flag = 'R', 'bad', 'ok')"),
    {"batch": "payload.batch.identifier", "name": "x.identity.name", "value": "x.measurement.value", "sign": "x.measurement.sign", "active": "x.state.active"},
    f"SELECT 'i' || o_orderkey::VARCHAR AS batch, l_returnflag AS name, (l_extendedprice - 30000) * 10.0::DOUBLE + 0.0::DOUBLE AS value, CASE WHEN l_extendedprice - 30000 < 0 THEN 'negative' ELSE 'non_negative' END AS sign, l_returnflag <> 'R' AS active FROM {_ITEMS}",
    "payload.rows",
)

# -- comparison and checks -------------------------------------------------


def _perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts beside copies in which some fields are changed, some within tolerance."""
    part = _table(spark, sf_dir, "part")
    gold = F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("detail"))
    near = F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice") * (1 + 1e-8)).when(F.col("p_size") % 3 == 1, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    made = F.struct(F.when(F.col("p_size") % 5 == 0, F.lit("?")).otherwise(F.col("p_name")).alias("name"), F.struct(F.col("p_size").cast("double").alias("size"), near.alias("price")).alias("detail"))
    return part.select("p_partkey", made.alias("made"), gold.alias("gold"))


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _perturbed(spark, sf_dir)
    return df.select(F.col("p_partkey").alias("id"), compare.equal_columns(F.col("made"), df.schema["made"].dataType, F.col("gold"), df.schema["gold"].dataType).alias("same"))


_add("compare_canonical", _canonical, "SELECT p_partkey AS id, p_size % 5 <> 0 AND p_size % 3 <> 1 AS same FROM part")
_add(
    "compare_leaves",
    lambda spark, d: compare.leaf_table(_perturbed(spark, d), ["p_partkey"], "gold").select(F.col("p_partkey").alias("id"), "path", "number", "text", "kind"),
    "SELECT p_partkey AS id, 'name' AS path, NULL::DOUBLE AS number, p_name AS text, 'string' AS kind FROM part "
    "UNION ALL SELECT p_partkey, 'detail.size', p_size::DOUBLE, NULL, 'number' FROM part UNION ALL SELECT p_partkey, 'detail.price', p_retailprice, NULL, 'number' FROM part",
)
_add(
    "compare_field_f1",
    lambda spark, d: compare.field_f1_table(_perturbed(spark, d), ["p_partkey"], "made", "gold").select(F.col("p_partkey").alias("id"), "n_agree", F.round("field_f1", 9).alias("field_f1")),
    "SELECT id, n AS n_agree, round(2 * (n / 3.0) * (n / 3.0) / (n / 3.0 + n / 3.0), 9)::DOUBLE AS field_f1 FROM (SELECT p_partkey AS id, (1 + (p_size % 5 <> 0)::INT + (p_size % 3 <> 1)::INT)::BIGINT AS n FROM part)",
)


def _schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").withColumn("p_retailprice", F.floor(F.col("p_retailprice") * 10) / 10).withColumn("p_brand", F.expr("nullif(p_brand, 'Brand#11')"))
    schema = {
        "type": "object",
        "properties": {"p_brand": {"type": "string"}, "p_retailprice": {"type": "integer"}, "p_size": {"type": "number"}},
        "required": ["p_brand"],
    }
    row = F.struct(*part.columns)
    return part.agg(F.count_if(conforms(row, part.schema, schema)).alias("n_good"), F.count_if(~conforms(row, part.schema, schema)).alias("n_bad"))


_GOOD = "p_brand <> 'Brand#11' AND floor(p_retailprice * 10) / 10 = floor(floor(p_retailprice * 10) / 10)"
_add("schema_check", _schema_check, f"SELECT count(*) FILTER (WHERE {_GOOD})::BIGINT AS n_good, count(*) FILTER (WHERE NOT ({_GOOD}))::BIGINT AS n_bad FROM part")

# -- metrics and reports ---------------------------------------------------


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    good, edge = F.col("value") > 50, F.col("user_id") % 3 == 0
    return events.groupBy("event_type").agg(
        metrics.share(good).alias("exact_rate"), metrics.ratio(F.count_if(edge & good), F.count_if(edge)).alias("edge_rate"), metrics.ratio(F.sum(good.cast("long")), F.sum(F.lit(0))).alias("empty_rate")
    )


_add(
    "metric_rates",
    _rates,
    "SELECT event_type, avg((value > 50)::INT)::DOUBLE AS exact_rate, count(*) FILTER (WHERE user_id % 3 = 0 AND value > 50) / count(*) FILTER (WHERE user_id % 3 = 0) AS edge_rate, 0.0::DOUBLE AS empty_rate FROM events GROUP BY event_type",
)
_add(
    "metric_percentile",
    lambda spark, d: metrics.percentile_table(_table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}),
    "SELECT event_type, list_sort(list(value))[round_even((count(*) - 1) * 0.5, 0)::INT + 1] AS p50, list_sort(list(value))[round_even((count(*) - 1) * 0.95, 0)::INT + 1] AS p95 FROM events GROUP BY event_type",
)
_add(
    "metric_micro_f1",
    lambda spark, d: _table(spark, d, "events").groupBy("event_type").agg(F.round(metrics.micro_f1(F.count_if(F.col("value") > 50), F.count_if(F.col("value") > 20), F.count(F.lit(1))), 9).alias("micro_f1")),
    "SELECT event_type, round(2 * p * r / (p + r), 9)::DOUBLE AS micro_f1 FROM (SELECT event_type, count(*) FILTER (WHERE value > 50) / count(*) FILTER (WHERE value > 20) AS p, count(*) FILTER (WHERE value > 50) / count(*) AS r FROM events GROUP BY event_type)",
)


def _run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics table: runs are users modulo 3, splits are event types."""
    return _table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("run"), F.col("event_type").alias("split")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg((F.col("value") > 50).cast("double")).alias("exact")
    )


_RUNS = "(SELECT user_id % 3 AS run, event_type AS split, count(*) AS samples, avg((value > 50)::INT) AS exact FROM events GROUP BY 1, 2)"
_add(
    "metric_weighted",
    lambda spark, d: report.weighted_means(_run_metrics(spark, d), ["run"], ["exact"]).withColumn("exact", F.round("exact", 9)),
    f"SELECT run, round(sum(exact * samples) / sum(samples), 9)::DOUBLE AS exact FROM {_RUNS} GROUP BY run",
)


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["click", "purchase", "view"]
    made = report.pivoted(_run_metrics(spark, sf_dir), "run", "split", names, "exact")
    return made.select("run", *(F.round(n, 9).alias(n) for n in names))


_add(
    "pivot_exact",
    _pivot,
    "SELECT run, " + ", ".join(f"round(max(exact) FILTER (WHERE split = '{n}'), 9)::DOUBLE AS {n}" for n in ("click", "purchase", "view")) + f" FROM {_RUNS} GROUP BY run",
)


def _failed() -> Column:
    value = F.col("value")
    return F.when(value < 20, F.lit("runtime_error")).when(value < 40, F.lit("partial_value_mismatch")).when(value < 45, F.lit("json_parse_error"))


_FAILED_SQL = "CASE WHEN value < 20 THEN 'runtime_error' WHEN value < 40 THEN 'partial_value_mismatch' WHEN value < 45 THEN 'json_parse_error' END"
_add(
    "failure_histogram",
    lambda spark, d: metrics.failure_histogram(
        _table(spark, d, "events").withColumn("failure_type", metrics.final_failure(_failed(), F.when(F.col("user_id") % 7 == 0, F.lit("length")), F.col("value") > 50)), ["event_type"]
    ),
    f"SELECT event_type, failure_type, count(*)::BIGINT AS count FROM (SELECT event_type, CASE WHEN user_id % 7 = 0 AND NOT value > 50 THEN 'truncated_output' ELSE {_FAILED_SQL} END AS failure_type FROM events) WHERE failure_type IS NOT NULL GROUP BY 1, 2",
)
_add(
    "failure_report",
    lambda spark, d: report.failure_report(
        metrics.failure_histogram(_table(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("run"), F.col("event_type").alias("split"), _failed().alias("failure_type")), ["run", "split"]),
        _run_metrics(spark, d).withColumn("run", F.col("run").cast("string")),
        ["0", "1", "2"],
        ["click", "purchase", "view"],
    ).withColumn("rate", F.round("rate", 9)),
    f"SELECT f.*, r.samples::BIGINT AS samples, round(f.count / r.samples, 9)::DOUBLE AS rate FROM (SELECT (user_id % 3)::VARCHAR AS run, event_type AS split, {_FAILED_SQL} AS failure_type, count(*)::BIGINT AS count FROM events GROUP BY 1, 2, 3) f "
    f"JOIN {_RUNS} r ON f.run = r.run::VARCHAR AND f.split = r.split WHERE f.failure_type IS NOT NULL",
)
_add(
    "top4",
    lambda spark, d: report.top_per_group(_table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_seen")), ["l_returnflag"], 4, F.desc("n"), F.col("first_seen"), F.col("l_suppkey"))
    .select("l_returnflag", "l_suppkey", "n"),
    "SELECT l_returnflag, l_suppkey, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, first_seen, l_suppkey) AS k FROM (SELECT l_returnflag, l_suppkey, count(*) AS n, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1, 2)) WHERE k <= 4",
)
_add(
    "first_match",
    lambda spark, d: report.first_match(_table(spark, d, "events"), ["event_type"], F.col("value") > 90, "event_id", ["user_id", "value"]),
    "SELECT event_type, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id, arg_min(value, event_id) AS value FROM events WHERE value > 90 GROUP BY event_type",
)
_add(
    "excerpt",
    lambda spark, d: _table(spark, d, "documents").select("doc_id", report.excerpt(F.col("text")).alias("short")),
    "SELECT doc_id, CASE WHEN length(t) > 500 THEN substring(t, 1, 497) || '...' ELSE t END AS short FROM (SELECT doc_id, replace(text, chr(10), '\\n') AS t FROM documents)",
)
_add(
    "number_formats",
    lambda spark, d: _table(spark, d, "part").select("p_partkey", report.fixed(F.col("p_size") / 8, 3).alias("exact"), report.grouped(F.col("p_partkey") * 1234567).alias("whole")),
    "SELECT p_partkey, printf('%.3f', p_size / 8) AS exact, format('{:,}', p_partkey * 1234567) AS whole FROM part",
)

# -- dataset pipeline ------------------------------------------------------

_add(
    "shard_stride",
    lambda spark, d: dataset.shard(_table(spark, d, "orders").select("o_orderkey"), 1, 4, "o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1",
)
_PATTERN_SQL = """SELECT i AS global_index, CASE WHEN i < 15000 THEN 'base' WHEN i < 16000 THEN 'linguistic' WHEN i < 18500 THEN 'compositional' ELSE 'structural' END AS partition,
 CASE WHEN i < 16000 THEN ({base})[i % 11 + 1] WHEN i < 18500 THEN ({comp})[i % 5 + 1] ELSE ({struct})[i % 3 + 1] END AS graph_signature FROM generate_series(0, 19999) t(i)""".format(
    base=[n for n in PATTERNS][:11], comp=[n for n in PATTERNS][11:16], struct=[n for n in PATTERNS][16:]
)
_add("pattern_index", lambda spark, d: dataset.index_table(spark).select("global_index", "partition", "graph_signature"), _PATTERN_SQL)
_add(
    "pattern_quality",
    lambda spark, d: dataset.quality(dataset.index_table(spark)).where("measure in ('partition', 'pattern')"),
    f"WITH t AS ({_PATTERN_SQL}) SELECT 'partition' AS measure, partition AS value, count(*)::BIGINT AS count FROM t GROUP BY 2 UNION ALL SELECT 'pattern', graph_signature, count(*)::BIGINT FROM t GROUP BY 2",
)
_SPLIT_SQL = " UNION ALL ".join(f"SELECT '{n}' AS split, graph_signature FROM p WHERE partition = '{s[0]}' AND place >= {s[1]} AND place < {s[1] + s[2]}" for n, s in dataset.SPLITS.items())
_add(
    "split_slices",
    lambda spark, d: dataset.all_splits(dataset.index_table(spark)).groupBy("split", "graph_signature").agg(F.count(F.lit(1)).alias("count")),
    f"WITH t AS ({_PATTERN_SQL}), p AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY global_index) - 1 AS place FROM t) SELECT split, graph_signature, count(*)::BIGINT AS count FROM ({_SPLIT_SQL}) GROUP BY 1, 2",
)
_add(
    "leakage_overlap",
    lambda spark, d: dataset.overlap(_table(spark, d, "orders").select(F.col("o_custkey").alias("k")), _table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k"),
    "SELECT count(*)::BIGINT AS overlap FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)",
)
_add(
    "key_equality",
    lambda spark, d: dataset.key_differences(_table(spark, d, "documents"), _table(spark, d, "labels"), "doc_id"),
    "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN 'a' ELSE 'b' END AS only_in FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
)


def _prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("place"))
    return dataset.prefix_differences(docs.where("place < 100").withColumn("doc_id", F.when(F.col("place") % 10 == 3, -F.col("doc_id")).otherwise(F.col("doc_id"))), docs, "doc_id", "place")


_add("prefix_subset", _prefix, "SELECT -doc_id AS doc_id, doc_id AS place, doc_id AS other FROM documents WHERE doc_id < 100 AND doc_id % 10 = 3")
_add(
    "fingerprint",
    lambda spark, d: _table(spark, d, "part").select("p_partkey", F.sha2(F.to_json(F.struct("p_brand", "p_name", "p_size")), 256).alias("fingerprint")),
    """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}') AS fingerprint FROM part""",
)
_add(
    "index_check",
    lambda spark, d: dataset.index_check(_table(spark, d, "documents"), "doc_id"),
    "SELECT count(*)::BIGINT AS rows, count(DISTINCT doc_id)::BIGINT AS distinct, min(doc_id) AS least, max(doc_id) AS most, count(*) = count(DISTINCT doc_id) AND min(doc_id) = 0 AND max(doc_id) = count(DISTINCT doc_id) - 1 AS complete FROM documents",
)
_add("repeated_keys", lambda spark, d: dataset.repeated_keys(_table(spark, d, "conversations"), "conv_id"), "SELECT conv_id, count(*)::BIGINT AS count FROM conversations GROUP BY 1 HAVING count(*) > 1")
_add(
    "longest_row",
    lambda spark, d: dataset.longest(_table(spark, d, "documents"), "doc_id", F.length("text").cast("long"), F.col("doc_id")),
    "SELECT doc_id, length(text)::BIGINT AS length FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1",
)
_add("dataset_candidates", lambda spark, d: dataset.generate(spark).drop("difficulty"), None)
_add("dataset_faults", lambda spark, d: dataset.faults(dataset.generate(spark)), None)

# -- programs as data ------------------------------------------------------


def _per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two programs over the JSON in ``events.props``, by the kind of event."""
    one = json.dumps({"steps": [_s("copy", "k", "k"), _s("cast", "shown", "k", target_type="string")]})
    two = json.dumps({"steps": [_s("scale", "k", "k", factor=2), _s("constant", "shown", value="scaled")]})
    events = spread(_table(spark, sf_dir, "events").select("event_id", "event_type", "props")).select("event_id", F.when(F.col("event_type") == "click", F.lit(one)).otherwise(F.lit(two)).alias("program"), F.col("props").alias("record"))
    made = dynamic.transform_rows(events)
    return made.select("event_id", F.get_json_object("target", "$.k").cast("double").alias("k"), F.get_json_object("target", "$.shown").alias("shown"), "error")


_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"
_add(
    "dynamic_program_per_row",
    _per_row,
    f"SELECT event_id, CASE WHEN event_type = 'click' THEN {_K} ELSE {_K} * 2 END AS k, CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') ELSE 'scaled' END AS shown, NULL::VARCHAR AS error FROM events",
)
_add(
    "json_props",
    lambda spark, d: transform(
        _table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props")),
        {"steps": [_s("copy", "id", "event_id"), _s("copy", "k", "props.k"), _s("cast", "text", "props.k", target_type="string")]},
    ),
    "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS text FROM events",
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of differing quality for the rows of the ``grpo`` split."""
    from .operators.score import score_table

    # places come from arithmetic on indexes, so only the split is generated, once
    indexes = dataset.split(dataset.placed(dataset.index_table(spark)), "grpo").select("global_index")
    rows = stored(dataset.generate_at(indexes), "grpo")
    hidden = stored(dataset.hidden_cases(rows, "grpo"), "hidden")
    bad = F.when(F.col("global_index") % 6 == 1, F.lit("{")).when(F.col("global_index") % 6 == 2, F.lit('{"steps":[{"op":"python"}]}')).when(
        F.col("global_index") % 6 == 3, F.replace("reference_program", F.lit('"from": "s'), F.lit('"from": "t'))
    )
    scored = score_table(rows.join(hidden, "sample_id").withColumn("completion", F.coalesce(bad, "reference_program")))
    return scored.groupBy("failure_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("reward"), 6).alias("reward"))


_add("score_classes", _scored, None)

for _module in (scored_queries, json_queries, table_queries, stored_queries):
    for _name, _query in _module.QUERIES.items():
        _add(_name, _query, _module.ORACLE_SQL.get(_name))
_add(
    "dataset_columns",
    scored_queries.QUERIES["dataset_columns"],
    f"SELECT *, 's' || lpad(global_index::VARCHAR, 5, '0') || '_' AS path_prefix, 42000000 + global_index AS seed FROM ({_PATTERN_SQL})",
)
