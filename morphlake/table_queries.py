"""Queries of the dataset's checks over the given tables: places and slices,
overlaps, counts, faults and inferred schemas; each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_queries import PLANTED, _planted
from .operators import dataset, inference
from .scored_queries import COMPLETIONS, SOURCE, TARGET
from .sources.stage import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- places, slices --------------------------------------------------------

#: Slices of the orders of each status, in the order of their keys: first place, rows.
SLICES = {"head": (0, 500), "whole_head": (0, 3000), "next": (3000, 1000), "tail": (4000, 10**9)}


def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in total order of date and key, numbered from 0."""
    return dataset.numbered(_table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "place")


def order_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset.placed(_table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey")
    named = [F.when((F.col("place") >= a) & (F.col("place") < a + n), F.lit(name)) for name, (a, n) in SLICES.items()]
    return rows.select(F.explode(F.array_compact(F.array(*named))).alias("slice"), "o_orderstatus", "o_orderkey", "place")


_PLACED = "SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS place FROM orders"
_SLICES_SQL = " UNION ALL ".join(f"SELECT '{name}' AS slice, o_orderstatus, o_orderkey, place FROM ({_PLACED}) WHERE place >= {a} AND place < {a + n}" for name, (a, n) in SLICES.items())

# -- overlaps --------------------------------------------------------------


def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders split by the key: training, two tests, and the rest."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    split = F.element_at(F.array(*(F.lit(s) for s in ("train", "train", "test_a", "test_b", "rest"))), (F.pmod(F.floor(F.col("o_orderkey") / 7), F.lit(5)) + 1).cast("int"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("split", split)
    of = lambda *names: F.col("split").isin(*names)
    return dataset.overlaps(
        rows,
        {
            "order": (of("train"), of("test_a", "test_b"), F.col("o_orderkey")),
            "customer": (of("train"), of("test_a", "test_b"), F.col("o_custkey")),
            "part_and_supplier": (of("train"), of("test_a"), F.concat_ws("-", "l_partkey", "l_suppkey")),
            "day": (of("train"), of("test_b"), F.col("o_orderdate")),
        },
    )


def _overlap_sql(name: str, value: str, tests: str) -> str:
    return f"SELECT '{name}' AS \"check\", count(*)::BIGINT AS overlap FROM (SELECT {value} AS v FROM s WHERE split = 'train' INTERSECT SELECT {value} FROM s WHERE split IN ({tests}))"


_OVERLAPS_SQL = (
    "WITH s AS (SELECT *, ['train', 'train', 'test_a', 'test_b', 'rest'][floor(o_orderkey / 7)::BIGINT % 5 + 1] AS split FROM lineitem JOIN orders ON l_orderkey = o_orderkey) "
    + " UNION ALL ".join(
        (
            _overlap_sql("order", "o_orderkey", "'test_a', 'test_b'"),
            _overlap_sql("customer", "o_custkey", "'test_a', 'test_b'"),
            _overlap_sql("part_and_supplier", "l_partkey || '-' || l_suppkey", "'test_a'"),
            _overlap_sql("day", "o_orderdate", "'test_b'"),
        )
    )
)

# -- counts ----------------------------------------------------------------


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset's counts (groups, levels, flags) with orders in its columns."""
    key = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("partition"),
        F.col("o_orderpriority").alias("graph_signature"),
        (key % 5).alias("level"),
        (key % 3 == 0).alias("has_array"),
        (F.col("o_totalprice") > 200_000).alias("has_null"),
        (key < 0).alias("has_condition"),
    )
    return dataset.quality(rows)


_COUNTS_SQL = """
SELECT 'partition' AS measure, o_orderstatus AS value, count(*)::BIGINT AS count FROM orders GROUP BY 2
UNION ALL SELECT 'pattern', o_orderpriority, count(*)::BIGINT FROM orders GROUP BY 2
UNION ALL SELECT 'level', (o_orderkey % 5)::VARCHAR, count(*)::BIGINT FROM orders GROUP BY 2
UNION ALL SELECT 'has_array', 'true', (count(*) FILTER (WHERE o_orderkey % 3 = 0))::BIGINT FROM orders
UNION ALL SELECT 'has_null', 'true', (count(*) FILTER (WHERE o_totalprice > 200000))::BIGINT FROM orders
UNION ALL SELECT 'has_condition', 'true', (count(*) FILTER (WHERE o_orderkey < 0))::BIGINT FROM orders
"""

# -- faults ----------------------------------------------------------------


def case_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a sample with two cases, of which the second is spoilt by its
    key modulo 6: a source of another kind, a target that lacks a field, another
    result, a program that fails."""
    key, n = F.col("o_orderkey"), F.pmod("o_orderkey", F.lit(6))
    price = F.pmod(key, F.lit(1000))
    given = F.format_string('{"id": %d, "price": %d, "status": "%s"}', key, price, F.col("o_orderstatus"))
    wanted = F.format_string('{"id": %d, "twice": %d.0, "tag": "%s"}', key, price * 2, F.col("o_orderstatus"))
    case = lambda a, b: F.concat(F.lit('{"input": '), a, F.lit(', "expected": '), b, F.lit("}"))
    spoilt = (
        F.when(n == 1, case(F.replace(given, F.lit('"price": '), F.lit('"price": 0.5, "cost": ')), wanted))
        .when(n == 2, case(given, F.replace(wanted, F.lit('"tag"'), F.lit('"label"'))))
        .when(n == 3, case(given, F.replace(wanted, F.lit('"twice": '), F.lit('"twice": 1'))))
        .otherwise(case(given, wanted))
    )
    rows = spread(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")).select(
        key.alias("sample_id"),
        F.when(n == 4, F.lit(COMPLETIONS[6])).otherwise(F.lit(COMPLETIONS[0])).alias("reference_program"),
        F.lit(SOURCE).alias("source_schema"),
        F.lit(TARGET).alias("target_schema"),
        F.concat(F.lit("["), case(given, wanted), F.lit(", "), spoilt, F.lit("]")).alias("validation_cases"),
    )
    return dataset.faults(rows)


_FAULTS_SQL = """SELECT o_orderkey AS sample_id, CASE o_orderkey % 6 WHEN 1 THEN '$: cost is not allowed' WHEN 2 THEN '$: tag is required'
 WHEN 3 THEN 'the program gives another result' ELSE 'the program fails: cannot split status to tag' END AS fault FROM orders WHERE o_orderkey % 6 IN (1, 2, 3, 4)"""

# -- inferred schemas ------------------------------------------------------


def json_schema_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.field_table(inference.kind_counts(_planted(spark, sf_dir), "v"))


def _inferred_sql() -> str:
    """From the shapes that are planted, each counted as often as its events."""
    seen: list[str] = []

    def walk(x: object, path: str, k: int) -> None:
        kind = "null" if x is None else {bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array"}[type(x)]
        around = path.rpartition(".")[0] if not path.endswith("[]") else ""
        seen.append(f"({k}, '{path}', '{kind}', '{around}')")
        for name, value in x.items() if isinstance(x, dict) else ():
            walk(value, f"{path}.{name}", k)
        for value in x if isinstance(x, list) else ():
            walk(value, f"{path}[]", k)

    for k, (text, _) in enumerate(PLANTED):
        try:
            walk(json.loads(text.replace("@", "7")), "$", k)
        except ValueError:
            pass
    return f"""
WITH shape(k, path, kind, around) AS (VALUES {', '.join(seen)}),
e AS (SELECT event_id % {len(PLANTED)} AS k, count(*) AS m FROM events GROUP BY 1),
c AS (SELECT path, kind, any_value(around) AS around, sum(m) AS n FROM shape JOIN e USING (k) GROUP BY ALL),
o AS (SELECT path AS around, n AS objects FROM c WHERE kind = 'object')
SELECT path, string_agg(kind, ',' ORDER BY kind) AS kinds, sum(n)::BIGINT AS n, coalesce(any_value(around) <> '' AND sum(n) = any_value(objects), false) AS required
FROM c LEFT JOIN o USING (around) GROUP BY path"""


def conversation_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON objects, every third without its role."""
    fields: list[Column] = [F.col("conv_id"), F.col("turn"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("role"), F.col("text")]
    rows = _table(spark, sf_dir, "conversations").select(F.parse_json(F.to_json(F.struct(*fields))).alias("v"))
    return inference.field_table(inference.kind_counts(rows, "v"))


_CONVERSATION_SQL = """
SELECT '$' AS path, 'object' AS kinds, count(*)::BIGINT AS n, false AS required FROM conversations
UNION ALL SELECT '$.conv_id', 'integer', count(conv_id)::BIGINT, count(conv_id) = count(*) FROM conversations
UNION ALL SELECT '$.turn', 'integer', count(turn)::BIGINT, count(turn) = count(*) FROM conversations
UNION ALL SELECT '$.role', 'string', (count(role) FILTER (WHERE turn % 3 <> 0))::BIGINT, false FROM conversations
UNION ALL SELECT '$.text', 'string', count(text)::BIGINT, count(text) = count(*) FROM conversations
"""

QUERIES = {
    "order_places": order_places,
    "order_slices": order_slices,
    "split_overlaps": split_overlaps,
    "order_counts": order_counts,
    "case_faults": case_faults,
    "json_schema_inferred": json_schema_inferred,
    "conversation_schema": conversation_schema,
}
ORACLE_SQL = {
    "order_places": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders",
    "order_slices": _SLICES_SQL,
    "split_overlaps": _OVERLAPS_SQL,
    "order_counts": _COUNTS_SQL,
    "case_faults": _FAULTS_SQL,
    "json_schema_inferred": _inferred_sql(),
    "conversation_schema": _CONVERSATION_SQL,
}
