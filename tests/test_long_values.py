"""JSON values with long texts: depth and schema take no more stack than with short ones."""

import json

from pyspark.sql import functions as F

from morphlake import table_queries
from morphlake.functions import variant as V

#: Texts that hold what texts escape, and brackets that open nothing.
LONG = ["x" * 200_000, 'say "no" ' * 20_000, "[{\\\n\"" * 20_000, "\\" * 99_999, "é {" * 30_000]


def test_depth_with_long_texts(spark):
    values = [{"a": text, "b": [[text], {"c": {}}]} for text in LONG] + [LONG[2], [LONG[2]], {LONG[1][:40_000]: [1]}, 3, {}, {"": ""}]
    got = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, t string").repartition(3).select("k", V.depth(F.parse_json("t")).alias("d"))
    assert [r.d for r in got.orderBy("k").collect()] == [4] * len(LONG) + [0, 1, 2, 0, 1, 1]


def test_schema_of_long_conversations(spark, tmp_path):
    rows = [(k // 4, k % 4, ["user", "assistant"][k % 2], LONG[k % 5] if k else None) for k in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in table_queries.conversation_schema(spark, str(tmp_path)).collect()}
    roles = sum(t % 3 != 0 for _, t, *_ in rows)
    fields = {("$.conv_id", "integer", 40, True), ("$.turn", "integer", 40, True), ("$.role", "string", roles, False), ("$.text", "string", 39, False)}
    assert got == {("$", "object", 40, False)} | fields
