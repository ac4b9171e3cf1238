"""Dates read and written by columns, held against Python's own directives."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.functions.text import read_date, write_date
from morphlake.operators.compare import field_f1, field_f1_table

FORMS = ["%Y-%m-%d", "%d/%m/%Y", "%b %d, %Y", "%B %d %y", "%Y%m%d", "%Y-%j", "%H:%M:%S", "%d.%m.%y %H:%M", "%Y-%m-%dT%H:%M:%S", "%%%Y", "abc", "%m%d%Y"]
TEXTS = [
    "2031-11-07", "07/11/2031", "Nov 07, 2031", "november 7 69", "November 7 68", "20311107", "2031-366", "2032-366", "23:59:60", "1:2:3", "07.11.31 5:06",
    "2031-11-07T01:02:61", "%2031", "abc", "2031-02-30", " 2031-02-03", "2031-02-03\n", "02032031", "2031-11- 7", "29/02/1900", "0000-01-01", "9999-12-31",
    "\x012031\x0111\x017", "",
]


def test_reading(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    read = df.select("t", *(F.date_format(read_date(F.col("t"), f), "yyyy-MM-dd HH:mm:ss").alias(f"c{k}") for k, f in enumerate(FORMS)))
    for row in read.collect():
        for k, form in enumerate(FORMS):
            try:
                want = str(datetime.strptime(row["t"], form)) if row["t"] is not None else None
            except ValueError:
                want = None
            assert row[f"c{k}"] == want, (row["t"], form)


@pytest.mark.parametrize("form", ["%Y-%m-%d", "%y%Y", "%m%b%%", "it's %d'%B'", "%%", "", "%H:%M:%S %j"])
def test_writing(spark, form):
    at = datetime(2031, 5, 7, 1, 2, 3)
    rows = spark.createDataFrame([("2031-05-07 01:02:03",), (None,)], "t string").select(write_date(F.to_timestamp("t"), form).alias("x")).collect()
    assert [r.x for r in rows] == [at.strftime(form), None]


def test_field_f1_of_nested_values_without_a_shuffle(spark, capsys):
    one = T.StructType().add("a", "double").add("b", T.StructType().add("c", "string").add("d", "long")).add("e", T.ArrayType(T.StructType().add("f", "long")))
    two = T.StructType().add("b", T.StructType().add("c", "string").add("g", "long")).add("e", T.ArrayType(T.StructType().add("f", "double"))).add("a", "long")
    pairs = [
        ({"a": 1.0, "b": {"c": "x", "d": 3}, "e": [{"f": 1}, {"f": 2}]}, {"a": 1, "b": {"c": "x", "g": 3}, "e": [{"f": 1.0}]}),
        ({"a": None, "b": None, "e": []}, {"a": None, "b": {"c": None, "g": None}, "e": None}),
        ({"a": 2.0, "b": {"c": None, "d": None}, "e": [None]}, {"a": 2, "b": {"c": None, "g": 1}, "e": [None, {"f": 2.0}]}),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], T.StructType().add("id", "long").add("p", one).add("g", two))
    made = field_f1_table(df, ["id"], "p", "g")
    assert {r.id: r.field_f1 for r in made.collect()} == pytest.approx({k: field_f1(a, b) for k, (a, b) in enumerate(pairs)})
    made.explain()
    assert "Exchange" not in capsys.readouterr().out
