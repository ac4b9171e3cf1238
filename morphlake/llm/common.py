"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}
_held: dict[str, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (single-machine sessions, tests) a folder of our own takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="morphlake-")
    return _own_dirs[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/morphlake/{uuid.uuid4().hex}/{tag}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    This cuts the lineage so that lost executors cost only the current step,
    and later plans start from a scan whose columns can be pruned.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is much faster than ``translate``; it is used where no character
    outside ASCII could change with it.
    """
    other_case = r"[\p{javaUpperCase}\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"
    return F.when(col.rlike(other_case), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


#: Bits that a key filter spends on a key, and the most that one has (32 MB).
BITS_A_KEY, FILTER_BITS = 16, 1 << 28
#: Bits in one of Spark's bitmaps.
BITMAP = 1 << 15


def may_hold(rows: DataFrame, key: Column, keys: DataFrame, mark: str) -> DataFrame:
    """``rows`` and a boolean ``mark``: false where ``key`` is certainly none of
    ``keys`` (one column of the same type), so that such rows need no join.

    Bitmaps of hashed keys are broadcast, FILTER_BITS at most.  The more keys
    there are beyond that, the more rows are marked; none is ever missed.
    Nulls are keys like others.
    """
    slots = min(FILTER_BITS, max(BITMAP, 1 << (BITS_A_KEY * keys.count() - 1).bit_length()))

    def place(c: Column) -> Column:
        return F.xxhash64(c).bitwiseAND(F.lit(slots - 1))

    at, part, bits = (spare_name(rows, n) for n in ("place", "part", "bits"))
    places = keys.select(place(F.col(keys.columns[0])).alias(at)).distinct()
    split = places.select(F.floor(F.col(at) / BITMAP).alias(part), (F.col(at) % BITMAP).alias(at)).repartition(part)
    maps = materialize(split.groupBy(part).agg(F.bitmap_construct_agg(at).alias(bits)), "filter")
    on = F.floor(F.col(at) / BITMAP) == F.col(part)
    byte = F.conv(F.hex(F.substring(bits, (F.col(at) % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (F.col(at) % 8).cast("int")) == 1
    return rows.withColumn(at, place(key)).join(F.broadcast(maps), on, "left").select(*rows.columns, F.coalesce(found, F.lit(False)).alias(mark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name


def held(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: the last large object only,
    whichever operator it belongs to, so that stages do not add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def bounded_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: tuple[int, int], max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int], tuple[float, float]]:
    """Texts and labels (0 or 1, the largest that an id has) of at most ``most``
    documents of each label, lowest hash of the id first, and how many rows a
    sampled row of each label stands for.

    Texts over ``max_chars`` are left out before picking, so that others take
    their place.  Of rows that repeat an id the shortest text (then the least)
    is taken, in tasks already, so the driver gets no more than ``most`` texts
    whatever repeats."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(F.col(id_col).alias("id"), F.length(text).alias("size")).groupBy("id").agg(F.min("size").alias("size"))
    found = known.join(sizes, "id")
    short = lambda k: found.where((F.col("label") == k) & (F.col("size") <= max_chars)).orderBy(F.xxhash64("id"), "id").limit(most[k])
    picked = [r for k in (0, 1) for r in short(k).collect()]
    if not picked:
        return [], [], (1.0, 1.0)
    totals = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    wanted = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for r in picked], "id long, label int")
    shortest = (
        docs.select(F.col(id_col).alias("id"), text.alias("body"))
        .where(F.length("body") <= max_chars)
        .join(F.broadcast(wanted), "id")
        .groupBy("id", "label")
        .agg(F.min(F.struct(F.length("body").alias("size"), "body")).alias("least"))
    )
    rows = sorted((r["id"], r["label"], r["least"]["body"]) for r in shortest.collect())
    n = {k: sum(label == k for _, label, _ in rows) for k in (0, 1)}
    return [body for *_, body in rows], [label for _, label, _ in rows], (totals.get(0, 0) / max(1, n[0]), totals.get(1, 0) / max(1, n[1]))
