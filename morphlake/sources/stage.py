"""Tables that a job writes for itself and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a single machine that names
    none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="morphlake-"))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written once and scanned from there: what made it is not run again,
    whatever reads it how often, and lost executors cost no more than a scan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/morphlake/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks for each core of what ``spread`` deals out.
TASKS_A_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt evenly to a few tasks for each core: where a row costs far more
    than its bytes, files cut by bytes keep few cores busy.  For narrow rows, as
    all of them are shuffled."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
