"""JSON lines that change by commits: readers see all of a write or nothing.

A write puts its lines into a folder of its own, ``rows/part=<name>``, and then
a manifest, ``commits/<version>.json``, by a rename that never overwrites.  Of
writers at one time a single one gets a version, the others go on to the next.
What failed, or was never committed, is in no manifest and is not read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import json_line

MODES = ("errorifexists", "append", "overwrite")
MANIFEST = "version long, batch string, part string, rows long, replaces boolean"


class CommittedLines:
    """The lines at ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> DataFrame:
        """Every manifest, one row each."""
        folder = f"{self.path}/commits"
        if not self._fs.exists(self._at(folder)):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(folder)

    def live(self) -> DataFrame:
        """The manifests that count: from the last that replaced what was there."""
        made = self.commits()
        since = made.agg(F.coalesce(F.max(F.when(F.col("replaces"), F.col("version"))), F.lit(0)).alias("since"))
        return made.join(F.broadcast(since), F.col("version") >= F.col("since")).drop("since")  # one row

    def write(self, df: DataFrame, mode: str = "errorifexists", batch: str | None = None) -> bool:
        """Commit the rows of ``df``.  batch: a name under which rows are committed
        once; False, and nothing changes, if it was.  ``errorifexists`` refuses
        a path that holds a commit; the others add to it or replace it."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self._next(mode, batch) is None:  # known, or refused, before the work is done
            return False
        part, counted = uuid.uuid4().hex, Observation()
        folder = f"{self.path}/rows/part={part}"
        try:
            df.select(json_line(df).alias("value")).observe(counted, F.count(F.lit(1)).alias("rows")).write.text(folder)
            while (version := self._next(mode, batch)) is not None:
                manifest = {"version": version, "batch": batch, "part": part, "rows": counted.get["rows"], "replaces": mode == "overwrite"}
                if self._placed(version, manifest):
                    return True
        except BaseException:
            self._fs.delete(self._at(folder), True)
            raise
        self._fs.delete(self._at(folder), True)
        return False

    def read(self, schema: T.StructType | str) -> DataFrame:
        """The rows of all live commits."""
        live = self.live().select("part")  # listed before the rows are
        folder = f"{self.path}/rows"
        kind = schema if isinstance(schema, str) else schema.simpleString()
        if not self._fs.exists(self._at(folder)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema("value string, part string").text(folder)
        return rows.join(live, "part", "left_semi").select(F.from_json("value", kind).alias("row")).select("row.*")

    def _next(self, mode: str, batch: str | None) -> int | None:
        """The version to try, None if the batch is committed."""
        said = self.commits().agg(F.max("version").alias("last"), F.max(F.col("batch").eqNullSafe(F.lit(batch))).alias("known")).first()
        if batch is not None and said["known"]:
            return None
        if mode == "errorifexists" and said["last"] is not None:
            raise FileExistsError(f"{self.path} holds {said['last'] + 1} commits")
        return 0 if said["last"] is None else said["last"] + 1

    def _placed(self, version: int, manifest: dict) -> bool:
        """Put a manifest in its place; False if another has the version."""
        files, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        aside, place = self._at(f"{self.path}/aside/{uuid.uuid4().hex}"), self._at(f"{self.path}/commits/{version:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(place.getParent())
        never = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
        never[0] = files.Options.Rename.NONE
        try:
            files.FileContext.getFileContext(place.toUri(), conf).rename(aside, place, never)
        except Exception:
            if not self._fs.exists(place):
                raise
            self._fs.delete(aside, False)
            return False
        return True
