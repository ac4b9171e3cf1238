"""Delta-maintained token counts by source, language and tokenizer version.

Totals are never recounted: a batch of inserts, deletes and revised counts is
reduced to signed sums and added.  A batch is committed once: its sums are
written to a folder of their own, then a marker is written whole beside its
place and renamed to the name of the batch, which fails if that exists.  Only
sums that a marker points to count, so replayed batches change nothing, files of
failed attempts are ignored, and a driver that dies at any moment leaves a batch
committed or not.  A marker that cannot be read counts as none and is replaced.
``compact`` folds committed batches into one; it claims each batch in the same
way first, so of several compactors one alone folds it.  The rename must not
overwrite, which file systems like HDFS decide at once; a store without that
needs one driver at a time.

Defined results: null sources, languages and counts (0) are kept as keys and
values; a null or empty text has 0 tokens; every row counts, repeated ones too;
a group whose documents and tokens both sum to 0 is left out; empty tables and
batches give no rows; further columns are not looked at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder, slices

KEYS = ["source", "lang", "tokenizer"]
_SUMS = "source string, lang string, tokenizer string, documents long, tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str, version: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``doc_id, source, lang, tokenizer, tokens`` of every row."""
    with open(tokenizer_path) as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(source.value).encode_all
        for batch in batches:
            counts = [np.diff(encode(texts, 0)[1]) - 1 for _, texts in slices(batch.column(3))]
            tokens = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens)], ["doc_id", "source", "lang", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long").select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))


def revisions(counted: DataFrame, old: str = "old_tokens", new: str = "tokens") -> DataFrame:
    """Rows whose count changed; a document that changes its source or language
    is a delete and an insert."""
    return counted.select(*KEYS, F.lit(0).cast("long").alias("documents"), (F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).cast("long").alias("tokens"))


class Rollup:
    """The totals kept in ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, batch: str, kind: str = "commits"):
        return self._path(f"{self.folder}/{kind}/{quote(batch, safe='')}.json")

    def _placed(self, place, content: dict) -> bool:
        """Put a marker in its place; False if one is there."""
        jvm = self.spark._jvm
        aside = self._path(f"{self.folder}/aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs.mkdirs(place.getParent())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, place, never)
        except Exception:
            if self._fs.exists(place):
                self._fs.delete(aside, False)
                return False
            raise
        return True

    def committed(self, batch: str) -> bool:
        return quote(batch, safe="") in self._markers()

    def commit(self, batch: str, changes: DataFrame, replaces: list[str] | None = None) -> bool:
        """Add ``changes`` (KEYS, documents, tokens) under the name ``batch``;
        False, and nothing changes, if that batch is committed already."""
        if self.committed(batch):
            return False
        name = uuid.uuid4().hex
        sums = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{self.folder}/sums/{name}")
        content = {"batch": batch, "sums": name, "replaces": replaces or []}
        if self._placed(self._marker(batch), content):
            return True
        if self.committed(batch):  # another driver was first
            return False
        self._fs.delete(self._marker(batch), False)  # half a marker of an older kind
        return self._placed(self._marker(batch), content)

    def _markers(self) -> dict[str, dict]:
        """What readable markers say, by batch."""
        commits = self._path(f"{self.folder}/commits")
        if not self._fs.exists(commits):
            return {}
        found = {}
        for r in self.spark.read.text(f"{self.folder}/commits", wholetext=True).collect():
            try:
                said = json.loads(r["value"])
            except ValueError:
                continue
            found[quote(said["batch"], safe="")] = said
        return found

    def _entries(self) -> dict[str, dict]:
        """Sums by batch, without batches that a later one has folded in."""
        found = self._markers()
        gone = {quote(b, safe="") for x in found.values() for b in x["replaces"]}
        return {b: x for b, x in found.items() if b not in gone}

    def totals(self) -> DataFrame:
        paths = [f"{self.folder}/sums/{x['sums']}" for x in self._entries().values()]
        rows = self.spark.read.schema(_SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], _SUMS)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def compact(self, batches: list[str]) -> None:
        """Fold committed batches into one; they stay committed."""
        entries = self._entries()
        name = f"compacted-{uuid.uuid4().hex}"
        live = [b for b in batches if quote(b, safe="") in entries and self._placed(self._marker(b, "claims"), {"by": name})]
        if live:
            paths = [f"{self.folder}/sums/{entries[quote(b, safe='')]['sums']}" for b in live]
            self.commit(name, self.spark.read.schema(_SUMS).parquet(*paths), live)
