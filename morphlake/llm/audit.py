"""Filter interaction audit by Walsh-Hadamard sums.

Every document fails some of the filters: a mask of bits.  What any order of the
filters keeps, removes or removes twice depends only on how many documents of a
part have which mask.  Those counts are not gathered by mask: for each part and
label class (all, good, toxic) Spark adds up ``2 ** filters`` signed parity sums
(for each set of filters, +1 for a document that fails an even number of the
set, -1 for an odd number).  The Hadamard matrix times itself is its size times
the identity, so a second multiplication gives the cells exactly, in integers.
All orders, and each filter's Shapley value (a document that fails k filters
adds 1/k of the orders to each of them), are sums over the cells.

Only digests, counts and masks are shuffled, never texts.  Filter E needs the
smallest id of each text; rows of one text are first added up by part and label,
so that a text's group has as many rows as it has parts and label classes.  A
part's sums are combined in each task before they meet.

Defined results: a null text is empty, a null source the empty part; a null id
is smaller than none, has no smaller one beside it, and has no labels; an id
with several labels is good (toxic) if one of them says so; repeated rows each
count, and of equal texts all rows with the smallest id pass E; labels without
a document count nowhere; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT = 50, 65, 5
SYMBOLS = "#$%&*|"
#: Null ids meet in no join; they are spread over so many keys.
SPREAD = 4096
_WORD_CUT = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that look at one text only."""
    words = F.filter(F.split(text, _WORD_CUT, -1), lambda w: w != "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = (
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT_PCT,
        upper * 100 > F.length(text) * MAX_UPPER_PCT,
        text.rlike(f"[{SYMBOLS}]"),
    )
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic, mask, n``: documents counted by what they fail,
    several rows for a mask of a part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # the key of a null id is spread, as no label can meet it
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(F.lit(-1))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), own_failures(text).alias("own")).withColumn("salt", salt)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.coalesce(F.bool_or(F.col(source) == 1), F.lit(False)).alias(name) for name, source in (("good", "quality"), ("toxic", "toxic"))))
    counted = rows.groupBy("doc_id", "salt", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n"))
    labelled = counted.join(known.withColumn("salt", F.lit(-1).cast("long")), ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    # of the rows with the smallest id all pass E; nulls are never the smallest, and pass
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = labelled.groupBy("digest", "part", "good", "toxic", "own").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), first.alias("first")
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(F.lit(0))
    both = groups.withColumn("passing", passing)
    cells = F.array(F.struct(F.col("own").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("own") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    return both.select("part", "good", "toxic", F.inline(cells)).where("n > 0")


def parity_sums(cells: DataFrame, bits: int = len(FILTERS)) -> DataFrame:
    """``part, sums``: of each label class (all, good, toxic) the signed parity
    sums of every set of filters."""
    classes = [F.col("n"), F.when(F.col("good"), F.col("n")).otherwise(F.lit(0)), F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0))]
    sign = lambda s: F.lit(1) - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    names = [(c, s) for c in range(len(classes)) for s in range(1 << bits)]
    sums = cells.groupBy("part").agg(*(F.sum(classes[c] * sign(s)).alias(f"w{c}_{s}") for c, s in names))
    return sums.select("part", F.array(*(F.col(f"w{c}_{s}").cast("long") for c, s in names)).alias("sums"))


def hadamard(bits: int) -> np.ndarray:
    """The signs: -1 where two sets share an odd number of filters."""
    sets = np.arange(1 << bits)
    shared = np.array([[bin(a & b).count("1") for b in sets.tolist()] for a in sets.tolist()])
    return 1 - 2 * (shared % 2)


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def order_weights(filters: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Every order and step, and for each figure the matrix that takes cells to it."""
    size = 1 << len(filters)
    masks = np.arange(size)
    fails = np.array([bin(m).count("1") for m in masks.tolist()])
    keys, rows = [], {n: [] for n in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << filters.index(name)
            failing, gone = (masks & bit) > 0, (masks & before) > 0
            keys.append(("".join(order), step))
            rows["kept"].append((masks & (before | bit)) == 0)
            rows["removed"].append(failing & ~gone)
            rows["redundant"].append(failing & gone)
            rows["unique_fails"].append(masks == bit)
            rows["shapley"].append(np.where(failing, factorial(len(filters)) // np.maximum(1, fails), 0))
            before |= bit
    return keys, {n: np.array(r, np.int64) for n, r in rows.items()}


def orders(sums: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The figures of every order and step, from the parity sums of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = order_weights(filters)
        signs = hadamard(len(filters))
        names, steps = pa.array([o for o, _ in keys]), pa.array([s for _, s in keys], pa.int32())
        for batch in batches:
            for part, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every, good, toxic = np.array(flat, np.int64).reshape(3, -1) @ signs >> len(filters)
                made = [weights[n] @ every for n in ("kept", "removed", "redundant", "unique_fails")]
                made += [weights["removed"] @ good, weights["removed"] @ toxic, weights["shapley"] @ every]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.string()), names, steps, *map(pa.array, made)], _NAMES)

    return sums.mapInArrow(run, RESULT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    return orders(parity_sums(masked(docs, labels)))
