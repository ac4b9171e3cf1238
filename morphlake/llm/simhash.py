"""SimHash near-deduplication with bit-sliced comparison.

A fingerprint has a bit set where more than half of the text's shingle hashes
have it.  Equal fingerprints are one node.  Nodes that may be within the radius
share a key: the 64 bits are cut into more blocks than the radius, so some
blocks come through intact, and every choice of that many blocks is a table of
keys.  No link is lost by this, whatever the number of blocks; it is chosen so
that a key has few fingerprints.

Fingerprints of one key are compared bit-sliced: bit planes are stored
vertically, 64 fingerprints to a word, and a query updates the distances to 64
fingerprints at once with carry-save counters that overflow beyond the radius.
Words whose lanes have all overflowed are abandoned.  Each key gives a spanning
forest of its links, never all pairs; a key with more than ``KEY_ROWS``
fingerprints is cut into pieces that are compared two by two in tasks of their
own.  Components come from alternating star rounds.

Defined results: a text without words (null, empty, white space) has
fingerprint zero and links like any other; fewer words than a shingle are one
shingle; repeated rows and equal texts share a fingerprint; a null id counts as
larger than any other and a component of null ids alone has a null
``component_id``; an empty table gives an empty result; further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
KEY_ROWS = 4096
#: Blocks are added until a key has this many fingerprints on average at most.
KEY_MEAN = 256
MOST_TABLES = 256
#: Shingles hashed at a time, which bounds memory for very long texts.
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, STEP):
        part = words[a : min(n, a + STEP) + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, names: list[str], shingles: list[int], text_col: str = "text") -> DataFrame:
    """``docs`` and a column for each of ``shingles``, the text's fingerprint as a
    signed 64-bit integer."""
    at, columns = docs.columns.index(text_col), [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64) for k in shingles]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], columns)

    return docs.mapInArrow(run, T.StructType([*docs.schema, *(T.StructField(n, T.LongType()) for n in names)]))


# -- candidate keys --------------------------------------------------------


def key_masks(radius: int, n: int) -> list[int]:
    """Bit masks of the tables: any two fingerprints within the radius agree on
    at least one mask.  Blocks are added until a key has few fingerprints, but no
    more than give ``MOST_TABLES``: beyond, long keys are cut into pieces."""
    for blocks in range(radius + 1, 64):
        intact = blocks - radius
        if n >> (64 * intact // blocks) <= KEY_MEAN or comb(blocks + 1, radius) > MOST_TABLES:
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, intact)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(nodes: DataFrame, keys: list[Column], more: tuple[str, ...] = ()) -> DataFrame:
    """``t, k, i, j, node, fp, fp2`` and ``more``: what is compared shares the
    first four.  keys: of each table the key of a node."""
    tagged = F.array(*(F.struct(F.lit(t).alias("t"), k.alias("k")) for t, k in enumerate(keys)))
    kept = ["node", "fp", "fp2", *more]
    rows = nodes.select(*kept, F.explode(tagged).alias("x")).select("x.t", "x.k", *kept)
    hot = materialize(rows.groupBy("t", "k").count().where(F.col("count") > KEY_ROWS).select("t", "k", F.ceil(F.col("count") / KEY_ROWS).cast("int").alias("p")), "hot_keys")
    if hot.isEmpty():
        return rows.select("t", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), *kept)
    mine = F.pmod(F.xxhash64("node"), F.coalesce("p", F.lit(1))).cast("int")
    return (
        rows.join(hot, ["t", "k"], "left")
        .select("t", "k", *kept, mine.alias("a"), F.explode(F.sequence(F.lit(0), F.coalesce("p", F.lit(1)) - 1)).alias("b"))
        .select("t", "k", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), *kept)
    )


# -- comparison ------------------------------------------------------------


def _low_ones(n: np.ndarray) -> np.ndarray:
    """Words with the low n (0 to 64) bits set."""
    return np.where(n >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def close_pairs(fps: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < ends[i], of fingerprints within the radius, a slice
    of the queries at a time.  Fingerprints are words, or rows of words."""
    n = len(fps)
    prints = np.ascontiguousarray(fps.reshape(n, -1))
    n_bits = 64 * prints.shape[1]
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, n_bits // 8), axis=1, bitorder="little")
    words = -(-n // 64)
    padded = np.zeros((n_bits, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    n_counters = radius.bit_length()
    spare = (1 << n_counters) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    rows = np.flatnonzero(ends > np.arange(n) + 1)
    for a in range(0, len(rows), 4096):
        part = rows[a : a + 4096]
        first, last = part // 64, (ends[part] - 1) // 64
        for o in range(int((last - first).max()) + 1):
            q = part[first + o <= last]
            w = q // 64 + o
            valid = _low_ones(ends[q] - w * 64) & ~_low_ones(np.maximum(q + 1 - w * 64, 0))
            over = ~valid
            counters = [np.full(len(q), full if spare >> c & 1 else np.uint64(0)) for c in range(n_counters)]
            for p in range(n_bits):
                carry = planes[p][w] ^ (np.uint64(0) - (prints[q, p // 64] >> np.uint64(p % 64) & np.uint64(1)))
                for c in range(n_counters):
                    counters[c], carry = counters[c] ^ carry, counters[c] & carry
                over |= carry
                if p % 8 == 7:
                    live = np.flatnonzero(over != full)
                    if len(live) < len(q):
                        q, w, over = q[live], w[live], over[live]
                        counters = [c[live] for c in counters]
                        if not len(q):
                            break
            if len(q):
                lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at, lane = np.nonzero(lanes)
                yield q[at], w[at] * 64 + lane


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give what the pairs (i, j) connect the least of its labels."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, shorter := label[label]):
            label[:] = shorter


def spanning(fps: np.ndarray, ends: np.ndarray, radius: int, second: np.ndarray, second_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the links: (row, its root).  A link is
    within the radius in the first and in the second fingerprint."""
    label = np.arange(len(fps))
    for i, j in close_pairs(fps, ends, radius):
        if second_radius < 64:
            confirmed = np.bitwise_count(second[i] ^ second[j]) <= second_radius
            i, j = i[confirmed], j[confirmed]
        join_labels(label, i, j)
    rows = np.flatnonzero(label != np.arange(len(fps)))
    return rows, label[rows]


def by_key(found):
    """Applies ``found`` to the columns of whole keys: the first four columns say
    which key a row has, and rows of a key follow each other.  ``found`` also
    gets where each row's key ends."""

    def of(columns: list[np.ndarray]) -> pa.RecordBatch:
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)) + 1
        edges = np.concatenate((new, [len(columns[0])]))
        return found(columns[4:], np.repeat(edges, np.diff(np.concatenate(([0], edges)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            if not len(columns[0]):
                continue
            # the last key may go on in the next batch
            other = np.flatnonzero(np.any([c != c[-1] for c in columns[:4]], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            held = [c[cut:] for c in columns]
            if cut:
                yield of([c[:cut] for c in columns])
        if held is not None:
            yield of(held)

    return run


def _compare(radius: int, second_radius: int):
    def found(columns: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        node, fps, second = columns[0], columns[1].view(np.uint64), columns[2].view(np.uint64)
        a, b = spanning(fps, ends, radius, second, second_radius)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return by_key(found)


#: Rows that a task compares, on average at most.
TASK_ROWS = 2_000_000


def compared(rows: DataFrame, n_rows: int, run, schema: str) -> DataFrame:
    """``run`` over ``keyed`` rows, brought together by key, in the nodes' order."""
    key = ["t", "k", "i", "j"]
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // TASK_ROWS)
    return rows.repartition(n, *key).sortWithinPartitions(*key, "node").mapInArrow(run, schema)


def fingerprint_links(nodes: DataFrame, radius: int, second_radius: int = 64) -> DataFrame:
    """``a, b``: links between nodes that connect what the true links connect."""
    n = nodes.count()
    masks = key_masks(radius, n)
    rows = keyed(nodes, [F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    return compared(rows, n * len(masks), _compare(radius, second_radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, confirm: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id, fp, fp2, component_id`` for every row of ``docs``.  confirm: the
    shingle and radius of a second fingerprint (else ``fp2`` is 0)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shingles = [shingle, confirm[0]] if confirm else [shingle]
    rows = with_fingerprints(rows, ["fp", "fp2"][: len(shingles)], shingles).drop("text")
    rows = materialize(rows if confirm else rows.withColumn("fp2", F.lit(0).cast("long")), "fingerprints")
    nodes = rows.groupBy("fp", "fp2").agg(F.min("doc_id").alias("first_id"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = materialize(components(materialize(fingerprint_links(nodes, radius, confirm[1] if confirm else 64), "links")).withColumnRenamed("node", "of"), "roots")
    placed = materialize(nodes.join(roots, F.col("node") == F.col("of"), "left").select("fp", "fp2", "first_id", F.coalesce("root", "node").alias("root")), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = materialize(placed.join(least, "root").select("fp", "fp2", "component_id"), "named")
    return rows.join(named, ["fp", "fp2"]).select("doc_id", "fp", "fp2", "component_id")
