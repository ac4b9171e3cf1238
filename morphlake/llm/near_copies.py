"""The pipeline's near copies: SimHash of five-word shingles, checked exactly.

Two texts are linked if the Jaccard similarity of their sets of shingles is 0.8
or more, and groups are what links connect.  Equal sets are one node with a
SimHash of ``WORDS`` words of 64 bits.  Nodes that may be linked share a key: a
choice of fingerprint bits, of which there are ``tables``.  A bit differs at
0.8 with a probability of 0.15, so a pair at 0.8 shares no key with less than
``MISSED`` at any size, a closer pair with much less.  Within a key fingerprints
are compared bit-sliced (see ``simhash``) at ``RADIUS``, more than three standard
deviations beyond what a pair at 0.8 differs by.  Both only propose pairs: a
link is counted on the two whole sets.

Of each key every node proposes the least node within its radius, never all
pairs, and the least of all keys is tried, which connects most near copies.
Where proposals connect what tried pairs did not, the whole sets of what they
connect are compared in pieces of ``PIECE`` sets or ``PIECE_ITEMS`` shingles, and
each piece gives a spanning forest of its links.  A group of several pieces is
first cut into what shares rare shingles, as linked sets do: with the shingles
of both in one order, rare ones first, the first fifth and one of each have one
in common.  Common boilerplate then connects nothing.

Defined results: words are as in ``simhash``; fewer words than a shingle are one
shingle; texts without words are near copies of one another and of nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, may_hold, spare_name
from .graph import components
from .simhash import SEED, STEP, by_key, close_pairs, compared, join_labels, keyed

#: Similarity of a link as a fraction, so that it is counted in integers.
SHINGLE, SIMILAR = 5, (4, 5)
WORDS, RADIUS = 2, 32
#: Tables of keys at least, bits of a key at least, nodes that share a key on
#: average, and the share of pairs at the limit that may share none.
TABLES, KEY_BITS, KEY_MEAN, MISSED = 96, 10, 1024, 0.01
#: The probability that a bit is the same where the similarity is 0.8.
SAME = 0.8485
#: Sets and shingles of a piece, and shingles that are counted at a time.
PIECE, PIECE_ITEMS, STRIPE = 1024, 1 << 21, 2048
#: Counters, a power of two, that tell rare shingles from frequent ones.
COUNTERS = 1 << 18
# odd factors that make further words of a hash
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 62, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    n = len(words) - shingle + 1
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n))


def print_of(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles: a bit is set in more than half of them."""
    n, counts = len(found), np.zeros(64 * WORDS, np.int64)
    for a in range(0, n, STEP):
        part = found[a : a + STEP, None] * _FACTORS
        part ^= part >> np.uint64(32)
        part *= _FACTORS[::-1]
        part ^= part >> np.uint64(29)
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def key_masks(bits: int) -> np.ndarray:
    """Of each table the bits of its keys, as words; longer keys add bits."""
    tables = max(TABLES, ceil(log(MISSED) / log(1 - SAME**bits)))
    chosen = np.zeros((tables, 64 * WORDS), np.uint8)
    for t in range(tables):
        chosen[t, np.random.default_rng([SEED, t]).permutation(64 * WORDS)[:bits]] = 1
    return np.packbits(chosen, axis=1, bitorder="little").view("<u8")


def bands(found: np.ndarray) -> list[tuple[int, ...]]:
    """The keys of a set of shingles in a small corpus."""
    return [(t, *k) for t, k in enumerate((print_of(found) & key_masks(KEY_BITS)).tolist())] if len(found) else []


def with_sets(docs: DataFrame, text_col: str, key: tuple[str, str], more: str | None = None, made=None) -> DataFrame:
    """``docs`` without its text and with ``key``, the 128-bit name of the text's
    set of shingles; more: a column of longs for what ``made`` gives for the set."""
    at, kept = docs.columns.index(text_col), [c for c in docs.columns if c != text_col]
    names, docs_columns = [*kept, *key, *([more] if more else [])], docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                sets = [shingles(t) for t in part.column(at).to_pylist()]
                columns = [part.column(c) for c in range(len(docs_columns)) if c != at]
                for seed in (1, 2):
                    columns.append(pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)))
                if more:
                    columns.append(pa.array([made(s) for s in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [f for f in docs.schema if f.name != text_col] + [T.StructField(k, T.LongType()) for k in key]
    return docs.mapInArrow(run, T.StructType(fields + ([T.StructField(more, T.ArrayType(T.LongType()))] if more else [])))


def _sized_print(found: np.ndarray) -> np.ndarray:
    return np.concatenate(([len(found)], print_of(found).view(np.int64)))


def _as_longs(found: np.ndarray) -> np.ndarray:
    return found.view(np.int64)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: the pairs whose sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(one, "a").where(F.size("x") > 0).join(two, "b")
    part, whole = SIMILAR
    lengths, shared = F.size("x") + F.size("y"), F.size(F.array_intersect("x", "y"))
    long_enough = F.least(F.size("x"), F.size("y")) * whole >= F.greatest(F.size("x"), F.size("y")) * part
    return both.where(long_enough & (shared * (part + whole) >= lengths * part)).select("a", "b")


def _proposed(columns: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
    """Candidate pairs (a, b, tried) of keys, whose fingerprints and sizes allow a
    link.  tried: with the least node; else they say what candidates connect."""
    part, whole = SIMILAR
    node, words, size = columns[0], np.stack(columns[1:3], axis=1).view(np.uint64), columns[3]
    n = len(node)
    least, label = np.full(n, n), np.arange(n)
    for i, j in close_pairs(words, ends, RADIUS):
        fits = whole * np.minimum(size[i], size[j]) >= part * np.maximum(size[i], size[j])
        i, j = i[fits], j[fits]
        np.minimum.at(least, j, i)
        join_labels(label, i, j)
    has, moved = np.flatnonzero(least < n), np.flatnonzero(label != np.arange(n))
    a, b = np.concatenate((node[has], node[moved])), np.concatenate((node[least[has]], node[label[moved]]))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < len(has))], ["a", "b", "tried"])


def _forest(table: pa.Table) -> pa.Table:
    """A spanning forest of the links between the sets of a piece: how many
    shingles any two share is a product of 0-1 matrices, a stripe at a time."""
    part, whole = SIMILAR
    node, items = table.column("node").to_numpy(), table.column("items").combine_chunks()
    lengths = np.diff(items.offsets.to_numpy())
    n, row = len(node), np.repeat(np.arange(len(node)), lengths)
    _, column, counts = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = counts > 1
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for a in range(0, int(several.sum()), STRIPE):
        first, last = np.searchsorted(column, (a, a + STRIPE))
        stripe = np.zeros((n, STRIPE), np.float32)
        stripe[row[first:last], column[first:last] - a] = 1
        shared += stripe @ stripe.T
    label = np.arange(n)
    for k in range(n):
        alike = np.flatnonzero((shared[k] > 0) & (shared[k].astype(np.int64) * (part + whole) >= (lengths + lengths[k]) * part))
        join_labels(label, alike, np.full(len(alike), k))
    moved = np.flatnonzero(label != np.arange(n))
    return pa.table({"a": node[moved], "b": node[label[moved]]})


def _grouped(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``nodes`` and ``name``, the least node that links connect each with."""
    roots = materialize(components(links).withColumnRenamed("node", "of").withColumnRenamed("root", "least"), "roots")
    return nodes.join(roots, F.col("node") == F.col("of"), "left").withColumn(name, F.coalesce("least", "node")).drop("of", "least")


def _rare(counts: np.ndarray):
    """Of each set the shingles of which linked sets share one: all but the most
    frequent that a link cannot do without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = SIMILAR
        for batch in batches:
            for a in range(0, len(batch), 256):
                some, found = batch.slice(a, 256), [np.zeros(0, np.int64)]
                for items in some.column("items"):
                    x = items.values.to_numpy()
                    found.append(x[np.lexsort((x, counts[x & (COUNTERS - 1)]))[: len(x) + 1 + -len(x) * part // whole]] if len(x) else x)
                at = np.repeat(np.arange(len(some)), [len(x) for x in found[1:]])
                kept = some.select(["whole", "own"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(found))], ["whole", "own", "item"])

    return run


def _cut(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``groups`` (whole, own, node, ...) cut into what rare shingles connect, named
    anew in ``whole``; what meets nothing but its own goes.  Frequent is what has
    a large counter: ``COUNTERS`` counts reach the driver, and shingles that share
    one only make groups larger."""
    large = materialize(groups.select("whole", "own", "node").join(sets, "node"), "large")
    counts = np.zeros(COUNTERS, np.int64)
    counters = F.transform("items", lambda x: F.pmod(x, F.lit(COUNTERS)).cast("int"))
    for c, n in large.select(F.explode(counters).alias("c")).groupBy("c").count().collect():
        counts[c] = n
    rare = materialize(large.select("whole", "own", "items").mapInArrow(_rare(counts), "whole long, own long, item long").distinct(), "rare")
    met = rare.groupBy("whole", "item").agg(F.min("own").alias("b"), F.max("own").alias("last")).where("b < last")
    met = materialize(met.drop("last"), "met")
    links = rare.join(met, ["whole", "item"]).where("own > b").select(F.col("own").alias("a"), "b")
    roots = materialize(components(links).withColumnRenamed("node", "of").withColumnRenamed("root", "least"), "roots")
    return groups.join(roots, F.col("own") == F.col("of")).withColumn("whole", F.col("least")).drop("of", "least")


def _open(groups: DataFrame) -> DataFrame:
    """``whole, p``: groups that true links do not connect, and their pieces."""
    found = groups.groupBy("whole").agg(F.min("own").alias("r"), F.max("own").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("items"))
    pieces = F.greatest(F.ceil(F.col("n") / PIECE), F.ceil(F.col("items") / PIECE_ITEMS)).cast("int")
    return materialize(found.where("r < s").select("whole", pieces.alias("p")), "several")


def near_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``nodes`` (node, k1, k2, hash, size, fp, fp2) that connect
    what true links between candidates connect.  texts: ``hash, text``."""
    n = nodes.count()
    masks = key_masks(max(KEY_BITS, ceil(log2(max(1, n) / KEY_MEAN)))).view(np.int64).tolist()
    keys = [F.xxhash64(F.col("fp").bitwiseAND(F.lit(a)), F.col("fp2").bitwiseAND(F.lit(b))) for a, b in masks]
    rows = keyed(nodes, keys, ("size",))
    found = materialize(compared(rows, n * len(keys), by_key(_proposed), "a long, b long, tried boolean").distinct(), "proposed")
    first = materialize(found.where("tried").groupBy("a").agg(F.min("b").alias("b")), "first")
    wanted = materialize(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "k1", "k2", "hash", "size"), "node"), "wanted")
    asked = wanted.select("hash").distinct()
    asked_texts = may_hold(texts, F.col("hash"), asked, "asked").where("asked").join(asked, "hash", "left_semi").select("text")
    made = with_sets(asked_texts, "text", ("k1", "k2"), "items", _as_longs)
    sets = materialize(made.groupBy("k1", "k2").agg(F.first("items").alias("items")).join(wanted, ["k1", "k2"]).select("node", "items"), "sets")
    links = materialize(_verified(first, sets), "links")
    # what candidates connect and true links do not is open
    groups = _grouped(_grouped(wanted.select("node", "size"), links, "own"), found.select("a", "b"), "whole")
    groups = materialize(groups, "groups")
    several = _open(groups)
    if not several.where("p > 1").isEmpty():
        large, small = (groups.join(several.where(p).select("whole"), "whole", "left_semi") for p in ("p > 1", "p = 1"))
        groups = materialize(small.unionByName(_cut(large, sets)), "groups")
        several = _open(groups)
    mine = F.pmod(F.xxhash64("node"), F.col("p")).cast("int")
    pieces = groups.join(several, "whole").select("whole", "node", mine.alias("x"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("y"))
    pieces = materialize(pieces.select("whole", "node", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")), "open")
    forest = pieces.join(sets, "node").groupBy("whole", "i", "j").applyInArrow(lambda t: _forest(t), "a long, b long")
    return materialize(links.unionByName(forest), "links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, k1, k2, component_id, stays`` for every row of ``docs``; stays: the
    row has the smallest (id, k1, k2) of its group, where no id is the largest."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    rows = materialize(with_sets(rows, "text", ("k1", "k2"), "print", _sized_print), "fingerprints")
    nodes = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.min("hash").alias("hash"), F.first("print").alias("print"))
    size, *words = (F.col("print")[k] for k in range(1 + WORDS))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "first_id", "hash", size.alias("size"), words[0].alias("fp"), words[1].alias("fp2"))
    nodes = materialize(nodes, "nodes")
    links = near_links(nodes, docs.select(F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")))
    roots = materialize(components(links).withColumnRenamed("node", "of"), "roots")
    placed = nodes.join(roots, F.col("node") == F.col("of"), "left").select("k1", "k2", "first_id", F.coalesce("root", "node").alias("root"))
    placed = materialize(placed, "placed")
    survivor = F.min(F.struct(F.col("first_id").isNull().alias("unknown"), "first_id", "k1", "k2"))
    least = materialize(placed.groupBy("root").agg(survivor.alias("s")), "least")
    stays = (F.col("k1") == F.col("s.k1")) & (F.col("k2") == F.col("s.k2"))
    named = materialize(placed.join(least, "root").select("k1", "k2", F.col("s.first_id").alias("component_id"), stays.alias("stays")), "named")
    found = rows.select("doc_id", "k1", "k2").join(named, ["k1", "k2"])
    return found.select("doc_id", "k1", "k2", "component_id", (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that with the smallest id; columns as
    they came.

    Where ids repeat, rows are told apart by their shingles too: the group's
    smallest (id, shingles) stays, and of rows that share all of them one.
    Only rows that a filter of dropped and repeated ids lets through are
    shuffled with their texts.
    """
    found = materialize(near_groups(docs, id_col, text_col), "groups")
    key, gone_1, gone_2, k1, k2, copy, hint = (spare_name(docs, n) for n in ("drop_id", "drop_k1", "drop_k2", "own_k1", "own_k2", "own_text", "in_doubt"))
    dropped = materialize(found.where(~F.col("stays")).select("doc_id", "k1", "k2"), "dropped")
    repeated = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    marked = may_hold(docs, F.col(id_col).cast("long"), dropped.select("doc_id").union(repeated), hint)
    rows, clear = marked.where(F.col(hint)).select(*docs.columns), marked.where(~F.col(hint)).select(*docs.columns)
    gone = dropped.select(F.col("doc_id").alias(key), F.col("k1").alias(gone_1), F.col("k2").alias(gone_2))
    same = F.col(id_col).eqNullSafe(F.col(key))
    if repeated.isEmpty():
        return clear.union(rows.join(gone, same, "left_anti").select(*docs.columns))
    told = with_sets(rows.withColumn(copy, F.col(text_col)), copy, (k1, k2))
    kept = told.join(gone, same & (F.col(k1) == F.col(gone_1)) & (F.col(k2) == F.col(gone_2)), "left_anti")
    return clear.union(kept.dropDuplicates([id_col, k1, k2]).select(*docs.columns))
