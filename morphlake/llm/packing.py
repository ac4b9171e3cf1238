"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Documents become token ids (an end id after each) and only documents longer
than a sequence are cut.  Pieces that fill a sequence need no packing.  The
others are dealt to nodes of at most ``NODE_ITEMS`` items.  Each node packs by
best fit, longest first, and emits bins that are nearly full; the bins left
underfull become items of the next level, where nodes of the same size mix what
different nodes left over.  Levels end when one node held all that was left or
when a level saved next to nothing.  A bin is one row that carries its members,
at most one for each token, so no step gathers more than a node's items.

Defined results: a null or empty text is one piece that holds the end id;
repeated rows and null ids are packed like any row; ties in length go by the
order of the scan; an empty table gives an empty result; further columns are
not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder, slices

CAPACITY = 2048
END_ID = 0
NODE_ITEMS = 200_000
#: A bin with at most this many free tokens goes out at once.
NEARLY_FULL = 8
#: Levels go on while one saves at least this part of the bins it was given.
WORTH_IT = 0.002

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BINS = "fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""
    with open(tokenizer_path) as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(source.value).encode_all
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, bounds = encode(texts, end_id)
                n = -(-np.diff(bounds) // capacity)
                of = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                begin = bounds[of] + piece * capacity
                stop = np.minimum(begin + capacity, bounds[of + 1])
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist())]
                owners = batch.column(0).slice(at, len(texts)).take(pa.array(of))
                columns = [owners, pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(stop - begin), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first: the items of each bin.  An item goes to the bin
    with the least free space that takes it; bit r of ``free`` says that some
    bin has r tokens left."""
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = free >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            slot = open_bins[left]
            k = slot.pop()
            if not slot:
                free &= ~(1 << left)
            bins[k].append(item)
        else:
            left, k = capacity, len(bins)
            bins.append([item])
        left -= size
        if left:
            open_bins[left].append(k)
            free |= 1 << left
    return bins


def _pack_node(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = table.column("fill").to_numpy().astype(np.int64)
        lists = table.column("members").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds, members = lists.offsets.to_numpy(), lists.values
        bins = best_fit(sizes, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(sizes))
        per_bin = np.fromiter(map(len, bins), np.int64, len(bins))
        # where each item begins in its bin
        filled = np.concatenate(([0], np.cumsum(sizes[order])))
        first = np.concatenate(([0], np.cumsum(per_bin)))
        base = filled[:-1] - np.repeat(filled[first[:-1]], per_bin)
        counts = (bounds[1:] - bounds[:-1])[order]
        ends = np.cumsum(counts)
        take = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(bounds[:-1][order], counts)
        moved = members.take(pa.array(take))
        offsets = moved.field("offset").to_numpy() + np.repeat(base, counts)
        fields = [pa.array(offsets) if f.name == "offset" else moved.field(f.name).cast(f.type) for f in _MEMBER]
        values = pa.StructArray.from_arrays(fields, fields=list(_MEMBER))
        edges = np.concatenate(([0], ends))[first].astype(np.int32)
        fill = (filled[first[1:]] - filled[first[:-1]]).astype(np.int32)
        return pa.table({"fill": pa.array(fill), "members": pa.ListArray.from_arrays(pa.array(edges), values)})

    return run


def pack_pieces(found: DataFrame, capacity: int = CAPACITY, node_items: int = NODE_ITEMS) -> DataFrame:
    """Bins (``fill``, ``members``) for pieces (``doc_id, piece, start, length, ids_crc32``)."""
    single = found.select(
        F.col("length").cast("int").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))).alias("members")
    )
    done = single.where(F.col("fill") >= capacity - NEARLY_FULL)
    left = single.where(F.col("fill") < capacity - NEARLY_FULL)
    n = left.count()
    while n > 0:
        nodes = -(-n // node_items)
        packed = materialize(left.withColumn("node", F.pmod(F.monotonically_increasing_id(), F.lit(nodes))).groupBy("node").applyInArrow(_drop_node(_pack_node(capacity)), _BINS), "bins")
        done = done.unionByName(packed.where(F.col("fill") >= capacity - NEARLY_FULL))
        left = packed.where(F.col("fill") < capacity - NEARLY_FULL)
        bins, under = packed.agg(F.count(F.lit(1)), F.count_if(F.col("fill") < capacity - NEARLY_FULL)).first()
        saved, n = n - bins, under
        if nodes == 1 or saved < WORTH_IT * (saved + bins):
            break
    return done.unionByName(left)


def _drop_node(pack):
    def run(table: pa.Table) -> pa.Table:
        return pack(table.select(["fill", "members"]))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, node_items: int = NODE_ITEMS) -> DataFrame:
    """One row per piece: where it comes from and its place in a sequence."""
    found = materialize(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    bins = pack_pieces(found, capacity, node_items).select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return bins.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
