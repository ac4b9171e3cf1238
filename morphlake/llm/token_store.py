"""A content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of the last ids says so,
and every chunk is known by its BLAKE2 digest.  A folder holds

``all/``       Parquet: rows of kind ``chunks`` (``key``: digest, ``n``, ``ids``),
               each distinct chunk once, ids as little-endian unsigned integers
               of ``width`` bytes, and the recipes as the tasks made them;
``recipes/``   Parquet in ascending id order: ``part, idx, doc_id, n_tokens,
               before, root, chunks`` - the document's ordered digests, ``root``
               their digest, ``before`` the ids ahead of it within its part;
``manifest/``  JSON, one row for each block of ``BLOCK`` documents of a part: its
               documents, ids, and the Merkle root of its documents' roots.

Reading verifies every chunk against its digest and every document and block
against its root.  Checksums of whole documents come from their chunks'
checksums by CRC combination, so contents are read once and never shuffled;
``read_documents`` joins the contents themselves.

Tasks send a chunk once for each ``SENT`` distinct chunks however often it occurs
in them, so a chunk of a third of all documents is about as many rows as there
are tasks.  Equal chunks then meet in one partition, sorted, and the first of
each is written: no state grows with the data.  Recipes are dealt evenly.

A chunk stored once cannot stand in the order of every document that holds it,
so contents lie in an order made from their digests; what ascends with the ids of the
documents are the recipes, which say in which order the ids follow each other.

Defined results: a null or empty text is the end id alone; repeated rows are
stored as rows of their own that share chunks; equal ids go by their content;
a null id comes first; an empty table gives an empty store; further columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .tokens import encoder, slices

END_ID = 2
ROLL = 8
MIN_CHUNK, MASK, MAX_CHUNK = 64, 0xFF, 1024
#: Digests that a task remembers, and bytes of contents for each partition.
SENT, PART_BYTES = 50_000, 64 << 20
#: Bytes of text that are encoded at a time: the more, the fewer distinct segments in all.
SLICE_BYTES = 6 << 20
_POSITIVE = np.int64((1 << 63) - 1)
_SCATTER, _ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def cuts(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of documents end, and how many each document has.

    bounds: where each document begins in ``ids``, and the end.  A chunk ends
    after an id at which the hash of the last ROLL ids has its low bits clear, at
    least MIN_CHUNK and at most MAX_CHUNK ids on.  No cut is closer than
    MIN_CHUNK to a document's begin, so hashes that reach across do not matter.
    """
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _SCATTER
    mixed ^= mixed >> np.uint64(29)
    rolling, weight = mixed.copy(), _ROLL
    for k in range(1, ROLL):
        rolling[k:] += mixed[:-k] * weight
        weight = np.uint64(int(weight) * int(_ROLL) & 0xFFFFFFFFFFFFFFFF)
    places = np.flatnonzero((rolling >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
    edges = np.searchsorted(places, bounds).tolist()
    at, begins = places.tolist(), bounds.tolist()
    ends, counts = [], []
    for k, (last, n) in enumerate(zip(begins, begins[1:])):
        had = len(ends)
        for place in at[edges[k] : edges[k + 1]]:
            while place - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if place - last >= MIN_CHUNK:
                ends.append(place)
                last = place
        while n - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if last < n:
            ends.append(n)
        counts.append(len(ends) - had)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def digest(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


# -- CRC-32 of joined pieces ----------------------------------------------

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def _power(n_bytes: int) -> int:
    """x to the 8 * n_bytes, the factor that ``n_bytes`` more bytes put on a CRC."""
    out, base = 1 << 31, 1 << 23
    while n_bytes:
        if n_bytes & 1:
            out = _times(out, base)
        base, n_bytes = _times(base, base), n_bytes >> 1
    return out


_powers: dict[int, int] = {}


def _join_crc(crc: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of ``crc``'s contents followed by contents with CRC ``more``."""
    values, back = np.unique(lengths, return_inverse=True)
    for v in values.tolist():
        if v not in _powers:
            _powers[v] = _power(v)
    factor = np.array([_powers[v] for v in values.tolist()], np.uint32)[back]
    out, b = np.zeros_like(crc), crc.copy()
    for k in range(31, -1, -1):
        out ^= np.where(factor >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out ^ more


# -- writing ---------------------------------------------------------------

_ROWS = "kind string, deal long, key binary, n long, ids binary, doc_id long, chunks array<binary>"
_ROWS_ARROW = pa.schema([("kind", pa.string()), ("deal", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("chunks", pa.list_(pa.binary()))])
_RECIPES = "part long, idx long, doc_id long, n_tokens long, before long, root binary, chunks array<binary>"
_SIZE = 16


def _rows(kind: str, many: int, **columns) -> pa.RecordBatch:
    """A batch of ``_ROWS``; columns left out are null."""
    columns["kind"] = pa.array([kind] * many)
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(many, f.type)) for f in _ROWS_ARROW], schema=_ROWS_ARROW)


def _pieces(data: bytes, bounds: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as binary values that share it."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _digests(keys: bytes) -> pa.Array:
    return _pieces(keys, np.arange(0, len(keys) + 1, _SIZE))


def _encoded(docs: DataFrame, source, end_id: int, width: int) -> DataFrame:
    """Chunk rows (key: digest) and recipe rows (key: root) of all documents; deal is
    made from a chunk's digest, and negative for recipes, so that a number sorts both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent, made = encoder(source.value).encode_all, set(), 0
        task = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE_BYTES):
                ids, bounds = encode(texts, end_id)
                if len(ids) and int(ids.max()) >> 8 * width:
                    raise ValueError(f"ids of this vocabulary do not fit in {width} bytes")
                data = ids.astype(f"<u{width}").tobytes()
                view = memoryview(data)
                ends, counts = cuts(ids, bounds)
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                keys, new = [], []
                for k, (a, b) in enumerate(zip((begins * width).tolist(), (ends * width).tolist())):
                    key = digest(view[a:b])
                    keys.append(key)
                    if key not in sent:
                        sent.add(key)
                        new.append(k)
                if len(sent) > SENT:
                    sent.clear()
                joined = b"".join(keys)
                chosen = pa.array(new, pa.int64())
                hashes, contents = _digests(joined), _pieces(data, np.concatenate((begins, ends[-1:])) * width)
                deal = pa.array(np.frombuffer(joined, "<i8")[::2] & _POSITIVE)
                yield _rows("chunks", len(new), deal=deal.take(chosen), key=hashes.take(chosen), n=pa.array(ends - begins).take(chosen), ids=contents.take(chosen))
                stops = np.cumsum(counts)
                edges = np.concatenate(([0], stops)) * _SIZE
                roots = b"".join(digest(joined[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist()))
                lists = pa.ListArray.from_arrays(pa.array((edges // _SIZE).astype(np.int32)), hashes)
                yield _rows("recipes", len(texts), deal=pa.array(task.integers(-(1 << 62), 0, len(texts))), key=_digests(roots), n=pa.array(np.diff(bounds)), doc_id=batch.column(0).slice(at, len(texts)), chunks=lists)

    return docs.mapInArrow(run, _ROWS)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk once; equal digests follow each other."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(2).to_pylist()
        chunk = np.array(pc.equal(batch.column(0), "chunks"))
        other = np.fromiter((a != b for a, b in zip(keys, [last, *keys[:-1]])), bool, len(keys))
        last = keys[-1] if chunk[-1] else None
        yield batch.filter(pa.array(other | ~chunk))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the recipes of a part and counts the ids before each."""
    part, idx, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ahead = before + np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), part)), pa.array(np.arange(idx, idx + len(n))), batch.column(0), batch.column(1), pa.array(ahead), batch.column(2), batch.column(3)],
            ["part", "idx", "doc_id", "n_tokens", "before", "root", "chunks"],
        )
        idx, before = idx + len(n), before + int(n.sum())


def _block_root(table: pa.Table) -> pa.Table:
    """The Merkle root over the documents of one block, and its totals."""
    table = table.sort_by("idx")
    level = table.column("root").to_pylist()
    while len(level) > 1:
        level = [digest(b"".join(level[k : k + 2])) for k in range(0, len(level), 2)]
    n = table.column("n_tokens").to_numpy()
    return pa.table({"part": table.column("part").slice(0, 1), "block": table.column("block").slice(0, 1), "documents": [len(n)], "ids": [int(n.sum())], "merkle_root": [level[0].hex()]})


#: Documents of a Merkle tree.
BLOCK = 4096
_MANIFEST = "part long, block long, documents long, ids long, merkle_root string"


def _parts(docs: DataFrame) -> int:
    """Partitions of the store: by the size of the files that are read, which Spark
    knows, or else by that of the texts."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 58:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = 2) -> None:
    """Encode ``docs`` into a new store in ``folder``; ids that do not fit in
    ``width`` bytes are an error."""
    spark = docs.sparkSession
    with open(tokenizer_path) as f:
        source = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = _parts(rows)
    (
        _encoded(rows, source, end_id, width)
        .repartition(n, "deal")
        .sortWithinPartitions("deal", "key")
        .mapInArrow(_first_of_each, _ROWS)
        .write.option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "1")
        .option("parquet.enable.dictionary#ids", "false")
        .parquet(f"{folder}/all")
    )
    listed = _read(spark, f"{folder}/all", "recipes").select("doc_id", F.col("n").alias("n_tokens"), F.col("key").alias("root"), "chunks")
    ordered = listed.repartitionByRange(n, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered.mapInArrow(_in_order, _RECIPES).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _manifest(spark.read.parquet(f"{folder}/recipes")).write.json(f"{folder}/manifest")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(path).where(F.col("kind") == kind)


def _manifest(recipes: DataFrame) -> DataFrame:
    rows = recipes.select("part", F.floor(F.col("idx") / BLOCK).alias("block"), "idx", "n_tokens", "root")
    return rows.groupBy("part", "block").applyInArrow(_block_root, _MANIFEST)


# -- reading ---------------------------------------------------------------


def _checked_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, contents, crcs, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            wide, at = memoryview(np.frombuffer(b"".join(contents), f"<u{width}").astype("<u4").tobytes()), 0
            for key, data in zip(keys, contents):
                if digest(data) != key:
                    raise ValueError(f"chunk {key.hex()} does not match its digest")
                n = len(data) // width
                crcs.append(zlib.crc32(wide[4 * at : 4 * (at + n)]))
                sizes.append(n)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["key", "crc", "size"])

    return run


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks each recipe and joins its chunks' checksums."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        doc_id, start, n_tokens, root, parts = (batch.column(k) for k in range(5))
        bounds, flat = parts.offsets.to_numpy(), parts.values
        keys = flat.field("key").to_pylist()
        crcs, sizes = flat.field("crc").to_numpy().astype(np.uint32), flat.field("size").to_numpy()
        firsts, counts = bounds[:-1], bounds[1:] - bounds[:-1]
        for a, n, want, total in zip(firsts.tolist(), counts.tolist(), root.to_pylist(), n_tokens.to_pylist()):
            if digest(b"".join(keys[a : a + n])) != want or int(sizes[a : a + n].sum()) != total:
                raise ValueError(f"a document does not match its root {want.hex()}")
        order = np.argsort(-counts, kind="stable")
        firsts, counts = firsts[order], counts[order]
        crc = crcs[firsts]
        for k in range(1, int(counts[0]) if len(counts) else 0):
            live = int(np.searchsorted(-counts, -k, "left"))
            at = firsts[:live] + k
            crc[:live] = _join_crc(crc[:live], crcs[at], sizes[at] * 4)
        back = np.empty(len(crc), np.int64)
        back[order] = crc
        yield pa.RecordBatch.from_arrays([doc_id, start, n_tokens, pa.array(back)], names)


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids ahead of each part; a row for each part."""
    manifest = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").groupBy("part").agg(F.sum("ids").alias("ids"))
    ahead = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ids")
    return manifest.select("part", ahead.alias("ahead"))


def read_checksums(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the store."""
    stored = spark.read.parquet(f"{folder}/recipes")
    said = spark.read.schema(_MANIFEST).json(f"{folder}/manifest")
    wrong = _manifest(stored).join(said.withColumnRenamed("merkle_root", "said"), ["part", "block", "documents", "ids"], "full").where(~F.col("said").eqNullSafe(F.col("merkle_root")))
    if not wrong.isEmpty():
        raise ValueError("the recipes do not match the manifest")
    chunks = _read(spark, f"{folder}/all", "chunks").select("key", "ids").mapInArrow(_checked_chunks(width), "key binary, crc long, size long")
    spread = stored.select("part", "idx", F.posexplode("chunks").alias("pos", "key"))
    listed = (
        spread.join(chunks, "key")
        .groupBy("part", "idx")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "key", "crc", "size"))).alias("parts"))
    )
    heads = stored.select("part", "idx", "doc_id", "n_tokens", "before", "root").join(_starts(spark, folder), "part")
    return (
        heads.join(listed, ["part", "idx"])
        .select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "root", "parts")
        .mapInArrow(_combined, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def read_documents(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """``doc_id, start, ids``: the documents themselves, ids as an array."""
    stored = spark.read.parquet(f"{folder}/recipes")
    contents = _read(spark, f"{folder}/all", "chunks").select("key", "ids")
    joined = (
        stored.select("part", "idx", F.posexplode("chunks").alias("pos", "key"))
        .join(contents, "key")
        .groupBy("part", "idx")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.frombuffer(b"".join(p["ids"] for p in parts), f"<u{width}").astype(np.int64).tolist() for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    heads = stored.select("part", "idx", "doc_id", "before").join(_starts(spark, folder), "part")
    return heads.join(joined, ["part", "idx"]).select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "parts").mapInArrow(run, "doc_id long, start long, ids array<long>")


def store_round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` to a store in the shared folder and read it back."""
    folder = new_path(spark, "token_store")
    write_store(docs, folder, tokenizer_path)
    return read_checksums(spark, folder)
