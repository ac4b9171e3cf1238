"""WARC archives: writing pages, and reading by boundary-chain verification.

Reading is split by byte ranges.  Nothing in the middle of a file says for sure
that a record begins there: the magic bytes may stand in a payload.  So each
range task lists every *candidate* record with the offset of its successor (in
a gzip archive the end of the member, else the end of the declared length).
Candidates of one range are first followed to where they leave it, then pointer
jumping from offset 0 doubles the hops between ranges until every file's chain
is known: a range that the chain enters has one true entry, and only records
that the chain reaches are returned.  Rounds grow with the logarithm of the
ranges in the largest file; what is joined is 40 bytes for each candidate.

Writing puts one archive for each task into a folder that all executors share;
a manifest row names each finished archive, so files of lost or repeated tasks
are ignored.  Records are gzip members of their own by default.

A file that is damaged or cut short anywhere along its chain is an error that
names it, never a shorter result.

Defined results: a null payload is empty; payloads under ``MIN_REVISIT`` bytes
are always responses; of equal payloads the smallest id is the response and
rows that repeat that id are responses too; a null id is larger than any other;
null or odd URLs are left out or percent-encoded; an empty table gives no
archives and an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_path

MIN_REVISIT = 100
SPLIT_BYTES = 32 << 20
FILE_BYTES = 1 << 30
MAGIC = {"gzip": b"\x1f\x8b\x08", "none": b"WARC/1."}
_ID = "urn:page:"

MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
_LINKS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("range", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("successor", T.LongType()),
        T.StructField("exit", T.LongType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


# -- records ---------------------------------------------------------------


def _header(pairs: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None) + b"\r\n"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP header, with the length of the
    payload that it stands for, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%~._-")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<{_ID}{refers_to}>" if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _header(head) + block + b"\r\n\r\n"


def _fields(data: bytes) -> dict[str, str]:
    """Lower-cased header fields of the lines after the first."""
    out = {}
    for line in data.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(data: bytes) -> dict | None:
    """The fields of a record that ``data`` begins with; None if it is none."""
    if not data.startswith(MAGIC["none"]):
        return None
    at = data.find(b"\r\n\r\n")
    head = _fields(data[:at]) if at > 0 else {}
    if not head.get("content-length", "").isdigit():
        return None
    block = data[at + 4 : at + 4 + int(head["content-length"])]
    cut = block.find(b"\r\n\r\n")
    http, payload = (block[:cut], block[cut + 4 :]) if cut >= 0 else (b"", block)

    def number(name: str) -> int | None:
        text = head.get(name, "")[1:-1].removeprefix(_ID)
        return int(text) if text.lstrip("-").isdigit() else None

    stated = head.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = head.get("warc-type")
    if kind == "revisit":
        length, digest = int(_fields(http).get("content-length", 0)), stated
    else:
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if stated and stated != digest:
            raise ValueError(f"payload of {head.get('warc-record-id')} does not match its digest")
    return {
        "page_id": number("warc-record-id"),
        "url": head.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": number("warc-refers-to"),
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": payload,
    }


# -- writing ---------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, first_id``; first_id: the response that
    shares the payload, null where the payload is its own."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    shared = materialize(
        rows.where(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .select("digest", "first_id"),
        "shared",
    )
    return rows.join(shared, "digest", "left")


def write_archives(pages: DataFrame, folder: str, compress: str = "gzip", file_bytes: int = FILE_BYTES, level: int = 3, **columns) -> DataFrame:
    """Write ``pages`` to archives in ``folder``; returns the manifest."""
    suffix = ".warc.gz" if compress == "gzip" else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = out = None
        size = records = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"file": name, "bytes": size, "records": records}], schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                page_id, url, payload, digest, first = row
                revisit = first is not None and first != page_id
                data = build_record(page_id, url, payload, digest, first, revisit)
                if compress == "gzip":
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                if out is None:
                    name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{suffix}"
                    out, size, records = fs.open_output_stream(f"{base}/{name.rpartition('/')[2]}", compression=None), 0, 0
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    rows = plan_records(pages, **columns).select("page_id", "url", "payload", "digest", "first_id")
    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


# -- reading ---------------------------------------------------------------


class _Window:
    """Bytes of a file from some offset on, read as far as asked for."""

    def __init__(self, source, size: int, start: int, end: int) -> None:
        self.source, self.size, self.start = source, size, start
        self.data = source.read_at(max(0, min(end, size) - start), start)

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        found = self.source.read_at(min(self.size - at, max(1 << 16, len(self.data) // 4)), at)
        self.data += found
        return bool(found)

    def record(self, at: int, codec: str) -> tuple[bytes, int] | None:
        """The record that begins at file offset ``at`` and its successor's
        offset, or None if no record begins there."""
        k = at - self.start
        if codec == "gzip":
            inflate = zlib.decompressobj(31)
            out, fed = [], k
            try:
                while not inflate.eof:
                    if fed >= len(self.data) and not self.more():
                        return None
                    out.append(inflate.decompress(self.data[fed : fed + (1 << 16)]))
                    fed = min(len(self.data), fed + (1 << 16))
                    if len(out) == 1 and not out[0].startswith(MAGIC["none"][: len(out[0])]):
                        return None
            except zlib.error:
                return None
            data = b"".join(out)
            return (data, self.start + fed - len(inflate.unused_data)) if data.startswith(MAGIC["none"]) else None
        while (head := self.data.find(b"\r\n\r\n", k)) < 0:
            if len(self.data) - k > 1 << 20 or not self.more():
                return None
        length = _fields(self.data[k:head]).get("content-length", "")
        if not self.data.startswith(MAGIC["none"], k) or not length.isdigit():
            return None
        end = head + 4 + int(length) + 4
        if self.start + end > self.size:
            return None
        while len(self.data) < end:
            if not self.more():
                return None
        return (self.data[k : end - 4], self.start + end) if self.data[end - 4 : end] == b"\r\n\r\n" else None


def _ranges(manifest: DataFrame, split_bytes: int) -> DataFrame:
    return manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("bytes", F.lit(1)) - 1) / split_bytes))).alias("range"))


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def _codec(path: str) -> str:
    return "gzip" if path.endswith(".gz") else "none"


def candidate_links(ranges: DataFrame, split_bytes: int) -> DataFrame:
    """Every place where a record might begin, its successor, and where the
    chain from there leaves the range."""
    names = [f.name for f in _LINKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, k in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codec, start, end = _codec(file), k * split_bytes, min(size, (k + 1) * split_bytes)
                magic = MAGIC[codec]
                with _open(file) as source:
                    window = _Window(source, size, start, min(size, end + len(magic) - 1))
                    follows, at = {}, window.data.find(magic)
                    while 0 <= at < end - start:
                        if found := window.record(start + at, codec):
                            follows[start + at] = found[1]
                        at = window.data.find(magic, at + 1)
                leaves: dict[int, int] = {}
                for at in sorted(follows, reverse=True):
                    leaves[at] = leaves.get(follows[at], follows[at])
                rows = [(file, k, at, follows[at], leaves[at]) for at in sorted(follows)]
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows) if rows else [[]] * 5)), schema=pa.schema([("file", pa.string()), *((n, pa.int64()) for n in names[1:])]))

    return ranges.mapInArrow(run, _LINKS)


def chain_entries(links: DataFrame, most_ranges: int) -> DataFrame:
    """``file, offset``: where the chain from the file's start enters a range.

    ``reached`` doubles with ``jump`` in every round.
    """
    jump = links.select("file", "offset", "exit")
    nodes = links.select("file", "offset")
    reached = links.where("offset = 0").select("file", "offset")
    hops = 1
    while hops < most_ranges:
        step = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = materialize(reached.unionByName(step.join(nodes, ["file", "offset"], "left_semi")).distinct(), "reached")
        hops *= 2
        if hops < most_ranges:
            on = jump.select(F.col("file").alias("f"), F.col("offset").alias("o"), F.col("exit").alias("e"))
            jump = materialize(jump.join(on, (F.col("file") == F.col("f")) & (F.col("exit") == F.col("o"))).select("file", "offset", F.col("e").alias("exit")), "jump")
    return reached


def _require_whole(manifest: DataFrame, links: DataFrame, entries: DataFrame) -> None:
    """Raise unless the chain of every file begins at its start and, from each
    entry, leads to another record or to the file's end."""
    begun = entries.where("offset = 0").select("file")
    lost = manifest.where("bytes > 0").select("file", "bytes").join(begun, "file", "left_anti").select("file", F.lit(0).cast("long").alias("at"))
    exits = entries.join(links.select("file", "offset", "exit"), ["file", "offset"]).join(manifest.select("file", "bytes"), "file")
    records = links.select("file", F.col("offset").alias("exit"))
    torn = exits.where(F.col("exit") != F.col("bytes")).join(records, ["file", "exit"], "left_anti").select("file", F.col("exit").alias("at"))
    broken = lost.unionByName(torn).limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0]['file']}: no whole record at byte {broken[0]['at']}")


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records (``RECORD``) of the archives that ``manifest`` (file, bytes) names."""
    schema = T.StructType([f for f in RECORD if payloads or f.name != "payload"])
    arrow = pa.schema([(f.name, pa.binary() if f.name == "payload" else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in schema])
    ranges = _ranges(manifest, split_bytes)
    tasks = max(1, ranges.count())
    links = materialize(candidate_links(ranges.repartition(tasks, "file", "range"), split_bytes), "links")
    most = ranges.agg(F.max("range")).first()[0] or 0
    entries = materialize(chain_entries(links, most + 1), "entries")
    _require_whole(manifest, links, entries)
    entries = entries.withColumn("range", F.floor(F.col("offset") / split_bytes)).join(manifest.select("file", "bytes"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codec, end, rows, held = _codec(file), (at // split_bytes + 1) * split_bytes, [], 0
                with _open(file) as source:
                    window = _Window(source, size, at, min(size, end))
                    while at < min(end, size):
                        if (found := window.record(at, codec)) is None:
                            raise ValueError(f"{file}: no whole record at byte {at}")
                        data, after = found
                        row = {"file": file, "offset": at, **parse_record(data)}
                        rows.append(row if payloads else {k: v for k, v in row.items() if k != "payload"})
                        held, at = held + len(data), after
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return entries.select("file", "bytes", "offset").repartition(tasks, "file", "offset").mapInArrow(run, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    manifest = write_archives(pages, new_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
