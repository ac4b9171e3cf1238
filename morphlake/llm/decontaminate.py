"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items are normalised to words: A-Z lower-cased, every
other ASCII character but 0-9 and a-z a separator, every character beyond ASCII
part of a word.  Normalising maps UTF-8 byte to byte, so word positions map
straight back to the original.  The windows of all items go into one automaton,
and each text is scanned once.

The windows are broadcast only up to ``MAX_ITEMS_BYTES``; a larger benchmark is
cut into parts of that size and scanned part by part, the hits being carried
along, with the same result.

Defined results: a null or empty text has no words, no hits and is not
contaminated; a null or empty item has no window; an item with fewer words than
the window is one window; items that share a window are all found; a null item
id reads ``null``; repeated item ids count once; repeated documents are judged
row by row; further columns stay as they are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, materialize, spare_name

WINDOW = 13
#: A document is contaminated if it has hits and at least one word in SHARE is hit.
SHARE = 20
#: An automaton takes about 0.6 MB for each KB of items (measured, 13-word windows).
MAX_ITEMS_BYTES = 1 << 19

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
CARRIED = T.StructType([T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
_FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_CARRIED_ARROW = pa.struct([("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def normalised(text: str | None) -> bytes:
    """The text's UTF-8 with every byte outside a word a space; same length."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES)


class Windows:
    """The automaton over all windows of some items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        owners: dict[bytes, tuple[int, set[str]]] = {}
        for item, text in items:
            words = normalised(text).split()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                part = words[i : i + window]
                owners.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(item)
        self.owners = list(owners.values())
        self.automaton = ahocorasick.Automaton() if owners else None
        for k, pattern in enumerate(owners):
            self.automaton.add_word(pattern.decode("latin-1"), (k, len(pattern)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None: none), and the items found."""
        if self.automaton is None or not words:
            return None, set()
        line = b" " + b" ".join(words) + b" "
        hit, items, starts = None, set(), None
        for end, (k, length) in self.automaton.iter(line.decode("latin-1")):
            if hit is None:
                hit, starts = np.zeros(len(words), bool), np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            n, owned = self.owners[k]
            at = int(np.searchsorted(starts, end - length + 1))
            hit[at : at + n] = True
            items |= owned
        return hit, items


def _spans(norm: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code point offsets in the original text."""
    data = np.frombuffer(norm, np.uint8)
    in_word = np.concatenate(([0], (data != 32).astype(np.int8), [0]))
    edge = np.diff(in_word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    runs = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b]])} for a, b in zip(first, last)]


def _judge(norm: bytes, n: int, hit: np.ndarray | None, items: set[str]) -> dict:
    n_hit = 0 if hit is None else int(hit.sum())
    return {
        "n_words": n,
        "n_hit": n_hit,
        "n_items": len(items),
        "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
        "contaminated": n_hit > 0 and SHARE * n_hit >= n,
        "spans": _spans(norm, hit) if n_hit else [],
    }


def annotate(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_bytes: int = MAX_ITEMS_BYTES) -> DataFrame:
    """``docs`` and a struct column ``name`` (see ``FOUND``) that says what was found."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    parts = -(-size // max_bytes) or 1
    carry = spare_name(docs, "carried")
    found = docs
    for k in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        last = k == parts - 1
        shipped = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in mine.collect()])
        found = _scanned(found, shipped, uuid.uuid4().hex, window, text_col, carry, k > 0, last, name)
        if not last:
            found = materialize(found, "carried")
    return found


def _scanned(docs: DataFrame, shipped, key: str, window: int, text_col: str, carry: str, carried: bool, last: bool, name: str) -> DataFrame:
    keep = [c for c in docs.columns if c != carry]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, FOUND) if last else T.StructField(carry, CARRIED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = held(key, lambda: Windows(shipped.value, window))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            before = batch.column(batch.schema.get_field_index(carry)).to_pylist() if carried else [None] * len(texts)
            out = []
            for text, was in zip(texts, before):
                norm = normalised(text)
                words = norm.split()
                hit, found = windows.scan(words)
                if was and was["hits"]:
                    hit = np.zeros(len(words), bool) if hit is None else hit
                    hit[was["hits"]] = True
                    found = found | set(was["items"])
                if last:
                    out.append(_judge(norm, len(words), hit, found))
                else:
                    out.append({"hits": [] if hit is None else np.flatnonzero(hit).tolist(), "items": sorted(found)})
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, _FOUND_ARROW if last else _CARRIED_ARROW)], [*keep, name if last else carry])

    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id`` and the fields of ``FOUND``."""
    found = annotate(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "found", "text", **options)
    return found.select("doc_id", "found.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows; columns as they came."""
    name = spare_name(docs, "found")
    found = annotate(docs, benchmark, name, text_col, **options)
    return found.where(~F.col(name)["contaminated"]).select(*docs.columns)
