"""Token ids from the tokenizers library, with a cache of words.

The library takes microseconds for each word, and most words come again.  Both
kinds of vocabulary used here cut a text at white space before they look for
tokens, so the ids of a text are the ids of its space-separated segments in a
row.  Each segment is encoded by the library once in a worker and then looked
up.  A text is cut only at spaces between two characters that are not white
space, where no token of the library can reach across; tokenizers of another
make get whole texts.

``encode_all`` takes a batch of texts: Arrow cuts all of them at once and names
each distinct segment by a number; those that the worker knows are found by Arrow
as well, and only new ones become Python's strings.  The ids are put in place by
number.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import held

#: Entries of the caches of segments and of their pieces; the first words of a
#: corpus are its frequent ones.
MAX_SEGMENTS, MAX_PIECES = 300_000, 400_000

#: Letters and digits up to U+024F, which have the same class in every version
#: of Unicode in use; segments with characters beyond go to the library whole.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
# fixed values: the split patterns of the two vocabularies, for those characters
BYTE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
WORD_SPLIT_SOURCE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The same with a mark after each segment, which no piece contains.
_MARK = "\0"
MARKED_BYTE_SPLIT = re.compile(rf"\0|'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}\0]+|\s+(?![^\s\0])|\s+")
MARKED_WORD_SPLIT = re.compile(rf"\0|'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}\0]+")

#: White space other than the space, for which a text takes the careful cut.
_ODD_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_CAREFUL = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = r" [ \t\n\r]|[\t\n\r] |[" + _ODD_SPACE + "]"
_PLAIN = re.compile("[\x01-\x1b\x20-\x7f\xa1-\u024f]*\\Z")
_PLAIN_LINE = re.compile("[\x00-\x1b\x20-\x7f\xa1-\u024f]*\\Z")

#: Characters of text that are encoded at a time.
SLICE_CHARS = 2 << 20


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter: itself
    where it is one, else the next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()
#: The same, but for the mark.
_MARKED_LETTERS = {b: x for b, x in _LETTERS.items() if chr(b) != _MARK}
_id = attrgetter("id")


class _Cache(dict):
    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value

    def fill(self, keys: list[str], values: list[bytes]) -> None:
        """Keeps what there is room for."""
        if (room := self.most - len(self)) > 0:
            self.update(zip(keys[:room], values))


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, source: str) -> None:
        self.tokenizer = Tokenizer.from_str(source)
        about = json.loads(source)
        self.added = [x["content"] for x in about["added_tokens"]]
        #: Texts that are not cut at every space.
        self.odd = "|".join([_UNEVEN, *map(re.escape, self.added)])
        before, split = about.get("normalizer"), about.get("pre_tokenizer") or {}
        self.kind = "whole"
        if about.get("post_processor") is None and about["model"]["type"] == "BPE" and not any(" " in x for x in self.added):
            if before is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
                self.kind, self.pattern, self.marked = "byte", BYTE_SPLIT, MARKED_BYTE_SPLIT
            elif before is not None and WORD_SPLIT_SOURCE in json.dumps(split).replace("\\\\", "\\"):
                self.kind, self.pattern, self.marked = "word", WORD_SPLIT, MARKED_WORD_SPLIT
        self.pieces = _Cache(self._piece, MAX_PIECES)
        self.pieces[_MARK] = b""
        self.rest = _Cache(self._after_space if self.kind == "byte" else self._segment, MAX_SEGMENTS)
        #: What ``encode_all`` knows: segments, their ids in a row, how many each has.
        self.known, self.flat, self.size = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_LETTERS)
        return array("I", map(_id, self.tokenizer.model.tokenize(letters))).tobytes()

    def _named(self, pieces: list[str]) -> list[bytes]:
        """The ids of many pieces, of which marks have none; new ones are spelt in
        letters in a row."""
        found = [*map(self.pieces.get, pieces)]
        new = [k for k, x in enumerate(found) if x is None]
        names = [*dict.fromkeys([pieces[k] for k in new])]
        if names:
            letters = _MARK.join(names).encode().decode("latin-1").translate(_MARKED_LETTERS).split(_MARK)
            made = [array("I", map(_id, x)).tobytes() for x in map(self.tokenizer.model.tokenize, letters)]
            self.pieces.fill(names, made)
            given = dict(zip(names, made))
            for k in new:
                found[k] = given[pieces[k]]
        return found

    def _segment(self, segment: str) -> bytes:
        # what is split is the normalised text: lower-case forms of plain capitals may lie beyond the class
        plain = segment if self.kind == "byte" or not _PLAIN.match(segment) else segment.lower()
        if not _PLAIN.match(plain):
            return self.library(segment)
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(plain)))

    def _after_space(self, segment: str) -> bytes:
        return self._segment(" " + segment)

    def _line(self, segments: list[str]) -> list[bytes] | None:
        """The ids of each piece, and an empty value after each segment, which are
        split in a row with a mark between them; none if one is not plain."""
        space = " " if self.kind == "byte" else ""
        line = space + (_MARK + space).join(segments) + _MARK
        plain = line if self.kind == "byte" else line.lower()
        if line.count(_MARK) > len(segments) or not (_PLAIN_LINE.match(line) and (plain is line or _PLAIN_LINE.match(plain))):
            return None
        return self._named(self.marked.findall(plain))

    def _many(self, segments: list[str]) -> tuple[bytes, np.ndarray]:
        """The ids of many segments in a row, and how many each has."""
        if not segments:
            return b"", np.zeros(0, np.int64)
        found = self._line(segments)
        if found is None:
            fit = [bool(_PLAIN.match(x) and _PLAIN.match(x.lower())) for x in segments]
            if all(fit):
                fit = [False] * len(segments)
            plain, n = self._many([x for x, ok in zip(segments, fit) if ok])
            stops = (np.cumsum(n) * 4).tolist()
            good = iter(zip([0, *stops], stops))
            made = [plain[slice(*next(good))] if ok else self.rest.make(x) for x, ok in zip(segments, fit)]
            return b"".join(made), np.fromiter(map(len, made), np.int64, len(made)) // 4
        size = np.fromiter(map(len, found), np.int64, len(found))
        return b"".join(found), np.diff(np.cumsum(size)[size == 0], prepend=0) // 4

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "whole" or any(x in text for x in self.added):
            return self.library(text)
        if re.search(_UNEVEN, text):
            first, *rest = _CAREFUL.split(text)
        else:
            first, *rest = text.split(" ")
        return self._segment(first) + b"".join(map(self.rest.__getitem__, rest))

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the id ``end``, in a row, and
        where each text begins (one more entry than texts)."""
        heads, tails = [], []
        odd = pc.fill_null(pc.match_substring_regex(texts, self.odd), True).to_pylist()
        for text, other in zip(texts.to_pylist(), odd):
            if text and self.kind != "whole" and not other:
                head, space, tail = text.partition(" ")
                heads.append(self._segment(head))
                tails.append(tail if space else None)
            else:
                heads.append(self.encode(text))
                tails.append(None)
        parts = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        named = parts.flatten().dictionary_encode()
        codes = named.indices.to_numpy()
        n_parts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy().astype(np.int64)
        # segments that are known come first, then the new ones, the heads, the end
        place = pc.fill_null(pc.index_in(named.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        new, n_known = place < 0, len(self.known)
        unknown = named.dictionary.filter(pa.array(new))
        made, made_size = self._many(unknown.to_numpy(zero_copy_only=False).tolist())
        place[new] = n_known + np.arange(len(unknown))
        ends = [*heads, end.to_bytes(4, "little")]
        flat = np.concatenate((self.flat, np.frombuffer(made + b"".join(ends), "<u4")))
        size = np.concatenate((self.size, made_size, np.fromiter(map(len, ends), np.int64, len(ends)) // 4))
        at = np.cumsum(size) - size
        if (room := min(MAX_SEGMENTS - n_known, len(unknown))) > 0:
            self.known = pa.concat_arrays([self.known, unknown.slice(0, room)])
            self.flat, self.size = flat[: at[n_known + room]].copy(), size[: n_known + room].copy()
        # the pieces of text k: its head, its other segments, the end
        n = len(heads)
        last = np.cumsum(n_parts + 2)
        first = last - n_parts - 2
        order = np.empty(int(last[-1]) if n else 0, np.int64)
        middle = np.ones(len(order), bool)
        middle[first], middle[last - 1] = False, False
        order[middle] = place[codes]
        order[first] = n_known + len(unknown) + np.arange(n)
        order[last - 1] = len(size) - 1
        sizes = size[order]
        stops = np.cumsum(sizes)
        ids = flat[np.arange(int(stops[-1]) if n else 0) + np.repeat(at[order] - stops + sizes, sizes)]
        return ids, np.concatenate(([0], stops[last - 1]))


def encoder(source: str) -> Encoder:
    """The encoder of a vocabulary file's text; one in each Python worker."""
    return held("encoder " + hashlib.sha256(source.encode()).hexdigest(), lambda: Encoder(source))


def slices(column: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """Runs of a column of texts of about ``most`` bytes, or one longer text, with
    the row that each begins at."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(column):
        before = int(total[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield at, column.slice(at, stop - at)
        at = stop
