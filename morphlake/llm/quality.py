"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` consecutive words.  Labels are
known for documents only, so which passages speak for a label is learned too:

* every passage is encoded: shares of byte classes and of pairs of them inside
  its words, how many words repeat, word lengths; then one layer of ``tanh``;
* gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))`` over all
  passages of the document, weighs them;
* the weighted passage representation is scored by a logistic layer.

All weights are learned together from document labels by gradient descent, on
the driver, on a bounded sample of labelled rows: ``MAX_PER_LABEL`` documents a
label, lowest hash of the id first, among those of at most ``MAX_SAMPLE_CHARS``
characters.  Sampled rows weigh as much as the rows that they stand for, so
scores are probabilities of the table, not of the sample.

Scoring reads whole texts of any length: a text is encoded in pieces of about
``PIECE`` bytes, cut between passages, and the attention's softmax is merged
from piece to piece, so memory does not grow with a text.

Defined results: a null or empty text, or one of blanks, is one passage without
words; rows with a null label teach nothing; ids with several labels are good
if one is; of rows that repeat an id the shortest text (then the least) teaches;
repeated rows score alike; a null id hashes as the empty text; with labels of
one kind, or none, every score is their mean (1 without labels); an empty table
gives an empty result; further columns stay out of the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held

MAX_PER_LABEL, MAX_SAMPLE_CHARS = 2000, 20_000
FOLDS, HELD_OUT = 4, 2
PASSAGE, PIECE = 64, 1 << 20
ENCODED, GATES = 24, 12
EPOCHS, RATE, DECAY = 120, 0.02, 1e-4
THRESHOLD = 0.7

#: Classes of bytes: blank, lower, upper, digit, beyond ASCII, control, and every sign.
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, 5, np.uint8)
_CLASS[list(b" \t\n\v\f\r")] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 4
_CLASS[list(_SIGNS)] = 6 + np.arange(len(_SIGNS))
_N_CLASS = 6 + len(_SIGNS)
#: For pairs signs fall into few groups: ends of sentences, quotes and brackets, the rest.
_GROUP = np.minimum(_CLASS, 6)
_GROUP[list(b".,;:?!")] = 7
_GROUP[list(b"\"'()[]{}<>")] = 8
_N_GROUP = 9
FEATURES = _N_CLASS + _N_GROUP**2 + 6
_POWERS = np.cumprod(np.concatenate(([1], np.full(255, 0x9E3779B97F4A7C15, np.uint64))), dtype=np.uint64)


def held_out(id_col: Column) -> Column:
    """Rows whose crc32 of the id as text leaves HELD_OUT modulo FOLDS."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


# -- passages --------------------------------------------------------------


def passages(data: np.ndarray) -> np.ndarray:
    """Features of each passage of the text with these bytes; one row of zeros
    for a text without words."""
    inside = _CLASS[data] != 0
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    at = np.flatnonzero(inside)
    word = np.cumsum(np.concatenate(([False], np.diff(at) > 1))) if len(at) else at
    n = -(-len(starts) // PASSAGE)
    home = word // PASSAGE
    first = data[at]
    follows = np.concatenate((data[1:], [32]))[at]
    size = np.bincount(home, minlength=n).astype(np.float64)
    out = np.empty((n, FEATURES), np.float32)
    classes = np.bincount(home * _N_CLASS + _CLASS[first], minlength=n * _N_CLASS).reshape(n, _N_CLASS)
    pairs = np.bincount(home * _N_GROUP**2 + _GROUP[first].astype(np.int64) * _N_GROUP + _GROUP[follows], minlength=n * _N_GROUP**2).reshape(n, -1)
    out[:, :_N_CLASS] = np.sqrt(classes / size[:, None])
    out[:, _N_CLASS:-6] = np.sqrt(pairs / size[:, None])
    place = at - starts[word]
    mark = np.add.reduceat((first.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, 255)], np.flatnonzero(np.concatenate(([True], np.diff(word) > 0))))
    length = np.bincount(word).astype(np.float64)
    bag = np.arange(len(starts)) // PASSAGE
    words = np.bincount(bag, minlength=n).astype(np.float64)
    order = np.lexsort((mark, bag))
    new = np.concatenate(([True], (np.diff(mark[order]) != 0) | (np.diff(bag[order]) != 0)))
    same = np.concatenate(([False], (mark[1:] == mark[:-1]) & (bag[1:] == bag[:-1])))
    mean = np.bincount(bag, length, n) / words
    out[:, -6] = np.bincount(bag[order], new, n) / words
    out[:, -5] = np.bincount(bag, same, n) / words
    out[:, -4] = np.log1p(mean)
    out[:, -3] = np.log1p(np.maximum(0, np.bincount(bag, length**2, n) / words - mean**2))
    out[:, -2] = np.log(words / PASSAGE + 0.02)
    out[:, -1] = np.bincount(bag, _CLASS[data[starts]] == 2, n) / words
    return out


def cut(data: np.ndarray, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Parts of a text that hold whole passages: as few as keep to about
    ``piece`` bytes, so that passages are those of the whole text."""
    a, size = 0, piece
    while a + size < len(data):
        part = data[a : a + size]
        inside = _CLASS[part] != 0
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        whole = max(0, len(starts) - 1) // PASSAGE * PASSAGE
        if whole:
            yield part[: starts[whole]]
            a, size = a + int(starts[whole]), piece
        else:  # fewer words than a passage has, so far
            size *= 2
    yield data[a:]


# -- the model -------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Attention:
    """``weights`` by name; without them every document scores ``prior``."""

    weights: dict[str, np.ndarray] | None
    prior: float

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Representations, the two gates, and the attention's logits of passages."""
        w = self.weights
        h = np.tanh(((x - w["mean"]) * w["scale"]) @ w["W"] + w["b"])
        a, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        return h, a, g, (a * g) @ w["w"]

    def score(self, data: np.ndarray) -> float:
        """Of one text of any length: its pieces' attention is merged as it goes."""
        top, total, mixed = -np.inf, 0.0, 0.0
        for part in cut(data):
            h, _, _, logit = self.encode(passages(part))
            most = max(top, float(logit.max()))
            share, fade = np.exp(logit - most), np.exp(top - most)
            total, mixed, top = total * fade + share.sum(), mixed * fade + share @ h, most
        return self.chance(mixed / total)

    def chance(self, mixed: np.ndarray) -> float:
        return float(_sigmoid(mixed @ self.weights["c"] + self.weights["d"]))


def train(bags: list[np.ndarray], labels: list[int], weight_of: tuple[float, float] = (1.0, 1.0), seed: int = 11) -> Attention:
    """Fit encoder, gates and classifier to documents' passages and labels 0 and
    1.  weight_of: how many rows a sampled row of each label stands for."""
    y = np.array(labels, float)
    share = np.where(y == 1, weight_of[1], weight_of[0]) if len(y) else y
    prior = float((share * y).sum() / share.sum()) if len(y) else 1.0
    if len(set(labels)) < 2:
        return Attention(None, prior)
    share = share / share.sum()
    x = np.concatenate(bags).astype(np.float64)
    sizes = np.array([len(b) for b in bags])
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {"mean": x.mean(0), "scale": 1 / (x.std(0) + 0.02)}
    x = ((x - w["mean"]) * w["scale"]).astype(np.float32)
    shapes = {"W": (FEATURES, ENCODED), "b": (ENCODED,), "V": (ENCODED, GATES), "U": (ENCODED, GATES), "w": (GATES,), "c": (ENCODED,), "d": ()}
    w |= {n: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) and n != "b" else np.zeros(s)) for n, s in shapes.items()}
    first, second = ({n: np.zeros(s) for n, s in shapes.items()} for _ in range(2))
    for t in range(1, EPOCHS + 1):
        h = np.tanh(x @ w["W"].astype(np.float32) + w["b"])
        a, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logit = (a * g) @ w["w"]
        part = np.exp(logit - np.maximum.reduceat(logit, starts)[owner])
        part /= np.add.reduceat(part, starts)[owner]
        mixed = np.add.reduceat(part[:, None] * h, starts, axis=0)
        wrong = share * (_sigmoid(mixed @ w["c"] + w["d"]) - y)
        back = wrong[:, None] * w["c"]  # on the mixed representation
        pull = (back[owner] * h).sum(1)
        d_logit = part * (pull - np.add.reduceat(part * pull, starts)[owner])
        d_a, d_g = d_logit[:, None] * w["w"] * g * (1 - a**2), d_logit[:, None] * w["w"] * a * g * (1 - g)
        d_h = (part[:, None] * back[owner] + d_a @ w["V"].T + d_g @ w["U"].T) * (1 - h**2)
        grads = {"W": x.T @ d_h.astype(np.float32), "b": d_h.sum(0), "V": h.T @ d_a, "U": h.T @ d_g, "w": (a * g).T @ d_logit, "c": mixed.T @ wrong, "d": wrong.sum()}
        rate = RATE * (1 - 0.9 * t / EPOCHS)
        for n, grad in grads.items():
            grad = grad + DECAY * w[n]
            first[n], second[n] = 0.9 * first[n] + 0.1 * grad, 0.99 * second[n] + 0.01 * grad**2
            w[n] = w[n] - rate * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.99**t)) + 1e-6)
    return Attention(w, prior)


# -- tables ----------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[str], list[int], tuple[float, float]]:
    """Texts, labels, and how many rows a sampled row of each label stands for."""
    return bounded_sample(docs, labels.where(~held_out(F.col(id_col))), label_col, (MAX_PER_LABEL, MAX_PER_LABEL), MAX_SAMPLE_CHARS, id_col, text_col)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Attention:
    """The model learned from labelled rows that are not held out."""
    texts, known, weight_of = labelled_sample(docs, labels, id_col, text_col)
    return train([passages(_bytes(t)) for t in texts], known, weight_of)


def annotate(docs: DataFrame, model: Attention, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with its text column replaced by the score."""
    shipped, key, at = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, docs.columns.index(text_col)
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Attention = held(key, lambda: shipped.value)
        for batch in batches:
            if scorer.weights is None:
                scores = [scorer.prior] * batch.num_rows
            else:
                column = batch.column(at).cast(pa.large_binary())
                ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + batch.num_rows + 1]
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
                scores = [scorer.score(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != at), pa.array(scores, pa.float64())], [*names, name])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(run, f"{rest}, `{name}` double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = annotate(rows, fit(docs, labels, id_col, text_col))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
