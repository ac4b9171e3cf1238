"""Toxicity by a linear-chain conditional random field.

Each word is tagged clean or toxic.  Labels are known for documents, so they
label tokens in part: every token of a clean document is clean, and at least
one token of a toxic document is toxic.  Training maximises the likelihood of
just that: the probability that all tags are clean, or that not all are, both
read off the forward pass; forward-backward marginals give the gradient.  The
document's score is the probability that it has a toxic token (what the
marginals of its tokens, each given that none before is toxic, add up to), and
runs of tokens with a marginal of a half or more are the offending spans; a
toxic document without such a token has its likeliest one.

The model is fitted on the driver on a bounded sample of labelled rows:
``MAX_TOXIC`` and ``MAX_CLEAN`` documents, lowest hash of the id first, among
those of at most ``MAX_SAMPLE_CHARS`` characters.  Scoring reads whole texts and
nothing but texts.

Defined results: a null or empty text scores like a text without words (0);
rows with a null label teach nothing; ids with several labels are toxic if one
is; repeated rows score alike; a null id counts as held out; without labels of
both kinds every document's score is the share of toxic labels (0 without
labels); an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, held, spare_name

MAX_TOXIC, MAX_CLEAN, MAX_SAMPLE_CHARS = 800, 1600, 20_000
FOLDS = 5
BUCKETS = 1 << 18
ROUNDS, RATE, L2, BIAS = 40, 0.35, 2e-5, -7.0
MAX_CACHED = 300_000
THRESHOLD = 0.5

WORD = re.compile(r"\w+")


def held_out(id_col: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 0 modulo FOLDS."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def features(word: str) -> list[int]:
    """Hashed features: the word, its beginnings, its ends."""
    names = [f"w{word}", *(f"p{word[:k]}" for k in range(3, min(9, len(word) + 1))), *(f"s{word[-k:]}" for k in range(3, min(6, len(word) + 1)))]
    return [zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names]


@dataclass
class Crf:
    """``weights`` of features for the toxic tag, and factors of the transitions
    clean-toxic, toxic-clean, toxic-toxic (clean-clean and clean words: 1).
    Without ``weights`` every document scores ``prior``."""

    weights: np.ndarray | None
    bias: float
    moves: np.ndarray
    prior: float

    def emission(self, word: str) -> float:
        return float(min(20.0, self.bias + self.weights[features(word)].sum()))


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents longest first, and how many of them have a token at each step."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    return order, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")


def forward(factor: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray, keep: bool = False):
    """``log Z`` of each document (the all-clean path weighs 1), and with
    ``keep`` the toxic/clean ratio after each token.  factor: of each token."""
    to_toxic, to_clean, stay = moves
    order, live = _steps(lengths)
    begin = starts[order]
    ratio, log_z = np.zeros(len(order)), np.zeros(len(order))
    ratios = np.zeros(len(factor)) if keep else None
    for t, n in enumerate(live.tolist()):
        at, r = begin[:n] + t, ratio[:n]
        norm = 1 + r * to_clean
        log_z[:n] += np.log(norm)
        ratio[:n] = factor[at] * (to_toxic + r * stay) / norm
        if keep:
            ratios[at] = ratio[:n]
    out = np.empty(len(order))
    out[order] = log_z + np.log1p(ratio)
    return (out, ratios) if keep else out


def backward(factor: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The toxic/clean ratio of what follows each token."""
    to_toxic, to_clean, stay = moves
    order, live = _steps(lengths)
    end = (starts + lengths)[order]
    after, ratios = np.ones(len(order)), np.zeros(len(factor))
    for t, n in enumerate(live.tolist()):
        at = end[:n] - 1 - t
        s = after[:n].copy()
        ratios[at] = s
        ahead = factor[at] * s
        after[:n] = (to_clean + stay * ahead) / (1 + to_toxic * ahead)
    return ratios


def train(texts: list[str], toxic: list[int], clean_weight: float = 1.0) -> Crf:
    """Fit the field to documents with labels 0 and 1."""
    y = np.array(toxic, bool)
    prior = float(y.sum() / max(1e-9, y.sum() + clean_weight * (~y).sum())) if len(y) else 0.0
    if not y.any() or y.all():
        return Crf(None, 0.0, np.ones(3), prior)
    ids: dict[str, int] = {}
    docs = [np.fromiter((ids.setdefault(w, len(ids)) for w in WORD.findall(t.lower())), np.int32) for t in texts]
    words = np.concatenate(docs)
    lengths = np.array([len(d) for d in docs])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    owner = np.repeat(np.arange(len(docs)), lengths)
    listed, counts = array("I"), array("I")
    for word in ids:
        found = features(word)
        listed.extend(found)
        counts.append(len(found))
    n_words = len(ids)
    ids.clear()
    flat = np.frombuffer(listed, np.uint32).astype(np.int32)
    of_word = np.repeat(np.arange(n_words, dtype=np.int32), counts)
    share = np.where(y, 1.0, clean_weight) / (y.sum() + clean_weight * (~y).sum())
    weights, bias, logs = np.zeros(BUCKETS), BIAS, np.array([0.0, 0.0, 0.0])
    sums, bias_sum, logs_sum = np.full(BUCKETS, 1e-10), 1e-4, np.full(3, 1e-4)
    first = np.zeros(len(words), bool)
    first[starts[lengths > 0]] = True
    for _ in range(ROUNDS):
        moves = np.exp(logs)
        by_word = np.minimum(20.0, bias + np.bincount(of_word, weights[flat], n_words))
        factor = np.exp(by_word)[words]
        log_z, before = forward(factor, starts, lengths, moves, keep=True)
        after = backward(factor, starts, lengths, moves)
        none = np.exp(-log_z)
        push = share * np.where(y, -none / np.maximum(1e-6, 1 - none), 1.0)
        push[lengths == 0] = 0
        marginal = before * after / (1 + before * after) * push[owner]
        grad = np.bincount(flat, np.bincount(words, marginal, n_words)[of_word], BUCKETS) + L2 * weights
        # expected transitions between a token and the one before it
        r = np.where(first, 0.0, np.concatenate(([0.0], before[:-1])))
        ahead = factor * after
        parts = np.stack([moves[0] * ahead, np.where(first, 0, r * moves[1]), r * moves[2] * ahead])
        total = 1 + parts.sum(0)
        g_logs = (parts / total * push[owner]).sum(1) + 1e-3 * logs
        g_bias = marginal.sum()
        sums, bias_sum, logs_sum = 0.9 * sums + 0.1 * grad**2, 0.9 * bias_sum + 0.1 * g_bias**2, 0.9 * logs_sum + 0.1 * g_logs**2
        weights -= RATE * grad / (np.sqrt(sums) + 1e-5)
        bias -= 0.1 * g_bias / (np.sqrt(bias_sum) + 1e-3)
        logs -= 0.05 * g_logs / (np.sqrt(logs_sum) + 1e-3)
    return Crf(weights.astype(np.float32), float(bias), np.exp(logs), prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", only: Column | None = None) -> tuple[list[str], list[int], float]:
    """Texts, labels, and how many clean rows a sampled clean row stands for,
    relative to toxic ones.  only: a condition on ``labels``."""
    rows = labels.where(only) if only is not None else labels
    texts, known, (clean, toxic) = bounded_sample(docs, rows, label_col, (MAX_CLEAN, MAX_TOXIC), MAX_SAMPLE_CHARS, id_col, text_col)
    return texts, known, clean / toxic if clean and toxic else 1.0


class _Scorer:
    def __init__(self, model: Crf) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def factor(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            found = np.exp(self.model.emission(word))
            if len(self.known) < MAX_CACHED:
                self.known[word] = found
        return found

    def score(self, texts: list[str | None], spans: bool) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
        if self.model.weights is None:
            return np.full(len(texts), self.model.prior), [[] for _ in texts]
        factors = [np.fromiter(map(self.factor, WORD.findall((t or "").lower())), np.float64) for t in texts]
        lengths = np.array([len(f) for f in factors], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate(factors) if factors else np.zeros(0)
        scores = -np.expm1(-forward(flat, starts, lengths, self.model.moves))
        found: list[list[dict[str, int]]] = [[] for _ in texts]
        chosen = np.flatnonzero((scores >= THRESHOLD) & (lengths > 0)) if spans else []
        if len(chosen):
            for k, marginals in zip(chosen.tolist(), self._marginals([factors[k] for k in chosen])):
                found[k] = _spans(texts[k], marginals)
        return scores, found

    def _marginals(self, factors: list[np.ndarray]) -> list[np.ndarray]:
        """The probability that each token is toxic, by forward and backward passes."""
        lengths = np.array([len(f) for f in factors], np.int64)
        stops, flat = np.cumsum(lengths), np.concatenate(factors)
        _, before = forward(flat, stops - lengths, lengths, self.model.moves, keep=True)
        both = before * backward(flat, stops - lengths, lengths, self.model.moves)
        return np.split(both / (1 + both), stops[:-1])


def _origins(text: str) -> np.ndarray:
    """Of each character of the lower-cased text the place of the character that
    it comes from; lower-casing makes two characters of some."""
    return np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])


def _spans(text: str, marginals: np.ndarray) -> list[dict[str, int]]:
    """Runs of tokens with a marginal of THRESHOLD or more; where a text is toxic
    by many tokens of less, the likeliest.  Tokens are those of the lower-cased
    text that was scored; offsets are the text's own."""
    lower = text.lower()
    words = [w.span() for w in WORD.finditer(lower)]
    if len(lower) != len(text):
        origin = _origins(text)
        words = [(int(origin[a]), int(origin[b - 1]) + 1) for a, b in words]
    toxic = marginals >= min(THRESHOLD, marginals.max())
    out: list[dict[str, int]] = []
    for k in np.flatnonzero(toxic).tolist():
        if out and k and toxic[k - 1]:
            out[-1]["end"] = words[k][1]
        else:
            out.append({"start": words[k][0], "end": words[k][1]})
    return out


VERDICT = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def annotate(docs: DataFrame, model: Crf, name: str, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` and a struct column ``name`` (score, spans)."""
    shipped, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = T.StructType([*docs.schema, T.StructField(name, VERDICT)])
    at = docs.columns.index(text_col)
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: _Scorer(shipped.value))
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                scores, found = scorer.score(part.column(at).to_pylist(), spans)
                verdict = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, _SPANS)], names=["score", "spans"])
                yield pa.RecordBatch.from_arrays([*part.columns, verdict], names)

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """The field learned from labelled rows that are not held out."""
    return train(*labelled_sample(docs, labels, id_col, text_col, only=~held_out(F.col(id_col))))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = annotate(rows, fit(docs, labels, id_col, text_col), "found", "text", spans)
    score = F.col("found.score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "found.spans")


def drop_toxic(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score THRESHOLD or more; columns as they came."""
    name = spare_name(docs, "toxicity")
    return annotate(docs, model, name, text_col, spans=False).where(F.col(name)["score"] < THRESHOLD).select(*docs.columns)
