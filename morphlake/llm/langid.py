"""Language identification as a mixture of languages.

Each language has a character trigram model (interpolated with bigrams and
letters) of its words.  A document is taken as a mixture: every word comes from
one of the languages, and expectation-maximisation estimates the proportions
from the words' likelihoods.  Sets of one, two, ... languages, the most
likely ones first, are compared by their likelihood less the usual penalty of
half the logarithm of the words for each further language; the best set is
kept, and the prediction is its largest member.

The models are learned on the driver from a bounded sample of the labelled rows
that are not held out: of every language about ``SAMPLE_ROWS`` documents (fewer
where all languages together would take more than ``MAX_ROWS``), drawn by the
hash of the id, of at most ``MAX_SAMPLE_CHARS`` characters, or of any length
where a language has no shorter ones.

Defined results: a null text and a text without letters are ``und`` with score
0; ties go to the first language by name; rows with a null language teach
nothing; repeated rows get equal results; a null id counts as held out; without
labelled rows every text is ``und``; an empty table gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .toxicity import held_out

SAMPLE_ROWS, MAX_ROWS, MAX_SAMPLE_CHARS = 1000, 20_000, 20_000
ROUNDS = 12
MAX_CACHED = 300_000
#: Word-language likelihoods held at a time.
STEP = 2_000_000
#: Weights of trigrams, bigrams, letters and of any character at all.
MIX = (0.6, 0.25, 0.14, 0.01)
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; empty if there is no letter."""
    found = WORD.findall((text or "").lower())
    return found if any(w.isalpha() or any(map(str.isalpha, w)) for w in found) else []


@dataclass
class Languages:
    """``names`` and tables of n-gram log-likelihood parts."""

    names: list[str]
    grams: dict[str, np.ndarray]

    def trigram(self, gram: str) -> np.ndarray:
        """Log-probability of a trigram's last letter under each language."""
        none = np.zeros(len(self.names))
        return np.log(MIX[3] / 1000 + self.grams.get(gram[2], none) + self.grams.get(gram[1:], none) + self.grams.get(gram, none))


def train(texts: list[str], languages: list[str]) -> Languages:
    names = sorted(set(languages))
    grams: dict[str, np.ndarray] = {}
    for column, name in enumerate(names):
        counted = Counter(w for t, x in zip(texts, languages) if x == name for w in words_of(t))
        ngrams: tuple[Counter, ...] = (Counter(), Counter(), Counter())
        heads: tuple[Counter, ...] = (Counter(), Counter(), Counter())
        for word, n in counted.items():
            line = f"  {word} "
            for k in range(2, len(line)):
                for size in (1, 2, 3):
                    ngrams[size - 1][line[k - size + 1 : k + 1]] += n
                    heads[size - 1][line[k - size + 1 : k]] += n
        for size, weight in ((1, MIX[2]), (2, MIX[1]), (3, MIX[0])):
            for gram, n in ngrams[size - 1].items():
                row = grams.setdefault(gram, np.zeros(len(names)))
                row[column] = weight * n / heads[size - 1][gram[:-1]]
    return Languages(names, grams)


def mixture(likelihood: np.ndarray, weight: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents whose words are rows of
    ``likelihood``; allowed: the languages of each document's set."""
    sizes = np.diff(np.concatenate((starts, [len(likelihood)])))
    owner = np.repeat(np.arange(len(starts)), sizes)
    part = allowed / allowed.sum(1, keepdims=True)
    totals = np.add.reduceat(weight, starts)[:, None]
    for _ in range(ROUNDS):
        joint = likelihood * part[owner]
        joint *= (weight / joint.sum(1))[:, None]
        part = np.add.reduceat(joint, starts, axis=0) / totals
        part = np.maximum(part, 1e-12) * allowed
        part /= part.sum(1, keepdims=True)
    fit = np.log((likelihood * part[owner]).sum(1)) * weight
    return part, np.add.reduceat(fit, starts)


def choose(likelihood: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language set of each document: proportions, and its size.
    likelihood: scaled so that each word's largest is 1."""
    n, languages = len(starts), likelihood.shape[1]
    full, _ = mixture(likelihood, weight, starts, np.ones((n, languages)))
    alone = np.add.reduceat(np.log(likelihood) * weight[:, None], starts, axis=0)
    best = np.zeros((n, languages))
    first = alone.argmax(1)
    best[np.arange(n), first] = 1.0
    value, size = alone.max(1), np.ones(n, np.int64)
    penalty = 0.5 * np.log(np.maximum(2.0, np.add.reduceat(weight, starts)))
    rank = (-full).argsort(1, kind="stable")
    ends = np.concatenate((starts[1:], [len(likelihood)]))
    going = np.arange(n)
    for k in range(2, languages + 1):
        allowed = np.zeros((len(going), languages))
        np.put_along_axis(allowed, rank[going, :k], 1.0, 1)
        rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[going], ends[going])])
        sizes = ends[going] - starts[going]
        part, fit = mixture(likelihood[rows], weight[rows], np.cumsum(sizes) - sizes, allowed)
        better = fit - (k - 1) * penalty[going] > value[going]
        going = going[better]
        if not len(going):
            break
        best[going], size[going] = part[better], k
        value[going] = fit[better] - (k - 1) * penalty[going]
    return best, size


class _Predictor:
    """Likelihoods of the words seen so far, in the rows of a growing matrix."""

    def __init__(self, model: Languages) -> None:
        self.model = model
        self.grams: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.names)))
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.new: list[str] = []
        self.rows = np.zeros((0, len(self.model.names)), np.float32)

    def _id(self, word: str) -> int:
        found = self.ids.get(word)
        if found is None:
            found = self.ids[word] = len(self.ids)
            self.new.append(word)
        return found

    def _gram(self, gram: str) -> int:
        found = self.grams.get(gram)
        if found is None:
            found = self.grams[gram] = len(self.grams)
            if found == len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[found] = self.model.trigram(gram)
        return found

    def learn_new(self) -> None:
        if not self.new:
            return
        if len(self.grams) > MAX_CACHED:
            self.grams = {}
        lines = [f"  {w} " for w in self.new]
        flat = np.fromiter((self._gram(x[k : k + 3]) for x in lines for k in range(len(x) - 2)), np.int64)
        sizes = np.array([len(x) - 2 for x in lines])
        logs = np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes, axis=0)
        rows = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60.0)).astype(np.float32)
        self.rows, self.new = np.concatenate((self.rows, rows)), []

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[str]]]:
        names = self.model.names
        out, score, sets = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if not names:
            return out, score, sets
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        total = 0
        for k, text in enumerate(texts):
            found = words_of(text)
            if found:
                ids, n = np.unique(np.fromiter(map(self._id, found), np.int64), return_counts=True)
                held.append((k, ids, n))
                total += len(ids)
            if held and (total * len(names) > STEP or k == len(texts) - 1):
                self._place(held, out, score, sets)
                held, total = [], 0
            if not held and len(self.ids) > MAX_CACHED:
                self.forget()
        if held:
            self._place(held, out, score, sets)
        return out, score, sets

    def _place(self, held, out, score, sets) -> None:
        names = self.model.names
        self.learn_new()
        rows = self.rows[np.concatenate([x[1] for x in held])]
        sizes = np.array([len(x[1]) for x in held])
        best, _ = choose(rows.astype(np.float64), np.concatenate([x[2] for x in held]).astype(np.float64), np.cumsum(sizes) - sizes)
        top = best.argmax(1)
        for (k, _, _), row, t in zip(held, best, top.tolist()):
            out[k], score[k] = names[t], float(min(1.0, row[t]))
            sets[k] = [names[i] for i in (-row).argsort(kind="stable") if row[i] > 0]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """The models learned from a sample of the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("name"), F.col(text_col).alias("body")).where(~held_out(F.col("id")) & F.col("name").isNotNull() & F.col("body").isNotNull())
    short = F.length("body") <= MAX_SAMPLE_CHARS
    counts = rows.groupBy("name").agg(F.count_if(short).alias("short"), F.count(F.lit(1)).alias("all")).collect()
    if not counts:
        return Languages([], {})
    most = max(1, min(SAMPLE_ROWS, MAX_ROWS // len(counts)))
    # a share of each language by the hash of the id; a sixth more is drawn to allow for chance
    shares = {r["name"]: min(1.0, 1.16 * most / (r["short"] or r["all"])) for r in counts}
    share = F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), F.col("name"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003
    long_only = [r["name"] for r in counts if not r["short"]]
    sample = rows.where(drawn & (short | F.col("name").isin(long_only))).select("name", "body").collect()
    return train([r["body"] for r in sample], [r["name"] for r in sample])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Languages | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` of every row of ``docs``;
    languages: the chosen set, largest proportion first."""
    model = model or fit(docs, id_col, text_col, lang_col)
    shipped, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = held(key, lambda: _Predictor(shipped.value))
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                found = predictor.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.list_(pa.string()))],
                    ["doc_id", "held_out", "lang_pred", "score", "languages"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")
