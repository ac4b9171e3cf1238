"""Secret scanning: fixed patterns, and formats learned by grammar inference.

Three fixed patterns find the base spans.  What they find in all documents labels
credentials of three formats.  Each distinct credential counts once.  It is read as
classes of characters, and Spark counts what follows each state: a depth, the first
``HEAD`` classes (down to ``HEAD_DEPTH``) and the last one.  These counts, bounded in number whatever the
rows, become a probabilistic automaton for each format by merging states whose
futures are statistically compatible.  Only states of one depth merge, so an
automaton keeps what it has learned about prefixes and lengths.  Strings are read to
their ends; from ``OWN_DEPTH`` on states share one depth and lead to each other.  States are compared,
by Hoeffding's bound (``ALIKE`` at least) and down the automaton, where both have
``SUPPORT`` strings at least; a state with fewer joins the likeliest of its depth.
The same is done with half of all ordinary candidates, by their hash: those that lie
outside credentials.  Every candidate of every text - a run of at least
``MIN_CANDIDATE`` letters, digits and ``+/_.=-`` - is scored by the likelihood of the
best format over the ordinary one, per character; candidates above the threshold,
which is set so that almost none of the other half of the ordinary candidates passes,
add a span of kind ``format`` unless a base span holds them.  Likelihoods are counted
in steps of 1 / ``GRID``.

Defined results: a null text counts as empty and has no spans; spans are code
points with an exclusive end; repeated rows get equal results; without
credentials in the table nothing is added to the base spans; an empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialize

MIN_CANDIDATE = 8
#: Strings that a state needs to be compared; the depth up to which states know theirs;
#: the depth of the longest text that Spark can hold.
SUPPORT, OWN_DEPTH, DEPTH = 24, 256, 2**31 - 1
#: Classes at the beginning that a state knows, the depth up to which it does, and the
#: difference of frequencies up to which states are alike however many strings they have.
HEAD, HEAD_DEPTH, ALIKE = 2, 64, 0.06
#: Steps of a likelihood in which quantiles are counted.
GRID = 4096
#: How far below its format's own strings a candidate's likelihood may lie, per
#: character: about one unexpected character in thirty.
SLACK = 0.25
#: Merging: confidence of Hoeffding's bound, and the share of the ordinary
#: candidates that may pass.
ALPHA, PASS = 0.05, 0.001
MAX_CACHED = 200_000
#: Characters that are counted at a time.
SLICE = 1 << 19

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE},}}")
KINDS = ("assign", "access", "hex", "format")
MIN_VALUE, MIN_ACCESS = 6, 20

_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_TO_HEX = bytes(0x68 if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66 else 0x20 for b in range(256))
_RUN = b"h" * 24


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, value start)`` of the fixed patterns' matches, in
    order.  Plain searches rule out most texts before a pattern is tried."""
    found: list[tuple[int, int, int, int]] = []
    data = text.encode("utf-8", "replace")
    lower = data.lower()
    if any(n.encode() in lower for n in _NAMES):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if _RUN in data.translate(_TO_HEX):
        found += [(m.start(), 2, m.end(), m.start()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


# -- grammar inference -----------------------------------------------------

#: Characters by class; a class is one symbol and its members are equally likely.
CLASSES = ("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "+", "/", "_", ".", "=", "-")
_SYMBOL = {c: k for k, members in enumerate(CLASSES) for c in members}
_EACH = [-math.log(len(members)) for members in CLASSES]
_END = len(CLASSES)


@dataclass
class State:
    """``seen`` strings pass through; ``out`` counts what follows (symbols, end)."""

    seen: int = 0
    out: Counter = field(default_factory=Counter)
    next: dict[int, int] = field(default_factory=dict)
    #: Where most strings go.
    likely: int = -1


@dataclass
class Automaton:
    """A probabilistic automaton over character classes."""

    states: dict[int, State]

    def log_likelihood(self, text: str, least: float = -math.inf) -> float:
        """Smoothed, so that no string is impossible; an unexpected symbol goes on
        as the likeliest does, and beyond the states known every symbol is equally
        likely.  Infinitely small once it is below ``least``: it only falls."""
        at, total = 0, 0.0
        for c in text:
            if total < least:
                return -math.inf
            k = _SYMBOL[c]
            state = self.states.get(at)
            if state is None:
                total += -math.log(_END + 1) + _EACH[k]
                continue
            total += math.log((state.out[k] + 0.1) / (state.seen + 0.1 * (_END + 1))) + _EACH[k]
            at = state.next.get(k, state.likely)
        state = self.states.get(at)
        return total + (math.log((state.out[_END] + 0.1) / (state.seen + 0.1 * (_END + 1))) if state else -math.log(_END + 1))


#: The mark of an end, which may follow like a class.
_CODES = np.zeros(256, np.int64)
for _c, _k in {**_SYMBOL, "\n": _END}.items():
    _CODES[ord(_c)] = _k
#: Bases of the numbers of states: classes and none; what may follow.
_BASE, _FOLLOW = _END + 1, _END + 1
_HEADS = _BASE**HEAD
#: States from this number on have OWN_DEPTH and more.
_DEEP = OWN_DEPTH * _HEADS * _BASE


def _slices(strings: list[str]) -> Iterator[list[tuple[str, int]]]:
    """The strings with their marks, in lists of some SLICE characters at most.  A
    string that goes on from one list to the next does so at a depth, and its last
    character is repeated."""
    part: list[tuple[str, int]] = []
    room = SLICE
    for x in strings:
        x += "\n"
        if len(x) <= room:
            part.append((x, 0))
            room -= len(x)
            continue
        for at in range(0, len(x), SLICE):
            if part:
                yield part
            part = [(x[max(0, at - 1) : at + SLICE], at)]
        room = SLICE - len(part[0][0])
    if part:
        yield part


def _followed(part: list[tuple[str, int]], deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``follows`` says of one slice."""
    symbol = _CODES[np.frombuffer("".join([x for x, _ in part]).encode(), np.uint8)]
    sizes = np.array([len(x) for x, _ in part])
    stops = np.cumsum(sizes)
    begins = stops - sizes
    # the repeated character stands one before the depth at which its string goes on
    from_depth = np.array([max(0, at - 1) for _, at in part])
    depth = np.arange(len(symbol)) - np.repeat(begins - from_depth, sizes)
    before = np.concatenate(([0], symbol + 1))[:-1]
    head = np.zeros(len(symbol), np.int64)
    for k in range(HEAD):
        class_k = np.repeat(symbol[np.minimum(begins + k, len(symbol) - 1)] + 1, sizes)
        head = np.where(depth > k, head * _BASE + class_k, head)
    head[depth > HEAD_DEPTH] = 0
    state = (np.minimum(depth, deepest) * _HEADS + head) * _BASE + np.where(depth > 0, before, 0)
    return np.unique(np.delete(state * _FOLLOW + symbol, begins[from_depth > 0]), return_counts=True)


def follows(strings: list[str], deepest: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """What follows each state in these strings, and how often.  A state is a number
    made of depth (``deepest`` at most), first classes and last class; what follows it
    is the last digit."""
    found = [_followed(part, deepest) for part in _slices(strings)]
    if len(found) == 1:
        return found[0]
    none = np.zeros(0, np.int64)
    codes, at = np.unique(np.concatenate([none, *(codes for codes, _ in found)]), return_inverse=True)
    counts = np.zeros(len(codes), np.int64)
    np.add.at(counts, at, np.concatenate([none, *(n for _, n in found)]))
    return codes, counts


def _shared(state: int) -> int:
    """The state itself, or the one of OWN_DEPTH that it counts for."""
    return state if state < _DEEP else _DEEP + state % _BASE


def _after(state: int, k: int) -> int:
    """The state that a class leads to."""
    depth, head = divmod(state // _BASE, _HEADS)
    head = head * _BASE + k + 1 if depth < HEAD else head if depth < HEAD_DEPTH else 0
    return _shared(((depth + 1) * _HEADS + head) * _BASE + k + 1)


def counted_states(follow: Iterable[tuple[int, int]]) -> dict[int, State]:
    """States from how often what follows them does; the first is 0."""
    states: dict[int, State] = {0: State()}
    for code, n in follow:
        at, k = divmod(code, _FOLLOW)
        state = states.setdefault(_shared(at), State())
        state.seen += n
        state.out[k] += n
        if k < _END:
            state.next[k] = _after(at, k)
    return states


def _alike(a: State, b: State) -> bool:
    """No outgoing frequency of the two differs by more than chance allows."""
    bound = max(ALIKE, math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(a.seen) + 1 / math.sqrt(b.seen)))
    return all(abs(a.out[k] / a.seen - b.out[k] / b.seen) <= bound for k in a.out.keys() | b.out.keys())


def _kept(gone: dict[int, int], state: int) -> int:
    """The state that stands for one that may have merged."""
    while state in gone:
        state = gone[state]
    return state


def _compatible(states: dict[int, State], a: int, b: int, gone: dict[int, int]) -> bool:
    """The two states and what both lead to are alike, as far as there are
    enough strings to tell."""
    todo, met = [(a, b)], {(a, b)}
    while todo:
        x, y = (states[k] for k in todo.pop())
        if x.seen < SUPPORT or y.seen < SUPPORT:
            continue
        if not _alike(x, y):
            return False
        pairs = {(_kept(gone, x.next[k]), _kept(gone, y.next[k])) for k in x.next.keys() & y.next.keys()} - met
        met |= pairs
        todo += [(p, q) for p, q in pairs if p != q]
    return True


def _likeness(a: State, b: State) -> float:
    """The share of what follows ``b`` that follows ``a`` as well."""
    return sum(min(a.out[k] / a.seen, n / b.seen) for k, n in b.out.items())


def _fold(states: dict[int, State], into: int, other: int, gone: dict[int, int]) -> None:
    """Add a state's counts, and those of what it leads to, to another state; gone:
    gets the states that others stand for."""
    todo = [(into, other)]
    while todo:
        a, b = (_kept(gone, k) for k in todo.pop())
        if a == b:
            continue
        mine, its = states[a], states.pop(b)
        gone[b] = a
        mine.seen += its.seen
        mine.out.update(its.out)
        for k, target in its.next.items():
            if k in mine.next:
                todo.append((mine.next[k], target))
            else:
                mine.next[k] = target


def merged(states: dict[int, State]) -> Automaton:
    """Merge compatible states, depth by depth; at each depth the states with most
    strings come first.  What compatible states lead to is alike as well and merges
    with them.  A state with few strings is no evidence of that: only its own counts
    are added to the likeliest state's, and classes that only it has lead on.  The
    states that share the last depth lead to each other, so all of them are its layer,
    and merging two may merge others of it."""
    gone: dict[int, int] = {}
    all_kept, layer = [0], [0]
    while layer and layer[0] < _DEEP:
        reached = {_kept(gone, q) for p in layer for q in states[p].next.values()}
        if reached and max(reached) >= _DEEP:
            reached = {q for q in states if q >= _DEEP}
        below = sorted(reached, key=lambda q: (-states[q].seen, q))
        layer = []
        for q in below:
            if q in gone:
                continue
            if states[q].seen >= SUPPORT or not layer:
                into = next((r for r in layer if _compatible(states, r, q, gone)), None)
                if into is None:
                    layer.append(q)
                else:
                    _fold(states, into, q, gone)
                    layer = [r for r in layer if r not in gone]
            else:
                into = max(layer, key=lambda r: (_likeness(states[r], states[q]), states[r].seen))
                few, mine = states.pop(q), states[into]
                gone[q] = into
                mine.seen += few.seen
                mine.out.update(few.out)
                mine.next = few.next | mine.next
        all_kept += layer
    states = {q: states[q] for q in all_kept}
    for state in states.values():
        state.next = {k: _kept(gone, q) for k, q in state.next.items()}
        state.likely = max(state.next.items(), key=lambda x: (state.out[x[0]], -x[0]), default=(0, -1))[1]
    return Automaton(states)


def infer(strings: list[str]) -> Automaton:
    """The automaton of these strings."""
    codes, counts = follows(strings, OWN_DEPTH)
    return merged(counted_states(zip(codes.tolist(), counts.tolist())))


@dataclass
class Grammar:
    """The formats' automata, the ordinary one, the threshold on their ratio, and
    of each format the least likelihood per character that its strings have."""

    formats: list[Automaton]
    ordinary: Automaton | None
    threshold: float
    floors: list[float] = field(default_factory=list)

    def score(self, text: str) -> float:
        """Log-likelihood ratio of the best format to the ordinary one, per
        character; beyond the formats' own ranges no score."""
        least = [floor * len(text) for floor in self.floors]
        fits = (x for x, floor in zip(map(Automaton.log_likelihood, self.formats, [text] * len(least), least), least) if x >= floor)
        best = max(fits, default=-math.inf)
        return best if best == -math.inf else (best - self.ordinary.log_likelihood(text)) / len(text)


def _steps(values: Iterable[float]) -> Counter:
    """How many values each step of 1 / GRID has."""
    return Counter(math.floor(x * GRID) for x in values)


def _step_at(steps: dict[int, int], rank: int) -> int:
    """The step of the value that ``rank`` values precede."""
    for step, n in sorted(steps.items()):
        rank -= n
        if rank < 0:
            return step
    return max(steps)


def _floor(steps: dict[int, int]) -> float:
    return _step_at(steps, sum(steps.values()) // 100) / GRID - SLACK


def _fits(automaton: Automaton, strings: list[str]) -> Counter:
    return _steps(automaton.log_likelihood(x) / len(x) for x in strings)


def _scores(grammar: Grammar, strings: list[str]) -> Counter:
    """Scores that are not above zero count as zero."""
    return _steps(max(0.0, grammar.score(x)) for x in strings)


def _threshold(steps: dict[int, int]) -> float:
    n = sum(steps.values())
    step = _step_at(steps, min(n - 1, math.ceil(n * (1 - PASS))))
    return (step + 1) / GRID if step else 1e-9


def learn(credentials: dict[int, list[str]], ordinary: list[str]) -> Grammar:
    """What ``fit`` learns, from lists: half of the ordinary strings make the
    automaton, the others the threshold."""
    learned = [(sorted(x), infer(sorted(x))) for _, x in sorted(credentials.items()) if x]
    if not learned or not ordinary:
        return Grammar([], None, math.inf)
    half = len(ordinary) // 2 or 1
    grammar = Grammar([a for _, a in learned], infer(ordinary[:half]), 0.0, [_floor(_fits(a, x)) for x, a in learned])
    grammar.threshold = _threshold(_scores(grammar, ordinary[half:] or ordinary))
    return grammar


# -- DataFrames ------------------------------------------------------------


def _outside(found: list[tuple[int, int, int, int]], text: str) -> Iterator[re.Match]:
    """Candidates that no base span holds."""
    if not found:
        yield from CANDIDATE.finditer(text)
        return
    starts, reach = [f[0] for f in found], [*accumulate((f[2] for f in found), max)]
    for m in CANDIDATE.finditer(text):
        k = bisect_right(starts, m.start())
        if not k or reach[k - 1] < m.end():
            yield m


#: Kinds of strings: those of base spans, and two halves of the ordinary ones.
_CREDENTIALS, _FIRST, _SECOND = (0, 1, 2), 3, 4


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct strings of each batch, by kind."""
    for batch in batches:
        rows: list[set[str]] = [set() for _ in range(4)]
        for text in batch.column(0).to_pylist():
            if text:
                found = base_spans(text)
                for _, k, end, value in found:
                    rows[k].add(text[value:end])
                rows[3].update([m[0] for m in _outside(found, text)])
        kinds = np.repeat(np.arange(4, dtype=np.int32), [len(x) for x in rows])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([x for r in rows for x in r], pa.string())], ["kind", "value"])


def _tallied(strings: DataFrame, tally: Callable[[int, list[str]], tuple[Iterable[int], Iterable[int]]]) -> dict[int, dict[int, int]]:
    """Of each kind, how often Spark counts each code that ``tally`` gives for its
    strings.  Codes are bounded in number, so these counts fit into the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            for kind in np.unique(kinds).tolist():
                codes, n = tally(kind, batch.column(1).filter(pa.array(kinds == kind)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(codes), pa.int32()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["kind", "code", "n"])

    counted = strings.mapInArrow(run, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    found: dict[int, dict[int, int]] = {}
    for kind in pc.unique(counted.column("kind")).to_pylist():
        own = counted.filter(pc.equal(counted.column("kind"), kind)).sort_by("code")
        found[kind] = dict(zip(own.column("code").to_pylist(), own.column("n").to_pylist()))
    return found


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Learn the formats from what the fixed patterns find in all rows, and the
    ordinary automaton and the threshold from all that they do not find."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_strings, "kind int, value string").distinct()
    half = F.when(F.col("kind") == 3, 3 + F.pmod(F.xxhash64("value"), F.lit(2))).otherwise(F.col("kind")).cast("int")
    strings = materialize(found.select(half.alias("kind"), "value"), "strings")
    kind = F.col("kind")
    counts = _tallied(strings.where(kind <= _FIRST), lambda _, values: follows(values, OWN_DEPTH))
    formats = {k: merged(counted_states(counts[k].items())) for k in _CREDENTIALS if k in counts}
    ordinary = counts.get(_FIRST) or _tallied(strings.where(kind == _SECOND), lambda _, values: follows(values, OWN_DEPTH)).get(_SECOND)
    if not formats or not ordinary:
        return Grammar([], None, math.inf)
    ship = docs.sparkSession.sparkContext.broadcast
    known = ship(formats)
    steps = _tallied(strings.where(kind < _FIRST), lambda k, values: _columns(_fits(known.value[k], values)))
    grammar = Grammar([*formats.values()], merged(counted_states(ordinary.items())), 0.0, [_floor(steps[k]) for k in formats])
    shipped = ship(grammar)
    scores = lambda half: _tallied(strings.where(kind == half), lambda _, values: _columns(_scores(shipped.value, values))).get(half)
    grammar.threshold = _threshold(scores(_SECOND) or scores(_FIRST))
    return grammar


def _columns(counts: Counter) -> tuple[list[int], list[int]]:
    return [*counts], [*counts.values()]


def _passes(grammar: Grammar):
    """Whether a candidate scores above the threshold; remembers candidates."""
    known: dict[str, bool] = {}

    def passes(text: str) -> bool:
        if (was := known.get(text)) is None:
            was = grammar.score(text) > grammar.threshold
            if len(known) < MAX_CACHED:
                known[text] = was
        return was

    return passes


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """``doc_id, found`` of every row; found: kind, start and end of each span in order."""
    grammar = grammar or fit(docs, id_col, text_col)
    shipped, key = docs.sparkSession.sparkContext.broadcast(grammar), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shipped.value
        passes = held(key, lambda: _passes(grammar)) if grammar.formats else None
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = base_spans(text)
                if passes:
                    found = sorted(found + [(m.start(), 3, m.end(), m.start()) for m in _outside(found, text) if passes(m[0])])
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def listed(spans, sep: str = ","):
    """Spans as ``kind:start:end``, joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), sep)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text."""

    def of(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *(of(k) for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
