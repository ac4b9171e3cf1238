"""op3 reads strings to their ends: what lies beyond any depth is counted and scored."""

import random

import pytest

from morphlake.llm import secrets

rng = random.Random(31)
UPPER = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
KEYS = ["sk_" + "".join(rng.choices(UPPER, k=700)) for _ in range(160)]
WORDS = sorted({"".join(rng.choices(["tion", "ing", "er", "ment", "Un", "able"], k=rng.randint(3, 7))) for _ in range(3000)})
START = "k" * (secrets.OWN_DEPTH + 44)
MIXED = ["".join(rng.choices("aZ9+/_gG", k=n)) for n in (1, 255, 256, 257, 258, 300, 3001)] + ["x" * 256, "x" * 257, "", START]


def by_depth(strings):
    """How often what follows each state does, by the definition; deep states share a depth."""
    out = {}
    for text in strings:
        symbols = [next(k for k, c in enumerate(secrets.CLASSES) if x in c) for x in text]
        for d, what in enumerate([*symbols, 11]):
            head = tuple(symbols[: min(d, secrets.HEAD)]) if d <= secrets.HEAD_DEPTH else ()
            state = (min(d, secrets.OWN_DEPTH), head, symbols[d - 1] if d else None, what)
            out[state] = out.get(state, 0) + 1
    return out


@pytest.mark.parametrize("size", [70, 257, 1000, secrets.SLICE])
def test_counts_whatever_the_slices(monkeypatch, size):
    monkeypatch.setattr(secrets, "SLICE", size)
    codes, counts = secrets.follows(MIXED, secrets.OWN_DEPTH)
    want = by_depth(MIXED)
    assert sorted(counts.tolist()) == sorted(want.values())
    assert counts.sum() == sum(len(x) + 1 for x in MIXED)
    states = secrets.counted_states(zip(codes.tolist(), counts.tolist()))
    assert states == secrets.counted_states(zip(*(x.tolist() for x in secrets.follows(MIXED))))
    seen = {}
    for (d, head, last, _), n in want.items():
        seen[d, head, last] = seen.get((d, head, last), 0) + n
    assert sorted(s.seen for s in states.values()) == sorted(seen.values())
    reached = {}
    for s in states.values():
        for k, q in s.next.items():
            reached[q] = reached.get(q, 0) + s.out[k]
    assert reached | {0: len(MIXED)} == {q: s.seen for q, s in states.items()}


def test_states_do_not_grow_with_length():
    automata = [secrets.infer(["".join(rng.choices("aZ9+/_gG", k=n)) for _ in range(5)]) for n in (20_000, 300_000)]
    assert len(automata[0].states) < 3000 and len(automata[1].states) < 3000
    for a in automata:
        assert all(q in a.states for s in a.states.values() for q in s.next.values())
        deep = [s for q, s in a.states.items() if q >= secrets._DEEP]
        assert sum(s.out[secrets._END] for s in deep) == 5 and any(q >= secrets._DEEP for s in deep for q in s.next.values())


def test_deep_states_tell_what_they_saw():
    """Digits and letters in turn behind a long beginning: pairs of each are unlike."""
    automaton = secrets.infer([START + "7z" * rng.randint(50, 90) for _ in range(200)])
    like, unlike = (automaton.log_likelihood(START + x) for x in ("7z" * 60, "77zz" * 30))
    assert like > unlike + 100


def test_strings_that_differ_late_are_two(spark):
    texts = [f"token = {START}{x} and {WORDS[0]}{START}{x}" for x in "ab"]
    grammar = secrets.fit(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    assert grammar.formats[0].states[0].seen == 2
    local = secrets.learn({0: [START + x for x in "ab"]}, [f"{WORDS[0]}{START}{x}" for x in "ab"])
    assert grammar.formats == local.formats and grammar.floors == local.floors


def test_long_formats_are_found(spark):
    """Keys of 703 characters are learned where they are assigned and found where they stand alone."""
    learned = [f"{' '.join(rng.sample(WORDS, 30))} token = {x}" for x in KEYS[:120]]
    alone = [f"{' '.join(rng.sample(WORDS, 30))} ({x})" for x in KEYS[120:]]
    docs = spark.createDataFrame([*enumerate(learned + alone)], "doc_id long, text string").repartition(3)
    grammar = secrets.fit(docs.where("doc_id < 120"))
    local = secrets.learn({0: KEYS[:120]}, ["x" * 8])
    assert grammar.formats == local.formats and grammar.floors == local.floors
    rows = {r.doc_id: r for r in secrets.digest_columns(secrets.scan(docs, grammar=grammar)).collect()}
    assert all(rows[k].spans.count(":") == 2 and rows[k].n_assign == 1 for k in range(120))
    spans = {k: rows[k].spans for k in range(120, 160)}
    assert sum(s == f"format:{len(alone[k - 120]) - 704}:{len(alone[k - 120]) - 1}" for k, s in spans.items()) >= 36
