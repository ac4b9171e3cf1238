"""What op3 learns comes from all rows: counts by Spark are those of all distinct strings."""

import random

import numpy as np

from morphlake.llm import secrets

rng = random.Random(12)
HEX = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(2600)]
LONG = "Ab" * 200
WORDS = sorted({"".join(rng.choices(["tion", "ing", "er", "ment", "Un", "able"], k=rng.randint(3, 7))) for _ in range(9000)})


def followed(strings):
    """What follows each state by the definition, one character at a time."""
    out = {}
    for text in strings:
        symbols = [next(k for k, c in enumerate(secrets.CLASSES) if x in c) for x in text[: secrets.DEPTH]]
        for d in range(len(symbols) + 1):
            what = symbols[d] if d < len(symbols) else 11 if len(text) <= secrets.DEPTH else 12
            head = tuple(symbols[: min(d, secrets.HEAD)]) if d <= secrets.HEAD_DEPTH else ()
            state = (d, head, symbols[d - 1] if d else None, what)
            out[state] = out.get(state, 0) + 1
    return out


def test_counts_by_the_definition():
    for strings in ([], ["a"], ["", "_"], HEX[:40] + WORDS[:40] + [LONG, "x" * 256, "x" * 257]):
        codes, counts = secrets.follows(strings)
        assert sorted(counts.tolist()) == sorted(followed(strings).values())
    states = secrets.counted_states(zip(codes.tolist(), counts.tolist()))
    assert states[0].seen == len(strings)
    assert all(secrets._after(0, k) in states for k in states[0].next)
    assert all(states[q].seen for s in states.values() for q in s.next.values())


def test_all_rows_are_learned(spark):
    """More documents' credentials and candidates than any sample had; each distinct one counts once."""
    words = iter(WORDS * 10)
    texts = [f"{' '.join(next(words) for _ in range(4))} {x} and {x}" for x in HEX] + [f"token = {LONG}", None]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    grammar = secrets.fit(docs.repartition(5))
    by_kind = {0: 1, 2: len(HEX)}
    assert [a.states[0].seen for a in grammar.formats] == [*by_kind.values()]
    ordinary = {w for w in " ".join(filter(None, texts)).split() if len(w) >= secrets.MIN_CANDIDATE and w in set(WORDS)}
    assert 0.4 * len(ordinary) < grammar.ordinary.states[0].seen < 0.6 * len(ordinary)
    local = secrets.learn({0: [LONG[: secrets.DEPTH + 1]], 2: HEX}, sorted(ordinary))
    assert grammar.formats == local.formats and grammar.floors == local.floors
    again = secrets.fit(docs.repartition(3).orderBy("text"))
    assert grammar == again
    # almost none of the ordinary half that the threshold was set with passes
    assert sum(grammar.score(w) > grammar.threshold for w in ordinary) <= 0.01 * len(ordinary)
    assert np.mean([grammar.score(x) > grammar.threshold for x in HEX]) > 0.95


def test_unlike_prefixes_stay_apart():
    """Two formats of one kind that differ behind their prefix are not mixed."""
    one = ["a" + "".join(rng.choices("0123456789", k=12)) + "xyzw" for _ in range(300)]
    two = ["7" + "".join(rng.choices("0123456789", k=12)) + "WXYZ" for _ in range(300)]
    automaton = secrets.infer(one + two)
    assert min(map(automaton.log_likelihood, one)) > max(automaton.log_likelihood(x[:13] + "WXYZ") for x in one) + 2
    assert 30 < len(automaton.states) < 60


def test_states_are_bounded():
    """Long strings of all classes: below HEAD_DEPTH a state is a depth and a class."""
    strings = ["".join(rng.choices("aZ9+/_gG", k=257)) for _ in range(400)]
    states = secrets.counted_states(zip(*(x.tolist() for x in secrets.follows(strings))))
    deep = [q for q in states if q // secrets._BASE // secrets._HEADS > secrets.HEAD_DEPTH]
    assert 0 < len(deep) <= (secrets.DEPTH - secrets.HEAD_DEPTH) * len(secrets.CLASSES)
    assert all(q in states for s in states.values() for q in s.next.values())
    assert len(secrets.merged(states).states) < 2000


def test_one_ordinary_candidate(spark):
    """A single candidate makes both automaton and threshold, whichever half it is in."""
    for word in [w for w in WORDS if len(w) >= secrets.MIN_CANDIDATE][:4]:
        grammar = secrets.fit(spark.createDataFrame([(1, f"{word} {HEX[0]} and {HEX[1]}")], "doc_id long, text string"))
        assert grammar.ordinary.states[0].seen == 1 and grammar.score(word) <= grammar.threshold < float("inf")
