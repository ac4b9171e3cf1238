"""Learned formats: states, withheld credentials, variants no pattern finds."""

import random

from morphlake.llm import secrets

rng = random.Random(8)
HEX = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(400)]
KEYS = ["sk_" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=21)) for _ in range(400)]
WORDS = ["".join(rng.choices(["tion", "ing", "er", "ment", "al", "Un", "able", "s"], k=rng.randint(3, 7))) for _ in range(3000)] + [str(rng.randrange(10**15)) for _ in range(60)]
#: One character that no hexadecimal number has in the middle, so that no run is long enough.
VARIANTS = [x[:20] + rng.choice("xG_") + x[21:] for x in HEX[300:]]


def brute(text, grammar):
    """Spans by the definition: every run, scored on its own."""
    base = secrets.base_spans(text)
    out = [(a, k, b) for a, k, b, _ in base]
    start = None
    for k, c in enumerate(text + " "):
        if c.isascii() and (c.isalnum() or c in "+/_.=-"):
            start = k if start is None else start
        elif start is not None:
            inside = any(a <= start and k <= b for a, _, b, _ in base)
            if k - start >= secrets.MIN_CANDIDATE and not inside and grammar.score(text[start:k]) > grammar.threshold:
                out.append((start, 3, k))
            start = None
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_formats_keep_length_and_prefix():
    grammar = secrets.learn({0: KEYS[:300], 2: HEX[:300]}, sorted(set(WORDS)))
    assert all(20 < len(a.states) < 200 for a in grammar.formats)
    assert all(grammar.score(x) > grammar.threshold for x in HEX[300:] + KEYS[300:])
    assert sum(grammar.score(x) > grammar.threshold for x in VARIANTS) >= 95
    assert sum(grammar.score(x) > grammar.threshold for x in set(WORDS)) <= 3
    assert not any(grammar.score(x[:9]) > grammar.threshold for x in HEX[300:])  # far too short
    assert not any(grammar.score(x.lower()) > grammar.threshold for x in KEYS[300:])  # another prefix of classes


def test_spans_against_brute_force(spark):
    texts = [" ".join(rng.sample(WORDS, 40)) for _ in range(300)]
    for k in range(0, 200):
        texts[k] += f" token = {KEYS[k]} then {HEX[k]}."
    learned = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    grammar = secrets.fit(learned)
    for k in range(200, 290):
        texts[k] += f" stands alone: {KEYS[k + 100]}, and\u00e9 ({VARIANTS[k - 200]})\nend"
    rows = [*enumerate(texts), (300, None), (301, ""), (0, texts[0]), (None, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = secrets.digest_columns(secrets.scan(docs, grammar=grammar)).collect()
    want = sorted((-1 if d is None else d, brute(t or "", grammar)) for d, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.spans) for r in got) == want
    found = [s.count("format") for d, s in want if 200 <= d < 290]
    assert sum(found) >= 160 and not any("format" in s for d, s in want if not 200 <= d < 290)
