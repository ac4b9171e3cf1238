"""The filter audit against documents walked through every order."""

import re
from itertools import permutations

import numpy as np

from morphlake.llm import audit

DOCS = "doc_id long, text string, source string, lang string, mask long"


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, text, _ in docs:
        if d is not None:
            smallest[text or ""] = min(d, smallest.get(text or "", d))
    out = {}
    for part in {s or "" for *_, s in docs}:
        mine = []
        for d, text, source in docs:
            if (source or "") == part:
                t = text or ""
                words = re.findall(r"[^\x20\x09-\x0D]+", t)
                tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and smallest[t] < d)
                mine.append(({n for n, failed in zip("ABCDE", tests) if failed}, d in good, d in toxic))
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                before = sum(1 for f, *_ in mine if name in f and f & set(order[: step - 1]))
                unique = sum(1 for f, *_ in mine if f == {name})
                out[part, "".join(order), step] = [len(left), len(gone), before, unique, sum(g for _, g, _ in gone), sum(x for *_, x in gone)]
                removed[name] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def made(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_against_every_order(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = [long, long + " #", "short", "SHOUT " * 60, "say say " * 40, "", None, " \t\n", "é" * 10, long.upper() + " |", "a b " * 60, long + "\x0b\x0cend"]
    docs = [(i, texts[i % len(texts)], ["a", None, "", "b"][i % 4]) for i in range(60)]
    docs += [(None, long, "a"), (None, long, "a"), (0, long, "b"), (3, texts[3], None), (-5, "short", "only")]
    labels = [(i, i % 3 == 0, i % 2) for i in range(0, 60, 2)] + [(1, None, None), (2, 0, 0), (None, 1, 1), (777, 1, 1)]
    labels = [(d, None if q is None else int(q), t) for d, q, t in labels]
    df = spark.createDataFrame([(d, t, s, "en", 9) for d, t, s in docs], DOCS).repartition(5)
    known = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert made(audit.audit(df, known)) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, None, 0)], DOCS)
    rows = made(audit.audit(one, labels))
    assert len(rows) == 600 and rows["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_inversion_is_exact():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 10**15, 32)
    signs = audit.hadamard(5)
    assert ((signs @ cells) @ signs >> 5 == cells).all()


def test_hot_text_meets_in_no_group_of_rows(spark):
    """A text that most rows share comes down to a row for each part and label."""
    docs = spark.createDataFrame([(i, "same", f"s{i % 3}", "", 0) for i in range(3000)], DOCS).repartition(6)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 3000, 2)], "doc_id long, quality int, toxic int")
    cells = audit.masked(docs, labels)
    assert cells.count() == 3 * 2 + 1 and cells.selectExpr("sum(n)").first()[0] == 3000
