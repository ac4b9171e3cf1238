"""The attention model: passages, gradients, merging, sampling, accuracy."""

import random
import zlib

import numpy as np
import pytest

from morphlake.llm import quality
from morphlake.llm.quality import FEATURES, PASSAGE, Attention, _bytes, cut, fit, passages, train
from morphlake.llm.quality import quality as scored


def words(rng, n):
    return " ".join("".join(rng.choices("abdegilmnorstu", k=rng.randint(2, 8))) for _ in range(n))


def test_pieces_give_the_passages_of_the_whole_text():
    rng = random.Random(1)
    for text in (words(rng, 1000), "", " \n\t ", "x" * 5000, words(rng, 200) + " " * 900 + "y" * 3000 + " " + words(rng, 300), "é ü  " * 400):
        whole = passages(_bytes(text))
        parts = list(cut(_bytes(text), 256))
        assert b"".join(p.tobytes() for p in parts) == text.encode()
        assert np.array_equal(np.concatenate([passages(p) for p in parts]), whole)
        assert len(whole) == max(1, -(-len(text.encode().split()) // PASSAGE))


def test_passage_features_by_hand():
    row = passages(_bytes("aa aa B1! zz"))[0]
    assert row[-6] == pytest.approx(3 / 4) and row[-5] == pytest.approx(1 / 4) and row[-1] == pytest.approx(1 / 4)
    assert row[1] ** 2 == pytest.approx(6 / 9) and row[2] ** 2 == pytest.approx(1 / 9) and row[3] ** 2 == pytest.approx(1 / 9) and row[6] ** 2 == pytest.approx(1 / 9)
    assert not passages(_bytes(" \t"))[0].any()


def test_training_descends_along_the_gradient(monkeypatch):
    """The gradients of one step agree with differences of the loss."""
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, FEATURES)).astype(np.float32) for n in (1, 3, 2, 5)]
    labels, share = [1, 0, 1, 0], (2.0, 1.0)
    monkeypatch.setattr(quality, "EPOCHS", 3)
    early = train(bags, labels, share)
    monkeypatch.setattr(quality, "EPOCHS", 60)
    late = train(bags, labels, share)

    def loss(m):
        out = 0.0
        for b, y in zip(bags, labels):
            h, _, _, logit = m.encode(b)
            part = np.exp(logit - logit.max())
            p = m.chance(part / part.sum() @ h)
            out -= share[y] * np.log(p if y else 1 - p)
        return out

    assert loss(late) < 0.2 * loss(early)


def test_attention_is_merged_over_pieces(monkeypatch):
    rng = random.Random(2)
    good, bad = [words(rng, 300) for _ in range(30)], [words(rng, 150) + " " + "## %% " * 90 for _ in range(30)]
    model = train([passages(_bytes(t)) for t in good + bad], [1] * 30 + [0] * 30)
    texts = [*good[:3], *bad[:3], "", words(rng, 3000)]
    whole = [model.score(_bytes(t)) for t in texts]
    h, _, _, logit = model.encode(passages(_bytes(texts[-1])))
    part = np.exp(logit - logit.max())
    assert whole[-1] == pytest.approx(model.chance(part / part.sum() @ h))
    monkeypatch.setattr(quality, "PIECE", 300)
    monkeypatch.setattr(quality.cut, "__defaults__", (300,))
    assert [model.score(_bytes(t)) for t in texts] == pytest.approx(whole)


def test_attention_goes_to_the_passages_that_tell():
    """One spoilt passage among clean ones draws more weight than they do."""
    rng = random.Random(3)
    good = [words(rng, 320) for _ in range(60)]
    bad = [words(rng, 64 * 2) + " " + "## %%& " * 32 + words(rng, 64 * 2) for _ in range(60)]
    model = train([passages(_bytes(t)) for t in good + bad], [1] * 60 + [0] * 60)
    fresh = words(rng, 64 * 2) + " " + "## %%& " * 32 + words(rng, 64 * 2)
    assert model.score(_bytes(fresh)) < 0.5 < model.score(_bytes(words(rng, 320)))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = words(rng, rng.choice([60, 200]))
        if bad:
            text = " ".join(w + rng.choice(["##", "%%", "&&"]) for w in text.split())
        rows.append((i, text, "en", i % 7))
        labels.append((i, int(not bad)))
    rows += [(400, None, "", 0), (401, "", "", 0), (402, "   ", "", 0), (None, "a b", "", 0), (5, rows[5][1], "", 0), (403, "word " * 90_000, "", 0)]
    labels += [(1, None), (None, 0), (9999, 0), (2, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").repartition(6), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_odd_rows(spark, table):
    docs, labels = table
    got = scored(docs, labels).collect()
    assert len(got) == docs.count()
    at = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(at[i].predicted == int(i % 5 != 0) for i in held) >= 0.97 * len(held)
    assert at[400].score == at[401].score == at[402].score


def test_labels_of_held_out_rows_teach_nothing(spark, table):
    docs, labels = table
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = ({r.doc_id: r.score for r in scored(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_PER_LABEL", 3)
    monkeypatch.setattr(quality, "MAX_SAMPLE_CHARS", 50)
    rows = [(i, "x" * (10 if i % 2 else 100)) for i in range(40)] + [(1, "y" * 20)] * 30 + [(1, "x" * 10)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 20) for i in range(40)] * 2, "doc_id long, quality int")
    texts, known, weight_of = quality.labelled_sample(docs, labels)
    assert sorted(known) == [0, 0, 0, 1, 1, 1] and all(t == "x" * 10 for t in texts)  # long rows give way to others
    n = [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20 * k, 20 * k + 20)) for k in (0, 1)]
    assert weight_of == (n[0] / 3, n[1] / 3)


def test_one_kind_of_labels_and_empty_tables(spark, table):
    docs, labels = table
    assert {r.score for r in scored(docs.limit(5), labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in scored(docs.limit(5), labels.where("false")).collect()} == {1.0}
    assert scored(docs.where("false"), labels).count() == 0


def test_repeatable(spark, table):
    docs, labels = table
    a, b = fit(docs, labels), fit(docs.repartition(3), labels)
    assert isinstance(a, Attention) and all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)
