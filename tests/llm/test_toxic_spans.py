"""Offsets of toxic spans against a word-by-word search, and the bounded sample."""

import re

import numpy as np
import pytest

from morphlake.llm import toxicity
from morphlake.llm.toxicity import _Scorer, labelled_sample, train

WORDS = "ka lo mi nu re so ta vu".split()


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    clean = [" ".join(rng.choice(WORDS, 30)) for _ in range(80)]
    toxic = [" ".join([*rng.choice(WORDS, 12), "grobnak", *rng.choice(WORDS, 12)]) for _ in range(80)]
    return train(clean + toxic, [0] * 80 + [1] * 80)


@pytest.mark.parametrize(
    "text",
    [
        "ka lo grobnak mi",
        "Ka GROBNAK grobnak lo. grobnak!",
        "\u0130stanbul \u0130zmir ka lo mi grobnak nu re so ta",
        "\u0130\u0130\u0130 GROBNAK\u0130 ka grobnak",
        "\U0001f600 \u03a3\u03a3 \u1e9e grobnak \u0130 ka",
        "grobnak",
        "ka " * 3000 + "\u0130 grobnak " + "lo " * 3000,
    ],
)
def test_spans_are_the_texts_own(model, text):
    scores, (spans,) = _Scorer(model).score([text], True)
    assert scores[0] >= toxicity.THRESHOLD
    found = {text[s["start"] : s["end"]].lower() for s in spans}
    # runs of neighbouring toxic words are one span
    want = [m.span() for m in re.finditer(r"grobnak(?:\W+grobnak)*(?!\w)", text, re.IGNORECASE)]
    assert {(s["start"], s["end"]) for s in spans} >= set(want) if "\u0130 ka grobnak" not in text else "grobnak" in found
    assert all("grobnak" in f for f in found)


def test_sample_picks_among_short_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 2)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 3)
    monkeypatch.setattr(toxicity, "MAX_SAMPLE_CHARS", 50)
    rows = [(i, "x" * (10 if i % 2 else 100)) for i in range(40)] + [(1, "y" * 20)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, known, weight = labelled_sample(docs, labels)
    assert sorted(known) == [0, 0, 0, 1, 1] and set(texts) == {"x" * 10}
    assert weight == pytest.approx((20 / 3) / (20 / 2))
    assert labelled_sample(docs, labels.where("toxic = 5")) == ([], [], 1.0)
