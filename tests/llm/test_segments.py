"""Segments that are known, new and odd, against the library; chunks sorted by number."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from morphlake.llm import token_store, tokens

rng = random.Random(4)
WORDS = ["".join(rng.choices("abcdeé'.,1A", k=rng.randint(1, 9))) for _ in range(400)] + ["日本語", "naïve", "ﬁn", "a\0b", "Σας", "İx", "x\ty", "", "tail "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("most", [0, 50, 300_000])
def test_known_segments_against_the_library(monkeypatch, name, most):
    monkeypatch.setattr(tokens, "MAX_SEGMENTS", most)
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    encoder = tokens.Encoder(open(path).read())
    for _ in range(4):
        texts = [" ".join(rng.choices(WORDS[:-9] if k % 2 else WORDS, k=rng.randint(0, 60))) for k in range(40)] + [None, "", " ", "one"]
        ids, bounds = encoder.encode_all(pa.array(texts), 7)
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert len(encoder.known) <= most and len(encoder.size) == len(encoder.known) and len(encoder.flat) == encoder.size.sum()


def test_recipes_and_chunks_are_dealt_apart(spark):
    """Rows sort by one number; chunks are stored once, recipes of equal texts as often as they come."""
    docs = spark.createDataFrame([(k, f"text {k % 3} " * 400) for k in range(30)], "doc_id long, text string").repartition(5)
    source = spark.sparkContext.broadcast(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    rows = token_store._encoded(docs, source, 2, 2)
    assert {(r.kind, r.deal >= 0) for r in rows.select("kind", "deal").collect()} == {("chunks", True), ("recipes", False)}
    dealt = rows.repartition(4, "deal").sortWithinPartitions("deal", "key").mapInArrow(token_store._first_of_each, token_store._ROWS).select("kind", "key").collect()
    keys = [bytes(r.key) for r in dealt if r.kind == "chunks"]
    assert len(keys) == len(set(keys)) and sum(r.kind == "recipes" for r in dealt) == 30
    assert set(keys) == {bytes(r.key) for r in rows.where("kind = 'chunks'").select("key").collect()}
