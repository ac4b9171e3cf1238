"""Token counts: the query against a recount, and commits that fail half-way."""

import collections

import public_tokenizers
from tokenizers import Tokenizer

from morphlake.llm import queries, rollup
from morphlake.llm.common import new_path

SUMS = "source string, lang string, tokenizer string, documents long, tokens long"


def totals(kept):
    return {(r.source, r.lang): (r.documents, r.tokens) for r in kept.totals().collect()}


def test_query_equals_a_recount(spark):
    texts = ["one two three", "", None, "ünï  cödé\n\nx" * 9, "a" * 5000]
    rows = [(k, texts[k % 5], ("en", "de", None)[k % 3], f"s{k % 4}") for k in range(120)] + [(None, "x y", None, None), (5, "again", "en", "s1"), (5, "again", "en", "s1")]
    folder = new_path(spark, "counted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.defaultdict(lambda: [0, 0])
    for _, text, lang, source in rows:
        want[source, lang][0] += 1
        want[source, lang][1] += len(library.encode(text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang): [r.documents, r.tokens] for r in queries.op8_token_rollup(spark, folder).collect()}
    assert got == want


def test_a_driver_that_dies_while_it_commits(spark):
    kept = rollup.Rollup(spark, new_path(spark, "rollup"))
    changes = spark.createDataFrame([("a", None, "v", 1, 5), ("a", None, "v", 1, 5), (None, "x", "v", 0, 0)], SUMS)
    kept._fs.create(kept._marker("one"), False).close()  # an empty marker
    assert not kept.committed("one") and totals(kept) == {}
    assert kept.commit("one", changes) and kept.committed("one") and totals(kept) == {("a", None): (2, 10)}
    assert not kept.commit("one", changes) and totals(kept) == {("a", None): (2, 10)}
    assert kept.commit("two", changes.limit(0)) and totals(kept) == {("a", None): (2, 10)}


def test_two_compactors(spark):
    folder = new_path(spark, "rollup")
    one, two = rollup.Rollup(spark, folder), rollup.Rollup(spark, folder)
    for k in range(3):
        one.commit(f"batch {k}/x", spark.createDataFrame([("a", "b", "v", 1, k)], SUMS))
    seen = two._entries()
    two._entries = lambda: seen  # what it read before the other was done
    one.compact([f"batch {k}/x" for k in range(2)])
    two.compact([f"batch {k}/x" for k in range(3)])
    assert totals(rollup.Rollup(spark, folder)) == {("a", "b"): (3, 3)}
    assert not one.commit("batch 1/x", spark.createDataFrame([("a", "b", "v", 1, 1)], SUMS))
