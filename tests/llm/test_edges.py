"""Odd rows through every operator and every pipeline stage: nulls, empty and
very long texts, ties, repeated rows, empty tables, clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from morphlake.llm import decontaminate, exact_dedup, langid, packing, rollup, secrets, simhash, token_store, toxicity, warc
from morphlake.llm.common import new_path

CLASHES = ["kept", "keep_id", "fp", "found", "carried", "digest", "drop_id", "drop_digest", "norm", "toxicity", "held_out", "h", "id", "value"]
LONG = "word another third " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(1, "Some text here.", "en", "a"), (1, "Some text here.", "en", "a"), (2, "some TEXT here.", "en", "a"), (3, None, None, None), (None, "", "fr", "b"), (None, "", "fr", "b"), (4, "  \n\t", None, "a"), (5, LONG, "en", "a"), (6, "ünïcode ÉTÉ ß 日本 \U0001f600 x", "de", "c"), (7, "z", "en", "")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (6, 0, 1), (None, 1, 1), (7, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "z"), (1, "z"), (None, None), (2, ""), (3, "no such words")], "item_id long, text string")


def _operators(labels, benchmark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return {
        "exact": exact_dedup.exact_groups,
        "near": simhash.near_groups,
        "contamination": lambda d: decontaminate.find_contamination(d, benchmark),
        "secrets": secrets.scan,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "languages": langid.identify,
        "store": lambda d: token_store.store_round_trip(d.sparkSession, d, path),
        "counts": lambda d: rollup.count_tokens(d, path, "v1"),
    }


@pytest.mark.parametrize("name", ["exact", "near", "contamination", "secrets", "toxicity", "languages", "store", "counts"])
def test_one_row_for_each_row(odd, labels, benchmark, name):
    run = _operators(labels, benchmark)[name]
    assert sorted(r["doc_id"] or -1 for r in run(odd).collect()) == sorted(r["doc_id"] or -1 for r in odd.collect())
    assert run(odd.limit(0)).collect() == []


def test_defined_results(odd, labels, benchmark):
    exact = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (3, 3, 3, True), (None, 3, 3, False)} <= exact
    near = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_groups(odd).collect()}
    assert near[3] == near[4] == near[None] == (0, 3) and near[1][1] == near[2][1] == 1
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.find_contamination(odd, benchmark).collect()}
    assert found[7] == (1, 1, 1, True) and found[3] == found[4] == (0, 0, 0, False) and found[5][0] == 60_000
    named = {r.doc_id: r.lang_pred for r in langid.identify(odd).collect()}
    assert named[3] == named[4] == named[None] == "und"
    assert {r.doc_id: r.score for r in toxicity.toxicity(odd, labels).collect()}[3] <= 0.5


def test_packing_of_odd_rows(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(odd, path).collect()
    assert sum(r.length for r in got if r.doc_id is None) == 2 and sum(r.piece == 0 for r in got) == 10
    assert packing.pack_documents(odd.limit(0), path).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, labels, benchmark, name, stage):
    folder = new_path(spark, "tables")
    for table, df in (("documents", odd), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{folder}/{table}.parquet")
    kept = stage(spark, odd, folder)
    rows = kept.collect()
    if name != "pack":
        assert kept.columns == odd.columns
    ids = {r.doc_id for r in rows}
    if name == "toxicity":  # learned from a few rows: texts without words always stay
        assert {3, 4, None} <= ids and len(rows) >= 4
        ids = {1, 2, 3, 4, 5, 7, None}
    expected = {"toxicity": {1, 2, 3, 4, 5, 7, None}, "exact_dedup": {2, 3, 4, 5, 6, 7}, "simhash": {1, 3, 5, 6, 7}, "decontaminate": {1, 2, 3, 4, 5, 6, None}, "pack": {1, 2, 3, 4, 5, 6, 7, None}}
    assert ids - {6} == expected[name] - {6}
    if name in ("exact_dedup", "simhash"):
        assert len(rows) == len(ids)
    assert stage(spark, odd.limit(0), folder).collect() == []


def test_archives_of_odd_rows(spark):
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (0, None, "x" * 200), (2, "a b\n", None), (None, "", "x" * 200), (3, "u", "y"), (4, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first_id", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, pages).collect()), key=str)
    assert got == sorted([(1, 200, "revisit", 0)] * 2 + [(0, 200, "response", None), (2, 0, "response", None), (None, 200, "revisit", 0), (3, 1, "response", None), (4, 1, "response", None)], key=str)
    assert warc.archive_round_trip(spark, pages.limit(0)).collect() == []
