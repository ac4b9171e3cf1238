"""Each stage of the pipeline against brute force on what the one before kept,
near copies by the exact similarity of 0.8."""

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from morphlake.llm.common import new_path

from .test_brute_force import corpus, lower  # noqa: F401
from .test_near_copies import survivors

WINDOW, LENGTH = 13, 2048


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contaminated(text, items):
    """By the rule for benchmark passages: 5 % of the words lie in windows."""
    found, hit = words(text), set()
    windows = {tuple(w[i : i + WINDOW]) for w in map(words, items) if w for i in range(max(1, len(w) - WINDOW + 1))}
    for window in windows:
        for i in range(len(found) - len(window) + 1):
            if tuple(found[i : i + len(window)]) == window:
                hit.update(range(i, i + len(window)))
    return bool(hit) and 20 * len(hit) >= len(found)


def check_packing(rows, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == docs.keys()
    for doc, text in docs.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(pieces[doc], key=lambda r: r.piece)):
            part = np.array(ids[at : at + LENGTH], "<u4")
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, at, len(part), zlib.crc32(part.tobytes()))
            at += len(part)
        assert at == len(ids)
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= LENGTH


def test_stages(spark, corpus):  # noqa: F811
    folder, docs, passages = corpus
    now = spark.read.parquet(f"{folder}/documents.parquet")
    base = next(t.split(" ") for d, t in docs.items() if len(t.split(" ")) == 120 and "grobnak" not in t.lower() and not contaminated(t, passages))
    near = {1000 + k: " ".join([*base[: 9 * k], f"other{k}", *base[9 * k :]]) for k in range(9)}
    far = {2000 + k: " ".join(w if i % (k + 2) else f"far{k}" for i, w in enumerate(base)) for k in range(9)}
    docs = docs | near | far
    made = [(d, t, "xx", "made", len(t)) for d, t in (near | far).items()]
    now = now.unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontaminate", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, now, folder).write.parquet(path)
        made = spark.read.parquet(path)
        before, rows = {r.doc_id: r.text for r in now.collect()}, made.collect()
        kept = {r.doc_id for r in rows}
        if name != "pack":
            assert made.columns == now.columns and len(rows) == len(kept)
            assert all(before[r.doc_id] == r.text for r in rows)
        if name == "toxicity":
            clean = {d for d, t in docs.items() if "grobnak" not in t.lower()}
            assert kept <= clean and len(kept) > 0.7 * len(clean)
        elif name == "exact_dedup":
            assert kept == {max(d for d, t in before.items() if lower(t) == x) for x in {lower(t) for t in before.values()}}
        elif name == "simhash":
            assert kept == survivors(before) and kept < before.keys()
        elif name == "decontaminate":
            bad = {d for d, t in before.items() if contaminated(t, passages)}
            assert bad and kept == before.keys() - bad
        else:
            check_packing(rows, before)
        now = made
