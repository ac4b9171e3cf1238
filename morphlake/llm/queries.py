"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, sql
from .audit import audit
from .common import materialize, new_path, table
from .decontaminate import find_contamination
from .exact_dedup import exact_groups
from .langid import identify
from .packing import pack_documents
from .quality import quality
from .rollup import Rollup, count_tokens, deletes, inserts, revisions
from .secrets import digest_columns, scan
from .simhash import near_groups
from .token_store import store_round_trip
from .toxicity import toxicity
from .warc import archive_round_trip


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan(table(spark, sf_dir, "documents")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    texts = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("spans", F.array_join(texts, ","))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first batch holds an old state: some documents under another language,
    some with an older count, some twice.  Later batches move, revise and delete;
    every batch is committed and then replayed, and some are folded together."""
    counted = materialize(count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k"), "counted")
    moved, revised, twice = (F.coalesce(F.pmod("doc_id", F.lit(n)) == k, F.lit(False)) for n, k in ((7, 1), (5, 2), (11, 3)))
    old = F.when(revised, F.col("tokens") + 3).otherwise(F.col("tokens"))
    before = counted.withColumn("old_tokens", old).withColumn("lang", F.when(moved, F.lit("unsorted")).otherwise(F.col("lang")))
    batches = {
        "load": inserts(before.withColumn("tokens", F.col("old_tokens"))).unionByName(inserts(counted.where(twice))),
        "revise": revisions(before.where(revised)),
        "move": deletes(before.where(moved)).unionByName(inserts(counted.where(moved))),
        "withdraw": deletes(counted.where(twice)),
    }
    rollup = Rollup(spark, new_path(spark, "rollup"))
    for name, changes in batches.items():
        for _ in range(2):
            rollup.commit(name, changes)
    rollup.compact(["load", "revise"])
    rollup.commit("revise", batches["revise"])
    return rollup.totals()


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).drop("languages")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_secrets": op3_secrets,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_pack": op6_pack,
    "op7_toxicity": op7_toxicity,
    "op8_token_rollup": op8_token_rollup,
    "op9_langid": op9_langid,
    "op10_token_store": op10_token_store,
    "op11_quality": op11_quality,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN b >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN b >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM (SELECT page_id, octet_length(encode(h)) AS b, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first_id
              FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
    """,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM (SELECT doc_id,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
              FROM documents)
    """,
    "op12_filter_audit": sql.AUDIT,
    "op13_centroids": sql.clusters(centroids.ROUNDS, centroids.CENTROIDS, centroids.DIMENSIONS, centroids.SEED),
}
