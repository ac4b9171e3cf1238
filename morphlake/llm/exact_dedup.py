"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Each text is cut where its own content says so (after a line end or a sentence
end), so equal passages give equal chunks wherever they stand.  A chunk is
known by a 64-bit hash which is verified with SHA-256: a hash that stands for
two contents is replaced by the digest itself.  Texts are then compared by
their ordered lists of identifiers.  To find copies the text is read once
and not shuffled; what moves is about 10 bytes for each 600 characters.

Defined results: a null text counts as empty; an empty text has an empty
recipe and groups with other empty texts; a null id is smaller than any other;
repeated rows are members of their group like any row and get one row each;
an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, may_hold, spare_name

MIN_CHUNK, MAX_CHUNK = 512, 8192
#: A chunk ends at the first line or sentence end after MIN_CHUNK characters.
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 2}}}?(?:\n|[.!?][ \t])|.{{1,{MAX_CHUNK}}}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the digest of the normalised text, and the
    recipe, an array of ``{h: 64-bit hash, d: SHA-256}`` in text order."""
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))
    return norm.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks, lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d"))).alias("recipe"),
    )


def chunk_dictionary(recipe: DataFrame) -> DataFrame:
    """Chunks known by more than one content: their hash does not identify them."""
    return (
        recipe.select(F.explode("recipe").alias("c"))
        .groupBy(F.col("c.h").alias("h"))
        .agg(F.min("c.d").alias("least"), F.max("c.d").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("h")
    )


def identifier_lists(recipe: DataFrame, unsafe: DataFrame, any_unsafe: bool) -> DataFrame:
    """``doc_id, text_sha256, ids``: the ordered verified identifiers.

    Where no hash is ambiguous the hashes are the identifiers.  Otherwise each
    chunk looks up its hash and an ambiguous one is known by its digest.
    """

    def plain(c: Column) -> Column:
        return F.unhex(F.lpad(F.hex(c["h"]), 16, "0"))

    if not any_unsafe:
        return recipe.select("doc_id", "text_sha256", F.transform("recipe", lambda c: plain(c)).alias("ids"))
    keyed = recipe.withColumn("row", F.expr("uuid()"))
    keyed = materialize(keyed, "keyed")
    looked = (
        keyed.select("row", F.posexplode("recipe").alias("pos", "c"))
        .withColumn("h", F.col("c.h"))
        .join(unsafe.withColumn("bad", F.lit(True)), "h", "left")
        .select("row", "pos", F.when(F.col("bad"), F.col("c.d")).otherwise(plain(F.col("c"))).alias("id"))
        .groupBy("row")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    )
    return keyed.join(looked, "row", "left").select("doc_id", "text_sha256", F.coalesce("ids", F.array().cast("array<binary>")).alias("ids"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Of equal texts (A-Z lower-cased) the row with the largest id stays.
    """
    recipe = materialize(recipes(docs, id_col, text_col), "recipes")
    unsafe = materialize(chunk_dictionary(recipe), "unsafe")
    any_unsafe = not unsafe.isEmpty()
    lists = identifier_lists(recipe, unsafe, any_unsafe)
    if any_unsafe:
        lists = materialize(lists, "lists")
    # counted before the shuffle; written, so that the join below has two plain
    # exchanges and a hot group can be split over tasks
    groups = materialize(lists.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return lists.join(groups, "ids").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each text; columns as they came.

    Repeated rows (same id, same text) are copies as well: one of them stays.
    Only rows that a filter of the dropped ids lets through are shuffled with
    their texts; the others stay where they are.
    """
    found = materialize(exact_groups(docs, id_col, text_col), "decisions")
    mark, key, gone_mark, hint = (spare_name(docs, n) for n in ("digest", "drop_id", "drop_digest", "in_doubt"))
    repeated = materialize(found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1"), "repeated")
    again = not repeated.isEmpty()
    dropped = materialize(found.where(~F.col("kept")).select("doc_id", "text_sha256"), "dropped")
    marked = may_hold(docs, F.col(id_col), dropped.select("doc_id").union(repeated.select("doc_id")), hint)
    rows = marked.where(F.col(hint)).withColumn(mark, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    gone = dropped.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(gone_mark))
    left = rows.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(mark) == F.col(gone_mark)), "left_anti")
    if again:
        left = left.dropDuplicates([id_col, mark])
    return marked.where(~F.col(hint)).select(*docs.columns).union(left.select(*docs.columns))
