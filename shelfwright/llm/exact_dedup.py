"""Exact duplicates by skew-safe combining; native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.shared import free_name, table, written

#: Parts of a digest's rows: copies meet inside a part first, and a digest has at most so many winners for the last stage.
SALTS = 32


def normal_text(text: Column) -> Column:
    """Every run of white space becomes one blank; only runs that differ from one blank are rewritten. Null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame, digest) -> DataFrame:
    d = docs.select("doc_id", normal_text(F.col("text")).alias("content"))
    return d.withColumns({"digest": digest(F.col("content")), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})


def _winners(keyed: DataFrame) -> DataFrame:
    """(digest, content, keep_id, group_size, salts): one row per different content.

    The grouping key holds the full content in both stages, so texts of one digest are still told apart. The first
    aggregation is partly done inside each input task (equal copies of a part leave a task as one row), then ends per part; the
    second sees at most SALTS rows of a content, whatever number of copies there are. ``salts`` has a bit for each part.
    """
    parts = keyed.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))
    return parts.groupBy("digest", "content").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(bit).alias("salts"))


def _parted(found: DataFrame) -> DataFrame:
    """A row for each part that a group has rows in."""
    return found.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("salts"), i) == 1))).drop("salts")


def groups(docs: DataFrame, digest=lambda content: F.sha2(content, 256)) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): one row per row of ``docs``.

    Texts are equal when their normal forms are; ``digest`` only brings candidates together, so a weak one gives the same groups.
    ``keep_id`` is the smallest doc_id of the group. Contents travel in two shuffles; rows get the result of their group
    by a slim join on (digest, part), so a group with a third of all rows is spread over SALTS keys.

    Nulls: null text is the empty text; a row with null doc_id counts in its group but gives it no keep_id, unless all its rows have
    none: then keep_id is null and they are kept. Repeated rows (same doc_id, equal texts) are one document: all carry the same
    values, and ``deduplicated`` leaves one. Very long texts are compared whole. Extra columns are ignored, whatever their
    names; no rows give no rows.
    """
    keyed = _keyed(docs, digest)
    found = written(_winners(keyed).drop("content"), "exact-groups")
    shared = written(found.groupBy("digest").count().where("count > 1").select("digest"), "exact-clashes")
    slim = keyed.select("doc_id", "digest", "salt")
    parted = _parted(found)
    values = ("keep_id", "group_size")
    if shared.isEmpty():
        out = slim.join(parted.select("digest", "salt", *values), ["digest", "salt"])
    else:  # different contents with one digest: only these meet on their contents again
        plain = parted.join(shared, "digest", "left_anti").select("digest", "salt", *values)
        clash = keyed.join(shared, "digest", "left_semi")
        told = clash.join(_parted(_winners(clash)), ["digest", "salt", "content"])
        out = slim.join(plain, ["digest", "salt"]).select("doc_id", *values, "digest").union(told.select("doc_id", *values, "digest"))
    return out.select("doc_id", *values, F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one is left."""
    same = free_name(docs, "content_digest")
    d = docs.withColumn(same, F.sha2(normal_text(F.col("text")), 256))
    stays = groups(docs).where("kept").select(F.col("doc_id").alias("stay_id"), F.col("digest").alias("stay_digest")).distinct()
    on = d["doc_id"].eqNullSafe(stays["stay_id"]) & (d[same] == stays["stay_digest"])
    return d.join(stays, on, "left_semi").dropDuplicates(["doc_id", same]).select(*docs.columns)


def op13(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
