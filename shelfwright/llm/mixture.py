"""Mixing sources to target weights by capped water-filling; native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm.shared import SPACE, WORD, n_words, table

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
#: Hash buckets of one source; the documents of a hot source are ranked inside buckets.
BUCKET_HEX = 3


def source_key(source: Column) -> Column:
    """Non-null form of a source, null being a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def water_fill(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources: ``sizes`` has one row per source (skey, source, source_size).

    Sources ordered by code point, null last, weigh ``weights`` in turn. A source stops at ``max_epochs`` times its size
    and the excess is reshared by weight. With sources ordered by cap / weight, a prefix is capped and all others
    share what is left: the level is found with two running sums instead of rounds. One row per source
    passes through one task; documents never do.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    every = Window.partitionBy()
    level = Window.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("total", F.sum("source_size").over(every) * budget_percent / F.lit(100.0))
         .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(level), F.lit(0)).cast("double"))
         .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(level), F.lit(0)))
         .withColumn("water", F.col("left_words") / F.col("left_weight"))
         .withColumn("capped", F.col("water") * F.col("weight") >= F.col("cap")))
    # The first uncapped source fixes the level; every source behind it has more room per weight.
    water = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "skey", "water"))).over(every)
    s = s.withColumn("level", water["water"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("skey", "source_size", target.alias("target"))


def _mixed(docs: DataFrame, seed: int = 7, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(row: the columns of ``docs``, size, source_size, target, taken)."""
    d = docs.select(F.struct("*").alias("row"), n_words(F.col("text")).alias("size"), source_key(F.col("source")).alias("skey"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"),
                    F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("mix_hash"))
    d = d.withColumn("mix_bucket", F.substring("mix_hash", 1, BUCKET_HEX))
    buckets = d.groupBy("skey", "mix_bucket").agg(F.sum("size").alias("bucket_size"), F.max("source").alias("source"))
    sizes = buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size"), F.max("source").alias("source"))
    plan = water_fill(sizes, weights, budget_percent, max_epochs)
    before = Window.partitionBy("skey").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = (buckets.select("skey", "mix_bucket", "bucket_size").join(plan, "skey")
         .withColumn("take", F.round("target").cast("long"))
         .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0)).cast("long"))
         .withColumn("room", F.col("take") - F.col("whole") * F.col("source_size") - F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
         .select("skey", "mix_bucket", "source_size", "target", "whole", "room"))
    ahead = Window.partitionBy("skey", "mix_bucket").orderBy("mix_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(b, ["skey", "mix_bucket"])
    rest = F.col("room") - F.coalesce(F.sum("size").over(ahead), F.lit(0))
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return d.select("row", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``size, source_size, target, taken`` (words taken of each row) to all rows of ``docs``.

    Each document is repeated as a whole ``floor(taken of source / size of source)`` times; the rest of the source's
    target is filled in a seeded order with one more repetition, the last of which is fractional. A source thus takes
    its target to the word. The order uses hash buckets of (source, hash): bucket totals are summed first, so a
    source with a third of all rows is ranked in thousands of small groups.

    Nulls: null text has size 0; null source is a source, the last; null doc_id is hashed as an empty one. Repeated
    rows count each; their order among themselves does not change the rows returned. Sources of size 0 have target 0. Extra
    columns are kept; columns named like an added one are replaced. An empty table gives an empty result.
    """
    made = ("size", "source_size", "target", "taken")
    return _mixed(docs, seed, weights, budget_percent, max_epochs).select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in made], *made)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per repetition, the fractional one cut behind its last word."""
    text = F.col("row")["text"]
    rest = F.expr("CASE WHEN size > 0 THEN taken % size ELSE 0 END").cast("int")
    whole = F.expr("CASE WHEN size > 0 THEN taken div size ELSE 0 END").cast("int")
    words = F.regexp_extract_all(text, F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))  # each with the space before it
    part = F.array_join(F.slice(words, F.lit(1), rest), "")
    texts = F.concat(F.array_repeat(text, whole), F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = _mixed(docs, **options).select("row", F.explode(texts).alias("part"))
    return out.select(*[F.col("part").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7' || coalesce(':' || doc_id::VARCHAR, '')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
              2 * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ()) * 150 / 100.0::DOUBLE AS total,
              coalesce(sum(cap) OVER o, 0)::DOUBLE AS capped_before, coalesce(sum(w) OVER o, 0)::DOUBLE AS w_before, (sum(w) OVER ())::DOUBLE AS w_all
       FROM s1 WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total::DOUBLE - capped_before) / (w_all - w_before) AS water FROM s2),
lv AS (SELECT arg_min(water, cap::DOUBLE / w) AS level FROM s3 WHERE water * w < cap),
s4 AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level * w, cap::DOUBLE)) AS target FROM s3, lv),
j AS (SELECT d.*, s4.source_size, s4.target, round(s4.target)::BIGINT AS take,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN take // source_size * size ELSE 0 END
        + greatest(0, least(size, (CASE WHEN source_size > 0 THEN take % source_size ELSE 0 END) - ahead)))::BIGINT AS taken
FROM j
"""
