"""Text jobs: token correction, text to product, taxonomy scores, accuracy rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.functions import text as T
from shelfwright.session import cut_lineage


def correction_table(tokens: DataFrame, vocab: DataFrame, cutoff: float = 0.82, min_len: int = 4) -> DataFrame:
    """Best vocabulary word for each distinct token, similarity = 1 - distance / longer length.

    Two words within d edits share one of d+1 even segments at nearly the same place, so words are
    joined on (length, segment number, segment) and only those candidates are compared.
    ``tokens`` and ``vocab`` are single-column frames named ``w``.
    """
    allow = lambda n: F.floor(n * (1 - cutoff) / cutoff + F.lit(1e-9)).cast("int")
    v = vocab.select("w").distinct().withColumn("n", F.length("w")).withColumn("d", allow(F.col("n")))
    seg_lo = lambda n, d, i: F.floor(n * i / (d + 1)).cast("int")
    segs = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.struct(
        i.alias("i"), F.substring(F.col("w"), seg_lo(F.col("n"), F.col("d"), i) + 1, seg_lo(F.col("n"), F.col("d"), i + 1) - seg_lo(F.col("n"), F.col("d"), i)).alias("s")))
    vi = v.select(F.col("w").alias("v"), "n", F.explode(segs).alias("g"))
    t = tokens.select("w").where(F.length("w") >= min_len).distinct().join(v.select("w"), "w", "left_anti")
    n = F.length("w")
    t = t.withColumn("n", F.explode(F.sequence(F.ceil(n * cutoff - F.lit(1e-9)).cast("int"), F.floor(n / cutoff + F.lit(1e-9)).cast("int")))).withColumn("d", allow(F.col("n")))
    probes = F.flatten(F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.transform(
        F.sequence(-F.col("d"), F.col("d")), lambda sh: F.struct(i.alias("i"), F.when(
            seg_lo(F.col("n"), F.col("d"), i) + sh >= 0,
            F.substring(F.col("w"), seg_lo(F.col("n"), F.col("d"), i) + sh + 1, seg_lo(F.col("n"), F.col("d"), i + 1) - seg_lo(F.col("n"), F.col("d"), i))).alias("s")))))
    ti = t.select("w", "n", F.explode(F.array_distinct(F.filter(probes, lambda p: p["s"].isNotNull()))).alias("g"))
    cand = ti.join(vi, ["n", "g"]).select("w", "v").distinct()
    sim = T.similarity(F.col("w"), F.col("v"))
    return cand.withColumn("sim", sim).where(F.col("sim") >= cutoff).groupBy("w").agg(
        F.min_by("v", F.struct(-F.col("sim"), F.col("v"))).alias("fixed"))


def correct_texts(texts: DataFrame, vocab: DataFrame, cutoff: float = 0.82) -> DataFrame:
    """Tokens of each text with near misses replaced; ``texts`` = (id, text). Returns corrected tokens."""
    tok = texts.select("id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "token")).withColumn(
        "w", F.lower(F.regexp_replace("token", "[^a-zA-Z0-9]", "")))
    table = correction_table(tok.select("w"), vocab, cutoff)
    return tok.join(table, "w").select("id", "pos", "token", "fixed")


def keyword_scores(items: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """Keyword hits per item and class, joined on words; ties go to the smaller class id.

    ``items`` = (scan_id, pos, aisle, text), ``keywords`` = (class_id, word).
    """
    words = items.select("scan_id", "pos", "aisle", F.explode(F.array_distinct(F.split(F.lower(text), r"[^a-z0-9#]+"))).alias("word"))
    return words.join(keywords, "word").groupBy("scan_id", "pos", "aisle", "class_id").agg(F.count("*").alias("hits"))


def best_class(items: DataFrame, keywords: DataFrame, text: str = "text", foreign: bool = False) -> DataFrame:
    """Best scoring class of each distinct text; with ``foreign`` of each text and aisle, among the classes other than the aisle.

    Items repeat a lot of texts and equal texts score alike, so only distinct texts are split and counted. The table is written once: a join
    with it sees its size.
    """
    keys = ["aisle", text] if foreign else [text]
    words = items.select(*keys).distinct().select(*keys, F.explode(F.array_distinct(F.split(F.lower(text), r"[^a-z0-9#]+"))).alias("word"))
    found = words.join(keywords, "word")
    found = found.where(F.col("class_id") != F.col("aisle")) if foreign else found
    hits = found.groupBy(*keys, "class_id").agg(F.count("*").alias("hits"))
    return cut_lineage(hits.groupBy(*keys).agg(F.min_by("class_id", F.struct(-F.col("hits"), F.col("class_id"))).alias("best")))


def infer_class(items: DataFrame, keywords: DataFrame, brand_classes: DataFrame) -> DataFrame:
    """Class by keyword hits, else the only class the brand belongs to."""
    only = brand_classes.groupBy("brand").agg(F.count_distinct("class_id").alias("n"), F.min("class_id").alias("by_brand")).where("n = 1")
    return items.join(best_class(items, keywords), "text", "left").join(only.select("brand", "by_brand"), "brand", "left").select(
        "scan_id", "pos", F.coalesce("best", "by_brand").alias("class_id"))


def with_foreign_class(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """Items with the best scoring class other than their own aisle as ``foreign_class``; items without one are left out."""
    return items.join(best_class(items, keywords, foreign=True), ["aisle", "text"]).withColumnRenamed("best", "foreign_class")


def foreign_class(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """(scan_id, pos, foreign_class): one row for each item, which its scan and pos name, however often it is repeated."""
    return with_foreign_class(items, keywords).select("scan_id", "pos", "foreign_class").distinct()


def match_products(texts: DataFrame, catalogue: DataFrame, accept: float = 0.55) -> DataFrame:
    """Best catalogue product of each text: its brand must be named, then shared words decide.

    Token overlap plus a bonus or penalty for the stated volume. ``texts`` = (id, text);
    ``catalogue`` = (sku, brand_token, words, volume). Joined on the brand token.
    """
    t = texts.select("id", F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9#]+")).alias("tw"), T.volume_tokens(F.col("text")).alias("tv"))
    named = t.select("id", F.explode("tw").alias("brand_token")).join(catalogue.select("brand_token").distinct(), "brand_token", "left_semi")
    cand = named.join(catalogue, "brand_token").join(t, "id")
    over = F.size(F.array_intersect("words", "tw")) / F.greatest(F.size("words"), F.lit(1))
    vol = F.when(F.size("tv") == 0, 0.0).when(F.array_contains("tv", F.col("volume")), 0.08).otherwise(-0.05)
    return cand.withColumn("score", F.bround(0.5 * over + 0.5 + vol, 4)).where(F.col("score") >= accept).groupBy("id").agg(
        F.min_by(F.struct("sku", "score"), F.struct(-F.col("score"), F.col("sku"))).alias("m")).select("id", "m.sku", "m.score")


def candidate_score(text: Column, brand: Column, product: Column, sub: Column) -> Column:
    """Score of a pack text against a planned row: brand, product words, product kind, keywords."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    over = F.when(text != "", F.size(F.array_intersect(words(product), words(text))) / F.greatest(F.size(words(product)), F.size(words(text)))).otherwise(0.0)
    hits = F.size(F.filter(F.split(product, " "), lambda w: (F.length(w) >= 4) & text.contains(w)))
    b = F.when((brand != "") & text.contains(brand), 1.0).otherwise(0.0)
    kind = F.when((sub != "") & text.contains(sub), 0.12).otherwise(0.0)
    return F.when(b > 0, F.least(F.lit(1.0), b * 0.55 + over * 0.33 + kind + F.least(F.lit(0.35), hits * 0.08))).otherwise(0.0)


def accuracy_rates(rows: DataFrame, by: str) -> DataFrame:
    """Share of right brands and products and mean error rate, per class and overall."""
    return rows.rollup(by).agg(
        F.count("*").alias("n"), F.bround(F.count_if("brand_ok") * 100.0 / F.count("*"), 1).alias("brand_rate"),
        F.bround(F.count_if("product_ok") * 100.0 / F.count("*"), 1).alias("product_rate"),
        F.bround(F.avg(F.col("cer").cast("decimal(20,10)")).cast("double") * 100.0, 1).alias("cer_percent"))


def quality_gates(rates: DataFrame, product_min: float = 95.0, text_min: float = 95.0) -> DataFrame:
    gate = lambda c, t: F.when(F.col(c) < t, "FAIL").otherwise("PASS")
    return rates.select(rates.columns[0], gate("product_rate", product_min).alias("product_gate"), gate("brand_rate", text_min).alias("brand_gate"))
