"""A corpus in five stages: quality rules, near-duplicates, secrets, source mixture, token ids.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, or the rows it makes of them; all but the last keep
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm import bpe, mixture, near_dup, quality, secrets
from shelfwright.llm.shared import free_name, written


def without_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret, a private key with its whole body, becomes ``[secret]``; n_chars follows the text. No document is dropped."""
    name = free_name(docs, "found")
    found, _ = secrets.find(docs, rules=secrets.REDACTED, name=name)
    hit = F.size(name) > 0
    text = F.when(hit, secrets.redacted(F.col("text"), F.col(name))).otherwise(F.col("text"))
    return with_text(found, docs, text, hit)


def with_text(rows: DataFrame, docs: DataFrame, text, changed) -> DataFrame:
    """The columns of ``docs`` with a new text; n_chars follows where it changed."""
    cols = {"text": text, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in docs.columns])


def mixed_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; n_chars follows the text where a repetition is fractional."""
    taken = mixture.repeated(docs)
    return with_text(taken, docs, F.col("text"), F.lit(True))


STAGES = [
    ("quality_rules", quality.stage),
    ("near_duplicates", near_dup.stage),
    ("secret_scans", without_secrets),
    ("source_mixture", mixed_sources),
    ("token_ids", bpe.stage),
]

#: Learned rules, MinHash candidates and merges are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
