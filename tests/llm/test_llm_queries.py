"""Registered queries of the subpackage against their SQL, and the pipeline against its stages done one by one."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, rows_of
from shelfwright.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op12_refined_whitening"}))  # op12: test_whitening.py
def test_query_returns_every_document(spark, name):
    ids = [r.doc_id for r in QUERIES[name](spark, SF).collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_pipeline_stages(spark):
    import re

    import public_tokenizers as tok
    import tiktoken

    from shelfwright.llm import bpe, mixture, quality, secrets
    from test_llm_operators import jaccard_groups  # noqa: I001

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert one.columns == docs.columns
    verdicts = {r.doc_id: r.kept for r in QUERIES["op9_quality_decision_list"](spark, SF).collect()}
    kept = one.collect()
    assert {r.doc_id for r in kept} == {k for k, v in verdicts.items() if v}
    two = corpus_pipeline.STAGES[1][1](spark, one, SF)
    groups = jaccard_groups([(r.doc_id, r.text) for r in kept])
    assert sorted(r.doc_id for r in two.collect()) == sorted(d for d, _, c in groups if d == c)
    three = corpus_pipeline.STAGES[2][1](spark, two, SF)
    assert three.columns == docs.columns and three.count() == two.count()
    assert secrets.find(three)[1].where("start IS NOT NULL").count() == 0
    clean = {r.doc_id: r.text for r in secrets.find(two)[0].where("size(found) = 0").collect()}
    assert all(r.text == clean[r.doc_id] for r in three.collect() if r.doc_id in clean)
    four = corpus_pipeline.STAGES[3][1](spark, three, SF)
    taken = {r.doc_id: r.taken for r in mixture.mix(three).collect()}
    seen: dict = {}
    for r in four.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert seen == {k: v for k, v in taken.items() if v}
    five = corpus_pipeline.STAGES[4][1](spark, four, SF)
    enc = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=bpe.read_ranks(tok.path(bpe.RANK_FILE)), special_tokens={})
    assert sorted((r.doc_id, list(r.ids)) for r in five.collect()) == sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in four.collect())
    assert quality.FEATURES
    run = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert run == sorted((r.doc_id, list(r.ids)) for r in five.collect())
