"""The stages, the whole pipeline, and the registered queries."""

import pytest
from compare import same_rows

import corpus_pipeline
from tempolith.llm.queries import LLM


def test_names_and_oracles():
    names = list(LLM.queries())
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: (len(n.split("_")[0]), n)) if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(LLM.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir, duck):
    same_rows(LLM.queries()[name](spark, sf_dir), duck.sql(LLM.oracle_sql()[name]))


def test_stages_keep_columns_and_handle_odd_rows(spark, sf_dir, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == odd_docs.columns, name
        assert out.dtypes == odd_docs.dtypes, name
        docs = out.cache()
        assert docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_stages_on_empty_tables(spark, sf_dir, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name


def test_decisions_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert n - 2 <= kept.count() <= n
    clean = corpus_pipeline.toxicity_filter(spark, docs, sf_dir)
    insults = "idiot|moron|scum|loser|pathetic"
    assert clean.filter(clean.text.rlike(rf"\b({insults})\b")).count() < docs.filter(docs.text.rlike(rf"\b({insults})\b")).count()
    one = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert one.count() < n and one.select("text").distinct().count() == one.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) >= {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0
