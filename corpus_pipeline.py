"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet
in the shared folder and reads it again for the next one. All stages but the last return the columns of
``documents``, whatever further columns these have.

Defined cases, for each stage: null text is rejected by the first stage (it has no language); repeated rows are
scored one by one by the first two stages, and the third keeps one of them; empty tables pass through; the last
stage has pieces for every row it gets, so a document that the mix repeats is packed as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolith.llm import common, langid, mixing, near_dups, packing, tokens, toxicity
from tempolith.session import ship
from tempolith.tables import load

#: Whole rows can't be given in SQL: models are fitted in between.
ORACLE_SQL = None


def _judged(docs: DataFrame, judge, reject: str) -> DataFrame:
    """The rows that ``judge`` doesn't reject. It sees other columns under neutral names, so that none can clash."""
    d, names = common.neutral(docs, ("text",))
    kept = judge(d).filter(~F.col(reject))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in; the rest, and texts without letters, go."""
    ship(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return _judged(docs, lambda d: langid.identify(d, model), "rejected")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't find toxic."""
    ship(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return _judged(docs, lambda d: toxicity.score(d, model), "is_toxic")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    ship(spark)
    return near_dups.deduplicated(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole or in part and up to twice, so that sources have their target weights."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack(docs, tokens.public_path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage left in the shared folder goes when its result is written."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.scratch(spark, f"pipeline-{name}")
        mark = common.scratch_mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        common.release(mark)
        docs = spark.read.parquet(path)
    return docs
