"""Documents to a knowledge graph: chunks, entities, golden entities, edges, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extract, resolve, text


def build(docs: DataFrame, key: str, body: str, kinds: dict[str, str], size: int = 400, overlap: int = 50) -> dict[str, DataFrame]:
    """chunks, entities (raw, a row a mention), golden, mentioned_in (entity to chunk), consolidates (golden to entity)."""
    chunks = text.chunks(docs, key, body, size, overlap)
    raw = extract.rule_entities(chunks.select("chunk_key", "text").distinct(), "chunk_key", "text", kinds)
    raw = raw.withColumn("entity_key", F.substring(F.md5(F.concat_ws(":", F.lower("name"), "chunk_key")), 1, 12)).withColumn("description", F.lit(""))
    golden = resolve.elect(raw, "type", "name", "entity_key", "description").withColumn("golden_key", F.concat(F.lit("g_"), F.substring(F.md5("norm"), 1, 12)))
    consolidates = golden.select("golden_key", "type", "norm").join(raw.withColumn("norm", F.lower(F.trim("name"))), ["type", "norm"]).select("golden_key", "entity_key")
    return {"chunks": chunks, "entities": raw, "golden": golden, "mentioned_in": raw.select("entity_key", "chunk_key").distinct(), "consolidates": consolidates.distinct()}


def hashed_embeddings(rows: DataFrame, key: str, body: str, dims: int = 64) -> DataFrame:
    """(key, embedding): unit vectors from hashed words, the deterministic stand-in for an embedding model."""

    def run(batches):
        import zlib

        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for t in pdf[body]:
                v = np.zeros(dims)
                for w in (t or "")[:512].lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dims] += 1 if h >> 16 & 1 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pd.DataFrame({key: pdf[key], "embedding": out})

    return rows.select(key, body).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def without_embedding(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no embedding yet."""
    return rows.join(done.filter("embedding IS NOT NULL").select(key), key, "left_anti")
