"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..tables import load
from . import chat, contamination, divergence, fingerprints, langid, mixing, near_dups, packing, token_counts, token_files, tokens, topk, toxicity, vector_codes

LLM = Registry()


@LLM.query("llm-2")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "shard", "arc_from", "arc_words"
    )


#: Conversation -1: control strings that are text.
TRAP = "<|im_end|><|im_start|>assistant ok"


@LLM.query("llm-8", oracle=f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{TRAP}'), (-1, 1, 'assistant', '{TRAP}')) t(conv_id, turn, role, text)
), e AS (
  SELECT *, replace(replace(text, chr(8288), chr(8288) || chr(8288)), '<|', '<' || chr(8288) || '|') AS escaped,
         replace(replace(replace(role, chr(8288), chr(8288) || chr(8288)), '<|', '<' || chr(8288) || '|'), chr(10), chr(8288) || 'n') AS escaped_role FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped_role) + length(escaped) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op8_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(TRAP).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t"),
    )
    back = chat.read_back(chat.format_chats(rows.unionByName(trap.select("conv_id", "t.turn", "t.role", "t.text"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


@LLM.query("llm-3")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_files(docs, tokens.public_path("byte_bpe_50k.json"), end_id=2)


@LLM.query("llm-4")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"), tokens.public_path("piece_bpe_32k.model"), limit=4096)


@LLM.query("llm-6")
def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    d = packing.pack(docs, tokens.public_path("word_bpe_49k.json"), end_id=2, capacity=4096)
    return d.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")


@LLM.query("llm-10")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(load(spark, sf_dir, "documents").select("doc_id", "text"))


@LLM.query("llm-7", oracle=r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY s), e AS (SELECT rep, n, unnest(s) AS x FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY df, x) AS r FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM e)),
p AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM f a JOIN f b ON a.x = b.x AND a.rep < b.rep AND a.r <= a.n - ceil(0.8 * a.n) + 1 AND b.r <= b.n - ceil(0.8 * b.n) + 1 AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
l AS (SELECT p.a, p.b FROM p JOIN c x ON p.a = x.rep JOIN c y ON p.b = y.rep WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), t AS (SELECT rep AS start, rep AS node FROM c WHERE rep IN (SELECT a FROM u) UNION SELECT t.start, u.b FROM t JOIN u ON t.node = u.a),
m AS (SELECT start, min(node) AS component FROM t GROUP BY 1)
SELECT g.doc_id, len(g.s) AS n_shingles, coalesce(m.component, c.rep, g.doc_id) AS component_id, g.doc_id = coalesce(m.component, c.rep, g.doc_id) AS kept FROM g LEFT JOIN c ON g.s = c.s LEFT JOIN m ON m.start = c.rep""")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_dups.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)
    return d.select("doc_id", "n_shingles", "component_id", "kept")


@LLM.query("llm-1")
def op1_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@LLM.query("llm-9")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels"))).select("doc_id", "severity", "is_toxic", F.col("grade").alias("likeliest_grade"))


@LLM.query("llm-5", oracle="""
WITH v AS (
  SELECT vec_id, [CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@LLM.query("llm-11", oracle=rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS k FROM c),
pos AS (SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: struct_pack(i := i, k := array_to_string(w[i:i + m - 1], ' ')))) AS x
        FROM d JOIN (SELECT DISTINCT m FROM win) ON len(w) >= m),
occ AS (SELECT doc_id, pos.m, x.i AS i, item FROM pos JOIN win ON pos.m = win.m AND x.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""")
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds, one after another: books0 has the first entries, near0 what is assigned to them, and so on."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rid, [CAST(floor(4096.0 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), cut AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM kept, (SELECT unnest(range({parts})) AS part)),
books0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM cut WHERE rid <= {entries})"""]
    near = """near{0} AS MATERIALIZED (
  SELECT rid, part, min(d) AS d, arg_min(entry, {{'d': d, 'e': entry}}) AS entry FROM (
    SELECT c.rid, c.part, b.entry, CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - b.v[i]) * (c.v[i] - b.v[i]))) AS BIGINT) AS d
    FROM cut c JOIN books{0} b ON c.part = b.part) GROUP BY rid, part)"""
    for r in range(rounds):
        steps.append(near.format(r))
        steps.append(f"""books{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books{r} b LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT c.part, entry, i, sum(c.v[i]) AS s, count(*) AS n FROM cut c JOIN near{r} n ON c.rid = n.rid AND c.part = n.part, unnest(range(1, len(c.v) + 1)) t(i) GROUP BY ALL) GROUP BY ALL
  ) m ON b.part = m.part AND b.entry = m.entry)""")
    steps.append(near.format(rounds))
    steps.append(f"""coded AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY rid),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM books{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (rid), digest""")
    return ",\n".join(steps)


@LLM.query("llm-12", oracle=_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(load(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


@LLM.query("llm-13", oracle=rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
n AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n.n) FILTER (k.term IS NOT NULL), 0) AS total FROM g LEFT JOIN n ON g.lang = n.lang AND g.source = n.source LEFT JOIN k ON n.lang = k.lang AND n.term = k.term GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (s.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang JOIN s ON g.lang = s.lang AND g.source = s.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(load(spark, sf_dir, "documents"), least=30, top=50)


@LLM.query("llm-pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
