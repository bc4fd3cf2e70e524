"""Readers and writers: JSON, JSON lines, CSV, source trees, documents, history logs, partitioned collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File extensions of documents: fixed values.
DOCUMENT_EXTENSIONS = ("pdf", "txt", "md", "rst", "adoc")
COMMIT_FIELDS = ("commit", "author", "email", "ts", "subject")
SEPARATOR = "|||"


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that hold one JSON array each, such as *_nodes.json."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_sources(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("v", "sv", "vh")) -> DataFrame:
    """(path, name, text) of a source tree; bytes that aren't UTF-8 are replaced."""
    pattern = "*.{" + ",".join(extensions) + "}"
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    text = F.decode(F.col("content"), "ISO-8859-1")
    text = F.coalesce(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")), text)
    return b.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), text.alias("text"))


def discover_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS) -> DataFrame:
    """(path, label, extension, length, doc_key) of documents under a folder."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").option("recursiveFileLookup", True).load(path)
    d = b.select("path", "length", F.regexp_extract("path", r"([^/]+)$", 1).alias("label"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))
    return d.withColumn("doc_key", F.concat(F.lit("doc_"), F.substring(F.md5("path"), 1, 12)))


def convert_documents(documents: DataFrame, converter: Callable[[str, bytes], str]) -> DataFrame:
    """(path, text) through a converter of one file, such as PDF to Markdown, which runs in the tasks."""

    def run(batches):
        for pdf in batches:
            pdf["text"] = [converter(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])]
            yield pdf[["path", "text"]]

    return documents.select("path", "content").mapInPandas(run, "path string, text string")


def parse_commits(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines of five fields, oldest first, as commits; a subject may contain the separator."""
    p = F.split(F.col(value), r"\|\|\|", 5)
    d = lines.filter(F.size(p) == 5).select(*[F.try_element_at(p, F.lit(i + 1)).alias(f) for i, f in enumerate(COMMIT_FIELDS)])
    return d.withColumn("ts", F.col("ts").try_cast("long")).withColumn("subject", F.left("subject", F.lit(200)))


def parse_name_only(lines: DataFrame, value: str = "value", order: str = "line") -> DataFrame:
    """(commit, file) from a log with file names: a header line with the commit, then its files.

    ``order`` numbers the lines of one log, so the header above each is carried down within that log.
    """
    from pyspark.sql import Window

    head = F.regexp_extract(F.col(value), r"^commit ([0-9a-f]{7,40})$", 1)
    w = Window.partitionBy("log").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("commit", F.last(F.when(F.length(head) > 0, head), ignorenulls=True).over(w))
    return d.filter((F.length(head) == 0) & (F.length(F.trim(value)) > 0) & F.col("commit").isNotNull()).select("commit", F.col(value).alias("file"))


def resolve_endpoints(edges: DataFrame, ids: DataFrame, defaults: dict[str, tuple[str, str]]) -> DataFrame:
    """Bare endpoint ids to collection/key: through an id map, else by the defaults of the edge type."""
    m = lambda c: ids.select(F.col("id").alias(c), F.concat_ws("/", "collection", "id").alias(f"_{c}"))
    e = edges.join(m("from"), "from", "left").join(m("to"), "to", "left")

    def fall_back(side: int, c: str) -> Column:
        if not defaults:
            return F.lit(None).cast("string")
        t = F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (k, v[side])])
        return F.when(F.contains(F.col(c), F.lit("/")), F.col(c)).otherwise(F.concat(F.try_element_at(t, F.col("type")), F.lit("/"), F.col(c)))

    rest = [c for c in edges.columns if c not in ("from", "to")]
    return e.select(F.coalesce("_from", fall_back(0, "from")).alias("from"), F.coalesce("_to", fall_back(1, "to")).alias("to"), *rest)


def write_collections(records: DataFrame, path: str, kind: str = "type", mode: str = "overwrite") -> None:
    """Records routed by their type: a partition each."""
    records.filter(F.col(kind).rlike("^[A-Za-z_][A-Za-z0-9_]*$")).write.mode(mode).partitionBy(kind).parquet(path)


def copy_collections(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """Tables from one place to another, replacing what is there."""
    for n in names:
        spark.read.parquet(f"{source}/{n}").write.mode("overwrite").parquet(f"{target}/{n}")


def upsert_table(spark: SparkSession, path: str, changes: DataFrame, key: str, seq: str) -> str:
    """Merge changes into a Parquet table, the last row of each key winning. The new state is written beside the old
    one, and its path is returned, so readers of the old one are never disturbed."""
    import uuid

    from ..operators.relational import upsert

    out = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    upsert(spark.read.parquet(path), changes, key, seq).write.parquet(out)
    return out
