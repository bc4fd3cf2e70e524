"""Binary files of token ids: written in ascending doc_id order, coded in blocks, read back by Spark tasks.

A file holds one range of doc_ids:

    b"TIDRC1\\n\\0" | group* | index | u64 index offset | u64 documents | u32 crc32 of the index | b"END\\0"

A group is a u64 length and the bytes of ``rangecoder.encode_group`` (at most GROUP ids, in blocks that start
afresh and carry a crc32 each). The index is zlib-packed: doc_ids (int64), then id counts (int64), in order.
Tasks write under a name of their own attempt in the shared folder; the manifest, written by Spark, names the
files of the attempts that succeeded, so a lost executor's file is never read. Files are opened through
pyarrow's file systems, by the scheme of the shared folder.

Defined cases: null text is empty and has its end id only; null doc_ids come first and read back as null;
equal doc_ids are in the order of their texts; an empty table writes an empty file and gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import lean, partitions, range_bounds, range_of, scratch

MAGIC, END = b"TIDRC1\n\0", b"END\0"
#: Ids coded at once, in side-by-side blocks.
GROUP = 1 << 23
#: Stands for a null doc_id in a file's index.
NULL_ID = -(2**63)
MANIFEST = "part int, file string, n_docs long, n_tokens long, n_bytes long"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def write_file(path: str, docs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[int, int, int]:
    """Documents to a file, in batches of (doc_ids, how many ids each has, all their ids). (documents, ids, bytes)."""
    from .rangecoder import encode_group

    system, at = _open(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    docs_of, counts, waiting, held, total, size = [], [], [], 0, 0, len(MAGIC)
    with system.open_output_stream(at) as out:
        out.write(MAGIC)

        def flush(everything: bool) -> None:
            nonlocal waiting, held, size
            ids = np.concatenate([np.zeros(0, np.uint32), *waiting])
            a = 0
            while len(ids) - a >= GROUP or (everything and a < len(ids)):
                g = encode_group(ids[a : a + GROUP])
                out.write(struct.pack("<Q", len(g)))
                out.write(g)
                size += 8 + len(g)
                a += GROUP
            waiting = [ids[a:].copy()]
            held = len(waiting[0])

        for doc, n, ids in docs:
            docs_of.append(doc.astype("<i8"))
            counts.append(n.astype("<i8"))
            total += len(ids)
            waiting.append(ids)
            held += len(ids)
            if held >= GROUP:
                flush(False)
        flush(True)
        n_docs = sum(map(len, docs_of))
        index = b"".join(x.tobytes() for x in (*docs_of, *counts))
        index = zlib.compress(index, 6)
        out.write(index)
        out.write(struct.pack("<QQI", size, n_docs, zlib.crc32(index)) + END)
    return n_docs, total, size + len(index) + 24


def read_file(path: str) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids before it in the file, its ids as bytes), group by group."""
    from .rangecoder import decode_group

    system, at = _open(path)
    with system.open_input_file(at) as f:
        size = f.size()
        tail = f.read_at(24, size - 24)
        index_at, n, crc = struct.unpack("<QQI", tail[:20])
        index = f.read_at(size - 24 - index_at, index_at)
        if f.read_at(len(MAGIC), 0) != MAGIC or tail[20:] != END or zlib.crc32(index) != crc:
            raise ValueError(f"{path} is damaged")
        index = zlib.decompress(index)
        ids, counts = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<i8", n, 8 * n)
        pos, start, held = len(MAGIC), 0, b""
        for doc, count in zip(ids.tolist(), counts.tolist()):
            if len(held) < 4 * count:
                parts = [held]
                have = len(held)
                while have < 4 * count:
                    (length,) = struct.unpack("<Q", f.read_at(8, pos))
                    parts.append(decode_group(f.read_at(length, pos + 8)).tobytes())
                    have += len(parts[-1])
                    pos += 8 + length
                held, a = memoryview(b"".join(parts)), 0
                held = held[a:]
            yield (None if doc == NULL_ID else doc), start, bytes(held[: 4 * count])
            held = held[4 * count :]
            start += count


def _write_tasks(folder: str, vocabulary: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        c = TaskContext.get()
        path = f"{folder}/part-{c.partitionId():06d}-{c.taskAttemptId()}.tid"
        t = tokens.cached_tokenizer(vocabulary)
        last = [0]

        def docs():
            for b in batches:
                if b.num_rows:
                    last[0] = b.column("_range")[b.num_rows - 1].as_py()
                doc_ids = pc.fill_null(b.column("doc_id"), NULL_ID).to_numpy()
                for first, ids, n in t.batches(b.column("text")):
                    ids, n = tokens.with_end(ids, n, end_id)
                    yield doc_ids[first : first + len(n)], n, ids

        n, total, size = write_file(path, docs())
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([last[0]], pa.int32()), "file": [path], "n_docs": [n], "n_tokens": [total], "n_bytes": [size]})

    return run


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids under ``folder``; the manifest: a row a file, with ``start``, the ids before it."""
    spark = docs.sparkSession
    n = partitions(spark)
    bounds = range_bounds(docs, "doc_id", n)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_range", range_of(F.col("doc_id"), bounds))
    d = d.repartitionById(len(bounds) + 1, "_range").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    d.mapInArrow(lean(_write_tasks(folder, vocabulary, end_id)), MANIFEST).write.parquet(f"{folder}/manifest")
    m = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_tasks(batches):
    import pyarrow as pa

    for b in batches:
        for path, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
            rows = [(doc, base + s, len(x) // 4, zlib.crc32(x)) for doc, s, x in read_file(path)]
            doc, start, n, crc = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files that the manifest names."""
    files = manifest.select("part", "file", "start")
    n = max(1, manifest.agg(F.max("part")).first()[0] or 0) + 1
    return files.repartitionById(n, "part").mapInArrow(lean(_read_tasks), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files and read them back."""
    return read_digests(write_tokens(docs, vocabulary, folder or scratch(docs.sparkSession, "token-files"), end_id))
