"""Chunks of documents that ask hash buckets about their keys.

Some operators must know, for millions of short keys of each document, what the whole corpus says of them. Here a chunk
(some MB of text) sends each of its distinct keys once, packed and sorted, to the bucket that owns the key's hash range;
the bucket answers in the order of the keys; and the answers of all buckets come back to the chunk. A key that a third
of all documents hold reaches its bucket once from each chunk, like any other, so no key makes a hot task. There are PER_PARTITION
buckets for each shuffle partition of the session. A chunk sends a message to each bucket for which it has a key, so there are chunks times buckets
messages at most, and never more than keys. With partitions held fixed, messages grow in proportion to the corpus; where partitions
grow along with it, they grow faster, towards one message a key, and lose what packing saves. A bucket's share of the keys is set by
spark.sql.shuffle.partitions, as that of any shuffle.

The chunks are a table in the shared folder, bucketed by chunk, so that answers join them without moving texts again.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm.common import bounded_batches, shared_dir, texts_of

PER_PARTITION = 4


def pack(values: np.ndarray) -> bytes:
    """Numbers as zstd-compressed byte planes."""
    v = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()) if len(v) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys[:1] * 0)) if len(keys) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where, among sorted 64-bit keys, each of equal hash ranges begins, and the end."""
    step = (1 << 64) // buckets
    bounds = np.array([k * step for k in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)])).astype(np.int64)


def cuts_of(sizes: list[int], most: int, held: int = 0) -> tuple[list[int], int]:
    """Where new chunks begin so that none but those of one text exceeds `most`, if `held` bytes wait already; and the bytes that wait then."""
    out = []
    for k, n in enumerate(sizes):
        if held and held + n > most:
            out.append(k)
            held = 0
        held += n
    return out, held


def chunked(docs: DataFrame, label: str, chunk_bytes: int) -> DataFrame:
    """A stored table of chunk and texts (compressed), bucketed by chunk. Rows in a chunk are sorted by doc_id; a chunk of more than `chunk_bytes` has one text."""

    def run(batches):
        from pyspark import TaskContext

        at, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)

        def packed(waiting):
            some = pa.Table.from_batches(waiting).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema) as out:
                out.write_table(some)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([press.compress(sink.getvalue().to_pybytes())], pa.binary())], names=["chunk", "texts"])

        waiting, held = [], 0
        for b in batches:
            cuts, held = cuts_of([len(t.as_buffer() or b"") for t in b.column(1)], chunk_bytes, held)
            for begin, end in zip([0, *cuts], [*cuts, b.num_rows]):
                if end > begin:
                    waiting.append(b.slice(begin, end - begin))
                if end < b.num_rows:  # a cut, maybe before the batch's first row
                    yield packed(waiting)
                    waiting, at = [], at + 1
        if waiting:
            yield packed(waiting)

    spark = docs.sparkSession
    bounded_batches(spark)
    name, n = f"{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = texts_of(docs).mapInArrow(run, "chunk long, texts binary")
    made.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").bucketBy(n, "chunk").format("parquet").saveAsTable(name)
    return spark.table(name)


def texts_in(data: bytes) -> tuple[list, list[bytes]]:
    """Ids and UTF-8 texts of a chunk."""
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()
    return table["doc_id"].to_pylist(), table["text"].cast(pa.binary()).to_pylist()


def buckets_for(spark: SparkSession) -> int:
    return PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_answers(table: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk with its answers as an array of structs; a chunk gets one for each bucket at most."""
    fields = [c for c in answers.columns if c != "chunk"]
    gathered = answers.groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias("answers"))
    return table.join(gathered, "chunk", "left").select("chunk", "texts", "answers")

