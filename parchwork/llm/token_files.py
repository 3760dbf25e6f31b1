"""Token ids in binary chunks: fixed-size id blocks, byte planes, zstandard, a chunk index.

The files form a table in any file system that Spark writes to. A row is a chunk, a run of
whole documents in doc_id order:

    part, chunk     the chunk's place; (part, chunk) follows doc_id order
    first, last     least and greatest doc_id within; null if no document has one
    n_ids, before   ids in the chunk, ids of the chunks before it in its part
    doc_ids, sizes  little-endian int64 ids and uint32 token counts of the documents;
                    documents of null doc_id stand last and have a count, but no id
    index           little-endian uint32 lengths of the compressed planes, four to a block
    planes          the planes, one after another

A block holds `BLOCK` ids (the last of a chunk may hold fewer). Its ids are transposed into
four byte planes, low bytes first, and each plane is a zstandard frame of its own, so the
planes of high bytes, nearly constant, take almost no room and a reader can fetch a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm._memory import tidy
from parchwork.llm._tokens import encoder, text_batches, tokenizer_path
from parchwork.plans.session import fresh_path

BLOCK = 65_536
#: A chunk ends with the document that brings it to this many ids.
CHUNK = 1 << 20

CHUNKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("before", T.LongType()), T.StructField("doc_ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
    T.StructField("index", T.BinaryType()), T.StructField("planes", T.BinaryType()),
])


def pack_planes(ids: np.ndarray, level: int = 3) -> tuple[bytes, bytes]:
    """(index, planes) of one chunk's ids."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level).compress
    frames = []
    for a in range(0, len(ids), BLOCK):
        planes = np.ascontiguousarray(ids[a : a + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4).T)
        frames += [compress(p.tobytes()) for p in planes]
    return np.array([len(f) for f in frames], dtype="<u4").tobytes(), b"".join(frames)


def unpack_planes(n_ids: int, index: bytes, planes: bytes) -> np.ndarray:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    ends = np.cumsum(np.frombuffer(index, dtype="<u4").astype(np.int64))
    out = np.empty((n_ids, 4), dtype=np.uint8)
    view, start = memoryview(planes), 0
    for k, end in enumerate(ends.tolist()):
        a = k // 4 * BLOCK
        out[a : a + BLOCK, k % 4] = np.frombuffer(expand(view[start:end]), dtype=np.uint8)
        start = end
    return out.view("<u4").reshape(-1)


def _encode(path: str, end_id: int):
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, tail = encoder(path).encode_bytes, TaskContext.get().partitionId(), np.array([end_id], dtype="<u4").tobytes()
        chunk = before = held = 0
        docs: list[int | None] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal chunk, before, held
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            index, planes = pack_planes(ids)
            known = [d for d in docs if d is not None]
            first, last = (known[0], known[-1]) if known else (None, None)
            row = (part, chunk, first, last, len(ids), before, np.array(known, dtype="<i8").tobytes(), np.array([len(p) // 4 for p in parts], dtype="<u4").tobytes(), index, planes)
            chunk, before, held = chunk + 1, before + len(ids), 0
            docs.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=CHUNKS.names)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in text_batches(texts):
                for doc, tokens in zip(ids[a:b], encode(texts[a:b], tail), strict=True):
                    docs.append(doc)
                    parts.append(tokens)
                    held += len(tokens) // 4
                    if held >= CHUNK:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, null_ids: bool = False) -> None:
    """Encode every whole text and write the chunks in ascending doc_id order to `path`.

    A null text is empty and leaves its end id alone. Rows of null doc_id stand last if
    `null_ids` is set, and are an error if not. Rows of equal or null doc_id stand side by
    side, in order of their texts' CRC-32, then of the texts. Columns besides doc_id and text
    are ignored; an empty table gives no chunks.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not null_ids:
        docs = docs.withColumn("doc_id", F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("doc_id is null"))).otherwise(F.col("doc_id")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the checksum deals rows of one id, or of none, over several tasks
    order = [F.col("doc_id").asc_nulls_last(), F.crc32(F.coalesce("text", F.lit("")))]
    in_order = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.coalesce("text", F.lit("")))
    in_order.mapInArrow(tidy(_encode(tokenizer, end_id), "encoders"), CHUNKS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document, of null doc_id too: doc_id, start, n_tokens, ids_crc32, and its ids if asked."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    # one row for each part, as many as the writer had tasks
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = F.broadcast(parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start")))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_planes(r["n_ids"], r["index"], r["planes"])
                sizes = np.frombuffer(r["sizes"], dtype="<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                own = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                known = pa.array(np.frombuffer(r["doc_ids"], dtype="<i8"))
                columns = [
                    pa.concat_arrays([known, pa.nulls(len(sizes) - len(known), pa.int64())]), pa.array(ends - sizes + r["before"] + r["part_start"]),
                    pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return chunks.join(starts, "part").select("n_ids", "before", "part_start", "doc_ids", "sizes", "index", "planes").mapInArrow(tidy(run), T.StructType(fields))


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path("word_bpe_49k.json"), end_id=1, null_ids=True)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
