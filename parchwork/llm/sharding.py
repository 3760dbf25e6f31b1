"""Sharding by jump consistent hashing (Lamping and Veach 2014).

The shard of a row follows from its key and the number of shards alone: no ring table,
no state, no look at other rows. With one more shard a row stays where it is or moves
to the new shard, and about 1/(n+1) of the rows move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm._memory import tidy
from parchwork.llm._ranks import numbered
from parchwork.llm._words import mix

_U = np.uint64
_STEP = _U(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard numbers of 64-bit keys, as the paper defines them."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    at = np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = at[live]
            key[live] = key[live] * _STEP + _U(1)
            draw = (key[live] >> _U(33)).astype(np.float64) + 1.0
            at[live] = ((out[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            live = live[at[live] < shards]
    return out


def _with_shards(key: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(key)
            keys = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            for count in (shards, shards + 1):
                batch = batch.append_column("shard" if count == shards else "grown_shard", pa.array(jump(keys, count).astype(np.int32)))
            yield batch

    return run


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 40) -> DataFrame:
    """`df` with `shard`, `grown_shard` (with one more shard) and `slot`, a gapless number in its shard.

    `key` is an integer column; a null key counts as 0 and stays in the result. Rows of equal
    key share a shard. Slots follow a hash of the key, then the key and the other columns, so rows that tie are
    equal; ranges of that order are numbered each by itself, whatever the keys. An empty table gives no rows. Columns named `shard`,
    `grown_shard`, `slot` in the input are replaced.
    """
    df = df.drop("shard", "grown_shard", "slot")
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())])
    order = [F.xxhash64(key), F.col(key), *(F.col(f"`{f.name}`") for f in df.schema.fields if f.name != key and isinstance(f.dataType, T.AtomicType))]
    placed = numbered(df.mapInArrow(tidy(_with_shards(key, shards)), schema), "shard", order, "slot", "shards")
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), "shard", "slot", "grown_shard")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 by the law `key`; a null text has no bytes and the CRC of none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    return assign_shards(docs, "doc_id", 40).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
