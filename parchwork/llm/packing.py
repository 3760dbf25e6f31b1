"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so the packing is planned on counts by
length, a table whose size does not depend on the input, and carried out by each piece's
number among pieces of its length, which follows from its range in the order of lengths. Documents above a third of the capacity share a bin
with one other of their kind at most: they are matched greedily, each with the longest
partner that still fits. Shorter ones then go, longest first, to the fullest bin that
has room for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm._memory import tidy
from parchwork.llm._ranks import ordered
from parchwork.llm._tokens import encoder, text_batches, tokenizer_path
from parchwork.plans.session import materialize, spread

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first bin, pieces to a bin, offset) and the number of bins.

    Piece `first rank + i` of that length goes to bin `first bin + i // per`, at
    `offset + (i % per) * length`. The number of runs is bounded by the capacity.
    """
    left = {x: n for x, n in counts.items() if n}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("lengths must be from 1 to the capacity")
    runs: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = {}
    #: By room left: runs of equal bins (first bin, how many).
    room: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def put(length: int, pieces: int, first: int, per: int, offset: int) -> None:
        runs.append((length, used.get(length, 0), pieces, first, per, offset))
        used[length] = used.get(length, 0) + pieces

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for x in large:
        while left[x]:
            y = next((y for y in large if y <= capacity - x and left[y] > (y == x)), None)
            n = left[x] if y is None else left[x] // 2 if y == x else min(left[x], left[y])
            if y == x:
                put(x, 2 * n, bins, 2, 0)
                left[x] -= 2 * n
            else:
                put(x, n, bins, 1, 0)
                left[x] -= n
                if y is not None:
                    put(y, n, bins, 1, x)
                    left[y] -= n
            if gap := capacity - x - (y or 0):
                room.setdefault(gap, []).append((bins, n))
            bins += n
    for x in sorted((x for x in left if 3 * x <= capacity and left[x]), reverse=True):
        n = left[x]
        for gap in sorted(g for g in room if g >= x):
            per, rest = gap // x, []
            for first, many in room.pop(gap):
                filled = min(many, n // per)
                if filled:
                    put(x, filled * per, first, per, capacity - gap)
                    n -= filled * per
                    if gap - per * x:
                        room.setdefault(gap - per * x, []).append((first, filled))
                if n and filled < many:  # fewer pieces are left than one more bin takes
                    put(x, n, first + filled, n, capacity - gap)
                    if gap - n * x:
                        room.setdefault(gap - n * x, []).append((first + filled, 1))
                    filled, n = filled + 1, 0
                if filled < many:
                    rest.append((first + filled, many - filled))
            if rest:
                room.setdefault(gap, []).extend(rest)
            if not n:
                break
        if n:
            per = capacity // x
            for many, to_each in ((n // per, per), (1, n % per)):
                if many and to_each:
                    put(x, many * to_each, bins, to_each, 0)
                    if gap := capacity - to_each * x:
                        room.setdefault(gap, []).append((bins, many))
                    bins += many
    return runs, bins


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path).encode_bytes, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            texts = [t or "" for t in texts]
            rows: list[tuple] = []
            for a, b in text_batches(texts):
                for doc, tokens in zip(ids[a:b], encode(texts[a:b], tail), strict=True):
                    n = len(tokens) // 4
                    ends = range(n if n <= capacity else n % capacity or capacity, n + 1, capacity)
                    start = 0
                    for k, end in enumerate(ends):
                        rows.append((doc, k, start, end - start, zlib.crc32(tokens[4 * start : 4 * end])))
                        start = end
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)

    return run


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`. Ties in length go by doc_id and piece; equal rows are interchangeable."""
    rows, parts = ordered(pieces, "length", [F.col("doc_id"), F.col("piece")], "ordered")
    # no more rows than lengths, of which there are `capacity`, and ranges, as many as the shuffle has partitions
    counts = parts.collect()
    first: list[tuple[int, int, int]] = []
    total: dict[int, int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["__range"])):
        first.append((r["length"], r["__range"], total.get(r["length"], 0) - r["__least"]))
        total[r["length"]] = total.get(r["length"], 0) + r["__n"]
    runs, _ = plan(total, capacity)
    table = np.array(sorted(runs) or np.empty((0, 6)), dtype=np.int64).reshape(-1, 6)
    firsts = np.array(first or np.empty((0, 3)), dtype=np.int64).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (length, rank) and (length, range) as single sortable numbers
        span, wide = np.int64(1) << np.int64(45), np.int64(1) << np.int64(32)
        run_keys, part_keys = table[:, 0] * span + table[:, 1], firsts[:, 0] * wide + firsts[:, 1]
        for batch in batches:
            length, where, at = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__range", "__place"))
            rank = firsts[np.searchsorted(part_keys, length * wide + where), 2] + at
            r = table[np.searchsorted(run_keys, length * span + rank, side="right") - 1]
            i = rank - r[:, 1]
            batch = batch.drop_columns(["__range", "__place"])
            yield batch.append_column("sequence_id", pa.array(r[:, 3] + i // r[:, 4])).append_column("offset", pa.array(r[:, 5] + i % r[:, 4] * length))

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(tidy(run, "encoders"), schema)


def pack(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Where each piece of each document's ids goes.

    `df` has `doc_id` (integer) and `text`; other columns take no part. A null text counts as
    empty, so it is its end id alone. A document longer than `capacity` is cut; its first
    piece takes the remainder and the others are full. Rows of equal doc_id are packed each
    on its own. An empty table gives no rows.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(spread(docs).mapInArrow(tidy(_cut(tokenizer, end_id, capacity), "encoders"), PIECES), "pieces")
    return place(pieces, capacity)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
