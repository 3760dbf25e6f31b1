"""Periodic runs of words: stretches that repeat with a period at least three times, found with bit-parallel lags.

Word ids of a text are cut into bit planes, each one big integer. For a lag p the planes are XORed with themselves
shifted by p and ORed: a zero says that the words p apart are identical. ANDing the zeros with themselves under
doubling shifts leaves the places where a stretch long enough begins. A few planes tell nearly always that there is
none; the others follow only then. A maximal stretch of period p whose least period divides p has been found at
that one, with the same ends, so of equal stretches the first lag stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm._memory import tidy
from parchwork.plans.session import spread

#: A run has this many words at least, and this many periods.
WORDS, PERIODS = 24, 3
#: Planes that are looked at before the others.
FEW = 3


def planes_of(words: list[bytes]) -> list[int]:
    """Bit planes of the words' ids; bit i of each belongs to word i."""
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    return [int.from_bytes(np.packbits((ids >> b) & 1 == 1, bitorder="little").tobytes(), "little") for b in range(max(1, (len(index) - 1).bit_length()))]


def begins(same: int, need: int) -> int:
    """Bits at which `need` ones or more in a row begin."""
    have = 1
    while same and have * 2 <= need:
        same &= same >> have
        have *= 2
    return same & (same >> (need - have)) if need > have else same


def groups(bits: int) -> Iterator[tuple[int, int]]:
    """(first, count) of the groups of ones."""
    at = 0
    while bits:
        low = (bits & -bits).bit_length() - 1
        bits >>= low
        at += low
        count = (~bits & (bits + 1)).bit_length() - 1
        yield at, count
        bits >>= count
        at += count


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start and period."""
    n = len(words)
    if n < WORDS:
        return []
    planes = planes_of(words)
    few, rest = planes[:FEW], planes[FEW:]
    ones = (1 << n) - 1
    found: dict[tuple[int, int], int] = {}
    for p in range(1, n // PERIODS + 1):
        other = 0
        for plane in few:
            other |= plane ^ (plane >> p)
        need = max(WORDS, PERIODS * p) - p
        mask = ones >> p
        starts = begins(mask & ~other, need)
        for plane in rest:
            if not starts:
                break
            other |= plane ^ (plane >> p)
            starts = begins(mask & ~other, need)
        for first, count in groups(starts):
            found.setdefault((first, count - 1 + need + p), p)
    return sorted((start, length, p) for (start, length), p in found.items())


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those behind the first period of a run that holds them."""
    stay = np.ones(n, dtype=bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, found, collapsed = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            words = (text.as_py() or b"").split()
            runs = runs_of(words)
            n_words.append(len(words))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            collapsed.append(b" ".join([w for w, stays in zip(words, kept(len(words), runs).tolist(), strict=True) if stays] if runs else words))
        columns = [batch.column(name) for name in batch.schema.names if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(found, _RUN), pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*names, "n_words", "runs", "collapsed"])


def periodic_runs(df: DataFrame) -> DataFrame:
    """`df` with n_words, runs (start, length and period in words, by start) and collapsed in place of text.

    Words are what stands between white space of ASCII. A run is a maximal stretch of words of the same least period, of 24
    words and three periods at least; runs may overlap. `collapsed` has the words that no run holds behind its first period,
    joined by one space. A null, empty or blank text has no words, no runs and an empty `collapsed`. Rows are
    judged one by one; repeated rows come out alike. Columns named n_words, runs or collapsed in the input are replaced.
    A text of n words takes n/3 lags of n bits. An empty table gives no rows.
    """
    rows = spread(df).drop("n_words", "runs", "collapsed").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(tidy(_find), schema)


def damage(df: DataFrame) -> DataFrame:
    """`df` (doc_id, text), in which the query makes the end of each text periodic whose crc32 of doc_id is divisible by 10."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    some = df.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, words))
    with_words = some.withColumn("words", F.when(F.size("words") > 0, F.col("words"))).withColumn("a", F.col("g") % F.size("words"))
    with_words = with_words.withColumn("p", 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8)))
    cycled = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.col("words")[(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")]))
    return with_words.select("doc_id", F.when(F.size("words") > 0, F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All documents; one without an id is left as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(damage(docs))
    # a fraction is greater if the crosswise products are; runs go by start, then period, so the first of equals stays
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
