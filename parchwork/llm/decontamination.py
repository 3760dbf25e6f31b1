"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts are brought to one form: A-Z lowered, cut into words at separators, each word of the benchmark
two letters of alphabets of their own, any other word two letters of neither. A window is then a
string of two letters a word that can match at words only, and the automaton, with two nodes
for a word of a window, reads each text once. Matches map back to words, and words to offsets in the
original text.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm._memory import CACHES, tidy
from parchwork.llm._words import LOWER, NON_WORD
from parchwork.plans.session import materialize, spread

#: Benchmark text whose windows a Python worker can hold, in bytes: an automaton takes some 100 bytes for one of them, its
#: table of windows 50. What lies beyond is read by further automata, each in a pass of its own over what the last has written.
AUTOMATON_BYTES = 8 << 20
#: Stands for a word that the benchmark doesn't have.
_OTHER = "\0\0"

_TABLE = bytes(0x20 if c in NON_WORD else c for c in LOWER)
#: The same words in the original text.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_FOUND = [
    T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows(items: list[tuple[int, str | None]], width: int) -> dict[str, tuple[int, tuple[int, ...]]]:
    """Pattern → number of its words and the items that hold it."""
    found: dict[bytes, tuple[int, set[int]]] = {}
    for item, text in items:
        own = words((text or "").encode())
        n = min(width, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            found.setdefault(b" " + b" ".join(own[k : k + n]) + b" ", (n, set()))[1].add(item)
    return {k.decode("latin-1"): (n, tuple(sorted(ids))) for k, (n, ids) in found.items()}


_automata: dict = CACHES.setdefault("automata", {})


class Windows:
    """The automaton of `patterns`; `told` gives the words and items of the pattern that a match names."""

    def __init__(self, patterns: dict[str, tuple[int, tuple[int, ...]]]):
        import ahocorasick

        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for p in patterns for w in p.encode("latin-1").split()))}
        base = math.isqrt(len(vocabulary)) + 1
        first, second = 0x10000, 0x10000 + base  # above all surrogates
        self.code = {w: chr(first + k // base) + chr(second + k % base) for w, k in vocabulary.items()}
        self.told = list(patterns.values())
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, p in enumerate(patterns):
            self._automaton.add_word("".join([self.code[w] for w in p.encode("latin-1").split()]), k)
        if patterns:
            self._automaton.make_automaton()

    def matches(self, own: list[bytes]) -> list[tuple[int, int]]:
        """(index of the last word, pattern) of each occurrence in a list of words."""
        if not self.told:
            return []
        code = self.code.get
        return [(end // 2, k) for end, k in self._automaton.iter("".join([code(w, _OTHER) for w in own]))]


def _automaton(key: str, patterns: dict[str, tuple[int, tuple[int, ...]]]) -> Windows:
    if key not in _automata:
        _automata.clear()
        _automata[key] = Windows(patterns)
    return _automata[key]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(told, first: bool):
    """Adds what this automaton finds to what earlier ones found."""
    # made on the driver and sent with the closure; an address in a worker may be that of another benchmark, freed
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, told.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n = len(texts)
            counts, items, ranges = ([0] * n, [[] for _ in range(n)], [[] for _ in range(n)])
            if not first:
                counts, items = batch.column("n_words").to_pylist(), batch.column("items").to_pylist()
                ranges = [[(r["first"], r["last"]) for r in x] for x in batch.column("ranges").to_pylist()]
            spans: list[list[dict]] = [[] for _ in range(n)]
            for i, text in enumerate(texts):
                own = words(text or b"")
                counts[i] = len(own)
                if matches := automaton.matches(own):
                    ranges[i] = merged([*ranges[i], *((end + 1 - automaton.told[k][0], end + 1) for end, k in matches)])
                    items[i] = sorted({*items[i], *(x for k in {k for _, k in matches} for x in automaton.told[k][1])})
                if ranges[i]:
                    at = [m.span() for m in _WORD.finditer(text.decode())]
                    spans[i] = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges[i]]
            batch = batch.drop_columns([f.name for f in _FOUND]) if not first else batch
            for name, values, kind in (("n_words", counts, pa.int64()), ("items", items, pa.list_(pa.int64())), ("ranges", [[{"first": a, "last": b} for a, b in x] for x in ranges], _RANGES), ("spans", spans, _SPANS)):
                batch = batch.append_column(name, pa.array(values, kind))
            yield batch

    return run


def find_contamination(df: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """`df` with n_words, items (ids whose windows occur), ranges (of words hit) and spans (of code points hit).

    `df` has a column text, `benchmark` item_id and text. A window is `width` consecutive words
    of an item; an item of fewer words, but not none, is one window. A null text has no words;
    such documents stay, with nothing hit. Ranges and spans are half-open, ascending and joined
    where they touch. Repeated items or documents are each counted as the rows they are; an
    item with a null id takes no part. The benchmark is gathered on the driver and sent to all executors, at most
    AUTOMATON_BYTES of it at a time. Columns of these names in the input are replaced.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // AUTOMATON_BYTES))
    out = spread(df).drop(*(f.name for f in _FOUND)).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*out.schema.fields, *_FOUND])
    for g in range(groups):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        told = spark.sparkContext.broadcast(windows([tuple(r) for r in mine.collect()], width))
        out = out.mapInArrow(tidy(_scan(told, g == 0), "automata"), schema)
        if g + 1 < groups:
            out = materialize(out, "scanned")  # so that no task holds two automata
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of `df` that hold no window of the benchmark."""
    return find_contamination(df, benchmark, width).where(F.size("items") == 0).select(*df.columns)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[int, str | None]], width: int = 10) -> tuple[int, int, int, str]:
    """(n_words, n_hit, n_items, items_sha256) by comparing every window with every position."""
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    own, hit, ids = pattern.findall((text or "").translate(lower)), set(), set()
    for item, t in items:
        w = pattern.findall((t or "").translate(lower))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[k : k + n]:
                    hit |= {*range(j, j + n)}
                    ids.add(item)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = r"regexp_extract_all(" + _LOWER_SQL.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
pos AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, s, pos.n, item_id FROM pos JOIN iw ON pos.n = iw.n AND pos.k = iw.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS joined
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
