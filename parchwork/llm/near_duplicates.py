"""Near-duplicate documents by one-permutation MinHash, with links confirmed on full shingle sets.

1. Documents of the same words in the same order, by a cryptographic digest of the words' bytes, form a class; its least doc_id
   stands for it from here on. Equal sets of other orders agree in every band and are linked like other pairs.
2. Each representative gets one banded signature from a single hash per shingle, with optimal
   densification. Documents that agree in a band share a bucket.
3. A bucket proposes a star: its least member with each other member, never all pairs. Stars
   are confirmed on full sets, of which what has equal hashes is compared by bytes, and give first components.
4. Where one star's members still fall into several components, the ones outside the centre's
   component are compared with the star's other members, block against block: both sides are
   cut into blocks of bounded size, and a block pair is one row whatever pairs it holds. So no
   link between members of a bucket is lost, and a group already connected costs nothing more.
5. Components of all confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm import _words
from parchwork.llm._memory import tidy
from parchwork.llm._oph import OnePermutation, jaccard_linked
from parchwork.llm.components import connected_components
from parchwork.plans.session import discard, materialize, spread

#: A pair at the threshold of 0.8 misses all bands with probability (1 - 0.8**ROWS)**BANDS = 5e-6.
BANDS, ROWS = 52, 7
#: Shingles in a block of step 4, about; a longer document is a block of its own.
BLOCK = 65_536

_SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType()),
    T.StructField("keys", T.ArrayType(T.LongType())),
])
_LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _digest(text: bytes) -> bytes:
    """Of the words' bytes: texts of one digest are one class. Equal sets of other orders share all bands and are linked as pairs."""
    return hashlib.blake2b(b" ".join(text.translate(_words.LOWER).split()), digest_size=16).digest()


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = OnePermutation(bands, rows)
        for batch in batches:
            texts = _texts(batch.column("text"))
            sizes, digests, keys = np.zeros(len(texts), np.int64), np.zeros((len(texts), 2), np.int64), [None] * len(texts)
            for a, b in _words.batched(texts):
                for i, own, exact in zip(range(a, b), *_words.sets_of(texts[a:b], width, _words.BLANKS), strict=True):
                    if len(own):
                        sizes[i], keys[i] = len(exact), family.band_keys(own)
                        digests[i] = np.frombuffer(_digest(texts[i]), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(keys, pa.list_(pa.int64()))], names=_SKETCH.names
            )

    return run


def _confirm(width: int, percent: int):
    """Rows (u, v, text of u, text of v), those of one u together: the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            members, centres, keep = _texts(batch.column("v_text")), batch.column("u_text"), []
            for a, b in _words.batched(members):
                at, texts = [], []  # each centre once, before the members
                for i in range(a, b):
                    if i == a or u[i] != u[i - 1]:
                        texts.append(centres[i].as_py().encode())
                    at.append(len(texts) - 1)
                _, sets = _words.sets_of([*texts, *members[a:b]], width, _words.BLANKS)
                keep += [i for i, c, own in zip(range(a, b), at, sets[len(texts) :], strict=True) if jaccard_linked(sets[c], own, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], names=_LINKS.names)

    return run


def links_between(a: list[tuple[int, int, np.ndarray]], b: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between documents (id, component, set) of different components, one for each document of `a` and component."""
    sizes = np.array([len(s) for _, _, s in b])
    ids, components = np.array([x for x, _, _ in b]), np.array([c for _, c, _ in b])
    shingles = np.concatenate([s for _, _, s in b])
    owner = np.repeat(np.arange(len(b)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    found = []
    for doc, component, own in a:
        lo, hi = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
        n = hi - lo
        lo, n = lo[n > 0], n[n > 0]
        if not len(n):
            continue
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(b))
        linked = np.flatnonzero((100 * common >= percent * (len(own) + sizes - common)) & (components != component))
        if len(linked):
            _, first = np.unique(components[linked], return_index=True)
            found += [(doc, int(ids[k])) for k in linked[first]]
    return found


def _cross(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                _, sets = _words.sets_of([r["text"].encode() for r in (*a, *b)], width, _words.BLANKS)
                docs = [(r["m"], r["component"], s) for r, s in zip((*a, *b), sets, strict=True)]
                found += links_between(docs[: len(a)], docs[len(a) :], percent)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=_LINKS.names)

    return run


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `df` (doc_id and text; others are ignored).

    Words are runs without white space, lower-cased in A-Z; a document's set holds its distinct
    `width`-word shingles, or its whole sequence if it has fewer words. Two documents are linked
    at 100 * intersection >= percent * union. Null, empty and blank texts have no set and are
    linked with nothing. A row with a null doc_id stands alone with a null component and is kept.
    Rows that repeat a doc_id and text are in one component under that doc_id. An empty table
    gives no rows.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialize(spread(docs).mapInArrow(tidy(_sketch(width, bands, rows)), _SKETCH), "sketch")
    with_set = sketch.where("n > 0 and doc_id is not null")
    classes = materialize(with_set.groupBy("high", "low").agg(F.min("doc_id").alias("rep")), "classes")
    first = F.col("doc_id") == F.col("rep")
    keyed = materialize(with_set.join(classes, ["high", "low"]).select("doc_id", "n", "rep", F.when(first, F.col("keys")).alias("keys")), "keyed")
    members = materialize(keyed.drop("keys"), "members")
    alone = materialize(sketch.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id")), "alone")
    discard(sketch, classes)

    banded = keyed.where("keys is not null").select("rep", "n", F.explode("keys").alias("key"))
    buckets = materialize(banded.groupBy("key").agg(F.min("rep").alias("c"), F.count("*").alias("size")).where("size > 1").select("key", "c"), "buckets")
    stars = materialize(banded.join(buckets, "key").select("c", F.col("rep").alias("m"), "n").distinct(), "stars")
    discard(keyed, buckets)
    wanted = stars.select(F.col("m").alias("doc_id")).distinct()
    texts = materialize(docs.join(wanted, "doc_id", "left_semi"), "texts")

    pairs = stars.where("c <> m").select(F.col("c").alias("u"), F.col("m").alias("v"))
    pairs = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text")), "v")
    pairs = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text")), "u").select("u", "v", "u_text", "v_text")
    links = materialize(pairs.mapInArrow(tidy(_confirm(width, percent)), _LINKS), "links")
    once = materialize(connected_components(links), "components")
    discard(links)

    def component(name: str, of: str) -> DataFrame:
        return once.select(F.col("id").alias(of), F.col("component").alias(name))

    open_stars = stars.join(component("at_m", "m"), "m", "left").join(component("at_c", "c"), "c", "left")
    open_stars = open_stars.select("c", "m", "n", F.coalesce("at_m", "m").alias("component"), (F.coalesce("at_m", "m") != F.coalesce("at_c", "c")).cast("int").alias("side"))
    sums = open_stars.groupBy("c").agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("n0"), F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("n1"))
    sums = materialize(sums.where("n1 is not null"), "open")
    many = F.ceil(F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")) / BLOCK).cast("long")
    parted = open_stars.join(sums, "c").select("c", "m", "component", "side", F.pmod(F.xxhash64("m"), many).alias("chunk"))
    parted = parted.join(texts.select(F.col("doc_id").alias("m"), "text"), "m")
    blocks = materialize(parted.groupBy("c", "side", "chunk").agg(F.collect_list(F.struct("m", "component", "text")).alias("docs")), "blocks")
    discard(texts, stars, sums)
    a = blocks.where("side = 1").select("c", F.col("chunk").alias("a_chunk"), F.col("docs").alias("a"))
    b = blocks.select("c", "side", "chunk", F.col("docs").alias("b"))
    crossed = a.join(b, "c").where("side = 0 or chunk >= a_chunk").select("a", "b").mapInArrow(tidy(_cross(width, percent)), _LINKS)
    more = materialize(crossed, "links")
    discard(blocks)
    final = materialize(connected_components(more.unionByName(once.select(F.col("id").alias("u"), F.col("component").alias("v")))), "components")
    discard(more, once)

    placed = members.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    out = placed.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.at = l.x)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.at) AS component_id, doc_id = min(r.at) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
