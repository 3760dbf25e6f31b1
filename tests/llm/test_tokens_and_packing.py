import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from parchwork.llm import _ranks, _words, packing, sharding, token_files
from parchwork.llm._tokens import Encoder, tokenizer_path
from parchwork.plans.session import fresh_path

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TEXTS = [
    "", " ", "\n", " a", "a ", "a \n b", "don't we're  x", "<|endoftext|>a b\n\nc", "É́ Σας ΟΔΟΣ　x\x1cy\x85z", "abc\t\tdef", "x\xa0y", "  lead", "trail  \n", "a\x01 b", "wor,ds. and! (more) - x;y", "123 4,5 漢字 ñandú", "İstanbul ﬁ", "a" * 5000,
    "the of the of " * 300,
]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("keep", [0, 3, 100_000])
def test_encoder_equals_the_library(name, keep):
    encode, encoder = library(name), Encoder(tokenizer_path(name), keep, keep)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(TEXTS)] == [encode(t) for t in TEXTS]


_encoders = {}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Zé.,!'\n\t1漢ßİ -_ ")), max_size=60), st.sampled_from(NAMES))
def test_encoder_on_any_text(text, name):
    if name not in _encoders:
        _encoders[name] = Encoder(tokenizer_path(name)), library(name)
    own, lib = _encoders[name]
    assert own.encode([text])[0].tolist() == lib(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, documents, monkeypatch):
    rng = random.Random(0)
    rows = [(i, rng.choice(TEXTS)) for i in rng.sample(range(1000), 80)] + [(5000, None)]
    monkeypatch.setattr(token_files, "CHUNK", 500)
    path = fresh_path(spark, "t")
    token_files.write_tokens(documents(rows), path, tokenizer_path(NAMES[0]), 1)
    encode, start = library(NAMES[0]), 0
    got = {r.doc_id: r for r in token_files.read_tokens(spark, path, with_ids=True).collect()}
    for i, t in sorted(rows):
        ids = [*encode(t or ""), 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].ids) == (start, len(ids), crc(ids), ids)
        start += len(ids)
    empty = fresh_path(spark, "t")
    token_files.write_tokens(documents([]), empty, tokenizer_path(NAMES[0]), 1)
    assert token_files.read_tokens(spark, empty).count() == 0
    with pytest.raises(Exception, match="doc_id is null"):
        token_files.write_tokens(documents([(None, "a")]), fresh_path(spark, "t"), tokenizer_path(NAMES[0]), 1)


def test_token_files_keep_rows_without_an_id(spark, documents, monkeypatch, tmp_path):
    rows = [(7, "x y"), (None, "b"), (None, None), (-3, "a"), (None, "a b c"), (None, "b"), (7, ""), *((None, f"t {k}") for k in range(60))]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(token_files, "CHUNK", 40)
    got = sorted(token_files.op3_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    encode, start = library(NAMES[0]), 0
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()), r[1] or ""))
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, want):
        ids = [*encode(t or ""), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)


def test_planes():
    for n in (0, 1, token_files.BLOCK, token_files.BLOCK * 2 + 7):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        assert (token_files.unpack_planes(n, *token_files.pack_planes(ids)) == ids).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 47, 100]))
def test_plan_places_each_piece_once_without_gaps(lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    runs, bins = packing.plan(counts, capacity)
    seen, content = set(), {}
    for length, first, n, start, per, offset in runs:
        for i in range(n):
            assert (length, first + i) not in seen
            seen.add((length, first + i))
            content.setdefault(start + i // per, []).append((offset + i % per * length, length))
    assert len(seen) == len(lengths) and len(content) == bins
    for own in content.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert bins >= -(-sum(lengths) // capacity)
    # no two bins could be one
    sizes = sorted(sum(n for _, n in own) for own in content.values())
    assert len(sizes) < 2 or sizes[0] + sizes[1] > capacity


def test_packing(documents):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *TEXTS, None])] + [(3, "again"), (None, "no id")]
    got = packing.pack(documents(rows), tokenizer_path(NAMES[1]), 0, capacity=100).collect()
    encode = library(NAMES[1])
    total, bins = sum(len(encode(t or "")) + 1 for _, t in rows), {}
    assert sum(r.length for r in got) == total
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    long = sorted((r for r in got if r.doc_id == 17), key=lambda r: r.piece)
    ids = [*encode(TEXTS[17]), 0]
    assert [r.length for r in long] == [len(ids) % 100 or 100, *[100] * ((len(ids) - 1) // 100)] and [crc(ids[r.start : r.start + r.length]) for r in long] == [r.ids_crc32 for r in long]
    assert packing.pack(documents([]), tokenizer_path(NAMES[1]), 0).count() == 0


def jump_by_the_book(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (1, 2, 40, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_by_the_book(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_sharding(documents):
    rows = [(i, f"t{i}") for i in range(3000)] + [(5, "t5"), (5, None), (None, ""), (None, None)]
    got = sharding.assign_shards(documents(rows), shards=7).collect()
    assert len(got) == len(rows) and all(0 <= r.shard < 7 for r in got)
    moved = [r for r in got if r.grown_shard != r.shard]
    assert all(r.grown_shard == 7 for r in moved) and 0.08 < len(moved) / len(got) < 0.18
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    sizes = [sum(r.shard == s for r in got) for s in range(7)]
    assert max(sizes) < 1.3 * min(sizes)
    assert sharding.assign_shards(documents([])).count() == 0
    again = {(r.doc_id, r.text, r.slot) for r in sharding.assign_shards(documents(rows).repartition(3), shards=7).collect()}
    assert len(again - {(r.doc_id, r.text, r.slot) for r in got}) == 0


def test_equal_rows_are_dealt_over_ranges(spark, documents):
    """Numbers are gapless where one key, or one row, is all there is, and no range has it all."""
    df = spark.createDataFrame([(1, 2048, 7)] * 4000 + [(2, 5, 7)], "piece int, length int, doc_id long").repartition(8)
    rows, parts = _ranks.ordered(df, "length", [F.col("doc_id")], "t")
    assert max(r["__n"] for r in parts.collect()) < 2000 and rows.count() == 4001
    got = _ranks.numbered(df, "length", [F.col("doc_id")], "n", "t").collect()
    assert sorted(r.n for r in got if r.length == 2048) == list(range(4000)) and [r.n for r in got if r.length == 5] == [0]


def test_sharding_query(spark, tmp_path):
    """Every column of the query by its definition."""
    rows = [(i, "x" * (i % 7) + "é" * (i % 3)) for i in range(2000)] + [(7, "again"), (7, None), (None, "none"), (-3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op10_sharding(spark, str(tmp_path)).collect()
    mixed = {i: int(k) for i, k in zip([i for i, _ in rows], _words.mix(np.array([i or 0 for i, _ in rows], dtype=np.int64).view(np.uint64)).tolist(), strict=True)}
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", jump_by_the_book(mixed[i], 40), jump_by_the_book(mixed[i], 41)) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def fewest(lengths, capacity):
    """Bins of the best packing, by trying all."""
    best = len(lengths)

    def put(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(lengths):
            best = len(room)
            return
        for x in {r for r in room if r >= lengths[k]}:
            i = room.index(x)
            put(k + 1, [*room[:i], x - lengths[k], *room[i + 1 :]])
        put(k + 1, [*room, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.sampled_from([30, 37, 64]))
def test_plan_comes_near_the_best_packing(lengths, capacity):
    _, bins = packing.plan({x: lengths.count(x) for x in set(lengths)}, capacity)
    best = fewest(lengths, capacity)
    assert best <= bins <= best + 1 and (bins == best or not all(3 * x > capacity for x in lengths))
