"""Near-duplicates and repeats against brute force, with nulls, empty, long, tied and repeated rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from parchwork.llm import _words, components, near_duplicates, suffixes
from parchwork.llm._oph import OnePermutation, jaccard_linked

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=0):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(own) // 25) + 1)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((k, rng.choice([" ", "\n", "\t "]).join(own)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n "), (k + 3, "One"), (k + 4, "ONE"), (k + 5, "é one two"), (k + 6, " ".join(WORDS * 50)), (k + 7, " ".join(WORDS * 50))]
    rng.shuffle(rows)
    return rows


def brute_near(rows, width=4, percent=80):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = [x for x in _split((t or "").translate(lower)) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def _split(text):
    import re

    return re.split(r"[\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_equal_brute_force(documents, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(documents(rows), width=4).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_edges(spark, documents):
    assert near_duplicates.near_duplicates(documents([])).count() == 0
    rows = near_duplicates.near_duplicates(documents([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (3, 3, True)]


def test_chain_through_a_member_that_is_no_centre(documents):
    """a-b and b-c are linked, a-c isn't: all one component, whichever is the star's centre."""
    base = [f"x{i}" for i in range(100)]
    other = [f"y{i}" for i in range(100)]
    a, b, c = base, [*base[:94], *other[:6]], [*base[:88], *other[:6], *other[20:26]]
    b2 = [*base[:90], *other[:10]]
    c2 = [*base[:80], *other[20:30], *base[90:90], *other[:10]]
    rows = [(1, " ".join(a)), (2, " ".join(c)), (3, " ".join(b)), (4, " ".join(b2)), (5, " ".join(c2))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(documents(rows), width=4).collect()}
    assert got == brute_near(rows)


def test_links_between_blocks():
    rng = np.random.default_rng(0)
    docs = [(i, i % 3, np.unique(rng.integers(0, 60, 40).astype(np.uint64))) for i in range(30)]
    found = near_duplicates.links_between(docs, docs, 60)
    want = {(i, c) for i, x, s in docs for j, c, t in docs if x != c and jaccard_linked(s, t, 60)}
    assert {(u, docs[v][1]) for u, v in found} == want


def test_signature_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    family = OnePermutation(52, 7)
    for size in (5, 40, 2000):
        pool = _words.mix(rng.integers(0, 1 << 62, size * 2, dtype=np.uint64))
        a, b = np.unique(pool[:size]), np.unique(pool[size // 5 : size + size // 5])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((family.signature(a) == family.signature(b)).mean() - true) < 0.13


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (7, 8), (3, 1), (20, 4), (4, 30), (30, 31)], "u long, v long")
    assert {(r.id, r.component) for r in components.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7), (4, 4), (20, 4), (30, 4), (31, 4)}
    assert components.connected_components(edges.where("u > 100")).count() == 0


def repeats(seed):
    rng = random.Random(seed)
    alphabet = ["ab", "é", "x", "yz", " ", "\n", "漢"]
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([10, 49, 60, 200]))) for _ in range(12)]
    rows = [(i * 3 % 101, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 8)))) for i in range(60)]
    return rows + [(200, None), (201, ""), (202, "a" * 400), (203, "b" + "a" * 300), (204, "ab" * 30_000), (205, "ab" * 30_000)]


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats_equal_brute_force(documents, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)
    rows = repeats(seed)
    want = suffixes.brute_force({i: (t or "").encode() for i, t in rows})
    got = suffixes.remove_repeats(documents(rows).repartition(5)).collect()
    assert {r.doc_id: (r.n_removed, len(r.removed_spans), bytes(r.kept)) for r in got} == want
    assert all(r.lang == "en" and sum(s.end - s.start for s in r.removed_spans) == r.n_removed for r in got)


def test_repeats_edges(documents):
    assert suffixes.remove_repeats(documents([])).count() == 0
    long = "0123456789" * 8
    rows = [(7, long), (7, long), (None, long), (9, "é" + long[:60]), (10, long)]
    got = sorted(((r.doc_id or 99), r.n_removed) for r in suffixes.remove_repeats(documents(rows)).collect())
    assert got == [(7, 0), (7, 0), (9, 60), (10, 80), (99, 80)]
    left = sorted((r.doc_id or 99, r.text) for r in suffixes.remove_repeats(documents(rows), as_text=True).collect())
    assert left == [(7, long), (7, long), (9, "é")]
    with pytest.raises(ValueError):
        suffixes.remove_repeats(documents(rows), length=20)


def test_cover_meets_every_difference():
    residues = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert residues == set(range(suffixes.PERIOD))


def test_sorted_numbers_pack(documents):
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (suffixes.unpack_sorted(suffixes.pack_sorted(v)) == v).all()
    assert (suffixes.unpack_numbers(suffixes.pack_numbers(v)) == v).all() and len(suffixes.unpack_sorted(suffixes.pack_sorted(v[:0]))) == 0


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_bucket_sorting_tells_windows_by_bytes(monkeypatch, rounds):
    """Windows of a bucket at all residues of the cover, in texts of few letters, against a table of them."""
    monkeypatch.setattr(suffixes, "ROUNDS", rounds)
    rng = np.random.default_rng(3)
    for letters, size in ((2, 1200), (3, 4000), (200, 3000)):
        text = rng.integers(0, letters, size).astype(np.uint8)
        text[size // 2 : size // 2 + 300] = text[:300]
        text[size - 130 :] = text[7:137]
        text[900 : 900 + 200] = 255 * (letters == 200)
        at = np.sort(rng.choice(size - 49, size // 2, replace=False))
        docs = rng.integers(0, 9, len(at))
        first = {}
        for p, d in zip(at.tolist(), docs.tolist(), strict=True):
            key = text[p : p + 50].tobytes()
            first[key] = min(first.get(key, d), d)
        assert suffixes.earlier(text, at, docs, 50).tolist() == [first[text[p : p + 50].tobytes()] for p in at.tolist()]


def test_cover_ranks_are_those_of_sorted_suffixes():
    text = np.random.default_rng(5).integers(97, 99, 600).astype(np.uint8)
    raw = text.tobytes() + bytes(70)
    words = np.array([int.from_bytes(raw[k : k + 8], "big") for k in range(660)], dtype=np.uint64)
    ranked = suffixes.CoverRanks(words, 600, 50)
    at = [p for p in range(600) if p % suffixes.PERIOD in suffixes.COVER]
    for depth in (50, 31):
        want = {x: k + 1 for k, x in enumerate(sorted({raw[p : p + depth] for p in at}))}
        assert [ranked.ranks(depth)[ranked.place[p]] for p in at] == [want[raw[p : p + depth]] for p in at]


def test_pieces_under_one_key_are_compared_by_bytes(documents, monkeypatch):
    """With one key for all texts, pieces that differ still count as different."""
    monkeypatch.setattr(suffixes.Block, "_spans", staticmethod(lambda sums, start, end: np.zeros(len(start), np.uint64)))
    rows = repeats(4)
    ids = [i for i, _ in sorted(rows, key=lambda r: r[0])]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([dict(rows)[i] for i in ids])], names=["doc_id", "text"])
    opened = suffixes.Opened({"rows": suffixes._serialized(batch), "tied": [{"answer": suffixes.pack_sorted(np.arange(1 << suffixes.TABLE_BITS, dtype=np.uint64))}]}, 50, 4)
    piece = [opened.block.data[a : a + n + 49].tobytes() for a, n in zip(opened.start.tolist(), opened.many.tolist(), strict=True)]
    assert len(opened.first) > 5 and all(piece[i] == piece[opened.first[g]] for i, g in enumerate(opened.group.tolist()))


def test_repeat_query(spark, tmp_path):
    """The query itself, its digests included, and no table left behind."""
    rows = repeats(2)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {i: (t or "").encode() for i, t in rows}
    want = {i: (len(texts[i]), n, spans, hashlib.sha256(kept).hexdigest()) for i, (n, spans, kept) in suffixes.brute_force(texts).items()}
    found = suffixes.op4_suffix_dedup(spark, str(tmp_path))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("parchwork")]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()} == want


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_with_one_polynomial_hash_differ(documents):
    """The Thue-Morse word and its complement agree under every polynomial modulo a power of two."""
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{x} one two three four five"), (2, f"{y} one two three four five"), (3, f"{x} {y} {x} {y}"), (4, f"{x[:200]} a b c"), (5, f"{y[:200]} a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(documents(rows), width=4).collect()}
    assert got == brute_near(rows)


@pytest.mark.parametrize("what", ["words", "shingles", "nothing"])
def test_sets_stay_exact_under_equal_hashes(monkeypatch, what):
    """Where hashes of different words or shingles agree, sets are told by bytes."""
    if what == "words":
        monkeypatch.setattr(_words, "hashes_of", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    if what == "shingles":
        monkeypatch.setattr(_words, "combine", lambda h, n: np.ones(max(0, len(h) - n + 1), np.uint64))
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "cc", "é", "w" * 300, "w" * 299 + "v", "x" * 9]) for _ in range(rng.choice([0, 1, 3, 4, 30]))).encode() for _ in range(40)]
    _, sets = _words.sets_of(texts, 4, _words.BLANKS)
    words = [t.split() for t in texts]
    want = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set() for w in words]
    assert [len(s) for s in sets] == [len(s) for s in want]
    assert all(len(np.intersect1d(a, b)) == len(x & y) for a, x in zip(sets, want) for b, y in zip(sets, want))


def test_words_of_one_hash_link_nothing(documents):
    # two words of sixteen bytes that the word hash can't tell apart
    rows = [(1, "fvgokprz!@!!!![! red green blue"), (2, "hktljffo>|d6w*de red green blue"), (3, "FVGOKPRZ!@!!!![!\tred  green blue\n"), (4, "a b c d e a b c d"), (5, "b c d e a b c d e a b"), (6, "e a b c d e a b c d e")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(documents(rows), width=4).collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, True), 3: (1, 1, False), 4: (5, 4, True), 5: (5, 4, False), 6: (5, 4, False)}
