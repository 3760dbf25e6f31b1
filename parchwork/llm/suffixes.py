"""Removal of byte strings that occur in an earlier document, by blockwise suffix sorting with a difference cover.

A suffix array sorts all suffixes at once; what is asked here is which suffixes agree on
their first `length` bytes and which document of such a tie comes first. As in blockwise
suffix sorting with a difference cover (Karkkainen 2007), one bucket of suffixes is sorted at a
time, in memory that the bucket's size bounds, and long ties go by ranks of a cover sample:

1. Which suffixes. With a difference cover D modulo `PERIOD`, any two equal windows have a
   common offset below PERIOD at which both have a sample position, so they share a sample
   string of length - PERIOD + 1 bytes. Keys of the sample suffixes, under a quarter of all, are dealt into buckets
   and counted; a window without a sample key that two documents have can't be repeated and goes no further. Keys
   are hashes: one that two strings share by chance only lets windows pass.
2. Buckets. Consecutive windows that are left and whose least MINIMIZER-byte key is the same travel as one piece
   of text to that key's bucket, where equal windows meet.
3. Sorting a bucket (`earlier`). Windows whose hash no other document's window has are left out, since they equal none.
   The cover sample around the others is sorted by its first `length` bytes and ranked, and they
   are sorted by their first PERIOD bytes. Of windows that tie there, any two have a common offset at which both
   reach a sample suffix: their ranks tell whether the windows agree to the end. Each tie is compared with its window of the
   least document, what differs with the least that is left, and after ROUNDS of these all at once, offset by offset.
   Equality is of bytes throughout.
4. Windows of later documents are removed; where they overlap their union is.

Documents are held in blocks of a bounded size, in a table bucketed by block, so that answers find
their documents without another shuffle of text. Before anything leaves a block its equal keys become
one and equal pieces one, so a string in all documents is sent once per block. Keys travel sorted, as differences in
byte planes under zstandard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parchwork.llm._memory import tidy
from parchwork.llm._words import _VALUES, _powers, mix
from parchwork.plans.session import fresh_path, materialize

_U = np.uint64
#: A perfect difference cover: each non-zero difference modulo PERIOD occurs once among COVER.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Text in a block of small tables and in one of any, about, and keys in a bucket, about.
BLOCK_BYTES, MOST_BYTES, BUCKET_KEYS = 2 << 20, 16 << 20, 1 << 20
#: Windows that tie are compared with one of them this many times.
ROUNDS = 6
#: Up to this much text blocks have BLOCK_BYTES; beyond it they grow as the text's square root, as does their number.
SMALL_BYTES = 4 << 30
#: Bytes of the key that names a window's bucket, and windows in a piece at most.
MINIMIZER, PIECE = 20, 200
#: A block remembers its tied sample keys by this many low bits; a chance hit only leaves a window for step 2.
TABLE_BITS = 23
_CHUNK = 1 << 17
_LAST = (1 << 63) - 1


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers as differences in byte planes."""
    import zstandard

    steps = np.diff(values, prepend=_U(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


class Block:
    """Documents in doc_id order as one byte array; null ids come last."""

    def __init__(self, batch: pa.RecordBatch, length: int):
        self.batch, self.length = batch, length
        ids = batch.column("doc_id")
        self.doc_ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def _chunks(self, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of positions: (first position, position within document, bytes to the document's end, prefix sums)."""
        power, _ = _powers(_CHUNK + width + 1)
        for a in range(0, len(self.data), _CHUNK):
            b = min(a + _CHUNK, len(self.data))
            first, last = np.searchsorted(self.ends, a, "right"), np.searchsorted(self.ends, b - 1, "right") + 1
            n = np.minimum(self.ends[first:last], b) - np.maximum(self.starts[first:last], a)
            at = np.arange(a, b)
            buf = self.data[a : b + width]
            with np.errstate(over="ignore"):
                sums = np.zeros(len(buf) + 1, dtype=np.uint64)
                np.cumsum(_VALUES[buf] * power[: len(buf)], out=sums[1:])
            yield a, at - np.repeat(self.starts[first:last], n), np.repeat(self.ends[first:last], n) - at, sums

    @staticmethod
    def _keys(sums: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        _, inverse = _powers(len(sums))
        with np.errstate(over="ignore"):
            return mix((sums[at + width] - sums[at]) * inverse[at])

    def samples(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, keys) of the cover sample."""
        width = self.length - PERIOD + 1
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        for a, within, room, sums in self._chunks(width):
            at = np.flatnonzero(cover[within % PERIOD] & (room >= width))
            yield a + at, self._keys(sums, at, width)

    def pieces(self, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, windows, bucket key, key of the text) of the pieces that tied samples leave open. `tied`: a table of low key bits."""
        near = np.zeros(len(self.data) + PERIOD + 1, dtype=np.int32)
        mask = _U((1 << TABLE_BITS) - 1)
        for at, keys in self.samples():
            near[at[tied[(keys >> _U(64 - KEY_BITS)) & mask]] + 1] = 1
        np.cumsum(near, out=near)
        out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))]
        span = self.length - MINIMIZER + 1
        for a, within, room, sums in self._chunks(self.length):
            n = len(within)
            at = np.flatnonzero((near[a + PERIOD : a + PERIOD + n] > near[a : a + n]) & (room >= self.length))
            if not len(at):
                continue
            least, width = self._keys(sums, np.arange(len(sums) - MINIMIZER), MINIMIZER), 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: width - span], least[span - width :])
            key = least[at]
            new = (np.diff(at, prepend=-2) != 1) | (np.diff(key, prepend=key[:1]) != 0)
            first = np.flatnonzero(new)
            new |= (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % PIECE == 0
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(at)))
            with np.errstate(over="ignore"):
                text = self._spans(sums, at[first], at[first] + many + self.length - 1)
            out.append((a + at[first], many, mix(key[first] ^ _U(0x94D049BB133111EB)), text))  # least keys are small ones; dealt anew they spread evenly
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    @staticmethod
    def _spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inverse = _powers(len(sums))
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def owners(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, "right")


#: Leading bits of a sample key that travel. Two different ones agree by chance for one sample in 2**(KEY_BITS - log2 samples).
KEY_BITS = 40


def _bucket_of(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Buckets are ranges of the leading 32 bits."""
    return ((keys >> _U(bits - 32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _runs(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(buckets):
        first = np.flatnonzero(np.diff(buckets, prepend=-1))
        yield from zip(buckets[first].tolist(), first.tolist(), [*first[1:].tolist(), len(buckets)], strict=True)


def _serialized(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _restored(data: bytes, length: int) -> Block:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return Block(table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema), length)


def _to_blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")]).combine_chunks()
            row = pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([_serialized(table.to_batches()[0])], pa.binary())], names=["block", "rows"])
            held.clear()
            seq, size = seq + 1, 0
            return row

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= limit:
                    held.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                    yield flush()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield flush()

    return run


_SENT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("base", T.LongType())])
_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("base", pa.int64())])
_ANSWER = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("answer", T.BinaryType())])
_ANSWER_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], names=schema.names)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _send_samples(length: int, buckets: int):
    """Each block's distinct sample keys by bucket; keys in two of its documents are marked in `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            block = _restored(r["rows"], length)
            found = [(at, k >> _U(64 - KEY_BITS)) for at, k in block.samples()]
            at = np.concatenate([np.empty(0, np.int64), *(x for x, _ in found)])
            keys = np.concatenate([np.empty(0, np.uint64), *(x for _, x in found)])
            low = _U(64 - KEY_BITS)
            if len(block.data) < 1 << (64 - KEY_BITS):  # key and position in one number
                packed = np.sort(keys << low | at.astype(np.uint64))
                keys, at = packed >> low, (packed & ((_U(1) << low) - _U(1))).astype(np.int64)
            else:
                order = np.argsort(keys, kind="stable")
                keys, at = keys[order], at[order]
            first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + _U(1))) if len(keys) else np.empty(0, np.int64)
            last = np.append(first[1:], len(keys)) - 1 if len(first) else first
            keys, twice, again = keys[first], np.zeros(len(first), dtype=bool), np.flatnonzero(first != last)
            twice[again] = block.owners(at[first[again]]) != block.owners(at[last[again]])
            yield _rows([(b, r["block"], pack_sorted(keys[x:y]), np.packbits(twice[x:y]).tobytes(), y - x) for b, x, y in _runs(_bucket_of(keys, buckets, KEY_BITS))], _SENT_ARROW)

    return run


def _count_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket at a time: the low bits of each block's keys that two documents have."""
    for r in _each(batches):
        sent = [(x["block"], unpack_sorted(x["keys"]), np.unpackbits(np.frombuffer(x["docs"], np.uint8), count=x["base"]).astype(bool)) for x in r["sent"]]
        every = np.sort(np.concatenate([k for _, k, _ in sent]))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        answers = []
        for block, keys, twice in sent:
            at = np.searchsorted(shared, keys)
            tied = keys[twice | (shared[np.minimum(at, len(shared) - 1)] == keys if len(shared) else False)]
            if len(tied):
                answers.append((block, r["bucket"], pack_sorted(np.unique(tied & _U((1 << TABLE_BITS) - 1)))))
        yield _rows(answers, _ANSWER_ARROW)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[1], ...: `size` numbers from each start."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Opened:
    """A block's open pieces: `order` sorts them by bucket and text, `first` are the first of each distinct one in that order."""

    def __init__(self, row: dict, length: int, buckets: int):
        self.block = _restored(row["rows"], length)
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        for a in row["tied"] or []:
            table[unpack_sorted(a["answer"])] = True
        start, many, key, text = self.block.pieces(table)
        bucket = _bucket_of(key, buckets, 64)
        order = np.lexsort((text, bucket))  # stable: positions, and so documents, ascend among equals
        self.start, self.many, self.bucket = start[order], many[order], bucket[order]
        text = text[order]
        new = (np.diff(text, prepend=text[:1] + _U(1)) != 0) | (np.diff(self.bucket, prepend=-1) != 0) if len(text) else np.empty(0, bool)
        new = self._told_apart(new, length)
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.docs = self.block.doc_ids[self.block.owners(self.start)]

    def _told_apart(self, new: np.ndarray, length: int) -> np.ndarray:
        """`new` with every piece its own where pieces under one key aren't all equal bytes."""
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        again = np.flatnonzero(~new)
        like, data = first[group[again]], self.block.data
        other = self.many[again] != self.many[like]
        same = np.flatnonzero(~other)
        for part in np.array_split(same, max(1, len(same) * (PIECE + length) >> 22)):
            size = self.many[again[part]] + length - 1
            if len(part):
                differs = data[_ragged(self.start[again[part]], size)] != data[_ragged(self.start[like[part]], size)]
                other[part] = np.logical_or.reduceat(differs, np.cumsum(size) - size)
        return new | np.isin(group, group[again[other]]) if other.any() else new


def _send_pieces(length: int, buckets: int):
    """Each block's distinct pieces by bucket: their text, windows and first documents."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for r in _each(batches):
            o = Opened(r, length, buckets)
            start, many, docs = o.start[o.first], o.many[o.first], o.docs[o.first]
            for b, x, y in _runs(o.bucket[o.first]):
                base = int(docs[x:y].min())
                text = o.block.data[_ragged(start[x:y], many[x:y] + length - 1)]
                yield _rows([(b, r["block"], pack(many[x:y].astype(np.uint8).tobytes() + text.tobytes()), pack_numbers((docs[x:y] - base).astype(np.uint64)), base)], _SENT_ARROW)

    return run


class CoverRanks:
    """The cover sample of a text of `size` bytes, of which `words` are the eight from each on, sorted by its suffixes' first `length`
    bytes; `place` gives a sample position's place in that order. Of positions that aren't `wanted` there is none."""

    def __init__(self, words: np.ndarray, size: int, length: int, wanted: np.ndarray | None = None):
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        self.sampled = np.tile(cover, size // PERIOD + 1)[:size]
        at = np.flatnonzero(self.sampled if wanted is None else self.sampled & wanted)
        offsets = range(0, length, 8)
        at = at[np.lexsort([words[at + k] for k in reversed(offsets)])]
        self.place = np.zeros(size, dtype=np.int64)
        self.place[at] = np.arange(len(at))
        #: Bytes that each suffix in order shares with the one before.
        self.shared = np.zeros(len(at), dtype=np.int64)
        open_ = np.arange(1, len(at))
        for k in offsets:
            x = words[at[open_] + k] ^ words[at[open_ - 1] + k]
            self.shared[open_] += (x[:, None] < (_U(1) << np.arange(56, -1, -8, dtype=np.uint64))[None, :]).sum(axis=1)
            open_ = open_[x == 0]

    def ranks(self, depth: int) -> np.ndarray:
        """By place, numbers that are equal for suffixes that agree on `depth` bytes and ascend with them."""
        return np.cumsum(self.shared < depth, dtype=np.int32)


def _meeting() -> np.ndarray:
    """For each two residues the least shift that brings both into the cover."""
    inside = np.isin((np.arange(PERIOD)[:, None] + np.arange(PERIOD)[None, :]) % PERIOD, COVER)  # residue, shift
    return (inside[:, None, :] & inside[None, :, :]).argmax(axis=2)


def _with_partner(text: np.ndarray, at: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Windows whose hash one of another document has too; all others equal none of another document."""
    power, _ = _powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[text] * power[: len(text)], out=sums[1:])
    keys = Block._keys(sums, at, length)
    order = np.argsort(keys)
    keys, d = keys[order], docs[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + _U(1)))
    open_ = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
    return order[np.repeat(open_, np.diff(np.append(first, len(order))))]


def _tied(words: np.ndarray, at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that agree on PERIOD bytes with one of another document, in order of those bytes and then by document, and their ties' numbers."""
    order = np.lexsort((words[at + PERIOD - 8], words[at + 8], words[at]))
    sorted_at = at[order]
    new = np.zeros(len(at), dtype=bool)
    new[0] = True
    for k in (0, 8, PERIOD - 8):
        x = words[sorted_at + k]
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    d = docs[order]
    open_ = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
    many = np.diff(np.append(first, len(at)))
    order = order[np.repeat(open_, many)]
    group = np.repeat(np.arange(np.count_nonzero(open_)), many[open_])
    _, d = np.unique(docs[order], return_inverse=True)
    by = np.argsort(group.astype(np.uint64) << _U(32) | d.astype(np.uint64))
    return order[by], group[by]


def earlier(text: np.ndarray, at: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """The least of `docs` among the windows that equal each one; a window is the `length` bytes of `text` at `at`."""
    best = docs.copy()
    if not len(at):
        return best
    some = _with_partner(text, at, docs, length)
    if not len(some):
        return best
    padded = np.zeros(len(text) + length + 16, dtype=np.uint64)
    padded[: len(text)] = text
    words = np.zeros(len(text) + length + 8, dtype=np.uint64)
    for k in range(8):  # the eight bytes from each position on, as a number in byte order
        words = words << _U(8) | padded[k : k + len(words)]
    left, group = _tied(words, at[some], docs[some])
    left = some[left]
    if not len(left):
        return best
    begun = np.cumsum(np.bincount(at[left], minlength=len(text)))
    begun[PERIOD:] -= begun[:-PERIOD].copy()  # windows that begin less than PERIOD before
    ranked = CoverRanks(words, len(text), length, begun > 0)
    ranks = np.array([ranked.ranks(length - shift) for shift in range(PERIOD)])
    meeting, residue = _meeting(), at % PERIOD
    for _ in range(ROUNDS):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        centre = np.repeat(left[first], np.diff(np.append(first, len(left))))
        shift = meeting[residue[left], residue[centre]]
        same = ranks[shift, ranked.place[at[left] + shift]] == ranks[shift, ranked.place[at[centre] + shift]]
        best[left[same]] = docs[centre[same]]
        left, group = left[~same], group[~same]
        if not len(left):
            return best
    for shift in range(PERIOD):
        met = np.flatnonzero(ranked.sampled[at[left] + shift])
        if not len(met):
            continue
        keys = group[met].astype(np.uint64) << _U(32) | ranks[shift, ranked.place[at[left[met]] + shift]].astype(np.uint64)
        by = np.argsort(keys)
        keys, met = keys[by], left[met[by]]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + _U(1)))
        least = np.repeat(np.minimum.reduceat(docs[met], first), np.diff(np.append(first, len(keys))))
        best[met] = np.minimum(best[met], least)
    return best


def _sort_windows(length: int):
    """One bucket at a time: for each window of each block's pieces, whether an earlier document has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for r in _each(batches):
            # equal pieces of different blocks are sorted once, under their first document
            number: dict[bytes, int] = {}
            same, many, docs, sizes = [], [], [], []
            for x in r["sent"]:
                own = unpack_numbers(x["docs"]).astype(np.int64) + x["base"]
                data = expand(x["keys"])
                n = np.frombuffer(data, dtype=np.uint8, count=len(own)).astype(np.int64)
                ends = (len(own) + np.cumsum(n + length - 1)).tolist()
                same += [number.setdefault(data[a:b], len(number)) for a, b in zip([len(own), *ends[:-1]], ends, strict=True)]
                many.append(n)
                docs.append(own)
                sizes.append(int(n.sum()))
            same, many, docs = np.array(same), np.concatenate(many), np.concatenate(docs)
            least, windows = np.full(len(number), _LAST), np.array([len(t) for t in number]) - length + 1
            np.minimum.at(least, same, docs)
            ends = np.cumsum(windows + length - 1)
            at = _ragged(ends - windows - length + 1, windows)
            best = earlier(np.frombuffer(b"".join(number), dtype=np.uint8), at, np.repeat(least, windows), length)
            later = np.repeat(docs, many) > best[_ragged((np.cumsum(windows) - windows)[same], many)]
            ends = np.cumsum(sizes).tolist()
            yield _rows([(x["block"], r["bucket"], pack(np.packbits(later[e - n : e]).tobytes())) for x, n, e in zip(r["sent"], sizes, ends, strict=True)], _ANSWER_ARROW)

    return run


def _remove(length: int, buckets: int, schema: pa.Schema, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for r in _each(batches):
            o = Opened(r, length, buckets)
            block, many = o.block, o.many[o.first]
            told = {x["bucket"]: x["answer"] for x in r["later"] or []}
            later = [np.empty(0, np.uint8)]
            for b, x, y in _runs(o.bucket[o.first]):
                later.append(np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(told[b]), np.uint8), count=int(many[x:y].sum())))
            later = np.concatenate(later).astype(bool)
            begin = (np.cumsum(many) - many)[o.group]
            gone = later[_ragged(begin, o.many)] | np.repeat(o.docs > o.docs[o.first][o.group], o.many)
            gone = _ragged(o.start, o.many)[gone]
            edges = np.zeros(len(block.data) + 1, dtype=np.int32)
            edges[gone] += 1
            edges[gone + length] -= 1
            cut = np.cumsum(edges[:-1]) > 0
            n = len(block.doc_ids)
            out = block.batch
            spans, kept, removed = [], [], np.zeros(n, np.int64)
            for i, (a, b) in enumerate(zip(block.starts.tolist(), block.ends.tolist(), strict=True)):
                mine = cut[a:b]
                if mine.any():
                    edge = np.diff(mine.view(np.int8), prepend=np.int8(0), append=np.int8(0))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                    removed[i] = int(mine.sum())
                    kept.append(block.data[a:b][~mine].tobytes())
                else:
                    spans.append([])
                    kept.append(block.data[a:b].tobytes())
            if as_text:
                at = out.schema.get_field_index("text")
                texts = [k.decode("utf-8", "ignore") if valid else None for k, valid in zip(kept, out.column(at).is_valid().to_pylist(), strict=True)]
                left = np.flatnonzero((removed == 0) | (removed < block.ends - block.starts))
                columns = out.set_column(at, "text", pa.array(texts, pa.string())).take(pa.array(left)).columns
            else:
                columns = [*out.columns, pa.array(block.ends - block.starts), pa.array(removed), pa.array(spans, schema.field("removed_spans").type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], names=schema.names)

    return run


def remove_repeats(df: DataFrame, length: int = 50, as_text: bool = False) -> DataFrame:
    """`df` with n_bytes, n_removed, removed_spans (half-open, in bytes) and kept (the remaining bytes).

    `df` has doc_id (integer) and text. A byte goes if a string of `length` bytes that covers it also
    starts in a document with a smaller doc_id; strings are judged on the input, and never cross
    documents. A null text is empty; texts under `length` bytes are kept. Rows of equal doc_id take nothing
    from each other; a null doc_id counts as greater than all others. Columns of the new names in the
    input are replaced. An empty table gives no rows. Strings are compared by their bytes.

    With `as_text` the result has the columns of `df`, the remaining text among them, and no documents of which
    nothing remains; a character that is cut in part goes as a whole.
    """
    if length < 2 * PERIOD:
        raise ValueError(f"strings must have {2 * PERIOD} bytes at least")
    spark = df.sparkSession
    docs = (df if as_text else df.drop("n_bytes", "n_removed", "removed_spans", "kept")).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    limit = BLOCK_BYTES if total <= SMALL_BYTES else min(MOST_BYTES, int(BLOCK_BYTES * (total / SMALL_BYTES) ** 0.5))
    name = f"parchwork_blocks_{uuid.uuid4().hex}"
    written = docs.mapInArrow(tidy(_to_blocks(limit)), "block long, rows binary")
    written.write.option("compression", "none").option("path", fresh_path(spark, "blocks")).bucketBy(parts, "block").format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files under a path of their own stay, and `blocks` reads them
    buckets = max(parts, -(-total * len(COVER) // PERIOD // BUCKET_KEYS))

    def answered(sent: DataFrame, sort, label: str, column: str) -> DataFrame:
        in_bucket = sent.groupBy("bucket").agg(F.collect_list(F.struct("block", "keys", "docs", "base")).alias("sent"))
        answers = materialize(in_bucket.mapInArrow(tidy(sort), _ANSWER), label)
        return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(column))

    tied = answered(blocks.mapInArrow(tidy(_send_samples(length, buckets)), _SENT), _count_samples, "tied", "tied")
    opened = blocks.join(tied, "block", "left")
    later = answered(opened.mapInArrow(tidy(_send_pieces(length, buckets)), _SENT), _sort_windows(length), "later", "later")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    more = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", span), T.StructField("kept", T.BinaryType())]
    schema = T.StructType([*docs.schema.fields, *([] if as_text else more)])
    out = opened.join(later, "block", "left").mapInArrow(tidy(_remove(length, buckets, to_arrow_schema(schema), as_text)), schema)
    return out.select(*df.columns) if as_text else out


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 50)
    return docs.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], length: int = 50) -> dict[int, tuple[int, int, bytes]]:
    """doc_id → (n_removed, n_spans, kept), by a table of all windows."""
    first: dict[bytes, int] = {}
    for doc in sorted(texts):
        t = texts[doc]
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], doc)
    out = {}
    for doc, t in texts.items():
        cut = np.zeros(len(t) + 1, dtype=bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < doc:
                cut[k : k + length] = True
        runs = int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1))
        out[doc] = (int(cut.sum()), runs, bytes(b for b, c in zip(t, cut, strict=False) if not c))
    return out
