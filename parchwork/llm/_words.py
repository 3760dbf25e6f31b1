"""Vectorised word hashing over batches of UTF-8 texts.

Texts are joined into one byte array and every word gets a 64-bit hash, eight bytes
at a time over all words, so the cost is a few numpy passes and no Python object is made for a
word. Hashes of words and shingles stand for them in keys; where an answer must be exact, `sets_of`
compares what has equal hashes by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_COMBINE = _U(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240117)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)

#: White space of the near-duplicate contract: space and the controls 09-0D.
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Separators of the decontamination contract, after lower-casing A-Z.
NON_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            for name, base in (("_pow", _BASE), ("_inv", _INV)):
                out = np.full(n, base, dtype=np.uint64)
                out[0] = 1
                globals()[name] = np.multiply.accumulate(out)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64; a bijection."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def separator_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


#: Longer words are hashed one by one.
_LONG = 256
#: Of eight bytes, the first k.
_FIRST = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], dtype=np.uint64)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, without a copy; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def word_bounds(buf: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of `buf`; `blank` marks separators."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.diff((~blank[buf]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; words of eight bytes or fewer differ whenever their lengths agree and their bytes don't."""
    sizes = ends - starts
    eights = _eights(buf)
    out = mix(sizes.astype(np.uint64) ^ _U(0x2545F4914F6CDD1D))
    short = np.flatnonzero(sizes <= _LONG)
    at = 0
    while len(short):
        out[short] = mix(out[short] ^ (eights[starts[short] + at] & _FIRST[np.minimum(sizes[short] - at, 8)]))
        at += 8
        short = short[sizes[short] > at]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(data: bytes, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of every word of `data`; `blank` marks separators."""
    buf = np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_bounds(buf, blank)
    return starts, hashes_of(buf, starts, ends)


def _words_differ(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> bool:
    """Whether two different words have one hash."""
    order = np.argsort(hashes)
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    i, j = order[same], order[same + 1]
    sizes = ends - starts
    if (sizes[i] != sizes[j]).any():
        return True
    eights, at = _eights(buf), 0
    while len(i):
        if ((eights[starts[i] + at] ^ eights[starts[j] + at]) & _FIRST[np.minimum(sizes[i] - at, 8)]).any():
            return True
        at += 8
        if at > _LONG:
            return any(buf[starts[a] : ends[a]].tobytes() != buf[starts[b] : ends[b]].tobytes() for a, b in zip(i.tolist(), j.tolist(), strict=True))
        on = sizes[i] > at
        i, j = i[on], j[on]
    return False


def sets_of(texts: list[bytes], width: int, separators: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its sorted distinct shingle hashes, and a sorted set of numbers that are equal among these texts
    just where shingles are. The second is the first unless two different words or shingles share a hash.
    """
    gap = bytes(separators[:1])
    buf = np.frombuffer(gap.join(texts).translate(LOWER), dtype=np.uint8)
    starts, ends = word_bounds(buf, separator_table(separators))
    words = hashes_of(buf, starts, ends)
    cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    runs = [combine(words[a:b], min(width, b - a)) if b > a else np.empty(0, np.uint64) for a, b in parts]
    hashed = [np.unique(r) for r in runs]
    flat = np.concatenate([np.empty(0, np.uint64), *runs])
    first = np.concatenate([np.empty(0, np.int64), *(np.arange(a, a + len(r)) for (a, _), r in zip(parts, runs, strict=True))])
    size = np.repeat([min(width, b - a) for a, b in parts], [len(r) for r in runs])
    order = np.argsort(flat)
    same = np.flatnonzero(flat[order[1:]] == flat[order[:-1]])
    i, j = order[same], order[same + 1]
    last = max(0, len(words) - 1)
    clash = bool((size[i] != size[j]).any()) or any((words[np.minimum(first[i] + k, last)] != words[np.minimum(first[j] + k, last)])[size[i] > k].any() for k in range(width if len(i) else 0))
    if not clash and not _words_differ(buf, starts, ends, words):
        return hashed, hashed
    number: dict[tuple[bytes, ...], int] = {}
    every = [buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    exact = [np.unique(np.array([number.setdefault(tuple(every[k : k + min(width, b - a)]), len(number)) for k in range(a, b - min(width, b - a) + 1)] if b > a else [], dtype=np.uint64)) for a, b in parts]
    return hashed, exact


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive entries."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, width):
            out = out * _COMBINE + hashes[k : n + k]
    return mix(out)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes.

    Fewer words than `width` make one shingle of the whole sequence; none make none.
    """
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(combine(hashes, min(width, len(hashes))))


def batched(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` (bytes) of about `limit` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def words_of(texts: list, separators: bytes, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of text, word starts within it, word hashes) of each UTF-8 text, lower-cased in A-Z."""
    blank = separator_table(separators)
    gap = bytes(separators[:1])
    for a, b in batched(texts, limit):
        part = texts[a:b]
        starts, hashes = word_hashes(gap.join(part).translate(LOWER), blank)
        offsets = np.cumsum([0, *(len(t) + 1 for t in part)])
        cuts = np.searchsorted(starts, offsets)
        for k in range(len(part)):
            s = slice(cuts[k], cuts[k + 1])
            yield a + k, starts[s] - offsets[k], hashes[s]


def grams_of(texts: list, separators: bytes, width: int, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(index of text, hashes of all its runs of `width` bytes), lower-cased in A-Z, separators as one kind, a blank at both ends."""
    table = bytes(0x20 if c in separators else c for c in LOWER)
    for a, b in batched(texts, limit):
        part = [b" " + t + b" " for t in texts[a:b]]
        buf = np.frombuffer(b"".join(part).translate(table), dtype=np.uint8)
        power, inverse = _powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(_VALUES[buf] * power[: len(buf)], out=sums[1:])
            hashes = mix((sums[width:] - sums[:-width]) * inverse[: max(0, len(buf) + 1 - width)]) if len(buf) >= width else np.empty(0, np.uint64)
        start = 0
        for k, t in enumerate(part):
            yield a + k, hashes[start : max(start, start + len(t) - width + 1)]
            start += len(t)
