"""One-permutation MinHash with optimal densification, and its bands."""

from __future__ import annotations

import numpy as np

from parchwork.llm._words import mix

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


class OnePermutation:
    """Signatures of `bands * rows` bins from one hash per shingle.

    A shingle's hash names its bin (multiply-shift on the high half) and its rank
    there; a bin keeps its least rank. An empty bin borrows from the first full bin of
    its own probe order, which is the same for all documents (Shrivastava 2017), so
    two bins still agree with probability equal to the Jaccard similarity.
    """

    def __init__(self, bands: int, rows: int, probes: int = 64):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(7)
        self._probe = rng.integers(0, self.bins, (probes, self.bins))
        self._salt = rng.integers(1, 1 << 63, self.bins, dtype=np.uint64) | _U(1)
        self._band = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """`shingles`: distinct 64-bit hashes, at least one."""
        with np.errstate(over="ignore"):
            ranks = mix(shingles ^ _U(0x5851F42D4C957F2D))
            bins = ((ranks >> _U(32)) * _U(self.bins)) >> _U(32)
            out = np.full(self.bins, _EMPTY)
            order = np.lexsort((ranks, bins))
            bins, ranks = bins[order].astype(np.int64), ranks[order]
            first = np.flatnonzero(np.diff(bins, prepend=-1))
            full = bins[first]
            out[full] = ranks[first]
            if len(full) == self.bins:
                return out
            taken = np.zeros(self.bins, dtype=bool)
            taken[full] = True
            empty = np.flatnonzero(~taken)
            for probe in self._probe:
                source = probe[empty]
                hit = taken[source]
                out[empty[hit]] = ranks[first[np.searchsorted(full, source[hit])]]
                empty = empty[~hit]
                if not len(empty):
                    return out
            for j in empty:  # very few shingles: go on with a longer probe order of that bin
                rng = np.random.default_rng(1000 + j)
                while True:
                    source = rng.integers(0, self.bins, 256)
                    hit = np.flatnonzero(taken[source])
                    if len(hit):
                        out[j] = ranks[first[np.searchsorted(full, source[hit[0]])]]
                        break
            return out

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 63-bit key per band, different between bands."""
        with np.errstate(over="ignore"):
            s = (self.signature(shingles) * self._salt).reshape(self.bands, self.rows)
            keys = self._band.copy()
            for k in range(self.rows):
                keys = mix(keys ^ s[:, k])
        return (keys >> _U(1)).astype(np.int64)


def jaccard_linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, for sorted distinct arrays."""
    na, nb = len(a), len(b)
    if not na or not nb or 100 * min(na, nb) < percent * max(na, nb):
        return False
    at = np.searchsorted(b, a)
    common = int(np.count_nonzero(b[np.minimum(at, nb - 1)] == a))
    return 100 * common >= percent * (na + nb - common)
