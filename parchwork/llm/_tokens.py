"""Whole-text tokenisation through a cache of the pieces that a tokenizer never merges across."""

from __future__ import annotations

import gc
import json
import os
import string
from itertools import chain

import numpy as np

from parchwork.llm._memory import CACHES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_MARKS = string.punctuation
#: `str.split` cuts at these; the tokenizers don't.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: All white space but blank and line feed, the mark that is used here to cut, and runs of white space.
_ODD = ("\x01", "\t", "\x0b", "\x0c", "\r", *_SEPARATORS, "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
_RUNS = ("  ", "\n\n", " \n", "\n ")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, equal to `Tokenizer.encode(text, add_special_tokens=False)`.

    Strings of special tokens inside a text are ordinary text. A text is cut where the
    pre-tokenizer always cuts (white space), each distinct piece goes through the library
    once, and the ids of the first `keep` pieces, and of a task's first `extra` others, are
    kept; that bounds memory and changes no result. Texts with unusual white space, and all texts of tokenizers whose
    cuts are unknown here, go through the library as a whole.
    """

    def __init__(self, path: str, keep: int = 1_000_000, extra: int = 200_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self._keep, self._room = keep, extra
        self._cache: dict[str, bytes] = {}
        self._extra: dict[str, bytes] = {}
        before, self._starts, self._ends = told.get("pre_tokenizer") or {}, None, None

        def marked(holds) -> np.ndarray:
            out = np.zeros(self._tokenizer.get_vocab_size() + 1, dtype=bool)
            out[[i for t, i in self._tokenizer.get_vocab().items() if holds(t)]] = True
            return out

        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not told.get("normalizer"):
            self._cut, self._starts = self._cut_byte_level, marked(lambda t: t.startswith("Ġ"))
            self._feed = self._tokenizer.encode("\n", add_special_tokens=False).ids[0]
        elif told.get("model", {}).get("end_of_word_suffix") and "\\s+" in json.dumps(told.get("normalizer")).replace("\\\\", "\\"):
            suffix = told["model"]["end_of_word_suffix"]
            self._cut, self._ends = self._cut_words, marked(lambda t: t.endswith(suffix))
        else:
            self._cut = lambda text: None

    @staticmethod
    def _cut_byte_level(text: str) -> list[str] | None:
        """Only where all white space is single blanks and line feeds."""
        if any(c in text for c in _ODD) or any(c in text for c in _RUNS):
            return None
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    @staticmethod
    def _cut_words(text: str) -> list[str] | None:
        return None if any(c in text for c in _SEPARATORS) else text.split()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of `new` pieces. Letters and the marks after them are two pre-tokens, so such a piece is put
        together from both; pieces of letters alone are one pre-token each and go in one string."""
        cache, extra, got = self._cache, self._extra, {}
        spaced, bare, ended, others = set(), set(), [], set()
        for x in new:
            stem = x if x.isalpha() else x.rstrip(_MARKS)
            bare_stem = stem if stem[:1] != " " else stem[1:]
            # some letters are lowered to a letter and a mark
            if not bare_stem.isalpha() or not (bare_stem.isascii() or bare_stem.lower().isalpha()):
                others.add(x)
                continue
            if len(stem) < len(x):
                ended.append((x, stem))
                others.add(x[len(stem) :])
            (spaced if stem[0] == " " else bare).add(stem)
        for words, encode in ((spaced, self._encode_words), (bare, self._encode_words), (others, self._encode)):
            some = []
            for x in words:
                if (known := cache.get(x) or extra.get(x)) is None:
                    some.append(x)
                else:
                    got[x] = known
            for a in range(0, len(some), 2048):
                part = some[a : a + 2048]
                got.update(zip(part, encode(part), strict=True))
        for x, stem in ended:
            got[x] = got[stem] + got[x[len(stem) :]]
        if len(cache) < self._keep:
            cache.update(got)
        elif len(extra) < self._room:
            extra.update(got)
        return got

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words, all or none with a blank before them, as one string; the ids are told apart by the tokens
        that mark a word's start or end, or stand for a line feed between. Without as many marks as words
        each goes by itself."""
        ids = np.empty(0, "<u4")
        if self._ends is not None or self._starts is not None:
            between = " " if self._ends is not None else "" if words[0][0] == " " else "\n"
            ids = np.array(self._tokenizer.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        if self._ends is not None:
            ends = np.flatnonzero(self._ends[ids]) + 1
            starts = np.append(0, ends[:-1])
        elif self._starts is not None and words[0][0] == " ":
            starts = np.flatnonzero(self._starts[ids])
            ends = np.append(starts[1:], len(ids))
        elif self._starts is not None:
            feeds = np.flatnonzero(ids == self._feed)
            starts, ends = np.append(0, feeds + 1), np.append(feeds, len(ids))
        else:
            return self._encode(words)
        if len(starts) != len(words) or starts[0] or ends[-1] != len(ids):
            return self._encode(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids for each text."""
        return [np.frombuffer(x, dtype="<u4") for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers, and `end` after them."""
        gc.disable()  # millions of strings in a few lists, and no cycle among them
        try:
            return self._encode_bytes(texts, end)
        finally:
            gc.enable()

    def _encode_bytes(self, texts: list[str], end: bytes) -> list[bytes]:
        parts = [self._cut(t) for t in texts]
        flat = list(chain.from_iterable(p for p in parts if p is not None))
        found = list(map(self._cache.get, flat))
        missing = [i for i, x in enumerate(found) if x is None] if None in found else []
        if missing and self._extra:
            for i in missing:
                found[i] = self._extra.get(flat[i])
            missing = [i for i in missing if found[i] is None]
        if missing:
            got = self._learn({flat[i] for i in missing})
            for i in missing:
                found[i] = got[flat[i]]
        out, at = [], 0
        for p in parts:
            n = 0 if p is None else len(p)
            out.append(b"".join((*found[at : at + n], end)))
            at += n
        whole = [i for i, p in enumerate(parts) if p is None]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids + end
        return out


_encoders: dict[str, Encoder] = CACHES.setdefault("encoders", {})


def encoder(path: str) -> Encoder:
    """One for each path and Python process; a task begins without the pieces that were only the last one's."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path]._extra.clear()
    return _encoders[path]


def text_batches(texts: list, limit: int = 1 << 20):
    """Ranges of about `limit` characters, so that what a batch needs stays small; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
