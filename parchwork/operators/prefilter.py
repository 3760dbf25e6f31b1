"""Which of many patterns can occur in a text, from one pass over its consonants.

Of each alternative of a pattern the longest word that every match holds is taken, without diacritics. All words stand in one trie,
written as a regular expression that looks ahead at each place of the text's consonant spine. A text without any of the words
costs that pass, however many patterns there are.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchwork.functions.dialect import HARAKAT

#: Letters of a word that tells a pattern, at least.
LEAST = 3
#: Diacritics and tatweel.
_SILENT = f"{HARAKAT[:-1]}ـ]"
#: An atom of a template with its quantifier: a loose word, a class, an escape, or a character.
_ATOM = re.compile(r"\{[؀-ۿ]+\}|\[(?:\\.|[^\]\\])*\]|\\x\{\w+\}|\\.|.", re.DOTALL)
_QUANTIFIER = re.compile(r"(?:[?*+]|\{[0-9,]+\})[+?]?")


def _alternatives(template: str) -> list[str]:
    """Split at the bars that stand in no group or class."""
    out, depth = [""], 0
    for atom in _ATOM.findall(template):
        depth += (atom == "(") - (atom == ")")
        if atom == "|" and not depth:
            out.append("")
        else:
            out[-1] += atom
    return out


def _word(alternative: str) -> str:
    """The longest run of letters that stands in no group and under no quantifier; empty if there is none of LEAST letters."""
    runs, depth, at = [""], 0, 0
    while at < len(alternative):
        atom = _ATOM.match(alternative, at)[0]
        at += len(atom)
        quantified = _QUANTIFIER.match(alternative, at)
        at = quantified.end() if quantified else at
        depth += (atom == "(") - (atom == ")")
        letters = re.sub(_SILENT, "", atom[1:-1] if atom[0] == "{" else atom)
        if not letters:
            continue  # a diacritic, said or not, leaves no trace in the spine
        if depth or quantified or not re.fullmatch("[ء-ي]+", letters):
            runs.append("")
        else:
            runs[-1] += letters
    return max((r for r in runs if len(r) >= LEAST), key=len, default="")


def required(template: str) -> frozenset[str]:
    """Words of which the spine of every match holds one; empty if some alternative has none."""
    words = [_word(a) for a in _alternatives(template)]
    return frozenset(words) if all(words) else frozenset()


def _trie(words: set[str]) -> str:
    """The longest of `words`, as a pattern without backtracking over shared beginnings."""
    by: dict[str, set[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], set()).add(w[1:])
    body = "|".join(c + _trie(rest) for c, rest in sorted(by.items()))
    if not body:
        return ""
    return f"(?:{body})?" if "" in words else f"(?:{body})" if len(by) > 1 else body


class Prefilter(NamedTuple):
    """`words` of each pattern, in the patterns' order; none: the pattern can't be told and is always tried."""

    words: list[frozenset[str]]

    def found(self, text: Column) -> Column:
        """The words that stand in `text`, each once; of several at one place the longest."""
        every = set().union(*self.words)
        look = f"(?=[{''.join(sorted({w[0] for w in every}))}])(?=({_trie(every)}))"
        return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, f"{_SILENT}+", ""), F.lit(look), F.lit(1)))

    def may(self, k: int, found: Column) -> Column:
        """Whether pattern `k` can occur where `found` are the words. A longer word at the same place stands for its beginnings."""
        every = set().union(*self.words)
        telling = sorted(w for w in every if any(w.startswith(x) for x in self.words[k]))
        return F.arrays_overlap(found, F.array(*map(F.lit, telling))) if self.words[k] else F.lit(True)


def of(templates: list[str]) -> Prefilter:
    return Prefilter([required(t) for t in templates])
