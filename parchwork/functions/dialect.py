"""Regular expressions for two engines.

Semantics are those of ECMAScript: `\\s` covers Unicode blanks, `\\w` and `\\b` are ASCII, `$` is the end of the
text unless lines are asked for. A Step carries a pattern for Java, with possessive quantifiers where
a long run would exhaust the stack, and if it differs the RE2 pattern that an SQL check uses.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class.
BLANKS = " \\t\\n\\r\\f\\x{0B}\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
S = f"[{BLANKS}]"
NOT_S = f"[^{BLANKS}]"
#: Start and end of a line, end of the text, and the ASCII word boundary, for Java. The start is the engine's own anchor, which
#: costs a tenth of a look behind at each position, but for NEL, which ends no line; a carriage return and line feed end one line together.
BOL, EOL, END = "(?m:^)(?<!\x85)", "(?![^\\n\\r\u2028\u2029])", "\\z"
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

ARABIC = "[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff]"
LATIN = "[a-zA-Z]"
HARAKAT = "[\u064b-\u0652\u0670]"


class Step(NamedTuple):
    """Replace every match. `$1` refers to a group; `sql` is the RE2 pattern if it is another, and `sql_put` its replacement."""

    pattern: str
    put: str
    sql: str | None = None
    sql_put: str | None = None


#: A pattern's pieces: an inline flag, a class, an escape (of a code point too), or a character; and what may follow one.
_PIECE = re.compile(r"\(\?[a-z]+\)|\[(?:\\.|[^\]\\])*\]|\\x\{\w+\}|\\.|.", re.DOTALL)
_TIMES = re.compile(r"([?*+]|\{([0-9]+)(,?)[0-9]*\})[+?]?")
_SIGNS = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\f": "\f"}


def needed(pattern: str) -> str:
    """The longest text that stands in every match of `pattern` as it is; empty if there is none outside of groups, classes and alternatives."""
    runs, depth, at, any_case = [""], 0, 0, False
    while at < len(pattern):
        piece = _PIECE.match(pattern, at)[0]
        at += len(piece)
        times = _TIMES.match(pattern, at)
        at = times.end() if times else at
        if piece.startswith("(?") and piece.endswith(")"):
            any_case = any_case or "i" in piece
            continue
        depth += (piece == "(") - (piece == ")")
        if piece == "|" and not depth:
            return ""
        sign = _SIGNS.get(piece) or (piece[1:] if piece[0] == "\\" and not piece[1].isalnum() and len(piece) == 2 else piece)
        plain = len(sign) == 1 and not (len(piece) == 1 and piece in "()[]{}.^$|?*+\\") and not (any_case and sign.isalpha())
        least = 1 if not times else 0 if times[1] in ("?", "*") else int(times[2] or 1)
        if depth or not plain or not least:
            runs.append("")
            continue
        runs[-1] += sign * least
        if times:  # there may be more of it before what follows
            runs.append("")
    return max(runs, key=len)


def rewrite(text: Column, steps: list[Step]) -> Column:
    """All steps in their order. A step whose pattern needs a text that isn't there is passed over, which costs a search for that text alone."""
    state = F.array(text)  # of one element, so that a lambda can name what the last step left

    def apply(s: Step):
        need = needed(s.pattern)

        def one(x: Column) -> Column:
            done = F.regexp_replace(x, s.pattern, s.put)
            return F.when(F.contains(x, F.lit(need)), done).otherwise(x) if need else done

        return one

    for s in steps:
        state = F.transform(state, apply(s))
    return F.get(state, F.lit(0))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rewrite_sql(expression: str, steps: list[Step]) -> str:
    for s in steps:
        put = s.sql_put if s.sql_put is not None else s.put.replace("\\$", "\0").replace("$", "\\").replace("\0", "$").replace("\\\\{", "{")
        expression = f"regexp_replace({expression}, {quoted(s.sql or re2(s.pattern))}, {quoted(put)}, 'g')"
    return expression


def re2(pattern: str) -> str:
    """Line anchors and possessive quantifiers in RE2's terms."""
    return pattern.replace(BOL, "(?m:^)").replace(EOL, "(?m:$)").replace("(?iu)", "(?i)").replace("++", "+").replace("*+", "*").replace("}+", "}").replace("?+", "?")


def trim(text: Column) -> Column:
    """Blanks at both ends, all kinds."""
    return F.regexp_replace(F.regexp_replace(text, f"\\A{S}++", ""), f"(?<!{S}){S}++\\z", "")


def trim_sql(expression: str) -> str:
    return f"regexp_replace(regexp_replace({expression}, {quoted('^' + S + '+')}, ''), {quoted(S + '+$')}, '')"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_sql(expression: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expression}, {quoted(re2(pattern))}))::INTEGER"


def first_only(text: Column, pattern: str, put: str) -> Column:
    """Replace the first match alone; `put` is literal."""
    return F.regexp_replace(text, f"(?s)\\A(.*?)(?:{pattern})", "$1" + put.replace("\\", "\\\\").replace("$", "\\$"))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
