"""Arabic presentation forms to standard letters (TXT-1), script runs (SNK-1d), protection of formulas (TXT-29), formulas to plain signs (SNK-1g).

What Spark has no built-in for runs as Arrow-batched functions; a batch without the characters in question is passed through.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from parchwork.functions.dialect import ARABIC, BLANKS

FORMS = re.compile("[\ufb50-\ufdff\ufe70-\ufeff]+")
_ARABIC = re.compile("[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff]")
_NEUTRAL = re.compile("[0-9A-Za-z\\s.,:;!?()\\[\\]{}'\"«»\\-–—/\\\\%*+=<>@#&_]")


def standard(text: str) -> str:
    """Compatibility decomposition and composition of presentation forms only; other compatibility characters stay."""
    return FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)


# Signs that stay in the run in which they stand.
NEUTRAL = f"0-9A-Za-z{BLANKS}.,:;!?()\\[\\]{{}}'\"«»\\-–—/\\\\%*+=<>@#&_"
#: A run of Arabic with the neutral signs behind it, or of anything else.
SCRIPT_RUN = f"{ARABIC}[{ARABIC[1:-1]}{NEUTRAL}]*+|[^{ARABIC[1:-1]}]++"


def script_run_rows(text: Column) -> Column:
    """An array of (text, arabic), the runs of either script in order; together they are the text. Null for null, empty for an empty text."""
    return F.transform(F.regexp_extract_all(text, F.lit(SCRIPT_RUN), F.lit(0)), lambda r: F.struct(r.alias("text"), r.rlike(f"\\A{ARABIC}").alias("arabic")))


def script_runs(text: str) -> list[tuple[str, bool]]:
    """Runs of text and whether they are Arabic. Latin letters, digits and signs belong to the run that they stand in."""
    runs: list[list] = []
    for c in text:
        arabic = bool(_ARABIC.match(c))
        if not arabic and runs and _NEUTRAL.match(c):
            arabic = runs[-1][1]
        if runs and runs[-1][1] == arabic:
            runs[-1][0] += c
        else:
            runs.append([c, arabic])
    return [(t, a) for t, a in runs]


# Signs for commands of formulas.
SIGNS = {
    "langle": "⟨", "rangle": "⟩", "times": "×", "div": "÷", "pm": "±", "le": "≤", "ge": "≥", "ne": "≠", "approx": "≈", "infty": "∞", "theta": "θ", "alpha": "α", "beta": "β", "gamma": "γ",
    "Delta": "Δ", "pi": "π", "therefore": "∴", "because": "∵", "parallel": "//", "cos": "cos", "sin": "sin", "tan": "tan", "quad": "  ", "qquad": "   ",
}


def plain_formula(tex: str) -> str:
    """A formula as plain text: fractions, roots and vectors spelled, commands as signs, `\\|` as two bars; unknown commands go.

    Commands are read whole, so `\\left` isn't taken for `\\le`, and only a written `\\|` becomes bars.
    """
    for pattern, put in (
        (r"\\vec\{(?:\\text\{([^}]+)\}|([^}]+))\}", lambda m: (m[1] or m[2]) + " ⃗"), (r"\\(?:text|mathrm|mathbf)\{([^}]+)\}", r"\1"),
        (r"\\frac\{([^}]+)\}\{([^}]+)\}", r"(\1 ÷ \2)"), (r"\\sqrt\{([^}]+)\}", r"√(\1)"), (r"\\(?:left|right)\\?([(){}\[\]])", r"\1"), (r"\\\|", "||"), (r"\\[;,]", " "),
    ):
        tex = re.sub(pattern, put, tex)
    return re.sub(r"\\([a-zA-Z]+)", lambda m: SIGNS.get(m[1], ""), tex).strip()


_FORMULA = re.compile(r"\$\$[\s\S]*?\$\$|\$[^$\n]+?\$")
_ARABIC_RUN = re.compile("[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff][\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\\s]*")
_TEXT_COMMAND = re.compile(r"(\\text\{[^}]*\})")


def protected_formulas(text: str) -> str:
    """Arabic inside formulas in `\\text{}`, and `//` as a command, so that a renderer shows both; what is already wrapped stays."""

    def formula(m: re.Match) -> str:
        parts = _TEXT_COMMAND.split(m[0])
        for k in range(0, len(parts), 2):
            parts[k] = _ARABIC_RUN.sub(lambda a: "\\text{" + a[0].rstrip() + "}" + a[0][len(a[0].rstrip()) :], parts[k]).replace("//", "\\parallel ")
        return "".join(parts)

    return _FORMULA.sub(formula, text)


def _text_function(f):
    @pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run


def to_standard_arabic(text: Column) -> Column:
    """Of texts without such forms Python gets a null."""
    some = text.rlike("[\ufb50-\ufdff\ufe70-\ufeff]")
    return F.when(some, _text_function(standard)(F.when(some, text))).otherwise(text)


def protect_formulas(text: Column) -> Column:
    some = text.contains("$")
    return F.when(some, _text_function(protected_formulas)(F.when(some, text))).otherwise(text)


def formula_text(text: Column) -> Column:
    return _text_function(plain_formula)(text)
