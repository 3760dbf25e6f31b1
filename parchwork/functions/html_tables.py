"""HTML tables inside text to markdown tables, and tags away (SNK-1e, SNK-1f)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from parchwork.functions.dialect import rewrite
from parchwork.functions.text import ARTIFACTS, BREAKS, TAGS_UNBOUND

_TABLE = re.compile(r"<table[^>]*>(.*?)</table>", re.IGNORECASE | re.DOTALL)
_ROW = re.compile(r"<tr[^>]*>(.*?)</tr>", re.IGNORECASE | re.DOTALL)
_CELL = re.compile(r"<(?:td|th)[^>]*>(.*?)</(?:td|th)>", re.IGNORECASE | re.DOTALL)


def _markdown(m: re.Match) -> str:
    rows = [[re.sub(r"\r?\n+", " ", re.sub(r"<[^>]+>", "", c)).strip() for c in _CELL.findall(r)] for r in _ROW.findall(m[1])]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n\n" + "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) + "\n\n"


@pandas_udf(T.StringType())
def _tables(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _TABLE.sub(_markdown, t), na_action="ignore")


def tables_to_markdown(text: Column) -> Column:
    """Of texts without a table Python gets a null."""
    some = text.contains("<table")
    return F.when(some, _tables(F.when(some, text))).otherwise(text)


def strip_html(text: Column) -> Column:
    """Tables kept as markdown, then breaks, tags and artifacts away. Here tags have no boundary, so img goes with i."""
    return rewrite(tables_to_markdown(text), [*BREAKS, *TAGS_UNBOUND, *ARTIFACTS])
