"""The layout engine: each page's tables, lists and punctuation (LAY-3 to LAY-8).

A page is one value, so the whole engine is a projection over its lines and needs no shuffle. Roll-ups group by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.functions.dialect import BLANKS, END, S, round_half_up, trim
from parchwork.functions.text import is_list_line, is_rtl, is_table_line, line_punctuation

# Messages of the report.
BALANCED = "تمت موازنة خلايا الجدول وتثبيت الأعمدة بعدد ({}) أعمدة متساوية"
HEADED = "إدراج سطر ترويسة الجدول وتثبيت محاذاة اليمين (RTL Columns Locked)"
LISTED = "ضبط ترقيم ومسافة البند: \"{}...\""
CROWDED_LINES, CROWDED_TABLES, LEAST_SCORE = 55, 2, 90
#: Non-characters of Unicode, which no text holds: a table line's start and end, a list item, and what stands between lines.
MARKS = ("\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3")


def cells(line: Column) -> Column:
    """A table line's cells, trimmed, without the outer pipes."""
    t = trim(line)
    t = F.when(t.startswith("|"), F.substring(t, 2, 1 << 30)).otherwise(t)
    t = F.when(t.endswith("|"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.transform(F.split(t, "\\|", -1), trim)


def is_separator(row: Column) -> Column:
    return F.forall(row, lambda c: c.rlike(f"\\A[{BLANKS}:\\-]+{END}"))


def width_of(rows: Column) -> Column:
    return F.array_max(F.transform(rows, F.size))


def stabilized(rows: Column, width: Column) -> Column:
    """Of an array of cell arrays and the cells of its longest row: as many cells in each, separators as `---:`, and one after the first row.

    A struct of lines, columns, balanced (some row was short) and headed (a separator was put in). Both arguments are used for
    each row, so they should be columns, not expressions.
    """
    separator = F.array_repeat(F.lit("---:"), width)
    even = F.transform(rows, lambda r: F.when(is_separator(r), separator).otherwise(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    headless = (F.size(even) < 2) | ~is_separator(F.try_element_at(even, F.lit(2)))
    headless = F.coalesce(headless, F.lit(True))
    full = F.when(headless, F.concat(F.slice(even, 1, 1), F.array(separator), F.slice(even, F.lit(2), F.greatest(F.size(even) - 1, F.lit(0))))).otherwise(even)
    return F.struct(
        F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))).alias("lines"), width.alias("columns"),
        F.exists(rows, lambda r: ~is_separator(r) & (F.size(r) < width)).alias("balanced"), headless.alias("headed"),
    )


def audit_pages(paged: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """The columns `keys`, and of each `page`: text, tables, lists, rtl_lines, table_issues, list_issues, n_lines, status."""
    # lines are marked by kind and joined, and neighbouring table lines become one piece: runs without a fold
    table, ends, item, between = MARKS

    def marked(x: Column) -> Column:
        return F.when(is_table_line(x), F.concat(F.lit(table), x, F.lit(ends))).when(is_list_line(x), F.concat(F.lit(item), x)).otherwise(x)

    joined = F.replace(F.array_join(F.transform(F.split("page", "\n", -1), marked), between), F.lit(ends + between + table), F.lit("\n"))
    pieces = paged.select(*keys, F.split(joined, between, -1).alias("pieces"))
    kind = lambda g: F.when(g.startswith(table), "table").when(g.startswith(item), "list").otherwise("text")
    grouped = pieces.select(*keys, F.transform("pieces", lambda g: F.struct(kind(g).alias("kind"), F.split(F.translate(g, table + ends + item, ""), "\n", -1).alias("lines"))).alias("groups"))
    # cells, then widths, are values of their own before a row asks for them
    grouped = grouped.select(*keys, F.transform("groups", lambda g: F.struct(g["kind"].alias("kind"), g["lines"][0].alias("line"), F.when(g["kind"] == "table", F.transform(g["lines"], cells)).alias("cells"))).alias("groups"))
    grouped = grouped.select(*keys, F.transform("groups", lambda g: F.struct(g["kind"].alias("kind"), g["line"].alias("line"), g["cells"].alias("cells"), width_of(g["cells"]).alias("width"), F.when(g["kind"] == "list", trim(g["line"])).otherwise(g["line"]).alias("plain"))).alias("groups"))
    none = F.expr("cast(null as struct<lines: array<string>, columns: int, balanced: boolean, headed: boolean>)")
    made = F.transform(
        "groups",
        lambda g: F.struct(
            g["kind"].alias("kind"), g["plain"].alias("plain"), F.when(g["kind"] == "table", stabilized(g["cells"], g["width"])).otherwise(none).alias("table"),
            F.when(g["kind"] != "table", line_punctuation(g["plain"])).alias("fixed"),
        ),
    )
    blank = F.array(F.lit(""))
    built = grouped.select(*keys, made.alias("m"))
    tables, lists = F.filter("m", lambda g: g["kind"] == "table"), F.filter("m", lambda g: g["kind"] == "list")
    issues = F.flatten(F.transform(tables, lambda g: F.filter(F.array(
        F.when(g["table"]["balanced"], F.concat(F.lit(BALANCED.split("{}")[0]), g["table"]["columns"].cast("string"), F.lit(BALANCED.split("{}")[1]))), F.when(g["table"]["headed"], F.lit(HEADED)),
    ), lambda x: x.isNotNull())))
    changed = F.filter(lists, lambda g: g["fixed"] != g["plain"])
    listed = F.transform(changed, lambda g: F.concat(F.lit(LISTED.split("{}")[0]), F.substring(g["plain"], 1, 25), F.lit(LISTED.split("{}")[1])))
    out = F.flatten(F.transform("m", lambda g: F.when(g["kind"] == "table", F.concat(blank, g["table"]["lines"], blank)).otherwise(F.array(g["fixed"]))))
    kept = F.regexp_replace(F.array_join(out, "\n"), f"(?:\\n{S}*+)++\\z|\\A{S}*+\\z", "")
    report = built.select(
        *keys, kept.alias("body"), F.size(tables).alias("tables"), F.size(lists).alias("lists"),
        F.size(F.filter("m", lambda g: (g["kind"] == "text") & is_rtl(g["fixed"]))).alias("rtl_lines"), issues.alias("table_issues"), listed.alias("list_issues"),
        F.size(F.filter(tables, lambda g: g["table"]["balanced"] | g["table"]["headed"])).alias("tables_fixed"),
    )
    n_lines = F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n", -1)))
    crowded = (F.col("n_lines") > CROWDED_LINES) & (F.col("tables") >= CROWDED_TABLES)
    status = F.when((F.size("table_issues") > 0) | (F.size("list_issues") > 0), "repaired").when(crowded, "warning").otherwise("perfect")
    return report.withColumn("n_lines", n_lines).select(*keys, trim(F.col("body")).alias("text"), "tables", "lists", "rtl_lines", "table_issues", "list_issues", "tables_fixed", "n_lines", status.alias("status"))


def roll_up(audited: DataFrame) -> DataFrame:
    """A document's pages, fixed tables and lists, right-to-left lines, score (from 90 to 100), and whether each page has a right-to-left line."""
    good = F.sum(F.col("status").isin("perfect", "repaired").cast("int"))
    score = F.least(F.lit(100), F.greatest(F.lit(LEAST_SCORE), round_half_up(100 * good / F.count("*"))))
    return audited.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("tables_fixed").alias("tables_fixed"), F.sum(F.size("list_issues")).alias("lists_fixed"), F.sum("rtl_lines").alias("rtl_lines"),
        score.cast("int").alias("score"), F.bool_and(F.col("rtl_lines") > 0).alias("all_valid"),
    )
