"""Queries and their SQL for segmentation, layout and structure (LAY, STR-7, STR-9, STR-14, SNK-1 parts, RUL-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.functions import text as X
from parchwork.functions.dialect import BLANKS, S, quoted, rewrite_sql, trim_sql
from parchwork.operators import layout, segment, structural
from parchwork.plans.fixtures import CORPUS_SQL, corpus
from parchwork.plans.text_queries import LINE_RTL, _LINE, _LIST, _TABLE, per_text
from parchwork.plans import text_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}

_FIX = f"CASE WHEN {LINE_RTL} THEN {rewrite_sql('x', X.LINE_PUNCTUATION)} ELSE x END"
_FIX_TRIMMED = _FIX.replace("(x,", f"({_LINE},").replace("ELSE x END", f"ELSE {_LINE} END")
#: pages p, lines l, kinds k, blocks b; tables t with their stable rows.
PARTS = f"""
{CORPUS_SQL},
s AS (SELECT doc_id, regexp_split_to_array(text, '\\n{S}*{X.MARKER}{S}*\\n') AS pages FROM corpus),
p AS (SELECT doc_id, unnest(pages) AS page, generate_subscripts(pages, 1)::INTEGER AS page_no FROM s),
a AS (SELECT doc_id, page_no, string_split(page, chr(10)) AS ls FROM p),
l AS (SELECT doc_id, page_no, unnest(ls) AS x, generate_subscripts(ls, 1)::INTEGER AS line_no FROM a),
k AS (SELECT *, {_TABLE} AS is_table, {_LIST} AS is_list, {_FIX} AS fixed, {_LINE} AS t FROM l),
m AS (SELECT *, is_table AND NOT coalesce(lag(is_table) OVER (PARTITION BY doc_id, page_no ORDER BY line_no), FALSE) AS begins FROM k),
b AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id, page_no ORDER BY line_no)::INTEGER AS block FROM m),
c AS (SELECT *, list_transform(string_split(regexp_replace(regexp_replace(t, '^\\|', ''), '\\|$', ''), '|'), lambda x: {_LINE}) AS cells FROM b WHERE is_table),
r AS (SELECT doc_id, page_no, block, min(line_no) AS line_no, list(cells ORDER BY line_no) AS rs, max(len(cells)) AS width FROM c GROUP BY ALL),
e AS (SELECT *, list_transform(rs, lambda row: len(list_filter(row, lambda y: NOT regexp_matches(y, '^[{BLANKS}:\\-]+$'))) = 0) AS seps FROM r),
v AS (SELECT *, list_transform(rs, lambda row, i: CASE WHEN seps[i] THEN list_resize(['---:'], width, '---:') ELSE list_resize(row, width, '') END) AS even, NOT coalesce(seps[2], FALSE) AS headed,
      len(list_filter(rs, lambda row, i: NOT seps[i] AND len(row) < width)) > 0 AS balanced FROM e),
tb AS (SELECT *, list_transform(CASE WHEN headed THEN list_concat(even[1:1], [list_resize(['---:'], width, '---:')], even[2:]) ELSE even END, lambda row: '| ' || array_to_string(row, ' | ') || ' |') AS lines FROM v)
"""


def _pages(spark, sf_dir: str) -> DataFrame:
    return segment.pages(corpus(spark, sf_dir))


def register(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, f"WITH {PARTS} {sql}"


register("lay01_pages", _pages, "SELECT doc_id, page_no, page FROM p")
register(
    "lay02_table_blocks",
    lambda spark, sf_dir: segment.table_blocks(segment.lines(_pages(spark, sf_dir))).groupBy("doc_id", "page_no", "block").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line")),
    "SELECT doc_id, page_no, block, count(*) AS n, min(line_no) AS first_line FROM b WHERE is_table GROUP BY ALL",
)


def _tables(spark, sf_dir: str) -> DataFrame:
    rows = segment.table_blocks(segment.lines(_pages(spark, sf_dir))).withColumn("cells", layout.cells(F.col("line")))
    grouped = rows.groupBy("doc_id", "page_no", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "cells"))).alias("r"))
    rows = grouped.withColumn("rows", F.transform("r", lambda x: x["cells"])).withColumn("width", layout.width_of(F.col("rows")))
    return rows.withColumn("t", layout.stabilized(F.col("rows"), F.col("width"))).select(
        "doc_id", "page_no", "block", F.array_join("t.lines", "\n").alias("markdown"), F.col("t.columns").alias("columns"), F.col("t.balanced").alias("balanced"), F.col("t.headed").alias("headed")
    )


register("lay03_stable_tables", _tables, "SELECT doc_id, page_no, block, array_to_string(lines, chr(10)) AS markdown, width AS columns, balanced, headed FROM tb")


def _audited(spark, sf_dir: str) -> DataFrame:
    return layout.audit_pages(_pages(spark, sf_dir))


_RTL_FIXED = LINE_RTL.replace("(x,", "(fixed,")
_COUNTS = f"n AS (SELECT doc_id, page_no, count(*) FILTER (is_list AND NOT is_table)::INTEGER AS lists, count(*) FILTER (is_list AND NOT is_table AND {_FIX_TRIMMED} <> t)::INTEGER AS changed, count(*) FILTER (NOT is_list AND NOT is_table AND {_RTL_FIXED})::INTEGER AS rtl_lines FROM b GROUP BY ALL)"
register(
    "lay04_lists", lambda spark, sf_dir: _audited(spark, sf_dir).select("doc_id", "page_no", "lists", F.size("list_issues").alias("changed"), "rtl_lines"), f", {_COUNTS} SELECT * FROM n"
)
_TEXT = f"""g AS (SELECT doc_id, page_no, line_no, CASE WHEN is_list THEN {_FIX_TRIMMED} ELSE fixed END AS x FROM b WHERE NOT is_table
      UNION ALL SELECT doc_id, page_no, line_no, chr(10) || array_to_string(lines, chr(10)) || chr(10) FROM tb),
j AS (SELECT doc_id, page_no, regexp_replace(string_agg(x, chr(10) ORDER BY line_no), '(?:\\n{S}*)+$', '') AS body FROM g GROUP BY ALL),
h AS (SELECT doc_id, page_no, count(*)::INTEGER AS tables, count(*) FILTER (balanced OR headed)::INTEGER AS fixed FROM tb GROUP BY ALL),
q AS (SELECT j.doc_id, j.page_no, body, {trim_sql('body')} AS text, coalesce(tables, 0) AS tables, coalesce(h.fixed, 0) AS tables_fixed, lists, changed, rtl_lines,
      CASE WHEN {trim_sql('body')} = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS n_lines FROM j JOIN n USING (doc_id, page_no) LEFT JOIN h USING (doc_id, page_no)),
w AS (SELECT *, CASE WHEN tables_fixed > 0 OR changed > 0 THEN 'repaired' WHEN n_lines > {layout.CROWDED_LINES} AND tables >= {layout.CROWDED_TABLES} THEN 'warning' ELSE 'perfect' END AS status FROM q)"""
register(
    "lay07_pages_audited", lambda spark, sf_dir: _audited(spark, sf_dir).select("doc_id", "page_no", "text", "tables", "tables_fixed", "status"),
    f", {_COUNTS}, {_TEXT} SELECT doc_id, page_no, text, tables, tables_fixed, status FROM w",
)
register(
    "lay08_roll_up", lambda spark, sf_dir: layout.roll_up(_audited(spark, sf_dir)),
    f", {_COUNTS}, {_TEXT} SELECT doc_id, count(*) AS pages, sum(tables_fixed)::BIGINT AS tables_fixed, sum(changed)::BIGINT AS lists_fixed, sum(rtl_lines)::BIGINT AS rtl_lines, "
    "least(100, greatest(90, floor(100 * count(*) FILTER (status IN ('perfect', 'repaired')) / count(*)::DOUBLE + 0.5)))::INTEGER AS score, bool_and(rtl_lines > 0) AS all_valid FROM w GROUP BY doc_id",
)
register(
    "lay09_rejoined", lambda spark, sf_dir: segment.join_pages(_audited(spark, sf_dir), "text"),
    f", {_COUNTS}, {_TEXT} SELECT doc_id, string_agg(text, chr(10) || chr(10) || '{X.MARKER}' || chr(10) || chr(10) ORDER BY page_no) AS text FROM w GROUP BY doc_id",
)

# Structure -----------------------------------------------------------------------------------------------------
_NUMBERS = "o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, num FROM (SELECT doc_id, unnest(ns)::BIGINT AS num, generate_subscripts(ns, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^[ \\t]*([0-9]+)\\.[ \\t]+', 1) AS ns FROM corpus)))"
QUERIES["str07_numbering_gaps"] = lambda spark, sf_dir: structural.numbering_gaps(corpus(spark, sf_dir))
SQL["str07_numbering_gaps"] = (
    f"WITH {CORPUS_SQL}, {_NUMBERS}, z AS (SELECT *, lag(num) OVER (PARTITION BY doc_id ORDER BY i) AS before, count(*) OVER (PARTITION BY doc_id) AS n FROM o) "
    "SELECT doc_id, i::INTEGER AS position, before, num FROM z WHERE n >= 3 AND before > 0 AND num > 1 AND num > before + 1 AND num - before <= 3"
)
per_text("str14_sections", {"sections": (lambda t: F.greatest(F.lit(1), X.count(t, f"{X.BOL}#{{1,3}}[ \\t]+")), "greatest(1, len(regexp_extract_all(text, '(?m)^#{1,3}[ \\t]+')))::INTEGER")})
_SENTENCE = trim_sql("x")
per_text("rul06_sentences", {"sentences": (
    lambda t: F.size(F.filter(F.split(X.trim(t), "[.؟!;\\n]+", -1), lambda x: F.length(X.trim(x)) > 5)),
    f"len(list_filter(regexp_split_to_array({trim_sql('text')}, '[.؟!;\\n]+'), lambda x: length({_SENTENCE}) > 5))::INTEGER",
)})
_PARTICLE = f"(?:بـ|في|من|إلى|عن|على|مع|أن|لأن|حيث{S}+إن|التي|الذي|الذين|بما{S}+فيها|وهو{S}+أن|كـ){S}*(?:\\.*|…){S}*"
per_text("cls13_hanging_particle", {"hanging": (structural.ends_hanging, f"regexp_matches({trim_sql('text')}, {quoted(_PARTICLE + '$')})")})
per_text("cls14_curriculum_cut", {"cut": (
    structural.is_curriculum_cut,
    f"(contains(text, 'حديث_2ث') AND NOT contains(text, 'الحديث السادس عشر') AND contains(text, '.....')) OR (contains(text, 'فقة_حنفى') AND NOT contains(text, 'باب الإكراه') AND length({trim_sql('text')}) < 8000) OR (contains(text, 'فقة_شافعى') AND contains(text, 'الصادق بـ'))",
)})
_KIND = (
    f"CASE WHEN starts_with({_LINE}, '```') THEN 'fence' WHEN {_TABLE} THEN 'table' WHEN contains({_LINE}, '{X.MARKER}') OR lower({_LINE}) IN ('<!-- pagebreak -->', '<!-- page_break -->', '<!--pagebreak-->') THEN 'page_break' "
    f"WHEN {_LINE} = '' THEN 'blank' WHEN {_LINE} IN ('***', '---', '___') THEN 'rule' WHEN starts_with({_LINE}, '# ') THEN 'h1' WHEN starts_with({_LINE}, '## ') THEN 'h2' WHEN starts_with({_LINE}, '### ') THEN 'h3' WHEN starts_with({_LINE}, '#### ') THEN 'h4' "
    f"WHEN regexp_matches({_LINE}, {quoted(f'^(?:[0-9٠-٩۰-۹]+|[a-zA-Z]|{chr(92)}([^)]+{chr(92)}))(?:[.{chr(92)}-)]{S}+|{S}+-{S}+)[^{chr(92)}n]*$')}) THEN 'numbered' WHEN regexp_matches({_LINE}, '^[-*+]{S}+') THEN 'bullet' WHEN starts_with({_LINE}, '> ') THEN 'quote' ELSE 'paragraph' END"
)
QUERIES["snk01a_block_kinds"] = lambda spark, sf_dir: structural.block_kinds(corpus(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
SQL["snk01a_block_kinds"] = (
    f"WITH {CORPUS_SQL}, ls AS (SELECT doc_id, string_split(text, chr(10)) AS v FROM corpus), ln AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ls), kd AS (SELECT doc_id, i, {_KIND} AS kind FROM ln), "
    "fc AS (SELECT *, sum((kind = 'fence')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM kd) SELECT doc_id, CASE WHEN kind = 'fence' THEN 'fence' WHEN inside THEN 'code' ELSE kind END AS kind, count(*) AS n FROM fc GROUP BY ALL"
)
QUERIES["snk01b_footnotes"] = lambda spark, sf_dir: structural.footnotes(corpus(spark, sf_dir))
SQL["snk01b_footnotes"] = (
    f"WITH {CORPUS_SQL}, f AS (SELECT doc_id, regexp_extract_all(text, '(?m)^\\[\\^([^\\]]+)\\]:{S}*(.*)$', 1) AS refs, regexp_extract_all(text, '(?m)^\\[\\^([^\\]]+)\\]:{S}*(.*)$', 2) AS notes FROM corpus) "
    f"SELECT doc_id, generate_subscripts(refs, 1)::INTEGER AS number, unnest(refs) AS ref, unnest(list_transform(notes, lambda x: {_LINE})) AS note FROM f"
)
for _name in ("str14_sections", "rul06_sentences", "cls13_hanging_particle", "cls14_curriculum_cut"):
    QUERIES[_name], SQL[_name] = text_queries.QUERIES.pop(_name), text_queries.SQL.pop(_name)
