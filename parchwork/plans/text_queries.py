"""Queries and their SQL for text normalisation, classification and guards (TXT, CLS, G, ERR, SRC predicates)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.functions import text as X
from parchwork.functions.dialect import ARABIC, BLANKS, LATIN, S, count_sql, quoted, re2, rewrite, rewrite_sql, trim, trim_sql
from parchwork.plans.fixtures import CORPUS_SQL, FILES, PAIRS, corpus, dealt, dealt_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def per_text(name: str, columns: dict[str, tuple[Callable[[Column], Column], str]], only: Callable[[Column], Column] | None = None, only_sql: str = "TRUE") -> None:
    """A query with a row for each text of the corpus; `columns`: expression and SQL over `text`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = corpus(spark, sf_dir)
        rows = rows if only is None else rows.where(only(F.col("text")))
        return rows.select("doc_id", *(f(F.col("text")).alias(c) for c, (f, _) in columns.items()))

    QUERIES[name] = run
    SQL[name] = f"WITH {CORPUS_SQL} SELECT doc_id, {', '.join(f'{sql} AS {c}' for c, (_, sql) in columns.items())} FROM corpus WHERE {only_sql}"


def steps(name: str, used: list, column: str = "cleaned") -> None:
    per_text(name, {column: (lambda t: rewrite(t, used), rewrite_sql("text", used))})


def matches(expression: str, pattern: str) -> str:
    return f"regexp_matches({expression}, {quoted(re2(pattern))})"


A, L = count_sql("text", ARABIC), count_sql("text", LATIN)
RTL = f"({A} > 0 AND {A} >= {L} * 0.3)"
per_text("txt02_arabic_count", {"n": (X.arabic_count, A)})
per_text("txt03_latin_count", {"n": (X.latin_count, L)})
per_text("txt04_has_arabic", {"found": (X.has_arabic, matches("text", ARABIC))})
steps("txt05_consonant_spine", X.SPINE, "spine")
per_text("txt07_haraka", {
    "has_haraka": (X.has_haraka, matches("text", "[ؐ-ٰٟ]")),
    "problem_at": (X.haraka_order_problem, "CASE WHEN " + matches("text", "ّ[ً-ْٰ]") + " THEN length(regexp_extract(text, '(?s)^(.*?)ّ[ً-ْٰ]', 1))::INTEGER END"),
})
KEY_SQL = trim_sql(rewrite_sql("text", X.KEY))
per_text("txt08_search_key", {"key": (X.search_key, KEY_SQL)})
steps("txt09_page_markers", X.MARKERS)
steps("txt10_breaks", X.BREAKS)
TAGS_SQL = "regexp_replace({}, '(?i)</?(?:span|div|p|b|strong|em|i)(?:>|[" + BLANKS + "/][^>]*>)', '', 'g')"
steps("txt11_tags", X.TAGS)
steps("txt12_page_numbers", X.PAGE_NUMBERS)


def notes_sql(expression: str) -> str:
    parts = f"regexp_split_to_array({expression}, {quoted(re2(X.STRAY_NOTE))})"
    return f"list_reduce(list_prepend('', list_transform({parts}, lambda p, i: CASE WHEN i = 1 THEN p ELSE '[^' || (i - 1)::VARCHAR || ']' || p END)), lambda a, b: a || b)"


per_text("txt13_stray_notes", {"cleaned": (X.number_stray_notes, notes_sql("text"))})
steps("txt14_artifacts", X.ARTIFACTS)
steps("txt15_spacing", X.SPACING)
steps("txt16_rules", X.RULES)
steps("txt17_dots", X.DOTS)
steps("txt18_curriculum", X.CURRICULUM)
CLEAN_SQL = trim_sql(rewrite_sql(notes_sql(rewrite_sql("text", [*X.MARKERS, *X.BREAKS, *X.TAGS, *X.PAGE_NUMBERS])), [*X.ARTIFACTS, *X.SPACING, *X.RULES, *X.DOTS, *X.CURRICULUM]))
per_text("txt19_clean_markdown", {"cleaned": (X.clean_markdown, CLEAN_SQL)})
per_text("txt20_sanitize_chunk", {
    "cleaned": (X.sanitize_chunk, rewrite_sql("text", [*X.DOTS, *X.BREAKS, *X.TAGS])), "plain": (lambda t: rewrite(t, X.DOTS_SHORT), rewrite_sql("text", X.DOTS_SHORT)),
})
per_text("txt21_plain_text", {"plain": (X.plain_text, trim_sql(rewrite_sql("text", X.PLAIN_P1)))})
PLAIN_P2 = [X.PLAIN_P4[0], X.PLAIN_P1[3], X.PLAIN_P1[4], X.PLAIN_P1[5], X.Step("`[^`]+`", ""), X.PLAIN_P1[7]]
steps("txt22_plain_text_saved", PLAIN_P2, "plain")
steps("txt23_plain_text_headings", X.PLAIN_P3, "plain")
steps("txt24_plain_text_unanchored", X.PLAIN_P4, "plain")
T_SQL = trim_sql("text")
_FENCED, _INNER = trim_sql(f"regexp_replace(regexp_replace({T_SQL}, '(?i)^```markdown{S}*', ''), '```{S}*$', '')"), trim_sql(f"regexp_replace(regexp_replace({T_SQL}, '(?i)^```[a-z]*{S}*', ''), '```{S}*$', '')")
_JSON = "CASE WHEN json_valid({0}) THEN coalesce(json_extract_string({0}, '$.markdown'), {0}) ELSE {0} END"
per_text("txt25_unwrap_answer", {"markdown": (X.unwrap_answer, f"CASE WHEN starts_with({T_SQL}, '```markdown') THEN {_FENCED} WHEN starts_with({T_SQL}, '```') AND ends_with({T_SQL}, '```') THEN {_JSON.format(_INNER)} WHEN starts_with({T_SQL}, '{{') AND ends_with({T_SQL}, '}}') THEN {_JSON.format(T_SQL)} ELSE {T_SQL} END")})
HEAD_28, QUESTION_28 = "(?iu)\\A(?:Unit|Chapter|Lesson|PART|MODULE)(?![A-Za-z0-9_])", f"(?iu)\\A(?:س{S}*[0-9]+|السؤال{S}+(?:الأول|الثاني|الثالث|الرابع|الخامس)|[0-9]+[.\\-)]){S}+"


def promoted(line: Column) -> Column:
    """Keyword lines become headings. The boundary is the ASCII one, so Arabic keywords before a blank don't count."""
    t = trim(line)
    return F.when(t == "", "").when(t.rlike(HEAD_28), F.concat(F.lit("## "), t)).when(t.rlike(QUESTION_28), F.concat(F.lit("\n### "), t)).otherwise(t)


_LINE = trim_sql("x")
per_text("txt28_promote_headings", {"markdown": (
    lambda t: F.array_join(F.transform(F.split(t, "\n", -1), promoted), "\n"),
    f"array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN {_LINE} = '' THEN '' WHEN regexp_matches({_LINE}, '(?i)^(?:Unit|Chapter|Lesson|PART|MODULE)(?:$|[^A-Za-z0-9_])') THEN '## ' || {_LINE} "
    f"WHEN regexp_matches({_LINE}, {quoted(QUESTION_28.replace('(?iu)', '(?i)').replace(chr(92) + 'A', '^'))}) THEN chr(10) || '### ' || {_LINE} ELSE {_LINE} END), chr(10))",
)})
_STRIPPED = f"regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: {_LINE} <> '{X.ORIGIN}'), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+', '')"
per_text("txt30_origin", {
    "marked": (X.mark_origin, f"CASE WHEN text = '' OR starts_with(text, '{X.ORIGIN}') THEN text ELSE '{X.ORIGIN}' || chr(10) || text END"),
    "direct": (X.has_origin, f"starts_with(text, '{X.ORIGIN}')"), "stripped": (X.strip_origin, f"CASE WHEN contains(text, '{X.ORIGIN}') THEN {_STRIPPED} ELSE text END"),
})
steps("txt31_brackets", X.NESTED_BRACKETS)
LINE_RTL = RTL.replace("text", "x")
per_text("txt32_arabic_punctuation", {"fixed": (
    lambda t: F.array_join(F.transform(F.split(t, "\n", -1), X.line_punctuation), "\n"),
    f"array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN {LINE_RTL} THEN {rewrite_sql('x', X.LINE_PUNCTUATION)} ELSE x END), chr(10))",
)})
per_text("cls01_rtl", {"rtl": (X.is_rtl, RTL)})
per_text("cls02_rtl_absolute", {"rtl": (X.is_rtl_absolute, count_sql("text", "[؀-ۿ]") + " > 20")})
PREFERRED = f"({A} >= {L} * 0.4)"
per_text("cls03_rtl_preferred", {
    "auto": (lambda t: X.is_rtl_preferred(t, F.lit("auto")), PREFERRED), "ltr": (lambda t: X.is_rtl_preferred(t, F.lit("ltr")), "FALSE"), "rtl": (lambda t: X.is_rtl_preferred(t, F.lit("rtl")), "TRUE"),
})
per_text("cls04_language", {"label": (lambda t: X.language_label(t, F.lit("auto")), f"CASE WHEN {A} > 10 AND {L} > 10 THEN 'Arabic & English' WHEN {PREFERRED} THEN 'Arabic' ELSE 'English' END")})
per_text("cls05_flags", {"math": (X.has_math, matches("text", "\\$|\\\\frac|\\\\sqrt|\\\\vec")), "tables": (X.has_table, "contains(text, '|')"), "arabic": (lambda t: X.arabic_count(t) > 5, f"{A} > 5")})
_HEADING = trim_sql(f"regexp_replace(regexp_extract(text, '(?m)^#+{S}+([^\\n\\r  ]+)', 1), '[*_#`]', '', 'g')")
per_text("cls06_title", {"title": (lambda t: X.title(t, F.lit("my book (pages 1-9).pdf")), f"CASE WHEN length({_HEADING}) > 2 AND length({_HEADING}) < 80 THEN {_HEADING} ELSE 'my book' END")})
_TABLE = f"((starts_with({_LINE}, '|') AND length({_LINE}) > 1 AND contains(substr({_LINE}, 2), '|')) OR (len(regexp_extract_all({_LINE}, '\\|')) >= 2 AND NOT starts_with({_LINE}, '#')))"
_NUMBERED = f"^(?:[0-9٠-٩]+|[a-zA-Z]|\\([^)]+\\))(?:[.\\-)]{S}+|{S}+-{S}+)[^\\n]*$"
_LIST = f"(regexp_matches({_LINE}, {quoted(_NUMBERED)}) OR regexp_matches({_LINE}, '^[-*+]{S}+'))"
for name, f, sql in (("cls07_table_lines", X.is_table_line, _TABLE), ("cls08_list_lines", X.is_list_line, _LIST)):
    per_text(name, {"n": (
        lambda t, f=f: F.size(F.filter(F.split(t, "\n", -1), f)), f"len(list_filter(string_split(text, chr(10)), lambda x: {sql}))::INTEGER",
    )})
per_text("cls09_recovered_pages", {"pages": (
    lambda t: F.size(F.filter(F.split(t, X.MARKER, -1), lambda p: trim(p) != "")), f"len(list_filter(string_split(text, '{X.MARKER}'), lambda x: {_LINE} <> ''))::INTEGER",
)})
_RECOVERED = f"len(list_filter(string_split(text, '{X.MARKER}'), lambda x: {_LINE} <> ''))"
per_text("cls10_coverage_gate", {"route": (
    lambda t: F.when((F.size(F.filter(F.split(t, X.MARKER, -1), lambda p: trim(p) != "")) > 0) & (F.size(F.filter(F.split(t, X.MARKER, -1), lambda p: trim(p) != "")) / F.lit(2) >= 0.6), "direct").otherwise("recognize"),
    f"CASE WHEN {_RECOVERED} > 0 AND {_RECOVERED} / 2.0 >= 0.6 THEN 'direct' ELSE 'recognize' END",
)})
per_text("cls11_damage", {
    "dot_flood": (X.has_dot_flood, "regexp_matches(text, '(?:\\.{12,}[ \\t]*){2,}|\\.{30,}')"),
    "truncated": (X.has_truncation, "contains(text, 'الصادق بـ') OR (contains(text, 'حديث_2ث') AND NOT contains(text, 'الحديث السادس عشر')) OR (contains(text, 'فقة_حنفى') AND NOT contains(text, 'باب الإقالة')) OR (contains(text, 'فقة_شافعى') AND NOT contains(text, 'كتاب البيوع'))"),
})
per_text("cls12_subject", {"subject": (X.subject, "CASE WHEN contains(text, 'سورة الملك') OR contains(text, 'تفسير') THEN 'تفسير سورة الملك' WHEN contains(text, 'حديث') OR contains(text, 'الحديث الأول') THEN 'الحديث الشريف' WHEN contains(text, 'حنفى') OR contains(text, 'القدوري') OR contains(text, 'الإقالة') THEN 'الفقه الحنفي' WHEN contains(text, 'شافعى') OR contains(text, 'محرمات الإحرام') THEN 'الفقه الشافعي' ELSE 'أزهري عام' END")})

# Guards: the rewrite is the text without its last part, of a size that depends on the row.
_AFTER = "substr(text, 1, (length(text) * (70 + doc_id % 30) / 100)::BIGINT)"


def cut(t: Column) -> Column:
    return F.substring(t, F.lit(1), F.expr("cast(length(text) * (70 + doc_id % 30) / 100 as decimal(20,4))").cast("double").cast("decimal(20,0)").cast("int"))


for name, f, least, share in (("g01_guard_client", X.guard_client, 5000, 0.8), ("g03_guard_server", X.guard_server, 8000, 0.75)):
    per_text(name, {"n_chars": (lambda t, f=f: F.length(f(t, F.substring(t, F.lit(1), F.expr("cast((length(text) * (70 + doc_id % 30)) div 100 as int)")))), f"CASE WHEN length(text) > {least} AND (length(text) * (70 + doc_id % 30)) // 100 < length(text) * {share} THEN length(text) ELSE (length(text) * (70 + doc_id % 30)) // 100 END::INTEGER")})
# every second rewrite loses its markers, the others grow
per_text("g04_guard_pages", {"n_chars": (
    lambda t: F.length(X.guard_pages(t, F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(t, X.MARKER, "")).otherwise(F.concat(t, F.lit("x"))))),
    "(length(text) + doc_id % 2)::INTEGER",
)})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each page: page_id, name, mime, size."""
    rows = dealt(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id"), "page_id", FILES, ("ending", "mime", "least"))
    return rows.select("page_id", F.concat(F.col("page_id").cast("string"), F.lit("_"), F.col("ending")).alias("name"), "mime", (F.col("least") + F.col("page_id") % 50).cast("long").alias("size"))


_FILES = f"(SELECT page_id, page_id || '_' || ending AS name, mime, (least + page_id % 50)::BIGINT AS size FROM {dealt_sql('pages', 'page_id', FILES, ('ending', 'mime', 'least'))})"


def per_file(name: str, columns: dict[str, tuple[Callable[[Column, Column], Column], str]]) -> None:
    """A query with a row for each file; `columns`: expression of name and type, and SQL."""
    QUERIES[name] = lambda spark, sf_dir: files(spark, sf_dir).select("page_id", "name", *(f(F.col("name"), F.col("mime")).alias(c) for c, (f, _) in columns.items()))
    SQL[name] = f"SELECT page_id, name, {', '.join(f'{sql} AS {c}' for c, (_, sql) in columns.items())} FROM {_FILES}"


_LOW = "lower(name)"
_IMAGE = f"(starts_with(mime, 'image/') OR regexp_matches({_LOW}, '\\.(?:png|jpe?g|bmp|webp|gif|{{}})$'))"


per_file("src05_file_kind", {
    "kind": (X.file_kind, f"CASE WHEN ends_with({_LOW}, '.pdf') OR mime = 'application/pdf' THEN 'pdf' WHEN {_IMAGE.format('svg')} THEN 'image' WHEN regexp_matches({_LOW}, '\\.docx?$') OR contains(mime, 'word') OR contains(mime, 'officedocument') THEN 'word' END"),
    "image": (X.is_image_file, _IMAGE.format("tiff?")),
})
per_file("txt26_base_names", {
    c: (lambda n, m, used=used: rewrite(n, used), rewrite_sql("name", used))
    for c, used in (("any_suffix", [X.ANY_SUFFIX]), ("pdf", [X.PDF_SUFFIX]), ("docx", [X.DOCX_SUFFIX]), ("download", X.DOWNLOAD_SUFFIX), ("without_pages", [X.ANY_SUFFIX, X.PAGE_RANGE]))
})
URLS = (("data:application/pdf;base64,",), ("data:image/png;base64,",), ("",), ("data:,",))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as the payload of a URL."""
    rows = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", URLS, ("head",))
    return rows.select("doc_id", F.concat("head", F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("url"))


QUERIES["txt27_data_urls"] = lambda spark, sf_dir: _urls(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(X.data_url_payload(F.col("url")), "\\s", "")).alias("payload"), X.data_url_mime(F.col("url")).alias("mime"))
SQL["txt27_data_urls"] = f"WITH u AS (SELECT doc_id, head || base64(encode(coalesce(text, ''))) AS url FROM {dealt_sql('documents', 'doc_id', URLS, ('head',))}) SELECT doc_id, md5(regexp_replace(url, '^data:[^;,]*(?:;[^,]*)?,', '')) AS payload, CASE WHEN regexp_matches(url, '^data:[^;,]+') THEN regexp_extract(url, '^data:([^;,]+)', 1) END AS mime FROM u"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which some come twice, without those whose name and size are in the queue already."""
    every = files(spark, sf_dir)
    return every.unionByName(every.where("size > 100")).join(every.where("size % 20 = 0").select("name", "size"), ["name", "size"], "left_anti").select("name", "size")


QUERIES["src06_queue_dedupe"] = _queue
SQL["src06_queue_dedupe"] = f"WITH f AS {_FILES} SELECT name, size FROM (SELECT * FROM f UNION ALL SELECT * FROM f WHERE size > 100) WHERE (name, size) NOT IN (SELECT (name, size) FROM f WHERE size % 20 = 0)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 7919 - 5).alias("n"))


QUERIES["txt33_format_bytes"] = lambda spark, sf_dir: sizes(spark, sf_dir).select("o_orderkey", X.format_bytes(F.col("n")).alias("shown"))
_UNIT = "least(greatest(floor(ln(n) / ln(1024.0)), 0), 4)"
SQL["txt33_format_bytes"] = f"SELECT o_orderkey, CASE WHEN n > 0 THEN regexp_replace(printf('%.1f', n / pow(1024.0, {_UNIT})), '\\.0$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][{_UNIT}::INTEGER + 1] ELSE '0 B' END AS shown FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 7919 - 5)::DOUBLE AS n FROM orders)"
QUERIES["txt34_format_duration"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", X.format_duration((F.col("o_orderkey") % 9000) / F.lit(1.5) - 2).alias("shown"))
_REST = "floor(s - floor(s / 60) * 60 + 0.5)::BIGINT"
_TAIL = f"CASE WHEN {_REST} > 0 THEN ' و ' || {_REST} || ' ثانية' ELSE '' END"
SQL["txt34_format_duration"] = (
    "SELECT o_orderkey, CASE WHEN s <= 0 THEN 'لحظات قليلة...' WHEN s < 6 THEN 'أقل من 5 ثوانٍ' WHEN s < 60 THEN 'حوالي ' || floor(s + 0.5)::BIGINT || ' ثانية' "
    f"WHEN m = 1 THEN CASE WHEN {_REST} > 0 THEN 'حوالي دقيقة' || {_TAIL} ELSE 'حوالي دقيقة واحدة' END WHEN m = 2 THEN 'حوالي دقيقتين' || {_TAIL} WHEN m <= 10 THEN 'حوالي ' || m || ' دقائق' || {_TAIL} WHEN m < 60 THEN 'حوالي ' || m || ' دقيقة' || {_TAIL} "
    "ELSE 'حوالي ' || m // 60 || ' ساعة و ' || m % 60 || ' دقيقة' END AS shown FROM (SELECT *, floor(s / 60)::BIGINT AS m FROM (SELECT o_orderkey, (o_orderkey % 9000) / 1.5 - 2 AS s FROM orders))"
)


def similarity(a: Column, b: Column) -> Column:
    from parchwork.operators.fuzzy import key_similarity

    return key_similarity(X.search_key(a), X.search_key(b))


def similarity_sql(a: str, b: str) -> str:
    from parchwork.operators.fuzzy import key_similarity_sql

    # DuckDB measures distances in bytes, so letters become single ones
    letters = "ابتثجحخدذرزسشصضطظعغفقكلمنهويءؤئ"
    single = "ABCDEFGHIJKLMNOPQRSTUVWXYZ01234"

    def key(x: str) -> str:
        return f"translate({KEY_SQL.replace('text', x)}, '{letters}', '{single}')"

    return key_similarity_sql(key(a), key(b))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of phrases for each part, with the part's name in both."""
    rows = dealt(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", PAIRS, ("x", "y"))
    return rows.select("p_partkey", F.concat_ws(" ", "x", "p_name").alias("a"), F.concat_ws(" ", "p_name", "y").alias("b"))


QUERIES["fuz02_pairs"] = lambda spark, sf_dir: _pairs(spark, sf_dir).select("p_partkey", F.round(similarity(F.col("a"), F.col("b")), 9).alias("score"))
SQL["fuz02_pairs"] = f"SELECT p_partkey, round({similarity_sql('a', 'b')}, 9) AS score FROM (SELECT p_partkey, x || ' ' || p_name AS a, p_name || ' ' || y AS b FROM {dealt_sql('part', 'p_partkey', PAIRS, ('x', 'y'))})"
