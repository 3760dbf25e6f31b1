"""Queries for presentation forms, formats, images and event progress (TXT-1, TXT-29, SNK-1, SRC-3, IMG, SCH-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.functions import html_tables, images, presentation
from parchwork.functions import text as X
from parchwork.functions.dialect import quoted, rewrite, rewrite_sql, trim_sql
from parchwork.operators import conversion
from parchwork.plans.fixtures import CORPUS_SQL, corpus, values_sql
from parchwork.plans.session import spread
from parchwork.sources import docx, pages
from parchwork.streaming import resume

QUERIES: dict = {}
SQL: dict[str, str] = {}

INLINE = "\\$\\$[\\s\\S]*?\\$\\$|\\$[^$\\n]+?\\$|\\*\\*.*?\\*\\*|\\*.*?\\*|`.*?`|\\[\\^[^\\]]+\\]|[^*`$\\[]+"


def inline_tokens(df: DataFrame) -> DataFrame:
    """doc_id, n, token, kind: marked pieces of a text."""
    rows = df.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(INLINE), F.lit(0))).alias("n", "token"))
    t = F.col("token")
    kind = (
        F.when(t.startswith("$$") & t.endswith("$$") & (F.length(t) >= 4), "block_formula").when(t.startswith("$") & t.endswith("$") & (F.length(t) >= 2), "formula")
        .when(t.startswith("**") & t.endswith("**") & (F.length(t) >= 4), "bold").when(t.startswith("*") & t.endswith("*") & (F.length(t) >= 2), "italic").when(t.startswith("`"), "code").when(t.startswith("[^"), "note").otherwise("text")
    )
    return rows.withColumn("kind", kind)


QUERIES["snk01c_inline_tokens"] = lambda spark, sf_dir: inline_tokens(corpus(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("chars"))
SQL["snk01c_inline_tokens"] = (
    f"WITH {CORPUS_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(INLINE)})) AS token FROM corpus), k AS (SELECT *, CASE WHEN starts_with(token, '$$') AND ends_with(token, '$$') AND length(token) >= 4 THEN 'block_formula' WHEN starts_with(token, '$') AND ends_with(token, '$') AND length(token) >= 2 THEN 'formula' "
    "WHEN starts_with(token, '**') AND ends_with(token, '**') AND length(token) >= 4 THEN 'bold' WHEN starts_with(token, '*') AND ends_with(token, '*') AND length(token) >= 2 THEN 'italic' WHEN starts_with(token, '`') THEN 'code' WHEN starts_with(token, '[^') THEN 'note' ELSE 'text' END AS kind FROM t) "
    "SELECT doc_id, kind, count(*) AS n, sum(length(token))::BIGINT AS chars FROM k GROUP BY ALL"
)
_STRIP = [*X.BREAKS, *X.TAGS_UNBOUND, *X.ARTIFACTS]
QUERIES["snk01f_strip_html"] = lambda spark, sf_dir: spread(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", rewrite(F.col("html"), _STRIP).alias("text"))
SQL["snk01f_strip_html"] = f"SELECT page_id, {rewrite_sql('html', _STRIP)} AS text FROM pages"
QUERIES["snk01e_html_tables"] = lambda spark, sf_dir: corpus(spark, sf_dir).select("doc_id", html_tables.strip_html(F.col("text")).alias("text"))
QUERIES["txt01_standard_arabic"] = lambda spark, sf_dir: corpus(spark, sf_dir).select("doc_id", presentation.to_standard_arabic(F.col("text")).alias("text"))
QUERIES["txt29_formulas"] = lambda spark, sf_dir: corpus(spark, sf_dir).select("doc_id", presentation.protect_formulas(F.col("text")).alias("text"))
QUERIES["src03e_page_estimate"] = lambda spark, sf_dir: corpus(spark, sf_dir).select("doc_id", docx.page_estimate(F.col("text")).alias("pages"))
SQL["src03e_page_estimate"] = f"WITH {CORPUS_SQL}, n AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '{X.MARKER}')) AS b FROM corpus) SELECT doc_id, (CASE WHEN b > 0 THEN b + 1 ELSE greatest(1, floor(n / {docx.CHARS_PER_PAGE}.0 + 0.5)) END)::INTEGER AS pages FROM n"


def docx_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every text to a Word document: the size of the archive."""
    made = docx.with_docx(corpus(spark, sf_dir).select("doc_id", F.col("text").alias("markdown"), X.is_rtl(F.col("text")).alias("rtl")))
    return made.select("doc_id", "rtl", F.length("docx").alias("bytes"))


QUERIES["snk01_docx"] = docx_round_trip
QUERIES["agg08_luminance"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", images.luma_of_arrays(F.transform("embedding", lambda x: F.round(x.cast("double") * 255, 3))).alias("l")).select("vec_id", F.round("l.total", 3).alias("total"), "l.least", "l.greatest", images.is_aged(F.col("l.least"), F.col("l.greatest")).alias("aged"))
SQL["agg08_luminance"] = (
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 255, 3)) AS v FROM embeddings) SELECT vec_id, round(list_sum(v), 3) AS total, list_min(v) AS least, list_max(v) AS greatest, list_min(v) > 30 OR list_max(v) < 225 OR list_max(v) - list_min(v) < 170 AS aged FROM v"
)
QUERIES["sch06_event_progress"] = lambda spark, sf_dir: resume.progress(spark.read.parquet(f"{sf_dir}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", "total")
SQL["sch06_event_progress"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL"


def _planned(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"))


QUERIES["sch06_remaining_chunks"] = lambda spark, sf_dir: resume.remaining_chunks(_planned(spark, sf_dir), _planned(spark, sf_dir).where("chunk_index < doc_id % 5"))
SQL["sch06_remaining_chunks"] = "SELECT conv_id AS doc_id, turn AS chunk_index FROM conversations WHERE turn >= conv_id % 5"


def _rescue(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    stopped = pages.where("doc_id % 3 = 0").groupBy("doc_id").agg(F.lit(2).cast("long").alias("start_page"))
    return resume.rescued_pages(pages.select("doc_id", "page_no", F.concat(F.lit("> "), "text").alias("page")), pages.select("doc_id", "page_no", F.col("text").alias("page")), stopped)


QUERIES["sch05_rescued_pages"] = _rescue
SQL["sch05_rescued_pages"] = "SELECT conv_id AS doc_id, turn AS page_no, CASE WHEN conv_id % 3 = 0 AND turn >= 2 THEN text ELSE '> ' || text END AS page FROM conversations"


def _layers(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(F.col("turn") % 3 < 2, F.col("text")).alias("page"))
    return pages.text_layer(turns)


QUERIES["src01_text_layer"] = lambda spark, sf_dir: _layers(spark, sf_dir).select("doc_id", F.length("raw").alias("chars"), "total_pages", "pages_with_text", "digital", "route")
_X = trim_sql("x")
SQL["src01_text_layer"] = (
    "WITH p AS (SELECT conv_id AS doc_id, list(CASE WHEN turn % 3 < 2 THEN coalesce(text, '') ELSE '' END ORDER BY turn) AS ps FROM conversations GROUP BY 1), "
    f"q AS (SELECT doc_id, array_to_string(ps, chr(10) || chr(10) || '{X.MARKER}' || chr(10) || chr(10)) AS raw, len(ps)::INTEGER AS n, len(list_filter(ps, lambda x: {_X} <> ''))::INTEGER AS k FROM p) "
    f"SELECT doc_id, length(raw)::INTEGER AS chars, n AS total_pages, k AS pages_with_text, length(regexp_replace(raw, '[ \\n\\t\\r]+', '', 'g')) > {pages.DIGITAL} AS digital, CASE WHEN k > 0 AND k / n::DOUBLE >= {pages.COVERAGE} THEN 'direct' ELSE 'recognize' END AS route FROM q"
)
QUERIES["src02_uploads"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", pages.decoded(F.concat(F.lit("data:application/pdf;base64,"), F.base64(F.encode("p_name", "UTF-8")))).cast("string").alias("content"))
SQL["src02_uploads"] = "SELECT p_partkey, p_name AS content FROM part"
QUERIES["src09_page_counts"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", pages.page_count(F.when(F.col("p_size") > 5, F.col("p_size"))).alias("pages"))
SQL["src09_page_counts"] = "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size ELSE 1 END AS pages FROM part"
QUERIES["src10_health"] = lambda spark, sf_dir: spark.range(1).select(F.lit("ok").alias("status"))
SQL["src10_health"] = "SELECT 'ok' AS status"
QUERIES["ai02_parts_sent"] = lambda spark, sf_dir: corpus(spark, sf_dir).select("doc_id", F.md5(conversion.context_part(F.col("text"))).alias("head"), F.md5(conversion.grammar_part(F.col("text"))).alias("tail"))
SQL["ai02_parts_sent"] = f"WITH {CORPUS_SQL} SELECT doc_id, md5(substr(text, 1, {conversion.CONTEXT_HEAD})) AS head, md5(substr(text, greatest(1, length(text) - {conversion.GRAMMAR_TAIL - 1}))) AS tail FROM corpus"
QUERIES["ai01_offline_stage"] = lambda spark, sf_dir: conversion.each_row(corpus(spark, sf_dir), "text", None).select("doc_id", F.length("answer").alias("n"), "status")
SQL["ai01_offline_stage"] = f"WITH {CORPUS_SQL} SELECT doc_id, length(text)::INTEGER AS n, 'offline' AS status FROM corpus"
QUERIES["str09_repeated_lines"] = lambda spark, sf_dir: conversion.repeated_lines(corpus(spark, sf_dir))
SQL["str09_repeated_lines"] = (
    f"WITH {CORPUS_SQL}, a AS (SELECT doc_id, string_split(text, chr(10)) AS v FROM corpus), l AS (SELECT doc_id, unnest(v) AS line, generate_subscripts(v, 1)::INTEGER AS line_no FROM a), "
    "b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l WHERE line <> '') SELECT doc_id, line_no, line FROM b WHERE line = before AND length(line) BETWEEN 5 AND 50"
)
CONTENTS: tuple[tuple[int, str], ...] = (
    (1, "# فهرس المحتويات\n| الموضوع | الصفحة |\n|---|---|\n| سورة الملك | 9 |\n| باب (ثان) | 3 |\n\n## الملك\nنص\n---PAGE_BREAK---\n**باب (ثان)** نص\n"), (2, "no table"), (3, "| المكي كذا | |\nx"),
)


def _with_contents(spark, sf_dir: str) -> DataFrame:
    """All documents and texts with a table of contents or a comparison; those have negative ids."""
    own = spark.createDataFrame([(-i, t) for i, t in CONTENTS], "doc_id long, text string")
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).unionByName(own)


_WITH_CONTENTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id::BIGINT, text FROM {values_sql(CONTENTS, 'doc_id, text')})"
QUERIES["str13_contents"] = lambda spark, sf_dir: conversion.calibrated_contents(_with_contents(spark, sf_dir))
SQL["str13_contents"] = f"SELECT doc_id, CASE WHEN doc_id = -1 THEN replace(text, '| سورة الملك | 9 |', '| سورة الملك | 2 |') ELSE text END AS text, CASE WHEN doc_id = -1 THEN 1 ELSE 0 END AS moved FROM {_WITH_CONTENTS}"
QUERIES["str10_comparison"] = lambda spark, sf_dir: _with_contents(spark, sf_dir).select("doc_id", conversion.completed_comparison(F.col("text")).alias("text"))
SQL["str10_comparison"] = f"SELECT doc_id, CASE WHEN doc_id = -3 THEN '| المكي كذا  | {conversion.MADANI} |' || chr(10) || 'x' ELSE text END AS text FROM {_WITH_CONTENTS}"
QUERIES["txt35_date_labels"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", conversion.date_label(F.col("o_orderdate"), F.lit("1995-03-15").cast("date")).alias("label"))
_MONTHS = ", ".join(f"'{m}'" for m in conversion.MONTHS)
SQL["txt35_date_labels"] = (
    f"SELECT o_orderkey, translate(CASE WHEN o_orderdate::DATE = DATE '1995-03-15' THEN '{conversion.TODAY}' ELSE day(o_orderdate) || ' ' || [{_MONTHS}][month(o_orderdate)] || '، ' END "
    f"|| strftime(o_orderdate, '%I:%M') || CASE WHEN hour(o_orderdate) < 12 THEN ' ص' ELSE ' م' END, '0123456789', '{conversion.DIGITS}') AS label FROM orders"
)
QUERIES["snk03_archives"] = lambda spark, sf_dir: conversion.archives(
    spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("archive_id"), F.concat(F.col("turn").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
).select("archive_id", (F.length("zip") > 0).alias("made"))
SQL["snk03_archives"] = "SELECT DISTINCT conv_id AS archive_id, TRUE AS made FROM conversations"


def _rasters(spark, sf_dir: str) -> DataFrame:
    """Embeddings as grey images of one row, the scale of each by its vec_id."""
    grey = F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 64).cast("int") + F.col("vec_id").cast("int") % 200, F.lit(256)))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", grey.alias("grey"))
    data = F.unhex(F.array_join(F.transform("grey", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return rows.select(F.struct(F.col("vec_id").cast("string").alias("origin"), F.lit(1).alias("height"), F.size("grey").alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data")).alias("image"))


QUERIES["img03_aged"] = lambda spark, sf_dir: images.enhance(_rasters(spark, sf_dir)).select("origin", F.round("min_luma", 6).alias("least"), F.round("max_luma", 6).alias("greatest"), "aged")
_GREY = "list_transform(embedding, lambda x: (((floor(x::DOUBLE * 64)::INTEGER + vec_id % 200) % 256) + 256) % 256)"
SQL["img03_aged"] = f"SELECT origin, least::DOUBLE AS least, greatest::DOUBLE AS greatest, least > 30 OR greatest < 225 OR greatest - least < 170 AS aged FROM (SELECT vec_id::VARCHAR AS origin, list_min({_GREY}) AS least, list_max({_GREY}) AS greatest FROM embeddings)"
QUERIES["img04_enhanced"] = lambda spark, sf_dir: images.enhance(_rasters(spark, sf_dir)).select("origin", "width", "data")


def direct_answers(spark, sf_dir: str) -> DataFrame:
    """Conversations as uploads: some without a payload, some with a broken one, some without a text layer."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k = F.col("doc_id") % 7
    payload = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "data:application/pdf;base64,%%%").otherwise(F.concat(F.lit("data:application/pdf;base64,"), F.base64(F.encode(F.col("doc_id").cast("string"), "UTF-8"))))
    uploads = turns.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.concat(F.lit("scan.v"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), payload.alias("payload"))
    layer = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(F.col("conv_id") % 3 > 0, F.col("text")).alias("page"))
    return pages.direct_answers(uploads, layer).drop("markdown")


QUERIES["src02_answers"] = direct_answers
SQL["src02_answers"] = f"""
WITH p AS (SELECT conv_id AS doc_id, count(*)::INTEGER AS n, string_agg(CASE WHEN conv_id % 3 > 0 THEN coalesce(text, '') ELSE '' END, chr(10) || chr(10) || '{X.MARKER}' || chr(10) || chr(10) ORDER BY turn) AS raw FROM conversations GROUP BY 1),
s AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN 400 WHEN 1 THEN 500 ELSE 200 END::INTEGER AS status, length(regexp_replace(raw, '\\s+', '', 'g')) > {pages.DIGITAL} AS digital FROM p),
a AS (SELECT *, status = 200 AND digital AS success FROM s)
SELECT doc_id, status, success, CASE WHEN status = 400 THEN {quoted(pages.NO_PAYLOAD)} WHEN status = 500 THEN {quoted(pages.BROKEN)} WHEN NOT success THEN {quoted(pages.NO_LAYER)} END AS error,
       CASE WHEN success THEN 'scan.v' || doc_id END AS title, CASE WHEN success THEN 'English' END AS language, CASE WHEN success THEN 'ltr' END AS direction, CASE WHEN success THEN FALSE END AS has_arabic,
       CASE WHEN success THEN contains(raw, '|') END AS has_tables, CASE WHEN success THEN n END AS total_pages, CASE WHEN success THEN {quoted(pages.METHOD)} END AS method, CASE WHEN success THEN raw END AS plain_text FROM a
"""
