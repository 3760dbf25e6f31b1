"""Queries for what the other modules leave: counters, guards on whole stages, single functions and small sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.functions import presentation
from parchwork.functions import text as X
from parchwork.functions.dialect import count_sql, quoted, re2, trim
from parchwork.operators import audit, batch, conversion, history, layout, rules, segment
from parchwork.operators.rule_tables import loose
from parchwork.plans.fixtures import CORPUS_SQL, corpus, values_sql
from parchwork.plans.layout_queries import PARTS
from parchwork.plans.session import fresh_path
from parchwork.sources import docx
from parchwork.streaming import settle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Single functions ---------------------------------------------------------------------------------------------------
WORDS = ("درس", "تقوت")
QUERIES["txt06_loose_words"] = lambda spark, sf_dir: corpus(spark, sf_dir).select("doc_id", *(X.count(F.col("text"), loose(w)).alias(f"w{i}") for i, w in enumerate(WORDS)))
SQL["txt06_loose_words"] = f"WITH {CORPUS_SQL} SELECT doc_id, {', '.join(f'{count_sql(chr(116) + chr(101) + chr(120) + chr(116), loose(w))} AS w{i}' for i, w in enumerate(WORDS))} FROM corpus"
QUERIES["fuz01_distances"] = lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("distance"))
SQL["fuz01_distances"] = "SELECT p_partkey, levenshtein(p_name, lower(p_type))::INTEGER AS distance FROM part"


def _formulas(spark, sf_dir: str) -> DataFrame:
    """A formula of each order's keys."""
    a, b = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    fraction, root = F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("} \\times \\pi")), F.concat(F.lit("\\sqrt{"), b, F.lit("} \\le y"))
    tex = F.when(F.col("o_orderkey") % 3 == 0, fraction).when(F.col("o_orderkey") % 3 == 1, root).otherwise(F.concat(F.lit("\\left(z"), a, F.lit("\\right) \\unknown q")))
    return table(spark, sf_dir, "orders").select("o_orderkey", presentation.formula_text(tex).alias("plain"))


QUERIES["snk01g_formulas"] = _formulas
SQL["snk01g_formulas"] = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '(' || o_orderkey || ' ÷ ' || o_custkey || ') × π' WHEN 1 THEN '√(' || o_custkey || ') ≤ y' ELSE '(z' || o_orderkey || ')  q' END AS plain FROM orders"


def script_run_counts(df: DataFrame) -> DataFrame:
    """doc_id, arabic, other: runs of either script, JVM-side: neutral signs belong to the run that they stand in, so a run ends where a letter of the other script begins."""
    letters = F.regexp_replace("text", "[0-9A-Za-z\\s.,:;!?()\\[\\]{}'\"«»\\-–—/\\\\%*+=<>@#&_]", "n")
    marks = F.regexp_replace(F.regexp_replace(letters, X.ARABIC, "ع"), "[^nع]", "x")
    # a neutral keeps the run's script; at the start it is of the other script
    runs = F.regexp_replace(F.concat(F.lit("x"), marks), "(?<=ع)n++", "")
    runs = F.regexp_replace(F.regexp_replace(runs, "n", ""), "(.)\\1++", "$1")
    began = F.when((F.substring(marks, 1, 1) == "ع") | (F.length("text") == 0), F.substring(runs, F.lit(2), F.length(runs))).otherwise(runs)
    return df.select("doc_id", (F.length(began) - F.length(F.replace(began, F.lit("ع"), F.lit("")))).alias("arabic"), (F.length(F.replace(began, F.lit("ع"), F.lit("")))).alias("other"))


QUERIES["snk01d_runs"] = lambda spark, sf_dir: corpus(spark, sf_dir).select("doc_id", F.posexplode(presentation.script_run_rows(F.col("text"))).alias("run_no", "r")).select("doc_id", "run_no", "r.arabic", F.md5("r.text").alias("run"))
SQL["snk01d_runs"] = (
    f"WITH {CORPUS_SQL}, r AS (SELECT doc_id, regexp_extract_all(text, {quoted(re2(presentation.SCRIPT_RUN))}) AS v FROM corpus), u AS (SELECT doc_id, (generate_subscripts(v, 1) - 1)::INTEGER AS run_no, unnest(v) AS run FROM r) "
    f"SELECT doc_id, run_no, regexp_matches(run, {quoted('^' + X.ARABIC)}) AS arabic, md5(run) AS run FROM u"
)
QUERIES["snk01d_script_runs"] = lambda spark, sf_dir: script_run_counts(corpus(spark, sf_dir))

# Stages and guards ---------------------------------------------------------------------------------------------------
# an answer that loses text, one that loses page markers, and one that is taken
_ANSWER = lambda: F.when(F.col("doc_id") % 3 == 0, F.substring(F.col("text"), F.lit(1), F.length("text") * 0.7)).when(F.col("doc_id") % 3 == 1, F.regexp_replace("text", X.MARKER, "")).otherwise(F.concat("text", F.lit("\nchecked")))
QUERIES["g02_guarded_stage"] = lambda spark, sf_dir: audit.contextual(corpus(spark, sf_dir).withColumn("origin", F.lit("recognized")), _ANSWER()).select("doc_id", "text", "contextual_fixed")


def grammar_stage(spark, sf_dir: str) -> DataFrame:
    """Direct and recognised texts, some with an assistant's answer."""
    t = corpus(spark, sf_dir).withColumn("origin", F.when(F.col("doc_id") % 2 == 0, "direct").otherwise("recognized"))
    said = F.expr(f"cast(named_struct('items', array(named_struct('text', left(text, 20), 'completion', 'x', 'reason', cast(null as string), 'confidence', 0.8D)), 'critical', doc_id % 5 = 0, 'abrupt', false, 'verdict', '', 'alert', cast(null as string), 'completed', concat(text, ' end')) as {audit.ASSISTANT})")
    return audit.grammar_stage(t, F.when(F.col("doc_id") % 3 > 0, said))


QUERIES["rul07_grammar_stage"] = grammar_stage
QUERIES["rul08_contextual_stage"] = lambda spark, sf_dir: audit.contextual(corpus(spark, sf_dir).withColumn("origin", F.lit("direct"))).select("doc_id", "text", "contextual_fixed")
QUERIES["str14_structural_stage"] = lambda spark, sf_dir: audit.structured(corpus(spark, sf_dir).withColumn("file_name", F.lit(None).cast("string"))).select("doc_id", "text", "structural_repaired")


def severity_counts(spark, sf_dir: str) -> DataFrame:
    e = rules.audit(corpus(spark, sf_dir)).select(F.explode("errors").alias("e"))
    return e.groupBy("e.subject").agg(F.count(F.when(F.col("e.severity") == "critical", 1)).alias("critical"), F.count(F.when(F.col("e.severity") == "warning", 1)).alias("warnings"))


QUERIES["agg03_severities"] = severity_counts
QUERIES["lay05_rtl_lines"] = lambda spark, sf_dir: segment.lines(segment.pages(corpus(spark, sf_dir))).groupBy("doc_id", "page_no").agg(F.count(F.when(X.is_rtl(F.col("line")), 1)).alias("rtl"))
_A, _L = count_sql("x", X.ARABIC), count_sql("x", X.LATIN)
SQL["lay05_rtl_lines"] = f"WITH {PARTS} SELECT doc_id, page_no, count(*) FILTER ({_A} > 0 AND {_A} >= {_L} * 0.3) AS rtl FROM l GROUP BY ALL"
QUERIES["lay06_last_lines"] = lambda spark, sf_dir: segment.lines(segment.pages(corpus(spark, sf_dir))).groupBy("doc_id", "page_no").agg(F.max(F.when(trim(F.col("line")) != "", F.col("line_no"))).alias("last_line"))
SQL["lay06_last_lines"] = f"WITH {PARTS} SELECT doc_id, page_no, max(line_no) FILTER (t <> '') AS last_line FROM k GROUP BY ALL"
QUERIES["chk03_default_mode"] = lambda spark, sf_dir: table(spark, sf_dir, "part").groupBy(batch.pages_per_chunk(F.expr("p_partkey % 700 + 1")).alias("pages_per_chunk")).agg(F.count("*").alias("n"))
_STEPS, _LAST = batch.CHUNKS[batch.DEFAULT_MODE]
SQL["chk03_default_mode"] = "SELECT CASE " + " ".join(f"WHEN p_partkey % 700 + 1 <= {a} THEN {b}" for a, b in _STEPS) + f" ELSE {_LAST} END AS pages_per_chunk, count(*) AS n FROM part GROUP BY 1"
QUERIES["rul04_completion_found"] = lambda spark, sf_dir: rules.grammar(corpus(spark, sf_dir)).where("confidence = 0.98").select("doc_id", "completion", "cut_text")
QUERIES["fuz05_merged_findings"] = lambda spark, sf_dir: conversion.merged_findings(
    rules.grammar(corpus(spark, sf_dir)).where("cut_text is not null"), corpus(spark, sf_dir).select("doc_id", F.substring("text", 1, 20).alias("cut_text"), F.lit("x").alias("completion"))
)

# Sinks ---------------------------------------------------------------------------------------------------------------


def stored_markdown(spark, sf_dir: str) -> DataFrame:
    """Documents stored as one line each and read back."""
    path = fresh_path(spark, "markdown")
    corpus(spark, sf_dir).select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(path)
    return spark.read.schema("doc_id long, text string").json(path)


QUERIES["snk02_markdown"] = stored_markdown
SQL["snk02_markdown"] = f"WITH {CORPUS_SQL} SELECT doc_id, text FROM corpus"


def word_round_trip(spark, sf_dir: str) -> DataFrame:
    """Documents to Word files and back: the words that come back."""
    made = docx.with_docx(table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[*`|\\[\\]#>$_-]", " ").alias("markdown"), F.lit(False).alias("rtl")))

    def parsed(batches):
        import pyarrow as pa

        for b in batches:
            found = [docx.parse(d) for d in b.column("docx").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(d.plain_text.split()) for d in found], pa.int64())], names=["doc_id", "words"])

    return made.select("doc_id", "docx").mapInArrow(parsed, "doc_id long, words long")


QUERIES["src03_word_round_trip"] = word_round_trip
def _table_rows(spark, sf_dir: str) -> DataFrame:
    """Of each region a table of its nations, with rows of one to three cells and pipes in some."""
    cells = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.concat("n_name", F.lit(" | x")))).when(F.col("n_nationkey") % 3 == 1, F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).otherwise(F.array(F.lit(""), F.col("n_name"), F.lit("a|b")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("cells")))), lambda r: r["cells"]).alias("rows"))


QUERIES["src03d_markdown_tables"] = lambda spark, sf_dir: _table_rows(spark, sf_dir).select("n_regionkey", docx.markdown_tables(F.col("rows")).alias("markdown"))
SQL["src03d_markdown_tables"] = """
WITH r AS (SELECT n_regionkey, n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN [n_name || ' | x'] WHEN 1 THEN [n_nationkey::VARCHAR, n_name] ELSE ['', n_name, 'a|b'] END AS c FROM nation),
w AS (SELECT n_regionkey, max(len(c)) AS w FROM r GROUP BY 1),
l AS (SELECT n_regionkey, list('| ' || array_to_string(list_transform(list_resize(c, w, ''), lambda x: replace(x, '|', chr(92) || '|')), ' | ') || ' |' ORDER BY n_nationkey) AS v, any_value(w) AS w FROM r JOIN w USING (n_regionkey) GROUP BY 1)
SELECT n_regionkey, array_to_string(list_concat(v[1:1], ['| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |'], v[2:]), chr(10)) AS markdown FROM l
"""


def single_pages(spark, sf_dir: str) -> DataFrame:
    """Each image a document of one page, merged in order."""
    images = table(spark, sf_dir, "embeddings")
    return history.merged_pages(images.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("ord")), images.select(F.col("vec_id").alias("doc_id"), F.lit(1).cast("long").alias("page_no"), F.col("label").cast("string").alias("page")))


def settled_chunks(spark, sf_dir: str) -> DataFrame:
    """Turns as chunks of a conversation whose lines are pages; some fail, and the rest is rescued."""
    c = table(spark, sf_dir, "conversations").where("turn >= 0")
    n = c.groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("n_chunks"))
    failed = (F.col("conv_id") * 7 + F.col("turn")) % 11 == 0
    chunks = c.join(n, "conv_id").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), "n_chunks", F.split("text", "\n", -1).alias("pages"), failed.alias("failed"), F.timestamp_seconds("turn").alias("ts"))
    return settle.settled(chunks)


QUERIES["sch06_settled_chunks"] = settled_chunks
SQL["sch06_settled_chunks"] = """
WITH c AS (SELECT conv_id AS doc_id, turn, string_split(text, chr(10)) AS p, (conv_id * 7 + turn) % 11 = 0 AS f FROM conversations WHERE turn >= 0),
g AS (SELECT *, bool_and(NOT f AND turn = no) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS good, max(turn) OVER (PARTITION BY doc_id) + 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS no FROM c)),
s AS (SELECT doc_id, p, coalesce(sum(len(p)) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g WHERE good)
SELECT doc_id, start + generate_subscripts(p, 1) AS page_no, unnest(p) AS page, FALSE AS rescue FROM s
UNION ALL SELECT doc_id, coalesce(sum(len(p)) FILTER (good), 0)::BIGINT + 1, NULL, TRUE FROM g GROUP BY doc_id HAVING count(*) FILTER (good) < max(n)
"""
QUERIES["snk07_single_page"] = single_pages
SQL["snk07_single_page"] = "SELECT row_number() OVER (ORDER BY vec_id) AS merged_no, vec_id AS doc_id, 1::BIGINT AS page_no, label::VARCHAR AS page FROM embeddings"


def isolated_failures(spark, sf_dir: str) -> DataFrame:
    """A function that fails on some rows costs only those."""

    def work(text: str) -> str:
        if "a" in text[:2].lower():
            raise ValueError("no")
        return text[:5]

    return conversion.each_row(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", work, attempts=2, sleep=lambda s: None).select("conv_id", "turn", "status", "error")


QUERIES["sch07_isolated_failures"] = isolated_failures
SQL["sch07_isolated_failures"] = "SELECT conv_id, turn, CASE WHEN contains(lower(substr(text, 1, 2)), 'a') THEN 'failed' ELSE 'done' END AS status, CASE WHEN contains(lower(substr(text, 1, 2)), 'a') THEN 'ValueError: no' END AS error FROM conversations"
_ROUND = lambda: conversion.server_round(F.col("l_linenumber") - 1, F.col("l_quantity") - 20 - F.col("l_tax"), F.col("l_discount") * 5)
QUERIES["sch03_server_rounds"] = lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _ROUND().alias("r")).select("l_orderkey", "l_linenumber", F.round("r.pause", 6).alias("pause"), "r.action", "r.seconds")
SQL["sch03_server_rounds"] = """
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN least(10.0, 1.5 + 1.2 * (l_linenumber - 1) + l_discount * 5) ELSE 0.0 END AS pause, l_quantity - 20 - l_tax AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(pause::DOUBLE, 6) AS pause, CASE WHEN c <= 0 THEN 'send' WHEN greatest(1, ceil(c)) <= 10 THEN 'wait' ELSE 'delegate' END AS action, CASE WHEN c > 0 THEN (greatest(1, ceil(c)) + 1)::INTEGER END AS seconds FROM r
"""


def package_summaries(spark, sf_dir: str) -> DataFrame:
    """The summaries of each customer's orders, taken for documents."""
    o = table(spark, sf_dir, "orders")
    items = o.select(F.col("o_custkey").alias("archive_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("doc.v"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("name"), (F.col("o_orderkey") % 30).alias("pages"), (F.col("o_orderstatus") == "F").alias("done"))
    return conversion.package_summaries(items, F.lit("today"))


QUERIES["snk03_summaries"] = package_summaries
_HEAD = "chr(10) || ".join(f"{quoted(x)} || " for x in (conversion.PACKAGE_RULE, conversion.PACKAGE_HEAD[0], conversion.PACKAGE_HEAD[1] + "today", conversion.PACKAGE_HEAD[2], conversion.PACKAGE_RULE)) + "chr(10) || chr(10)"
_ITEM = f"n || {quoted(conversion.PACKAGE_ITEM[0])} || 'doc.v' || o_orderkey || {quoted(conversion.PACKAGE_ITEM[1])} || p || {quoted(conversion.PACKAGE_ITEM[2])}"
_TOTALS = f"chr(10) || chr(10) || {quoted(conversion.PACKAGE_LINE)} || chr(10) || {quoted(conversion.PACKAGE_TOTALS[0])} || documents || {quoted(conversion.PACKAGE_TOTALS[1])} || chr(10) || {quoted(conversion.PACKAGE_TOTALS[2])} || pages || {quoted(conversion.PACKAGE_TOTALS[3])} || chr(10) || {quoted(conversion.PACKAGE_TOTALS[4])} || chr(10) || {quoted(conversion.PACKAGE_LINE)}"
SQL["snk03_summaries"] = f"""
WITH o AS (SELECT *, o_orderstatus = 'F' AS done, CASE WHEN o_orderkey % 30 > 0 THEN o_orderkey % 30 ELSE 1 END AS p FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM o WHERE done),
a AS (SELECT o_custkey, count(*) FILTER (done) AS documents, coalesce(sum(p) FILTER (done), 0)::BIGINT AS pages, count(*) FILTER (NOT done) AS failed FROM o GROUP BY 1),
l AS (SELECT o_custkey, string_agg({_ITEM}, chr(10) ORDER BY n) AS items FROM r GROUP BY 1)
SELECT o_custkey AS archive_id, documents, pages, failed, CASE WHEN documents > 0 THEN {_HEAD} || items || {_TOTALS} END AS summary FROM a LEFT JOIN l USING (o_custkey)
"""
