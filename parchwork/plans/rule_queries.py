"""Queries for fuzzy matching, rule engines and the whole audit (FUZ, RUL, STR), with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.functions import text as X
from parchwork.functions.dialect import quoted, trim, trim_sql
from parchwork.operators import audit, fuzzy, rules, structural, structure_report
from parchwork.plans.fixtures import CORPUS_SQL, corpus
from parchwork.plans.session import spread
from parchwork.plans.text_queries import KEY_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _canonical(spark, sf_dir: str) -> DataFrame:
    """The benchmark's items as canonical passages."""
    return rules.keys_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("ord"), "text"))


def _snippets(spark, sf_dir: str) -> DataFrame:
    """Every sentence of the benchmark, each second word of some left out."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(F.split("text", "\\.", -1)).alias("n", "s"))
    words = F.split(trim(F.col("s")), " ")
    return rows.select((F.col("item_id") * 1000 + F.col("n")).alias("snippet_id"), F.array_join(F.filter(words, lambda w, i: i % 5 < 4), " ").alias("text"))


QUERIES["fuz03_best_matches"] = lambda spark, sf_dir: fuzzy.best_matches(_snippets(spark, sf_dir), _canonical(spark, sf_dir)).select("snippet_id", "ord", F.round("score", 9).alias("score"), "whole", "phrase")
_ACCENTED = "éèêëçàâáäñíïîóôöúùûüßœÉÈÊÇÑÍÓÄÖÜÀÁÂ"
_SINGLE = "0123456789#$%&*_=+~<>@^|`-/ZYXWVUTSRQPO"[: len(_ACCENTED)]


def _single(column: str) -> str:
    """DuckDB measures distances in bytes, so accented letters become single ones."""
    return f"translate({column}, '{_ACCENTED}', '{_SINGLE}')"


_SIM = fuzzy.key_similarity_sql(_single("key"), _single("phrase"))
SQL["fuz03_best_matches"] = f"""
WITH b AS (SELECT item_id, text FROM benchmark), p AS (SELECT item_id, string_split(text, '.') AS ps FROM b), q AS (SELECT item_id, unnest(ps) AS s, generate_subscripts(ps, 1) - 1 AS n FROM p),
s AS (SELECT item_id * 1000 + n AS snippet_id, array_to_string(list_filter(string_split({trim_sql('s')}, ' '), lambda w, i: (i - 1) % 5 < 4), ' ') AS text FROM q),
k AS (SELECT snippet_id, {KEY_SQL} AS key FROM s), a AS (SELECT snippet_id, key, len(list_filter(string_split(key, ' '), lambda w: w <> '')) AS words FROM k WHERE length(key) >= 3),
c AS (SELECT item_id AS ord, {KEY_SQL} AS normalized FROM b), d AS (SELECT ord, normalized, list_filter(string_split(normalized, ' '), lambda w: w <> '') AS parts FROM c),
z AS (SELECT snippet_id, key, words, rank, CASE rank WHEN 0 THEN words WHEN 1 THEN words + 1 ELSE greatest(1, words - 1) END AS size FROM a, (VALUES (0), (1), (2)) r(rank)),
y AS (SELECT * FROM z WHERE NOT (words >= 2 AND size < 2) AND NOT (words >= 3 AND size < words - 1)),
w AS (SELECT snippet_id, key, ord, 1 AS kind, rank, i AS at_no, array_to_string(parts[i:i + size - 1], ' ') AS phrase, size = len(parts) AS whole, 0.78 AS least FROM y JOIN d ON words <= len(parts) AND size <= len(parts), unnest(range(1, len(parts) - size + 2)) u(i)
      UNION ALL SELECT snippet_id, key, ord, 0, 0, 0, normalized, TRUE, 0.70 FROM a, d),
g AS (SELECT *, {_SIM} AS score FROM w), h AS (SELECT *, row_number() OVER (PARTITION BY snippet_id ORDER BY score DESC, ord, kind, rank, at_no) AS no FROM g WHERE score >= least)
SELECT snippet_id, ord, round(score, 9) AS score, whole, phrase FROM h WHERE no = 1"""
QUERIES["fuz04_passages"] = lambda spark, sf_dir: fuzzy.passages(corpus(spark, sf_dir))
SQL["fuz04_passages"] = (
    f"WITH {CORPUS_SQL}, f AS (SELECT doc_id, regexp_extract_all(text, '﴿[^﴾]+﴾|«[^»]+»') AS q FROM corpus), g AS (SELECT doc_id, generate_subscripts(q, 1)::INTEGER - 1 AS n, regexp_replace(unnest(q), '[﴿﴾«»]', '', 'g') AS passage FROM f) SELECT * FROM g WHERE length(passage) >= 4"
)
QUERIES["fuz06_accuracy"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", rules.accuracy(F.col("o_orderkey") % 13, F.col("o_orderkey") % 17).alias("accuracy"))
SQL["fuz06_accuracy"] = "SELECT o_orderkey, (CASE WHEN o_orderkey % 13 = 0 THEN 100 ELSE floor((o_orderkey % 13 - o_orderkey % 17) / (o_orderkey % 13)::DOUBLE * 100 + 0.5) END)::INTEGER AS accuracy FROM orders"
QUERIES["fuz07_verification"] = lambda spark, sf_dir: rules.verify(corpus(spark, sf_dir), _canonical(spark, sf_dir))
QUERIES["rul01_audit"] = lambda spark, sf_dir: rules.audit(corpus(spark, sf_dir)).select("doc_id", F.size("errors").alias("errors"), "critical", "warnings", "score", "distorted", "dot_flood", "truncated", "subject", "summary")
QUERIES["rul01_errors"] = lambda spark, sf_dir: rules.audit(corpus(spark, sf_dir)).select("doc_id", F.inline("errors"))
QUERIES["rul02_repair"] = lambda spark, sf_dir: rules.repair(corpus(spark, sf_dir), items="items").withColumn("items", F.transform("items", lambda x: x["ord"]))
QUERIES["rul03_targets"] = lambda spark, sf_dir: rules.repair_targets(corpus(spark, sf_dir)).select("doc_id", "text", F.size("targets").alias("targets"))
QUERIES["rul05_completions"] = lambda spark, sf_dir: corpus(spark, sf_dir).select("doc_id", rules.complete(F.col("text")).alias("text"))
QUERIES["rul06_grammar"] = lambda spark, sf_dir: rules.grammar(corpus(spark, sf_dir))
QUERIES["str03_notes"] = lambda spark, sf_dir: rules.with_notes(corpus(spark, sf_dir))
QUERIES["document_audit"] = lambda spark, sf_dir: audit.audit(corpus(spark, sf_dir))


def clean_by_source(spark, sf_dir: str) -> DataFrame:
    """Documents cleaned and counted by source: one scan, one partial aggregate."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("source", X.plain_text(X.clean_markdown(F.col("text"))).alias("t"))
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("t")).alias("chars"), F.sum(F.size(F.split("t", "\n"))).cast("long").alias("lines"), F.count(F.when(X.is_rtl(F.col("t")), 1)).alias("rtl"))


QUERIES["clean_documents"] = clean_by_source


def _register_clean() -> None:
    from parchwork.functions.dialect import rewrite_sql
    from parchwork.plans.text_queries import CLEAN_SQL, RTL

    plain = trim_sql(rewrite_sql("c", X.PLAIN_P1))
    SQL["clean_documents"] = f"WITH a AS (SELECT source, {CLEAN_SQL} AS c FROM documents), b AS (SELECT source, {plain} AS text FROM a) SELECT source, count(*) AS documents, sum(length(text))::BIGINT AS chars, sum(len(string_split(text, chr(10))))::BIGINT AS lines, count(*) FILTER ({RTL}) AS rtl FROM b GROUP BY source"


_register_clean()


def _untitled(spark, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumn("file_name", F.lit(None).cast("string"))


def structure_reports(spark, sf_dir: str) -> DataFrame:
    """The structural report of every document, its findings aside."""
    r = structure_report.audited(_untitled(spark, sf_dir))
    return r.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), *(F.col(f"structure.{c}").alias(c) for c in ("sections", "total", "missing_headers", "numbering", "footnotes", "repaired", "verdict", "flawed")))


def structure_issues(spark, sf_dir: str) -> DataFrame:
    """Every finding of the structural report, of documents and inline texts."""
    r = structure_report.audited(corpus(spark, sf_dir).withColumn("file_name", F.lit(None).cast("string")))
    # an inner explode asks for non-empty arrays, a condition that would be pushed down through every step's expressions
    return r.select("doc_id", F.posexplode_outer("structure.issues").alias("n", "x")).where("n is not null").select("doc_id", "n", "x.*")


QUERIES["str14_report"], QUERIES["str14_issues"] = structure_reports, structure_issues
# documents have no Arabic letters, so of all findings the missing title and skipped numbers can occur
_FIRST, _WHOLE = "regexp_extract(text, '^[ \\t]*([^\\n#\\-*|]{4,60})', 1)", "regexp_extract(text, '^[ \\t]*[^\\n#\\-*|]{4,60}')"
_NUMBERS = "list_transform(regexp_extract_all(t, '(?m)^[ \\t]*([0-9]+)\\.[ \\t]+', 1), lambda x: x::BIGINT)"
_SAID = f"{quoted(structure_report.VERDICT[0])} || array_to_string(list_filter([{', '.join(f'CASE WHEN {c} > 0 THEN {quoted(a)} || {c} || {quoted(b)} END' for c, (a, b) in zip(('footnotes', 'missing_headers', 'numbering', 'repaired'), structure_report.VERDICT_PARTS, strict=True))}], lambda x: x IS NOT NULL), {quoted(structure_report.COMMA)}) || {quoted(structure_report.VERDICT[1])}"
SQL["str14_report"] = f"""
WITH a AS (SELECT doc_id, text, {trim_sql('text')} = '' AS blank, regexp_matches(text, '(?m)^#[ \\t]+[^\\n#]+') AS titled, {_FIRST} AS f, {_WHOLE} AS w FROM documents),
b AS (SELECT *, CASE WHEN blank OR titled THEN text WHEN length(f) > 5 AND NOT contains(f, '...') THEN '# ' || {trim_sql('f')} || substr(text, length(w) + 1)
                ELSE '# ' || CASE WHEN f <> '' THEN {trim_sql('f')} ELSE {quoted(structural.DEFAULT_TITLE)} END || chr(10) || chr(10) || text END AS t FROM a),
c AS (SELECT *, {_NUMBERS} AS n FROM b),
d AS (SELECT *, CASE WHEN blank OR len(n) < 3 THEN 0 ELSE len(list_filter(range(2, len(n) + 1), lambda i: n[i - 1] > 0 AND n[i] > 1 AND n[i] > n[i - 1] + 1 AND n[i] - n[i - 1] <= 3)) END::INTEGER AS numbering,
             CASE WHEN blank OR titled THEN 0 ELSE 1 END AS missing_headers, 0 AS footnotes FROM c),
e AS (SELECT *, missing_headers AS repaired, missing_headers + numbering AS total FROM d)
SELECT doc_id, split_part(t, chr(10), 1) AS title, CASE WHEN blank THEN 0 ELSE greatest(1, len(regexp_extract_all(t, '(?m)^#{{1,3}}[ \\t]+'))) END::INTEGER AS sections, total, missing_headers, numbering, footnotes, repaired,
       CASE WHEN blank THEN {quoted(structural.EMPTY)} WHEN total > 0 THEN {_SAID} ELSE {quoted(structural.SOUND)} END AS verdict, total > 0 AS flawed FROM e
"""
QUERIES["agg04_fix_totals"] = lambda spark, sf_dir: audit.audit(corpus(spark, sf_dir)).select("doc_id", *audit.COUNTERS, "auto_fixed")
