"""The document audit: contextual, grammar, structural, verification and layout stages in a row (the flagship query).

A document is a row and stays one; each stage is a projection over it, and what a stage reports is a column. Only documents
that hold a page marker are taken apart into pages and put together again, by a key of their row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.functions import text as X
from parchwork.functions.dialect import rewrite
from parchwork.operators import layout, rules, segment, structure_report

#: What stages count, in their order; a document's total is their sum.
COUNTERS = ("contextual_fixed", "truncated_items", "structural_repaired", "verses_corrected", "tables_fixed", "lists_fixed")


def contextual(df: DataFrame, assistant: Column | None = None) -> DataFrame:
    """Rules, then an assistant's answer if there is one and it loses nothing; text read directly is not sent to one."""
    out = rules.repair(df, counter="contextual_fixed")
    if assistant is not None:
        answer = X.guard_pages(F.col("text"), X.guard_client(F.col("text"), assistant))
        out = rules.repair(out.withColumn("text", F.when(F.col("origin") == "direct", F.col("text")).otherwise(answer)), counter="__again").withColumn("contextual_fixed", F.col("contextual_fixed") + F.col("__again")).drop("__again")
    return out


def completed(df: DataFrame) -> DataFrame:
    """Known cuts counted, and completed in recognised text; text read directly is complete."""
    out = df.withColumns({"truncated_items": rules.truncated(F.col("text")), "__done": rules.complete(F.col("text"))})
    kept = X.guard_pages(F.col("text"), F.col("__done"))
    return out.withColumn("text", F.when(F.col("origin") == "direct", F.col("text")).otherwise(kept)).drop("__done")


#: What an assistant says about a text's grammar; each part may be null.
ASSISTANT = "struct<items:array<struct<text:string,completion:string,reason:string,confidence:double>>,critical:boolean,abrupt:boolean,verdict:string,alert:string,completed:string>"
# Of an assistant's finding without a reason or confidence.
ASSISTANT_REASON, ASSISTANT_CONFIDENCE = "توقع نحوي عبر الذكاء الاصطناعي", 0.9


# The verdict that stands for an answer that failed.
FAILED_VERDICT = "تم فحص القواعد النحوية محلياً"


def clean_report() -> Column:
    """What counts as an assistant's answer where the call failed: no finding, and nothing completed."""
    return F.from_json(F.lit(json.dumps({"items": [], "critical": False, "abrupt": False, "verdict": FAILED_VERDICT}, ensure_ascii=False)), ASSISTANT)


def answered(answer: Column, failed: Column) -> Column:
    """An answer of type ASSISTANT, or the clean report where the call failed or its answer can't be read (null)."""
    return F.when(F.coalesce(failed, F.lit(False)) | answer.isNull(), clean_report()).otherwise(answer)


def grammar_stage(df: DataFrame, assistant: Column | None = None) -> DataFrame:
    """doc_id, text, sentences, items, critical, abrupt, verdict and alert: cuts found, and known ones completed in recognised text.

    `df` has doc_id, text and origin. `assistant` is an answer of type ASSISTANT, null where none was asked for (`answered` stands for failed calls); direct text isn't sent to
    one. Its findings follow the own ones but for those of the same text; its completed text counts only if it is longer.
    """
    told = F.lit(None).cast(ASSISTANT) if assistant is None else assistant
    out = rules.grammar(df.withColumn("told", F.when(F.col("origin") != "direct", told)), ("text", "origin", "told"))
    own = F.when(F.col("cut_text").isNotNull(), F.array(F.struct(F.col("cut_text").alias("text"), "completion", "reason", "confidence"))).otherwise(F.expr("cast(array() as array<struct<text:string,completion:string,reason:string,confidence:double>>)"))
    out = out.withColumn("own", own)
    taken = F.transform(
        F.filter("told.items", lambda x: ~F.exists("own", lambda y: y["text"] == F.coalesce(x["text"], F.lit("")))),
        lambda x: F.struct(
            F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["completion"], F.lit("")).alias("completion"),
            F.coalesce(F.nullif(x["reason"], F.lit("")), F.lit(ASSISTANT_REASON)).alias("reason"), F.coalesce(F.nullif(x["confidence"], F.lit(0.0)), F.lit(ASSISTANT_CONFIDENCE)).alias("confidence"),
        ),
    )
    critical = F.col("critical") | F.coalesce("told.critical", F.lit(False))
    done = F.when(F.col("origin") == "direct", F.col("text")).otherwise(X.guard_pages(F.col("text"), rules.complete(F.col("text"))))
    out = out.withColumn("done", done)
    longer = F.length("told.completed") > F.length("done")
    return out.select(
        "doc_id", F.when(longer, X.guard_pages(F.col("done"), F.col("told.completed"))).otherwise(F.col("done")).alias("text"), "sentences", F.concat("own", F.coalesce(taken, F.slice("own", 1, 0))).alias("items"),
        critical.alias("critical"), (F.col("abrupt") | F.coalesce("told.abrupt", F.lit(False))).alias("abrupt"), F.coalesce(F.nullif(F.col("told.verdict"), F.lit("")), F.col("verdict")).alias("verdict"),
        F.when(critical, F.coalesce(F.nullif(F.col("told.alert"), F.lit("")), F.col("alert"))).alias("alert"),
    )


def structured(df: DataFrame) -> DataFrame:
    return structure_report.audited(df).withColumn("structural_repaired", F.col("structure.repaired"))


def targeted(df: DataFrame) -> DataFrame:
    """Rules and known misreadings; passages need a canonical table and are matched by `rules.verify`."""
    out = rules.repair_targets(rules.repair(df, counter="__fixed"))
    hits = F.aggregate("targets", F.lit(0), lambda n, t: n + t["count"])
    spaced = F.when(F.col("text").rlike("[﴿﴾]"), rewrite(F.col("text"), rules.SPACED)).otherwise(F.col("text"))
    return out.withColumns({"verses_corrected": hits, "text": spaced}).drop("__fixed", "targets")


_CARRIED = ("doc_id", "file_name", "contextual_fixed", "truncated_items", "structural_repaired", "verses_corrected", "structure")


def audit(docs: DataFrame) -> DataFrame:
    """The result of each row: doc_id, title, language, direction, flags, pages, markdown, plain_text, the structural report, the
    stages' counters and their sum auto_fixed.

    `docs`: doc_id, text, and optionally origin ('direct' or another) and file_name. Null texts count as empty. Rows are told apart
    by themselves: repeated or null ids give as many results as there are rows.
    """
    base = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("origin") if "origin" in docs.columns else F.lit("direct")).alias("origin"),
        (F.col("file_name") if "file_name" in docs.columns else F.lit(None).cast("string")).alias("file_name"),
    )

    # the condition is one on the text as it came, so each side reads and stages its own documents only
    staged = targeted(structured(completed(contextual(base.withColumn("marked", F.col("text").contains(X.MARKER))))))
    staged = staged.withColumn("text", X.strip_origin(F.col("text")))
    figures = ("text", "tables_fixed", "rtl_lines")
    one = layout.audit_pages(staged.where("not marked").withColumnRenamed("text", "page"), _CARRIED).select(*_CARRIED, F.lit(1).alias("pages"), *figures, F.size("list_issues").alias("lists_fixed"))
    rows = staged.where("marked").withColumn("__row", F.monotonically_increasing_id())
    # no text is without a page; an inner explode would have that pushed down through every step's expressions
    paged = rows.select("__row", *_CARRIED, F.posexplode_outer(segment.page_texts(F.col("text"))).alias("page_no", "page"))
    many = layout.audit_pages(paged, ("__row", "page_no", *_CARRIED)).groupBy("__row").agg(
        *(F.min_by(c, "page_no").alias(c) for c in _CARRIED), F.count("*").cast("int").alias("pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), f"\n\n{X.MARKER}\n\n").alias("text"),
        F.sum("tables_fixed").cast("int").alias("tables_fixed"), F.sum("rtl_lines").cast("int").alias("rtl_lines"), F.sum(F.size("list_issues")).cast("int").alias("lists_fixed"),
    )
    out = one.unionByName(many.drop("__row"))
    m = F.col("text")
    return out.select(
        "doc_id", X.title(m, F.col("file_name")).alias("title"), X.language_label(m, F.lit("auto")).alias("language"), F.when(X.is_rtl(m), "rtl").otherwise("ltr").alias("direction"),
        X.has_math(m).alias("has_math"), X.has_table(m).alias("has_tables"), "pages", "rtl_lines", *COUNTERS, sum((F.col(c) for c in COUNTERS), F.lit(0)).alias("auto_fixed"), "structure",
        m.alias("markdown"), X.plain_text(m).alias("plain_text"),
    )
