"""Text layers of uploads: decoded payloads, pages to a document, and the route that a document takes (SRC-1, SRC-2, SRC-9, CLS-10).

Reading a PDF's text layer takes a library that isn't here; what such a reader gives, a table of pages, is the contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.functions import text as X
from parchwork.functions.dialect import S, trim
from parchwork.plans.text_queries import promoted

#: Characters that aren't blank above which a text layer is real, and the share of pages with text from which it will do.
DIGITAL, COVERAGE = 50, 0.6


def decoded(upload: Column) -> Column:
    """The bytes of a data URL or of bare base64."""
    return F.unbase64(X.data_url_payload(upload))


def page_count(told: Column) -> Column:
    return F.coalesce(told, F.lit(1))


def markdown_page(page: Column) -> Column:
    return F.array_join(F.transform(F.split(page, "\n", -1), promoted), "\n")


def text_layer(pages: DataFrame) -> DataFrame:
    """doc_id, raw, markdown, total_pages, pages_with_text, digital and route of each document of `pages` (doc_id, page_no, page).

    Blank pages are left out of the markdown. The route is 'direct' if enough pages have text, else 'recognize'.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("page", F.lit("")).alias("page"))))
    docs = pages.groupBy("doc_id").agg(F.transform(ordered, lambda p: p["page"]).alias("all"), F.count("*").cast("int").alias("total_pages"))
    docs = docs.withColumns({"raw": F.array_join("all", f"\n\n{X.MARKER}\n\n"), "kept": F.filter(F.transform("all", trim), lambda p: p != "")})
    digital = F.length(F.regexp_replace("raw", f"{S}++", "")) > DIGITAL
    enough = (F.size("kept") > 0) & (F.size("kept") / F.col("total_pages") >= COVERAGE)
    return docs.select("doc_id", "raw", F.array_join(F.transform("kept", markdown_page), f"\n\n{X.MARKER}\n\n").alias("markdown"), "total_pages", F.size("kept").alias("pages_with_text"), digital.alias("digital"), F.when(enough, "direct").otherwise("recognize").alias("route"))


# What an upload is told.
NO_PAYLOAD, BROKEN = "No PDF data provided", "تعذر الاستخراج الرقمي المباشر"
NO_LAYER = "لم يتم العثور على طبقة نصوص رقمية في الملف (الملف عبارة عن صور ممسوحة ضوئياً ويحتاج معالجة OCR عبر الذكاء الاصطناعي)."
METHOD = "direct_digital_extraction"


def direct_answers(uploads: DataFrame, pages: DataFrame) -> DataFrame:
    """What each row of `uploads` (doc_id, file_name, payload) is answered, with its text layer from `pages` (doc_id, page_no, page).

    status is 400 without a payload, 500 if it is no base64, else 200; success says whether there is a text layer, and error why not. title, language,
    direction, has_arabic, has_tables, total_pages, method, markdown and plain_text are those of the layer, null without one.
    A row of null doc_id has no pages.
    """
    payload = F.col("payload")
    asked = uploads.select("doc_id", "file_name", F.when(payload.isNull() | (payload == ""), 400).when(F.try_to_binary(X.data_url_payload(payload), F.lit("base64")).isNull(), 500).otherwise(200).alias("status"))
    found = asked.join(text_layer(pages), "doc_id", "left")
    success = (F.col("status") == 200) & F.coalesce("digital", F.lit(False))
    arabic = X.is_rtl_absolute(F.col("markdown"))
    error = F.when(F.col("status") == 400, NO_PAYLOAD).when(F.col("status") == 500, BROKEN).when(~success, NO_LAYER)
    given = {
        "title": F.regexp_replace(F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.lit("document")), "\\.[^/.]+\\z", ""), "language": F.when(arabic, "العربية").otherwise("English"), "direction": F.when(arabic, "rtl").otherwise("ltr"),
        "has_arabic": arabic, "has_tables": X.has_table(F.col("markdown")), "total_pages": F.col("total_pages"), "method": F.lit(METHOD), "markdown": F.col("markdown"), "plain_text": F.col("raw"),
    }
    return found.select("doc_id", "status", success.alias("success"), error.alias("error"), *(F.when(success, c).alias(n) for n, c in given.items()))
