"""The history of conversions: a keyed table, read newest first (SRC-7, SRC-8, SNK-3 to SNK-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.operators import ranges

#: Rows that the bounded view keeps.
BOUND = 20


def newest_first(history: DataFrame, time: str = "timestamp", key: str = "id") -> DataFrame:
    return history.orderBy(F.desc(time), F.desc(key))


def lookup(history: DataFrame, value: object, key: str = "id") -> DataFrame:
    return history.where(F.col(key) == F.lit(value))


def upsert(history: DataFrame, new: DataFrame, key: str = "id", time: str = "timestamp") -> DataFrame:
    """Rows of `new` take the place of rows of their key. Of several rows of one key the newest counts, of equally new ones the
    greatest by the other columns in their order."""
    rest = [c for c in new.columns if c not in (key, time)]
    by = ([time] if time in new.columns else []) + rest
    last = new.groupBy(key).agg(F.max(F.struct(*by)).alias("__last")).select(key, "__last.*").select(new.columns)
    return history.join(last.select(key), key, "left_anti").select(history.columns).unionByName(last)


def bounded(history: DataFrame, bound: int = BOUND, time: str = "timestamp", key: str = "id") -> DataFrame:
    """The newest `bound` rows: a top-k, which each task cuts down before anything is exchanged."""
    return newest_first(history, time, key).limit(bound)


def delete(history: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return history.join(keys.select(key), key, "left_anti").select(history.columns)


def mark(history: DataFrame, keys: DataFrame, column: str = "downloaded", key: str = "id") -> DataFrame:
    """`column` becomes true for rows of `keys`."""
    marked = keys.select(key).distinct().withColumn("__hit", F.lit(True))
    rest = [c for c in history.columns if c != column]
    return history.join(marked, key, "left").select(*rest, F.coalesce("__hit", F.col(column), F.lit(False)).alias(column)).select(history.columns)


# What isn't merged, and the error of a merger without pages.
NOT_MERGED, NO_PAGES = "docx", "لم يتم إضافة أي صفحات للملف المدمج"


def merged_pages(documents: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """One document of all pages: `documents` (doc_id, ord[, kind]) in order, `pages` (doc_id, page_no, page). merged_no counts from 1.

    Word documents (kind docx) are skipped, as are pages of no document. Order is by ord, doc_id and page_no, nulls first. Numbers come from
    sums over ranges of that order, so a document of any size is dealt over tasks. With `strict` a merger without pages is an error,
    which costs a look for one row.
    """
    merged = documents.where(~F.coalesce(F.col("kind") == NOT_MERGED, F.lit(False))) if "kind" in documents.columns else documents
    found = pages.select("doc_id", "page_no", "page").join(merged.select("doc_id", "ord"), "doc_id")
    if strict and found.isEmpty():
        raise ValueError(NO_PAGES)
    numbered = ranges.running(found, [F.col("ord"), F.col("doc_id"), F.col("page_no")], F.lit(1), "merged_no")
    return numbered.select("merged_no", "doc_id", "page_no", "page")


def archive_totals(items: DataFrame, done: Column, pages: Column) -> DataFrame:
    """Documents that are done, and their pages."""
    return items.where(done).agg(F.count("*").alias("documents"), F.coalesce(F.sum(pages), F.lit(0)).alias("pages"))
