"""Documents into pages, lines and table blocks, and back (LAY-1, LAY-2, LAY-9).

Order is carried in columns: page_no and line_no count from 1 within their document and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchwork.functions.dialect import S
from parchwork.functions.text import MARKER, is_table_line

#: A marker on a line of its own, with the blanks around it. Two neighbours share the line feed between them, so the second may stay.
PAGE_SPLIT = f"\\n{S}*{MARKER}{S}*\\n"


def page_texts(text: Column) -> Column:
    return F.split(text, PAGE_SPLIT, -1)


def pages(df: DataFrame) -> DataFrame:
    """doc_id, page_no, page."""
    return df.select("doc_id", F.posexplode(page_texts(F.col("text"))).alias("n", "page")).select("doc_id", (F.col("n") + 1).alias("page_no"), "page")


def lines(paged: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, line."""
    return paged.select("doc_id", "page_no", F.posexplode(F.split("page", "\n", -1)).alias("n", "line")).select("doc_id", "page_no", (F.col("n") + 1).alias("line_no"), "line")


def table_blocks(lined: DataFrame) -> DataFrame:
    """Table lines with `block`, the number of their run within the page."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    marked = lined.withColumn("is_table", is_table_line(F.col("line")))
    begins = F.col("is_table") & ~F.coalesce(F.lag("is_table").over(page), F.lit(False))
    return marked.withColumn("block", F.sum(begins.cast("int")).over(page)).where("is_table").drop("is_table")


def join_pages(paged: DataFrame, column: str = "page") -> DataFrame:
    """doc_id and text: pages in order with the marker between them."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.col(column).alias("page"))))
    return paged.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["page"]), f"\n\n{MARKER}\n\n").alias("text"))
