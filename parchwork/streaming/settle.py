"""Converted chunks of documents as a stream, settled in order (SCH-5, SCH-6).

A document's chunks arrive in any order, some twice, some failed, some never. Its pages go out in order as soon as all
before them have; from the first chunk that failed, or is missing when the document's time is up, its direct text stands
in. What is held of a document is its place and the chunks that came too early, in keyed state with a timer in event time, so a stopped
stream goes on in the middle of a document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A finished chunk: its number from 0, how many the document has, its pages, or that it failed.
CHUNK = "doc_id long, chunk_index int, n_chunks int, pages array<string>, failed boolean, ts timestamp"
#: A page, or with `rescue` the page from which the direct text stands in.
SETTLED = "doc_id long, page_no long, page string, rescue boolean"
_STATE = "place string"


def _begin() -> dict[str, Any]:
    return {"next": 0, "page": 1, "done": False, "held": {}}


def advance(place: dict[str, Any], n_chunks: int) -> list[tuple[int, str | None, bool]]:
    """The pages that can go out now, and the rescue if a failed chunk is next. Changes `place`."""
    out: list[tuple[int, str | None, bool]] = []
    while not place["done"] and str(place["next"]) in place["held"]:
        pages = place["held"].pop(str(place["next"]))
        if pages is None:
            out.append((place["page"], None, True))
            place["done"] = True
            break
        out += [(place["page"] + k, page, False) for k, page in enumerate(pages)]
        place["page"] += len(pages)
        place["next"] += 1
        place["done"] = place["next"] >= n_chunks
    if place["done"]:
        place["held"] = {}
    return out


def _rows(doc_id: int, out: list[tuple[int, str | None, bool]]) -> pd.DataFrame:
    pages, texts, rescues = zip(*out, strict=True) if out else ((), (), ())
    return pd.DataFrame({"doc_id": pd.Series([doc_id] * len(out), dtype="int64"), "page_no": pd.Series(pages, dtype="int64"), "page": pd.Series(texts, dtype="object"), "rescue": pd.Series(rescues, dtype="bool")})


def _settle(patience_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place = json.loads(state.get[0]) if state.exists else _begin()
        if state.hasTimedOut:
            state.remove()
            # a document that is done has kept its place only to know late chunks
            yield _rows(key[0], [] if place["done"] else [(place["page"], None, True)])
            return
        latest = 0
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts", kind="stable")
        for index, n, pages, failed, ts in zip(rows["chunk_index"], rows["n_chunks"], rows["pages"], rows["failed"], rows["ts"], strict=True):
            latest = max(latest, int(ts.timestamp() * 1000))
            if not place["done"] and index >= place["next"]:
                place["held"].setdefault(str(int(index)), None if failed or pages is None else list(pages))
            yield _rows(key[0], advance(place, int(n)))
        state.update((json.dumps(place),))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + patience_ms)

    return run


def settled_stream(chunks: DataFrame, patience: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """SETTLED rows of a stream of chunks (CHUNK), each page once and a document's pages in order.

    A chunk that comes again counts once, by its first arrival. A document of which nothing came for `patience` of event time is
    rescued from the first page that is missing; what comes for a document that is done is dropped until that time is over. A
    chunk is dropped if it is later than `late`. Rows without a doc_id, a number or a time belong to no document and are left out.
    """
    patience_ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    timed = chunks.where("doc_id is not null and chunk_index >= 0 and ts is not null").withWatermark("ts", late)
    return timed.groupBy("doc_id").applyInPandasWithState(_settle(patience_ms), SETTLED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settled(chunks: DataFrame) -> DataFrame:
    """The same of a table of all chunks that ever came: what the stream has given when every document is done or out of time."""
    known = chunks.where("doc_id is not null and chunk_index >= 0 and ts is not null")
    first = known.groupBy("doc_id", "chunk_index").agg(F.min_by(F.struct("n_chunks", "pages", (F.coalesce("failed", F.lit(False)) | F.col("pages").isNull()).alias("failed")), "ts").alias("c")).select("doc_id", "chunk_index", "c.*")
    ordered = Window.partitionBy("doc_id").orderBy("chunk_index")
    placed = first.withColumn("good", ~F.col("failed") & (F.row_number().over(ordered) - 1 == F.col("chunk_index")))
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("good"), F.size("pages")).otherwise(0)
    placed = placed.withColumn("good", F.bool_and("good").over(up_to)).withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + 1)
    pages = placed.where("good").select("doc_id", "start", F.posexplode("pages").alias("k", "page")).select("doc_id", (F.col("start") + F.col("k")).cast("long").alias("page_no"), "page", F.lit(False).alias("rescue"))
    ends = placed.groupBy("doc_id").agg(F.sum(F.col("good").cast("int")).alias("n"), F.max("n_chunks").alias("of"), F.sum(F.when(F.col("good"), F.size("pages")).otherwise(0)).alias("pages"))
    rescues = ends.where("n < of").select("doc_id", (F.col("pages") + 1).cast("long").alias("page_no"), F.lit(None).cast("string").alias("page"), F.lit(True).alias("rescue"))
    return pages.unionByName(rescues)


def whole_pages(settled_rows: DataFrame, direct: DataFrame) -> DataFrame:
    """doc_id, page_no and page of settled documents, the rest of rescued ones from `direct` (doc_id, page_no, page)."""
    from parchwork.streaming.resume import rescued_pages

    return rescued_pages(settled_rows.where("not rescue"), direct, settled_rows.where("rescue").select("doc_id", F.col("page_no").alias("start_page")))
