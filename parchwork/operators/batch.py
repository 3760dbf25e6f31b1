"""Queues, estimates, chunk plans, stages and model scheduling (AGG, CHK, STG, SCH, ERR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.functions.dialect import round_half_up
from parchwork.functions.text import format_duration

# The stages in order with the progress that each shows while it runs, and pages to a chunk up to so many pages.
STAGES: tuple[tuple[str, int], ...] = (
    ("image_denoise", 50), ("extraction", 40), ("contextual", 55), ("grammar", 70), ("structural", 85), ("quranic_verification", 90), ("layout_integrity", 95), ("finalizing", 98),
)
CHUNKS: dict[str, tuple[tuple[tuple[int, int], ...], int]] = {
    "maximum_savings": (((3, 1), (10, 2), (30, 5), (80, 8), (200, 12)), 15),
    "high_fidelity": (((6, 1), (30, 2)), 3),
    "balanced": (((4, 1), (12, 2), (40, 4), (100, 6), (250, 8)), 10),
}
DEFAULT_MODE = "maximum_savings"
UPDATED_PROGRESS = 60


def queue_eta(items: DataFrame, elapsed: Column, by: str = "batch_id") -> DataFrame:
    """One row for each batch of `items` (by, size, status, progress): files, bytes, percentage and the time left.

    `elapsed` is a Column over `by`, the seconds so far. One partial aggregate and a projection.
    """
    size = F.greatest(F.lit(1024.0), F.coalesce(F.col("size"), F.lit(1024)).cast("double"))
    progress = F.when(F.coalesce(F.col("progress"), F.lit(0)) == 0, 10).otherwise(F.col("progress"))
    ratio = F.greatest(F.lit(0), F.least(F.lit(100), progress)) / 100
    done, running, waiting = (F.col("status") == s for s in ("done", "processing", "pending"))
    sums = items.groupBy(by).agg(
        F.count("*").alias("total_files"), F.count(F.when(done, 1)).alias("completed"), F.count(F.when(running | waiting, 1)).alias("remaining"),
        F.sum(size).alias("total_bytes"), F.coalesce(F.sum(F.when(done, size).when(running, size * ratio)), F.lit(0.0)).alias("processed"),
    )
    left = F.greatest(F.lit(0.0), F.col("total_bytes") - F.col("processed"))
    percent = F.least(F.lit(100), F.greatest(F.lit(0), round_half_up(F.col("processed") / F.greatest(F.lit(1.0), F.col("total_bytes")) * 100)))
    t = sums.withColumns({"elapsed": elapsed.cast("double"), "left": left, "percent": percent})
    guess = F.greatest(F.lit(5.0), F.col("remaining") * 7 + F.col("left") / (500 * 1024) * 4)
    speed = F.col("processed") / F.col("elapsed")
    weight = F.least(F.lit(0.85), F.col("elapsed") / 15 * 0.7)
    seen = (F.col("elapsed") >= 3) & (F.col("processed") > 1024)
    t = t.withColumn("guess", guess)
    blended = F.greatest(F.lit(4), round_half_up(F.col("guess") * (1 - weight) + F.col("left") / F.greatest(F.lit(5000.0), speed) * weight))
    finished = (F.col("remaining") == 0) | (F.col("percent") >= 100)
    seconds = F.when(finished, 0).when(seen, blended).otherwise(round_half_up(F.col("guess")))
    rate = F.when(seen, speed).otherwise(F.col("total_bytes") / F.greatest(F.lit(10.0), F.col("guess")))
    shown = F.when(finished, "مكتمل").when(rate >= 1024 * 1024, F.concat(F.format_string("%.1f", rate / (1024 * 1024)), F.lit(" م.ب/ث"))).otherwise(F.concat(round_half_up(rate / 1024).cast("string"), F.lit(" ك.ب/ث")))
    t = t.withColumn("seconds", seconds.cast("long"))
    return t.select(
        by, "total_files", "completed", F.when(finished, 0).otherwise(F.col("remaining")).cast("long").alias("remaining"), "total_bytes",
        F.when(finished, F.col("total_bytes")).otherwise(F.col("processed")).alias("processed_bytes"), F.when(finished, 0.0).otherwise(F.col("left")).alias("remaining_bytes"),
        F.when(finished, 100).otherwise(F.col("percent")).cast("int").alias("percent"), "seconds",
        F.when(finished, "اكتملت المعالجة بالكامل").otherwise(format_duration(F.col("seconds"))).alias("eta"), shown.alias("speed"),
    )


def single_eta(percentage: Column, elapsed: Column, size: Column) -> Column:
    """Seconds left of one file."""
    safe = F.greatest(F.lit(1.0), F.least(F.lit(99.0), F.when(F.coalesce(percentage, F.lit(0)) == 0, 5).otherwise(percentage).cast("double")))
    baseline = F.greatest(F.lit(8.0), F.least(F.lit(60.0), 10 + F.when(F.coalesce(size, F.lit(0)) == 0, 500000).otherwise(size) / (1024.0 * 1024) * 8))
    by_time, by_size = round_half_up(elapsed / (safe / 100) - elapsed), round_half_up(baseline * (1 - safe / 100))
    return F.when(safe >= 98, 2).otherwise(F.greatest(F.lit(3), F.when(elapsed >= 2, by_time).otherwise(by_size))).cast("long")


def pages_per_chunk(pages: Column, mode: str = DEFAULT_MODE) -> Column:
    steps, last = CHUNKS[mode]
    out = F.when(F.lit(False), 0)
    for most, size in steps:
        out = out.when(pages <= most, size)
    return out.otherwise(last)


def plan_chunks(df: DataFrame, pages: Column, capacity: Column, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """A row for each chunk of each row of `df`: chunk_index (from 0), total_chunks, start_page, end_page (from 1, inclusive).

    A range is clamped to the document; none, or one that doesn't begin at 1 or later, is all pages.
    """
    ranged = F.coalesce(first, F.lit(0)) > 0 if first is not None else F.lit(False)
    start = F.when(ranged, F.greatest(F.lit(1), F.least(first, pages))).otherwise(1) if first is not None else F.lit(1)
    end = F.when(ranged, F.greatest(start, F.least(last, pages))).otherwise(pages) if last is not None else pages
    size = F.greatest(F.lit(1), F.coalesce(capacity, F.lit(1)))
    rows = df.withColumns({"__start": start.cast("int"), "__end": end.cast("int"), "__size": size.cast("int")}).where("__end >= __start")
    rows = rows.select("*", F.posexplode(F.sequence("__start", "__end", "__size")).alias("chunk_index", "start_page"))
    return rows.select(
        *df.columns, "chunk_index", F.ceil((F.col("__end") - F.col("__start") + 1) / F.col("__size")).cast("int").alias("total_chunks"),
        "start_page", F.least(F.col("start_page") + F.col("__size") - 1, F.col("__end")).alias("end_page"),
    )


def stage_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(STAGES)], "ord int, stage string, while_running int")


def stage_list(active: DataFrame, value: Column | None = None) -> DataFrame:
    """Of each row of `active` (active_stage) all stages with status and progress. With `value`, an update: its progress, or 60 if it is null."""
    names = F.array(*(F.lit(s) for s, _ in STAGES))
    at = F.array_position(names, F.col("active_stage")).cast("int") - 1
    rows = active.withColumn("__at", at).select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(s).alias("stage"), F.lit(p).alias("running")) for i, (s, p) in enumerate(STAGES)))).alias("s"))
    progress = F.col("s.running").cast("double") if value is None else F.coalesce(value.cast("double"), F.lit(float(UPDATED_PROGRESS)))
    before, now = F.col("s.ord") < F.col("__at"), F.col("s.ord") == F.col("__at")
    return rows.select(*active.columns, F.col("s.ord").alias("ord"), F.col("s.stage").alias("stage"), F.when(before, "completed").when(now, "in_progress").otherwise("pending").alias("status"), F.when(before, 100.0).when(now, progress).otherwise(0.0).alias("progress"))


def inferred_stage(phase: Column, percentage: Column) -> Column:
    return F.when(phase.isin("reading", "splitting"), "extraction").when(percentage > 85, "finalizing").when(percentage > 60, "grammar").when(percentage > 35, "contextual").otherwise("extraction")


def retry_seconds(message: Column) -> Column:
    """The wait that an error message names, rounded up; null if it names none."""
    a = F.regexp_extract(message, "(?i)retry in ([0-9.]+)s", 1)
    b = F.regexp_extract(message, "(?i)retryDelay\"?:\\s*\"([0-9]+)s\"", 1)
    return F.ceil(F.when(a != "", a).when(b != "", b).try_cast("double")).cast("int")


def provider_error(message: Column) -> Column:
    """not_found, quota_daily, quota_minute, busy or null."""
    low, wait = F.lower(message), retry_seconds(message)

    def has(*parts: str, of: Column = message) -> Column:
        found = of.contains(parts[0])
        for p in parts[1:]:
            found = found | of.contains(p)
        return found

    daily = has("GenerateRequestsPerDay") | (has("free_tier_requests") & (has("limit: 500") | F.coalesce(wait > 300, F.lit(False))))
    minute = has("GenerateRequestsPerMinute", "limit: 5", "limit: 15", "429", "RESOURCE_EXHAUSTED") | F.coalesce(wait <= 120, F.lit(False)) | has("rate limit", of=low)
    busy = has("503", "UNAVAILABLE") | has("high demand", "peak demand", "overloaded", of=low)
    return F.when(has("404", "NOT_FOUND", "no longer available"), "not_found").when(daily, "quota_daily").when(minute, "quota_minute").when(busy, "busy")


def response_class(message: Column) -> Column:
    """A struct of status (503, 429, 500), daily and retry_after."""
    low, wait = F.lower(message), F.coalesce(retry_seconds(message), F.lit(15))
    busy = message.contains("503") | low.contains("high demand") | low.contains("peak demand") | message.contains("UNAVAILABLE") | low.contains("overloaded") | low.contains("temporary")
    limited = message.contains("429") | message.contains("RESOURCE_EXHAUSTED") | message.contains("Quota exceeded") | low.contains("rate limit") | low.contains("quota")
    daily = message.contains("GenerateRequestsPerDay") | (message.contains("free_tier_requests") & (message.contains("limit: 500") | (wait > 300)))
    after = F.when(busy, F.greatest(F.lit(6), F.least(F.lit(25), wait))).when(limited & daily, 60).when(limited, F.greatest(F.lit(10), F.least(F.lit(65), wait + 2)))
    return F.struct(F.when(busy, 503).when(limited, 429).otherwise(500).alias("status"), (~busy & limited & daily).alias("daily"), after.alias("retry_after"))


def is_throttled(status: Column, message: Column) -> Column:
    low = F.lower(message)
    found = status.isin(429, 502, 503, 504)
    for part in ("peak demand", "high demand", "rate limit", "quota", "overloaded"):
        found = found | low.contains(part)
    for part in ("ضغطاً مؤقتاً", "UNAVAILABLE", "استجابة غير صالحة", "تعذر الاتصال", "503", "429"):
        found = found | message.contains(part)
    return found


def cooldown_seconds(kind: Column, wait: Column) -> Column:
    """How long a model rests after an error; null: for ever (not_found)."""
    return F.when(kind == "quota_daily", F.coalesce(wait + 10, F.lit(24 * 3600))).when(kind == "quota_minute", F.coalesce(F.least(F.lit(75), wait + 2), F.lit(15))).when(kind == "busy", 4)


def available_models(models: DataFrame, now: Column) -> DataFrame:
    """`models` (ord, model, cooled_until, blacklisted) that may be asked, best first as `rank`: those free now in their order, or if none is, the others by the end of their rest."""
    cooling = F.coalesce(F.col("cooled_until") > now, F.lit(False))
    allowed = models.where(~F.col("blacklisted") | (F.col("cooled_until").isNotNull() & ~cooling)).withColumn("cooling", cooling)
    ready = allowed.where("not cooling").agg(F.count("*").alias("ready"))
    chosen = allowed.join(F.broadcast(ready), F.lit(True)).where("not cooling or ready = 0")  # one row
    order = F.struct(F.col("cooling"), F.when(F.col("cooling"), F.col("cooled_until")), F.col("ord"))
    return chosen.select("ord", "model", order.alias("order"))


def retry_wait(kind: Column, attempt: Column, wait: Column) -> Column:
    """Seconds before the client asks again."""
    return F.when(wait.isNotNull(), F.least(F.lit(65), wait + 2)).when(kind == "short", F.least(F.lit(20), 6 + 3 * attempt)).otherwise(F.least(F.lit(35), F.greatest(F.lit(12), 10 + 4 * attempt)))


def merged_metadata(chunks: DataFrame) -> DataFrame:
    """Of each document's chunks: flags that any has, the last chunk's language, the first one's title."""
    return chunks.groupBy("doc_id").agg(
        F.bool_or("has_math").alias("has_math"), F.bool_or("has_tables").alias("has_tables"), F.max_by("language", "chunk_index").alias("language"), F.min_by("title", "chunk_index").alias("title")
    )
