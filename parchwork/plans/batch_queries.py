"""Queries and their SQL for queues, plans, stages, errors and history (AGG, CHK, STG, SCH, ERR, SRC-7/8, SNK-3 to SNK-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.functions import text as X
from parchwork.operators import batch, history
from parchwork.plans.fixtures import dealt, dealt_sql, values_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _queue(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "processing").otherwise(F.when(F.col("o_orderkey") % 7 == 0, "error").otherwise("pending"))
    return o.select((F.col("o_custkey") % 500).alias("batch_id"), F.floor("o_totalprice").cast("long").alias("size"), status.alias("status"), (F.col("o_orderkey") % 130 - 10).cast("double").alias("progress"))


_QUEUE = "q AS (SELECT o_custkey % 500 AS batch_id, floor(o_totalprice)::BIGINT AS size, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'processing' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'pending' END END AS status, (o_orderkey % 130 - 10)::DOUBLE AS progress FROM orders)"
_DURATION = (
    "CASE WHEN seconds <= 0 THEN 'لحظات قليلة...' WHEN seconds < 6 THEN 'أقل من 5 ثوانٍ' WHEN seconds < 60 THEN 'حوالي ' || seconds || ' ثانية' "
    "WHEN seconds // 60 = 1 THEN 'حوالي دقيقة' || CASE WHEN seconds % 60 > 0 THEN ' و ' || seconds % 60 || ' ثانية' ELSE ' واحدة' END "
    "WHEN seconds // 60 = 2 THEN 'حوالي دقيقتين' || CASE WHEN seconds % 60 > 0 THEN ' و ' || seconds % 60 || ' ثانية' ELSE '' END "
    "WHEN seconds // 60 <= 10 THEN 'حوالي ' || seconds // 60 || ' دقائق' || CASE WHEN seconds % 60 > 0 THEN ' و ' || seconds % 60 || ' ثانية' ELSE '' END "
    "WHEN seconds // 60 < 60 THEN 'حوالي ' || seconds // 60 || ' دقيقة' || CASE WHEN seconds % 60 > 0 THEN ' و ' || seconds % 60 || ' ثانية' ELSE '' END "
    "ELSE 'حوالي ' || seconds // 3600 || ' ساعة و ' || seconds // 60 % 60 || ' دقيقة' END"
)
QUERIES["agg01_queue_eta"] = lambda spark, sf_dir: batch.queue_eta(_queue(spark, sf_dir), F.col("batch_id") % 40)
SQL["agg01_queue_eta"] = f"""WITH {_QUEUE},
s AS (SELECT batch_id, count(*) AS total_files, count(*) FILTER (status = 'done') AS completed, count(*) FILTER (status IN ('processing', 'pending')) AS remaining, sum(greatest(1024.0, size)::DOUBLE) AS total_bytes,
      coalesce(sum(CASE status WHEN 'done' THEN greatest(1024.0, size)::DOUBLE WHEN 'processing' THEN greatest(1024.0, size)::DOUBLE * (greatest(0, least(100, CASE WHEN progress = 0 THEN 10 ELSE progress END)) / 100) END), 0) AS processed, (batch_id % 40)::DOUBLE AS elapsed FROM q GROUP BY batch_id),
t AS (SELECT *, greatest(0, total_bytes - processed) AS rest, least(100, greatest(0, floor(processed / greatest(1, total_bytes) * 100 + 0.5))) AS p FROM s),
u AS (SELECT *, greatest(5.0, remaining * 7 + rest / (500 * 1024) * 4) AS guess, elapsed >= 3 AND processed > 1024 AS seen, remaining = 0 OR p >= 100 AS finished, least(0.85, elapsed / 15 * 0.7) AS w FROM t),
v AS (SELECT *, (CASE WHEN finished THEN 0 WHEN seen THEN greatest(4, floor(guess * (1 - w) + rest / greatest(5000.0, processed / elapsed) * w + 0.5)) ELSE floor(guess + 0.5) END)::BIGINT AS seconds, CASE WHEN seen THEN processed / elapsed ELSE total_bytes / greatest(10, guess) END AS rate FROM u)
SELECT batch_id, total_files, completed, (CASE WHEN finished THEN 0 ELSE remaining END)::BIGINT AS remaining, total_bytes, CASE WHEN finished THEN total_bytes ELSE processed END AS processed_bytes, CASE WHEN finished THEN 0 ELSE rest END AS remaining_bytes,
  (CASE WHEN finished THEN 100 ELSE p END)::INTEGER AS percent, seconds, CASE WHEN finished THEN 'اكتملت المعالجة بالكامل' ELSE {_DURATION} END AS eta,
  CASE WHEN finished THEN 'مكتمل' WHEN rate >= 1024 * 1024 THEN printf('%.1f', rate / (1024 * 1024)) || ' م.ب/ث' ELSE floor(rate / 1024 + 0.5)::BIGINT || ' ك.ب/ث' END AS speed FROM v"""
QUERIES["agg02_single_eta"] = lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", batch.single_eta(F.col("o_orderkey") % 101, (F.col("o_custkey") % 50).cast("double"), F.floor(F.col("o_totalprice") * 100).cast("long")).alias("seconds"))
SQL["agg02_single_eta"] = """WITH t AS (SELECT o_orderkey, greatest(1.0, least(99.0, CASE WHEN o_orderkey % 101 = 0 THEN 5 ELSE o_orderkey % 101 END))::DOUBLE AS p, (o_custkey % 50)::DOUBLE AS e, floor(o_totalprice * 100)::BIGINT AS size FROM orders)
SELECT o_orderkey, (CASE WHEN p >= 98 THEN 2 ELSE greatest(3, CASE WHEN e >= 2 THEN floor(e / (p / 100) - e + 0.5) ELSE floor(greatest(8.0, least(60.0, 10 + CASE WHEN size = 0 THEN 500000 ELSE size END / (1024.0 * 1024)::DOUBLE * 8)) * (1 - p / 100) + 0.5) END) END)::BIGINT AS seconds FROM t"""
QUERIES["agg05_archive_totals"] = lambda spark, sf_dir: history.archive_totals(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderkey") % 30)
SQL["agg05_archive_totals"] = "SELECT count(*) AS documents, coalesce(sum(o_orderkey % 30), 0)::BIGINT AS pages FROM orders WHERE o_orderstatus = 'F'"
QUERIES["agg06_done_counts"] = lambda spark, sf_dir: _queue(spark, sf_dir).groupBy("batch_id").agg(F.count(F.when(F.col("status") == "done", 1)).alias("done"), F.count("*").alias("total"))
SQL["agg06_done_counts"] = f"WITH {_QUEUE} SELECT batch_id, count(*) FILTER (status = 'done') AS done, count(*) AS total FROM q GROUP BY batch_id"


def _chunked(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")
    return d.select("doc_id", "chunk_index", X.has_math(F.col("text")).alias("has_math"), (X.latin_count(F.col("text")) > 200).alias("has_tables"), F.substring("text", 1, 3).alias("language"), F.substring("text", 1, 12).alias("title"))


QUERIES["agg09_merged_metadata"] = lambda spark, sf_dir: batch.merged_metadata(_chunked(spark, sf_dir))
SQL["agg09_merged_metadata"] = "SELECT conv_id AS doc_id, bool_or(contains(text, '$')) AS has_math, bool_or(len(regexp_extract_all(text, '[a-zA-Z]')) > 200) AS has_tables, arg_max(substr(text, 1, 3), turn) AS language, arg_min(substr(text, 1, 12), turn) AS title FROM conversations GROUP BY conv_id"
_PAGES = "p_partkey % 700 + 1"
QUERIES["chk01_pages_per_chunk"] = lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", *(batch.pages_per_chunk(F.expr(_PAGES), m).alias(m) for m in batch.CHUNKS))


def _steps(mode: str) -> str:
    steps, last = batch.CHUNKS[mode]
    return "CASE " + " ".join(f"WHEN {_PAGES} <= {a} THEN {b}" for a, b in steps) + f" ELSE {last} END"


SQL["chk01_pages_per_chunk"] = f"SELECT p_partkey, {', '.join(f'{_steps(m)} AS {m}' for m in batch.CHUNKS)} FROM part"
QUERIES["chk02_chunk_plan"] = lambda spark, sf_dir: batch.plan_chunks(table(spark, sf_dir, "part").select("p_partkey"), F.expr(_PAGES), batch.pages_per_chunk(F.expr(_PAGES)), F.expr("p_partkey % 5 * 20"), F.expr("p_partkey % 5 * 20 + p_partkey % 90"))
SQL["chk02_chunk_plan"] = f"""WITH d AS (SELECT p_partkey, {_PAGES} AS n, {_steps('maximum_savings')} AS c, p_partkey % 5 * 20 AS f, p_partkey % 5 * 20 + p_partkey % 90 AS l FROM part),
r AS (SELECT *, CASE WHEN f > 0 THEN greatest(1, least(f, n)) ELSE 1 END AS s FROM d), e AS (SELECT *, CASE WHEN f > 0 THEN greatest(s, least(l, n)) ELSE n END AS z FROM r),
x AS (SELECT *, unnest(range(s, z + 1, c)) AS start_page FROM e)
SELECT p_partkey, ((start_page - s) // c)::INTEGER AS chunk_index, ceil((z - s + 1) / c::DOUBLE)::INTEGER AS total_chunks, start_page::INTEGER AS start_page, least(start_page + c - 1, z)::INTEGER AS end_page FROM x"""
_NAMES = ", ".join(f"'{s}'" for s, _ in batch.STAGES)
_ACTIVE = f"element_at(array({_NAMES}), cast(event_id % 8 + 1 as int))"
QUERIES["stg01_stage_list"] = lambda spark, sf_dir: batch.stage_list(table(spark, sf_dir, "events").select("event_id", F.expr(_ACTIVE).alias("active_stage")))
QUERIES["stg02_stage_update"] = lambda spark, sf_dir: batch.stage_list(table(spark, sf_dir, "events").select("event_id", F.expr(_ACTIVE).alias("active_stage"), F.expr("case when event_id % 3 > 0 then cast(event_id % 100 as double) end").alias("value")), F.col("value"))
_STAGES = values_sql(tuple((i, s, p) for i, (s, p) in enumerate(batch.STAGES)), "ord, stage, running")
for _name, _more, _shown in (("stg01_stage_list", "", "running"), ("stg02_stage_update", ", CASE WHEN event_id % 3 > 0 THEN (event_id % 100)::DOUBLE END AS value", "coalesce(value, 60)")):
    SQL[_name] = (
        f"WITH e AS (SELECT event_id, event_id % 8 AS pos, [{_NAMES}][event_id % 8 + 1] AS active_stage{_more} FROM events) SELECT event_id, active_stage{', value' if _more else ''}, ord, stage, CASE WHEN ord < pos THEN 'completed' WHEN ord = pos THEN 'in_progress' ELSE 'pending' END AS status, "
        f"(CASE WHEN ord < pos THEN 100 WHEN ord = pos THEN {_shown} ELSE 0 END)::DOUBLE AS progress FROM e, {_STAGES}"
    )
QUERIES["stg03_inferred_stage"] = lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", batch.inferred_stage(F.expr("element_at(array('reading', 'splitting', 'converting'), cast(event_id % 3 + 1 as int))"), F.expr("event_id % 101")).alias("stage"))
SQL["stg03_inferred_stage"] = "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'extraction' WHEN event_id % 101 > 85 THEN 'finalizing' WHEN event_id % 101 > 60 THEN 'grammar' WHEN event_id % 101 > 35 THEN 'contextual' ELSE 'extraction' END AS stage FROM events"

MESSAGES: tuple[tuple[str, int], ...] = (
    ("404 model NOT_FOUND", 404), ("GenerateRequestsPerDay exceeded, retry in 33.2s", 429), ("free_tier_requests limit: 500", 429), ("free_tier_requests, retry in 400s", 429), ("Please retry in 12.5s", 500), ("429 Too Many", 429),
    ("RESOURCE_EXHAUSTED {\"retryDelay\": \"47s\"}", 429), ("503 Service UNAVAILABLE", 503), ("The model is overloaded", 500), ("peak demand, Temporary", 502), ("something else", 500), ("Quota exceeded", 500), ("limit: 15 per minute", 500), ("", 504),
)


def _messages(spark, sf_dir: str) -> DataFrame:
    """Events as a provider's answers: event_id, message, status. Every third one names a wait of its own."""
    rows = dealt(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", MESSAGES, ("said", "status"))
    wait = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" retry in "), F.floor("value").cast("string"), F.lit("s"))).otherwise("")
    return rows.select("event_id", F.concat("said", wait).alias("message"), "status")


_WAIT = "ceil(try_cast(CASE WHEN regexp_matches(message, '(?i)retry in [0-9.]+s') THEN regexp_extract(message, '(?i)retry in ([0-9.]+)s', 1) WHEN regexp_matches(message, '(?i)retryDelay\"?:\\s*\"[0-9]+s\"') THEN regexp_extract(message, '(?i)retryDelay\"?:\\s*\"([0-9]+)s\"', 1) END AS DOUBLE))::INTEGER"


def _has(*parts: str, of: str = "message") -> str:
    return "(" + " OR ".join(f"contains({of}, '{p}')" for p in parts) + ")"


_KIND = (
    f"CASE WHEN {_has('404', 'NOT_FOUND', 'no longer available')} THEN 'not_found' WHEN {_has('GenerateRequestsPerDay')} OR ({_has('free_tier_requests')} AND ({_has('limit: 500')} OR coalesce(wait > 300, FALSE))) THEN 'quota_daily' "
    f"WHEN {_has('GenerateRequestsPerMinute', 'limit: 5', 'limit: 15', '429', 'RESOURCE_EXHAUSTED')} OR coalesce(wait <= 120, FALSE) OR {_has('rate limit', of='lower(message)')} THEN 'quota_minute' WHEN {_has('503', 'UNAVAILABLE')} OR {_has('high demand', 'peak demand', 'overloaded', of='lower(message)')} THEN 'busy' END"
)
_ANSWERS = f"(SELECT event_id, said || CASE WHEN event_id % 3 = 0 THEN ' retry in ' || floor(value)::BIGINT || 's' ELSE '' END AS message, status FROM {dealt_sql('events', 'event_id', MESSAGES, ('said', 'status'))})"
_M = f"m AS (SELECT *, {_WAIT} AS wait FROM {_ANSWERS})"
QUERIES["err01_provider_errors"] = lambda spark, sf_dir: _messages(spark, sf_dir).select("event_id", batch.provider_error(F.col("message")).alias("kind"), batch.retry_seconds(F.col("message")).alias("wait"))
SQL["err01_provider_errors"] = f"WITH {_M} SELECT event_id, {_KIND} AS kind, wait FROM m"
QUERIES["err02_responses"] = lambda spark, sf_dir: _messages(spark, sf_dir).select("event_id", batch.response_class(F.col("message")).alias("r")).select("event_id", "r.status", "r.daily", "r.retry_after")
_BUSY = f"({_has('503', 'UNAVAILABLE')} OR {_has('high demand', 'peak demand', 'overloaded', 'temporary', of='lower(message)')})"
_LIMITED, _DAILY = f"({_has('429', 'RESOURCE_EXHAUSTED', 'Quota exceeded')} OR {_has('rate limit', 'quota', of='lower(message)')})", f"({_has('GenerateRequestsPerDay')} OR ({_has('free_tier_requests')} AND ({_has('limit: 500')} OR coalesce(wait, 15) > 300)))"
SQL["err02_responses"] = f"WITH {_M} SELECT event_id, CASE WHEN {_BUSY} THEN 503 WHEN {_LIMITED} THEN 429 ELSE 500 END AS status, NOT {_BUSY} AND {_LIMITED} AND {_DAILY} AS daily, CASE WHEN {_BUSY} THEN greatest(6, least(25, coalesce(wait, 15))) WHEN {_LIMITED} AND {_DAILY} THEN 60 WHEN {_LIMITED} THEN greatest(10, least(65, coalesce(wait, 15) + 2)) END AS retry_after FROM m"
QUERIES["err03_throttled"] = lambda spark, sf_dir: _messages(spark, sf_dir).select("event_id", batch.is_throttled(F.col("status"), F.col("message")).alias("throttled"))
SQL["err03_throttled"] = f"WITH {_M} SELECT event_id, status IN (429, 502, 503, 504) OR {_has('peak demand', 'high demand', 'rate limit', 'quota', 'overloaded', of='lower(message)')} OR {_has('ضغطاً مؤقتاً', 'UNAVAILABLE', 'استجابة غير صالحة', 'تعذر الاتصال', '503', '429')} AS throttled FROM m"
QUERIES["sch02_cooldowns"] = lambda spark, sf_dir: _messages(spark, sf_dir).select("event_id", batch.cooldown_seconds(batch.provider_error(F.col("message")), batch.retry_seconds(F.col("message"))).alias("seconds"))
SQL["sch02_cooldowns"] = f"WITH {_M}, k AS (SELECT *, {_KIND} AS kind FROM m) SELECT event_id, CASE kind WHEN 'quota_daily' THEN coalesce(wait + 10, 86400) WHEN 'quota_minute' THEN coalesce(least(75, wait + 2), 15) WHEN 'busy' THEN 4 END AS seconds FROM k"
QUERIES["agg07_least_cooldown"] = lambda spark, sf_dir: _messages(spark, sf_dir).agg(F.min(batch.retry_seconds(F.col("message"))).alias("seconds"))
SQL["agg07_least_cooldown"] = f"WITH {_M} SELECT min(wait) AS seconds FROM m"


def _models(spark, sf_dir: str) -> DataFrame:
    """Suppliers as models: some rest until a moment, some are barred."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("model"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 200).alias("cooled_until"), (F.col("s_suppkey") % 4 == 1).alias("blacklisted"))


_MODEL_SQL = "(SELECT s_suppkey AS ord, s_name AS model, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 200 END AS cooled_until, s_suppkey % 4 = 1 AS blacklisted FROM supplier)"
QUERIES["sch01_models"] = lambda spark, sf_dir: batch.available_models(_models(spark, sf_dir), F.lit(100)).select("ord", "model")
SQL["sch01_models"] = f"WITH a AS (SELECT *, coalesce(cooled_until > 100, FALSE) AS cooling FROM {_MODEL_SQL} WHERE NOT blacklisted OR (cooled_until IS NOT NULL AND cooled_until <= 100)) SELECT ord, model FROM a WHERE NOT cooling OR (SELECT count(*) FROM a WHERE NOT cooling) = 0"
QUERIES["sch04_retry_waits"] = lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", batch.retry_wait(F.expr("case when event_id % 2 = 0 then 'short' else 'long' end"), F.expr("cast(event_id % 25 as int)"), F.expr("case when event_id % 5 = 0 then cast(event_id % 90 as int) end")).alias("seconds"))
SQL["sch04_retry_waits"] = "SELECT event_id, (CASE WHEN event_id % 5 = 0 THEN least(65, event_id % 90 + 2) WHEN event_id % 2 = 0 THEN least(20, 6 + 3 * (event_id % 25)) ELSE least(35, greatest(12, 10 + 4 * (event_id % 25))) END)::INTEGER AS seconds FROM events"


def _history(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp"), F.floor("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") % 2 == 0).alias("downloaded"))


_H = "h AS (SELECT o_orderkey AS id, o_orderdate AS timestamp, floor(o_totalprice)::BIGINT AS size, o_orderkey % 2 = 0 AS downloaded FROM orders)"
QUERIES["src07_newest_first"] = lambda spark, sf_dir: history.bounded(_history(spark, sf_dir)).select("id", "size", "downloaded")
SQL["src07_newest_first"] = f"WITH {_H} SELECT id, size, downloaded FROM h ORDER BY timestamp DESC, id DESC LIMIT 20"
QUERIES["src08_lookup"] = lambda spark, sf_dir: history.lookup(_history(spark, sf_dir), 7).select("id", "size")
SQL["src08_lookup"] = f"WITH {_H} SELECT id, size FROM h WHERE id = 7"
QUERIES["snk04_upsert"] = lambda spark, sf_dir: history.upsert(_history(spark, sf_dir).where("id % 4 > 0"), _history(spark, sf_dir).where("id % 3 = 0").withColumn("size", F.lit(-1).cast("long"))).select("id", "size", "downloaded")
SQL["snk04_upsert"] = f"WITH {_H} SELECT id, CASE WHEN id % 3 = 0 THEN -1 ELSE size END AS size, downloaded FROM h WHERE id % 4 > 0 OR id % 3 = 0"
QUERIES["snk05_delete_and_mark"] = lambda spark, sf_dir: history.mark(history.delete(_history(spark, sf_dir), _history(spark, sf_dir).where("id % 10 = 0")), _history(spark, sf_dir).where("id % 7 = 0")).select("id", "downloaded")
SQL["snk05_delete_and_mark"] = f"WITH {_H} SELECT id, downloaded OR id % 7 = 0 AS downloaded FROM h WHERE id % 10 <> 0"


def _merge_parts(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.col("text").alias("page"))
    return pages.groupBy("doc_id").agg((-F.max("doc_id")).alias("ord")), pages


QUERIES["snk06_merged_pages"] = lambda spark, sf_dir: history.merged_pages(*_merge_parts(spark, sf_dir))
SQL["snk06_merged_pages"] = "SELECT row_number() OVER (ORDER BY -conv_id, turn) AS merged_no, conv_id AS doc_id, turn AS page_no, text AS page FROM conversations"
