"""The operators of this folder as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parchwork.llm import chat, conversation_repair, decontamination, html_extraction, language_id, near_duplicates, packing, periodic_runs, quality, sharding, suffixes, token_files, topk
from parchwork.plans.session import ship

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_html_extraction": html_extraction.op2_html_extraction,
    "op3_token_files": token_files.op3_token_files,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_near_duplicates": near_duplicates.op5_near_duplicates,
    "op6_chat": chat.op6_chat,
    "op7_top_k": topk.op7_top_k,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_sharding": sharding.op10_sharding,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_language_id": language_id.op13_language_id,
}

_ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE_SQL,
    "op5_near_duplicates": near_duplicates.ORACLE_SQL,
    "op6_chat": chat.ORACLE_SQL,
    "op7_top_k": topk.ORACLE_SQL,
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(q) for name, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
