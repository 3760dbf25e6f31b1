"""The corpus pipeline: `documents` through quality, near-duplicates, repeats, benchmark leaks and packing.

Each stage takes what the one before has written and kept. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.llm import decontamination, near_duplicates, packing, quality, suffixes
from parchwork.llm._tokens import tokenizer_path
from parchwork.plans.session import materialize, ship

#: The key of a row in the near-duplicate stage.
ROW = "pipeline_row"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, doesn't reject.

    Each row is judged by its text alone, repeated rows alike; a null or empty text counts as empty. Labels with a null
    are left out; with labels of fewer than two grades nothing is rejected. An empty table stays empty.
    """
    ship(spark)
    model = quality.train(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.classify(docs, model).where(quality.kept()).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity of 0.8 or more), one of its least doc_id.

    Rows of one doc_id are judged by their texts, so of equal rows one stays, and of different texts all that are no
    near-duplicates. Rows of null doc_id, and of texts that are null, empty or blank, stay. An empty table stays empty.
    """
    ship(spark)
    told = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if told["n"] == told["ids"]:
        found = near_duplicates.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80)
        return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # rows get a key of their own, written, so that keys stay what they are
    rows = materialize(docs.withColumn(ROW, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    found = near_duplicates.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), width=5, percent=80)
    grouped = found.select(F.col("doc_id").alias(ROW), "component_id").where(f"{ROW} is not null")
    placed = materialize(rows.select(ROW, "doc_id").join(grouped, ROW), "placed")
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", ROW))[ROW].alias("first"))
    gone = placed.join(first, "component_id").where(f"{ROW} <> first").select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document has; n_chars follows, null where it was.

    Documents of which nothing is left go, those that were null or empty before stay. Rows of one doc_id take nothing from
    each other; a null doc_id comes after all others. An empty table stays empty.
    """
    ship(spark)
    left = suffixes.remove_repeats(docs, 50, as_text=True)
    return left.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast("long"))).select(*docs.columns) if "n_chars" in docs.columns else left


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of the benchmark, whether its rows have ids or not.

    Each row is judged by its text alone; a null or empty text holds nothing and stays. Items that are null or without words
    have no window. An empty table stays empty.
    """
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs, items.withColumn("item_id", F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 ids.

    A null or empty text is its end id alone; each row is packed for itself, whatever its doc_id. An empty table gives no rows.
    """
    ship(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("quality", good), ("near_duplicates", distinct), ("suffix_dedup", without_repeats), ("decontamination", without_leaks), ("packing", packed)]

#: SQL has no tokenizer, regression or hash family of these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
