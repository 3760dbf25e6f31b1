"""Session plumbing: shipping the package to executors and cutting lineage through shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_folder: list[str] = []


#: Rows in a batch between Spark and Python, where the session has the default: rows are whole documents here.
BATCH_SETTING, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, and keep batches of documents small."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="parchwork-"), "parchwork.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as there are cores, if it has fewer: a small table is often one file of one row group,
    and what is computed on each text costs more than moving it once. A table of more partitions stays where it is."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # its partitions are the shuffle's, and to ask for them would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Only where the session names none and runs on one machine (tests) a local folder stands in;
    on a cluster executors would write to disks of their own, so that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(Path(tempfile.mkdtemp(prefix="parchwork-shared-")).as_uri())
    return _own_folder[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/parchwork/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there.

    A lost executor costs no recomputation of what stands before, and the table's true
    size is known to the planner of what comes after.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialize` has written, once all that reads them has been written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
