"""Cutting lineage before a stage that reads its input several times.

What an operator writes lies in one folder per application below
``spark.checkpoint.dir``; :func:`release` removes it when the results have been used.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Size up to which a table is shared with every task.
SHARED_BYTES = 64 * 1024 * 1024
# Size of what a Python worker gets at once: rows alone do not bound it, since texts are of any length.
BATCH_BYTES = 4 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; on a cluster it must come from the session.

    ``spark.checkpoint.dir`` names a folder that every executor can reach.  A
    private folder is made only for a local master, where driver and executors
    are the same machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="mildtext-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, on storage that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/mildtext-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; DataFrames that read them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> str:
    """Send this package to the executors, for jobs whose workers do not have it on their path.

    Functions that run in Python workers are looked up by name there.  Once per session;
    ``spark-submit --py-files`` with the same zip does as well.
    """
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='mildtext-zip-')}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    return archive


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of this session get batches of :data:`BATCH_BYTES`, unless the session says otherwise."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(BATCH_BYTES))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once, so that later passes re-read it; ids and numbers, not texts.

    The copy is parquet on shared storage: it survives lost executors, and later
    passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Size of a table, by reading it: 16 bytes a value, and the text of strings and nested values."""
    per_row = F.lit(16 * len(df.columns)).cast("bigint")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith(("array", "struct", "map")):
            column, kind = F.to_json(F.struct(column)), "string"
        if kind == "string":
            per_row = per_row + F.coalesce(F.octet_length(column), F.lit(0))
    return df.agg(F.sum(per_row)).first()[0] or 0


def sized(df: DataFrame, limit: int = SHARED_BYTES) -> DataFrame:
    """A written table with a join hint out of its true size: broadcast, or merge beyond the limit.

    Spark's own estimate takes an exploded or aggregated text for about as large
    as the compressed file, and would broadcast tables many times over its limit.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df.hint("merge")


def shared(df: DataFrame) -> DataFrame:
    """``df`` written once and then :func:`sized`; for tables per language, class or cluster."""
    return sized(materialize(df))
