"""Evaluation records on disk: a log of JSON batches, and a summary CSV.

Saving appends a batch and changes nothing else.  Spark's mark of success makes a batch part of the
log, so an interrupted save is never read; batches have a sequence number and a name of their
own, so two writers do not meet.  Reading takes, for every experiment, the records of its
last batch.  Compaction writes what is read as one base and then, as one small new file, the names of
what the base stands for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mildtext.sources import files

CI = "struct<mean: double, lower: double, upper: double>"

# A field that is null in every file would be inferred as string, so the schema is explicit.
RESULT_SCHEMA = f"""
    experiment string, lang string, language string, method string, n_shots int, n_samples bigint,
    toxicity_mean double, sta double, toxicity_pct_below_threshold double,
    similarity_mean double, similarity_pct_above_threshold double,
    fluency_ppl_mean double, fluency_norm_mean double, bleu double, chrf double,
    j2_score double, j3_score double,
    toxicity_ci {CI}, similarity_ci {CI}, j2_ci {CI},
    lora_rank int, lora_alpha int, lora_modules string, vary string,
    train_loss double, trainable_params bigint, checkpoint_size_mb double
"""


BATCH = r"(batch-\d+-[0-9a-f]+)/"


def _log(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Folders that are read, and those that a base stands for."""
    names = files.names(spark, path)
    bases = [n.removesuffix(".covers") for n in names if n.endswith(".covers")]
    covered = {c for b in bases for c in files.read(spark, f"{path}/{b}.covers").split()}
    finished = [n for n in names if n.startswith("batch-") and n not in covered and files.exists(spark, f"{path}/{n}/_SUCCESS")]
    return [*finished, *[b for b in bases if b not in covered]], sorted(covered.intersection(names))


def _next(spark: SparkSession, path: str) -> str:
    """Number and own name for a folder behind all there are, finished or not."""
    numbers = [int(n.split("-")[1]) for n in files.names(spark, path) if n.startswith(("batch-", "base-")) and not n.endswith(".covers")]
    return f"{max(numbers, default=0) + 1:012d}-{uuid.uuid4().hex}"


def save_results(metrics: DataFrame, path: str) -> None:
    """Append records as a batch of JSON lines; Spark writes its parts in parallel.

    An experiment that is saved again replaces its records when they are read; all others stay.
    Of two saves at the same time, that with the greater name counts as the later one.
    """
    name = f"batch-{_next(metrics.sparkSession, path)}"
    metrics.write.option("ignoreNullFields", "false").json(f"{path}/{name}")


def _latest(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    reader = spark.read.schema(f"{RESULT_SCHEMA}, _batch string")
    rows = reader.json([f"{path}/{f}" for f in folders]).withColumns(
        {"_file": F.col("_metadata.file_name"), "_batch": F.coalesce("_batch", F.regexp_extract(F.col("_metadata.file_path"), BATCH, 1))}
    )
    last = F.max("_batch").over(Window.partitionBy("experiment"))
    return rows.withColumn("_last", last).filter(F.col("_batch") == F.col("_last")).drop("_last")


def load_results(
    spark: SparkSession, path: str, glob: str | None = None, indented: bool = False
) -> DataFrame:
    """All records below ``path`` with the base name of their file.

    A log as :func:`save_results` writes it gives the latest records of every experiment; any other
    folder, all of its JSON lines.  ``indented`` reads files with one object over several lines, such
    as ``*_eval.json``.
    """
    folders = [] if glob or indented else _log(spark, path)[0]
    if folders:
        return _latest(spark, path, folders).drop("_batch")
    reader = spark.read.schema(RESULT_SCHEMA).options(multiLine=indented, recursiveFileLookup=True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path).withColumn("_file", F.col("_metadata.file_name"))


def compact_results(spark: SparkSession, path: str) -> None:
    """Put the records that count into one base; what it stands for is not read any more.

    Batches that are saved meanwhile stay batches.  Until the last small file is there, nothing has changed.
    """
    folders, _ = _log(spark, path)
    if len(folders) > 1:
        name = f"base-{_next(spark, path)}"
        _latest(spark, path, folders).drop("_file").write.option("ignoreNullFields", "false").json(f"{path}/{name}")
        files.create(spark, f"{path}/{name}.covers", "\n".join(folders))


def remove_covered(spark: SparkSession, path: str) -> None:
    """Delete what bases stand for; nothing may read the log at the time that began before the compaction."""
    for name in _log(spark, path)[1]:
        files.remove(spark, f"{path}/{name}")


def save_summary(summary: DataFrame, path: str) -> None:
    """CSV with a header; a folder of part files in the order of ``summary``."""
    summary.write.mode("overwrite").option("header", True).csv(path)
