"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from mildtext.session import scratch

# What a word is for every operator here: a run of anything but blank, tab, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as parquet in the shared checkpoint folder.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
    Meant for narrow tables of ids and numbers.  What was shuffled on the way is not
    needed any more; Spark removes it when the driver's collector meets the plan.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables of :func:`written` (or unions of them) that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``; at the end of a task, what it no longer holds goes back to the system.

    Workers are used again and wait beside the executor's JVM; what Arrow and the C library keep
    for later (over 100 MB a worker) would count all the while.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return task


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: a task holds the Python strings of one at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def squeezed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the text as ``z`` (binary, null stays null): before a shuffle, a text should be small.

    Other columns come under the names ``c0``, ``c1``, ... of their places.
    """
    fields = docs.schema.fields
    at = docs.columns.index(text_col)
    names = [f"c{n}" for n in range(len(fields)) if n != at]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches):
            z = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in range(len(fields)) if n != at], pa.array(z, pa.binary())], [*names, "z"]
            )

    shape = "".join(f"c{n} {f.dataType.simpleString()}, " for n, f in enumerate(fields) if n != at)
    return docs.mapInArrow(run, shape + "z binary")


def opened(z: bytes | None) -> str | None:
    """The text of :func:`squeezed`."""
    return None if z is None else zstandard.decompress(z).decode("utf-8", "surrogatepass")


def words(text: str) -> list[str]:
    """Words of a text by :data:`WORD`; ``str.split()`` would also cut at other white space."""
    for c in "\t\n\v\f\r":
        if c in text:
            text = text.replace(c, " ")
    found = text.split(" ")
    return [w for w in found if w] if "" in found else found
