"""Datasets kept on storage, and built anew when what they were built from has changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from mildtext.sources import files


def fingerprint(spark: SparkSession, sources: Iterable[DataFrame], arguments: dict | None = None) -> tuple[str, dict]:
    """A digest of the files (names, lengths, times of change) and schemas of ``sources`` and of ``arguments``, and
    what went into it.  ``arguments`` must be what JSON can hold."""
    told = {
        "sources": [{"files": [files.stamp(spark, f) for f in sorted(s.inputFiles())], "schema": s.schema.jsonValue()} for s in sources],
        "arguments": arguments or {},
    }
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest(), told


def cached_table(
    spark: SparkSession, path: str, build: Callable[[], DataFrame],
    sources: Iterable[DataFrame] = (), arguments: dict | None = None,
) -> DataFrame:
    """What ``build`` gives, kept below ``path`` as parquet for these sources and arguments.

    A manifest names the folder of a finished table.  It is written last, as a new file: a table
    that was half written has none and is never read, and of two writers the first one's table
    stays.  Other files, lengths, times, schemas or arguments have another manifest, so a change
    builds anew; older tables stay until :func:`forget`.
    """
    name, told = fingerprint(spark, sources, arguments)
    manifest = f"{path}/{name}.manifest"
    if not files.exists(spark, manifest):
        folder = f"table-{uuid.uuid4().hex}"
        build().write.parquet(f"{path}/{folder}")
        files.create(spark, manifest, json.dumps({"folder": folder, **told}))
    return spark.read.parquet(f"{path}/{json.loads(files.read(spark, manifest))['folder']}")


def forget(spark: SparkSession, path: str, sources: Iterable[DataFrame] = (), arguments: dict | None = None) -> None:
    """Remove all tables below ``path`` but that of these sources and arguments, unfinished ones too.

    Nothing may read or build tables there at the time.
    """
    keep = f"{fingerprint(spark, sources, arguments)[0]}.manifest"
    names = files.names(spark, path)
    kept = {keep, json.loads(files.read(spark, f"{path}/{keep}"))["folder"]} if keep in names else set()
    for name in names:
        if name not in kept:
            files.remove(spark, f"{path}/{name}")
