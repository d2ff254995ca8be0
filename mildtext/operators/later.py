"""Rows that are not the first of their key, out of one sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mildtext.session import materialize


def one_key(columns: list[str]) -> Column:
    """Columns as one text that is the same for equal values only; null equals null."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat(*parts)


def later_rows(rows: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """``ids`` of all rows but the one with the least ``ids`` of each combination of ``keys``, nulls being equal.

    Rows are ranged over the tasks by key and ids, so one key, however frequent, is spread over
    many tasks, and a row is a later one if the row before it has its key.  Only the first row of
    a task needs its neighbour's last key: two rows per task decide those.  One shuffle of keys and
    ids, no join.  Rows with equal ids and keys are all but one given, too.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.select(*ids).schema.fields}
    keyed = rows.select(one_key(keys).alias("key"), *ids)
    ordered = keyed.repartitionByRange("key", *ids).sortWithinPartitions("key", *ids)
    names = ["part", "kind", "key", *ids]
    later, head, tail = 0, 1, 2

    def told(kind: int, part: int, rows: pa.RecordBatch, with_key: bool) -> pa.RecordBatch:
        n = rows.num_rows
        key = rows.column(0) if with_key else pa.nulls(n, pa.string())
        fixed = [pa.array([part] * n, pa.int64()), pa.array([kind] * n, pa.int32()), key.cast(pa.string())]
        return pa.RecordBatch.from_arrays([*fixed, *[rows.column(1 + at) for at in range(len(ids))]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0)
            same = pc.equal(key.slice(1), key.slice(0, len(key) - 1))
            if last is None:
                yield told(head, part, batch.slice(0, 1), True)
            elif last.column(0)[0] == key[0]:
                yield told(later, part, batch.slice(0, 1), False)
            yield told(later, part, batch.slice(1).filter(same), False)
            last = batch.slice(len(key) - 1)
        if last is not None:
            yield told(tail, part, last, True)

    ddl = "part bigint, kind int, key string, " + ", ".join(f"`{c}` {k}" for c, k in fields.items())
    found = materialize(ordered.mapInArrow(run, ddl))
    # two rows per task
    edges = found.filter(F.col("kind") > later)
    before = F.lag("key").over(Window.orderBy("part", "kind"))
    joined = edges.withColumn("before", before).filter((F.col("kind") == head) & (F.col("key") == F.col("before")))
    return found.filter(F.col("kind") == later).select(*ids).unionByName(joined.select(*ids))
