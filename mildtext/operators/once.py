"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns which the optimizer must not copy into the steps above.

    Filters on a computed column are pushed down as copies of its expression, to
    the scan and into joins.  That is right for cheap expressions, but a pattern
    over a long text would run for every copy.  Behind a generator of one row
    the columns are plain attributes: computed once, without a shuffle.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    keep = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(row)))
