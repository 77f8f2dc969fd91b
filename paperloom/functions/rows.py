"""Row-local helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    The optimizer merges neighbouring projections. When a column is then read inside a
    lambda, its whole expression moves into the lambda and runs once per element. A
    one-element ``inline`` stands between the two projections and keeps them apart.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
