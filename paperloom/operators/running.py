"""Running totals that never put one whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.session import stored


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``_bin``, the number of the row's part in a range partition by key and order; it grows with the order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in (*keys, *order)])
    return stored(dealt.withColumn("_bin", F.spark_partition_id().cast("long")), "ranges")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    bin_by: Column | None,
    name: str,
    newest_first: bool = False,
    how: str = "sum",
) -> DataFrame:
    """Cumulative sum (or maximum) of ``value`` per key along ``order``.

    ``bin_by`` is a coarse position that grows with the order (an hour, a block of
    turns). Totals per bin are small and give each bin its starting offset; the exact
    sum then runs inside (key, bin) groups, so a hot key is spread over its bins. Without
    ``bin_by`` the bins are the parts of a range partition by key and order: they hold like
    numbers of rows wherever these lie, so one key with all rows, or with all of them in one
    hour, is still spread over all tasks. The parts are written once, as every later step
    must see the same ones; rows equal in key and order lie in one.
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    flip = (lambda c: F.desc(c)) if newest_first else (lambda c: F.asc(c))
    binned = ranged(df.withColumn("_v", value), keys, order) if bin_by is None else df.withColumn("_bin", bin_by).withColumn("_v", value)
    sums = binned.groupBy(*keys, "_bin").agg(combine("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy(flip("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bin").alias("_k_bin"),
        combine("_s").over(before).alias("_offset"),
    )
    match = F.col("_bin").eqNullSafe(F.col("_k_bin"))
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"_k_{k}")) & match
    inside = (
        Window.partitionBy(*keys, "_bin")
        .orderBy(*[flip(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = combine("_v").over(inside)
    total = F.coalesce(F.col("_offset"), F.lit(0)) + here if how == "sum" else F.greatest("_offset", here)
    return binned.join(offsets, match, "inner").withColumn(name, total).select(*df.columns, name)
