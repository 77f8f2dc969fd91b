"""Tables in the shared folder, and the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.session import new_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table below ``spark.checkpoint.dir`` and reads it again.

    It cuts the lineage, so that a lost executor repeats no earlier step, and gives the
    planner the table's true size.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of the key; the same rows every time.

    Rows far above the hash that is needed are left out where they are read, so what is sent to
    be ordered is a few times ``n`` rows, however many tasks read the table.
    """
    total, slots = df.count(), 1 << 30
    hashed = F.pmod(F.xxhash64(key), F.lit(slots))
    if total > 4 * n:
        share = df.where(hashed < F.lit(int(slots * 4 * n / total)))
        # rows of few keys may all lie outside the share
        df = share if share.count() >= n else df
    return df.orderBy(hashed, *df.columns).limit(n)
