"""Parquet and CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.operators.filters import compile_filters

ROWS_PER_FILE = 10_000
YEAR = "publicationYear"


def scan(spark: SparkSession, path: str, filters: Sequence[tuple] | None = None, schema: str | None = None) -> DataFrame:
    """A parquet file or folder under a filter list; the filters reach the reader. A missing path raises."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).where(compile_filters(filters))


def save(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, compression: str = "snappy", mode: str = "overwrite") -> None:
    """Part files of bounded length. An overwrite leaves no old part behind."""
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", compression).mode(mode).parquet(path)


def save_by_year(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.partitionBy(YEAR).mode(mode).parquet(path)


def load_years(spark: SparkSession, path: str, years: Sequence[int] | None = None, filters: Sequence[tuple] | None = None) -> DataFrame:
    """The given years of a year-partitioned table, or every partition that is named by four digits."""
    table = spark.read.parquet(path)
    wanted = F.col(YEAR).isin(list(years)) if years else F.col(YEAR).cast("string").rlike("^[0-9]{4}$")
    return table.where(wanted).where(compile_filters(filters))


def row_count_mismatch(meta: DataFrame, text: DataFrame) -> DataFrame:
    """One row when the two tables differ in length, else none."""
    side = lambda df, n: df.select(F.lit(n).alias("n"))
    both = side(meta, 1).unionByName(side(text, -1))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("difference")).where(F.col("difference") != 0)


def load_pair(
    spark: SparkSession, meta_path: str, text_path: str, years: Sequence[int] | None = None, filters: Sequence[tuple] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Metadata and text of the same papers: text is restricted to the ids that pass the metadata filters."""
    meta = load_years(spark, meta_path, years, filters)
    text = load_years(spark, text_path, years).join(meta.select("paperId"), "paperId", "left_semi")
    if row_count_mismatch(meta, text).take(1):
        raise ValueError("metadata and text differ in length")
    return meta, text


def with_fallback(text: DataFrame, pristine: DataFrame, key: str = "paperId") -> DataFrame:
    """Worked-on text rows, and pristine rows for the papers without one."""
    return text.unionByName(pristine.join(text.select(key), key, "left_anti"), allowMissingColumns=True)


def concat_subsets(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def save_subset(frames: Sequence[DataFrame], base: str, name: str) -> None:
    save(concat_subsets(frames), f"{base}/{name}")


def sample_rows(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The first rows by key, for a sample file."""
    return df.orderBy(key).limit(n)


def save_csv_sample(df: DataFrame, key: str, path: str, n: int = 100) -> None:
    sample_rows(df, key, n).coalesce(1).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path)


def save_pair(text: DataFrame, meta: DataFrame, folder: str) -> None:
    """Text and metadata of one batch; refuses a pair whose paperIds do not align."""
    left, right = text.select("paperId").alias("l"), meta.select("paperId").alias("r")
    lone = left.join(right, F.col("l.paperId") == F.col("r.paperId"), "full_outer").where(
        F.col("l.paperId").isNull() | F.col("r.paperId").isNull()
    )
    if lone.take(1):
        raise ValueError("text and metadata hold different papers")
    save(text, f"{folder}/text", mode="append")
    save(meta, f"{folder}/metadata", mode="append")
