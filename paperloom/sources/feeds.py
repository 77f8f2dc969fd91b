"""Metadata feeds landed as JSON: the archive snapshot, API pages and enrichment records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom.functions import text as T
from paperloom.operators.catalog import keep_keyed, plausible_venue
from paperloom.sources import schemas

SNAPSHOT_DAYS = 7


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SNAPSHOT).json(path)


def is_fresh(files: DataFrame, now: Column | None = None, days: int = SNAPSHOT_DAYS) -> Column:
    """Whether the newest file of a table read with ``_metadata`` is younger than ``days``, as a scalar."""
    newest = files.agg(F.max("_metadata.file_modification_time").alias("t"))
    limit = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return newest.select((F.col("t") >= limit).alias("fresh"))


def load_snapshot(spark: SparkSession, json_path: str, parquet_path: str) -> DataFrame:
    """The parquet copy of the snapshot when it is fresh, else a new copy made from the JSON lines."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(parquet_path)
        fresh = is_fresh(stored).first()["fresh"]
    except AnalysisException:
        fresh = False
    if not fresh:
        normalise_snapshot(read_snapshot(spark, json_path)).write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def normalise_snapshot(raw: DataFrame) -> DataFrame:
    """Snapshot records in the catalogue's columns."""
    published = T.first_version_date(F.col("versions")[0]["created"])
    return raw.select(
        F.col("id").alias("paperId"),
        "title",
        "abstract",
        "submitter",
        "comments",
        "journal-ref",
        "report-no",
        "license",
        T.author_commas(F.col("authors")).alias("authorName"),
        F.lit(None).cast("string").alias("authorId"),
        T.map_categories(F.col("categories")).alias("fieldsOfStudy"),
        T.pdf_link(F.col("id"), F.col("versions")).alias("openAccessPdf"),
        F.lit("arXiv.org").alias("venue"),
        F.lit("arxiv.org").alias("venue_lower"),
        F.lit(True).alias("isOpenAccess"),
        F.lit(None).cast("int").alias("citationCount"),
        F.lit(None).cast("int").alias("influentialCitationCount"),
        F.date_format(published, "yyyy-MM-dd").alias("publicationDate"),
        F.year(published).alias("publicationYear"),
        F.lit("arXiv").alias("source"),
        F.lit(None).cast("string").alias("status"),
        T.default_doi(F.col("doi"), F.col("id")).alias("doi"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed response pages, one row per page."""
    return spark.read.option("multiLine", True).schema(schemas.API_PAGE).json(path)


def flatten_pages(pages: DataFrame) -> DataFrame:
    """One row per paper: nested authors to lists, papers without authors or a plausible venue dropped,
    one per title."""
    rows = pages.select(F.inline("data")).where(F.col("authors").isNotNull() & (F.size("authors") > 0))
    rows = plausible_venue(keep_keyed(rows, "title", F.col("paperId")))
    return rows.select(
        "paperId",
        "title",
        "abstract",
        "venue",
        F.lower("venue").alias("venue_lower"),
        T.count_or_zero(F.col("citationCount")).alias("citationCount"),
        T.join_list(F.col("fieldsOfStudy")).alias("fieldsOfStudy"),
        "publicationDate",
        T.join_list(T.struct_field_list(F.col("authors"), "authorId")).alias("authorId"),
        T.join_list(T.struct_field_list(F.col("authors"), "name")).alias("authorName"),
    )


def incomplete_pages(pages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per run (or one in all) whose pages end before ``total`` papers were seen, or end twice."""
    seen = pages.groupBy(*keys).agg(
        F.coalesce(F.sum(F.size("data")), F.lit(0)).alias("seen"),
        F.max("total").alias("total"),
        F.count_if(F.col("token").isNull()).alias("last_pages"),
    )
    return seen.where((F.col("seen") < F.col("total")) | (F.col("last_pages") > 1))


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ENRICHMENT).json(path)


def flatten_enrichment(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("paperId").isNotNull()).select(
        "paperId",
        F.col("openAccessPdf.url").alias("openAccessPdf"),
        T.first_id(F.col("externalIds")).alias("doi"),
        T.reference_ids(F.col("references")).alias("referenceIds"),
        T.reference_titles(F.col("references")).alias("referenceTitles"),
        T.count_or_zero(F.col("influentialCitationCount")).alias("influentialCitationCount"),
        "isOpenAccess",
    )
