"""Batch jobs that compose the operators: catalogue refresh, snapshot merge, text processing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from paperloom.functions import text as T
from paperloom.operators import catalog as C
from paperloom.operators.blocks import clean_full_text
from paperloom.operators.chunks import CHUNK_SIZE, chunk_papers, with_role_prefix
from paperloom.operators.embed import Encoder, embed_texts
from paperloom.operators.filters import compile_filters, work_list
from paperloom.sources import feeds

COUNTS = ("citationCount", "influentialCitationCount")
PUSHED = {"extracted": "pdf_pushed", C.MISSING: "abstract_pushed"}


def new_articles(pages: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Landed pages and their enrichment as clean articles, one per doi."""
    papers = feeds.flatten_pages(pages).withColumns(
        {"publicationYear": F.year(F.to_date("publicationDate")), "source": F.lit("s2"), "status": F.lit(None).cast("string")}
    )
    full = C.enrich(papers, feeds.flatten_enrichment(enrichment), ["influentialCitationCount"], ["openAccessPdf"])
    return T.clean_strings(C.keep_keyed(C.readable(full), "doi", F.col("paperId")))


def merge_table(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    """New rows over stored ones by doi, with missing values encoded for storage.

    A stored table may hold a doi twice; its first paper by id is kept. Papers without a
    doi stay, each by itself.
    """
    if stored is not None:
        old = C.keep_keyed(C.decode_missing(stored), "doi", F.col("paperId"))
        new = C.combine_first(new, old, "doi")
    return C.encode_missing(new, COUNTS)


def refresh_catalogue(
    pages: DataFrame, enrichment: DataFrame, stored_meta: DataFrame | None = None, stored_text: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(metadata, text) after an update run. Incomplete pages stop the run."""
    if feeds.incomplete_pages(pages).take(1):
        raise ValueError("pages end before the announced number of papers")
    meta, text = C.split_article(new_articles(pages, enrichment))
    return merge_table(meta, stored_meta), merge_table(text, stored_text)


def merge_snapshot(snapshot: DataFrame, stored_meta: DataFrame, stored_text: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Snapshot papers of the year in fields the catalogue already covers, merged; links point to the snapshot."""
    fresh = C.of_year(C.overlaps_fields(snapshot, C.first_fields(stored_meta)), year)
    fresh = C.keep_keyed(C.keep_keyed(fresh, "title", F.col("paperId")), "doi", F.col("paperId"))
    meta = fresh.drop("title", "abstract", "submitter", "comments", "journal-ref", "report-no", "license", "status")
    text = fresh.select("paperId", "title", "abstract", "openAccessPdf", "isOpenAccess", "status", "doi")
    return (
        C.replace_links(merge_table(meta, stored_meta), snapshot),
        C.replace_links(merge_table(text, stored_text), snapshot),
    )


def extract_text(docs: DataFrame, text: DataFrame, meta: DataFrame, as_of_year: int, with_references: bool = False) -> DataFrame:
    """Cleaned full texts merged into the text table, rows as in ``meta``."""
    cleaned = clean_full_text(docs, with_references, as_of_year).withColumn("status", F.lit("extracted"))
    return C.merge_extracted(cleaned, text, meta, "paperId")


def embed_papers(
    meta: DataFrame,
    text: DataFrame,
    encoder: Callable[[], Encoder],
    chunk_size: int = CHUNK_SIZE,
    max_chunks: int | None = None,
) -> DataFrame:
    """Chunk vectors of all papers with sufficient text, with their payload columns."""
    chunks = chunk_papers(C.payload_and_text(meta, text), chunk_size=chunk_size, max_chunks=max_chunks)
    ready = chunks.withColumn("text", with_role_prefix(F.col("text"), "e5", "document"))
    return embed_texts(ready.drop("main_text", "ref_text", "title", "abstract"), "text", encoder)


def refresh_vectors(
    meta: DataFrame, text: DataFrame, encoder: Callable[[], Encoder], only_new: bool = True, years: Sequence[int] | None = None, **chunking: int
) -> tuple[DataFrame, DataFrame]:
    """(chunk vectors to upsert, text table with advanced status) for the papers still to do.

    Running it again on its own output finds no new work.
    """
    todo = text.where(compile_filters(work_list(only_new)))
    wanted = meta.where(F.col("publicationYear").isin(list(years))) if years else meta
    todo = C.chained_semi(todo, wanted)
    vectors = embed_papers(wanted, todo, encoder, **chunking)
    done = C.remap_status(todo, PUSHED).select("paperId", F.col("status").alias("_new"))
    advanced = text.join(done, "paperId", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    return vectors, advanced.select(*text.columns)
