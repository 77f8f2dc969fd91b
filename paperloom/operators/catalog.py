"""Catalogue refresh: dedupe, merge, link and status operators on paper tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from paperloom.functions import text as T

MISSING = "None"

# Marks of a blocked page, of a prevention url and of an error title.
BLOCK_MARKERS = (
    "captcha",
    "verify you are human",
    "not a robot",
    "forbidden",
    "error: 500",
    "this site can’t be reached",
)
PREVENTION_URLS = ("crawlprevention", "europepmc.org/backend")
ERROR_TITLES = ("just a moment", "privacy error", "validate user", "error 500")


def keep_one(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``.

    An aggregate rather than a window: each task keeps one row per key before the
    shuffle, so a key holding a third of the rows costs no more than any other.
    Null keys count as one key; ``keep_keyed`` leaves rows without a key alone.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def has_key(key: str) -> Column:
    """Whether a row has the key at all: neither null nor empty nor the word for missing."""
    return F.coalesce(~F.trim(key).isin("", MISSING), F.lit(False))


def keep_keyed(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the first by ``order``, and all rows that have no key."""
    return keep_one(df.where(has_key(key)), [key], order).unionByName(df.where(~has_key(key)))


def decode_missing(df: DataFrame) -> DataFrame:
    """The word 'None' in string columns becomes null."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(MISSING)) for c in names})


def encode_missing(df: DataFrame, counts: Sequence[str] = ()) -> DataFrame:
    """Null strings become 'None' and null counts 0."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    filled = df.na.fill(MISSING, names)
    return filled.withColumns({c: T.count_or_zero(F.col(c)) for c in counts if c in df.columns})


def combine_first(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Union of keys and columns; a value comes from ``new`` unless it is null there.

    Keys must be unique per side (``keep_keyed``). Rows without a key match nothing: they
    bypass the join, so they neither merge nor meet in one task.
    """
    columns = list(dict.fromkeys([key, *new.columns, *old.columns]))
    n, o = new.where(has_key(key)).alias("n"), old.where(has_key(key)).alias("o")

    def pick(c: str) -> Column:
        sides = [F.col(f"{s}.{c}") for s, df in (("n", new), ("o", old)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    joined = n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer").select(*[pick(c) for c in columns])
    lone = [df.where(~has_key(key)) for df in (new, old)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lone, joined)


def merge_extracted(extracted: DataFrame, text: DataFrame, meta: DataFrame, order: str) -> DataFrame:
    """Extracted text over stored text by doi, or by paper where there is none, then back to exactly
    the papers of ``meta``."""
    sides = extracted, text
    by_doi = [keep_one(df.where(has_key("doi")), ["doi"], F.col(order)) for df in sides]
    by_paper = [keep_one(df.where(~has_key("doi")), ["paperId"], F.col(order)) for df in sides]
    merged = combine_first(*by_doi, "doi").unionByName(combine_first(*by_paper, "paperId"))
    return meta.select("paperId").join(merged, "paperId", "left")


def enrich(papers: DataFrame, specs: DataFrame, counts: Sequence[str], links: Sequence[str]) -> DataFrame:
    """Left join of the enrichment feed; columns the papers already have win, defaults fill the gaps."""
    extra = specs.drop(*[c for c in specs.columns if c in papers.columns and c != "paperId"])
    joined = papers.join(extra, "paperId", "left")
    return joined.na.fill(0, list(counts)).na.fill(MISSING, list(links))


def readable(df: DataFrame) -> DataFrame:
    """Open access, or with a non-empty abstract."""
    return df.where(F.col("isOpenAccess") | (F.col("abstract").isNotNull() & (F.col("abstract") != "")))


def plausible_venue(df: DataFrame) -> DataFrame:
    return df.where(F.length("venue") > 3)


def split_article(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata, text) tables of an article table."""
    text_columns = [
        "paperId", "title", "abstract", "referenceTitles", "openAccessPdf", "isOpenAccess", "status", "doi",
    ]
    return (
        articles.drop("title", "abstract", "status"),
        articles.select(*[c for c in text_columns if c in articles.columns]),
    )


def replace_links(papers: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The snapshot's link where the last segment of a paper's link names a snapshot paper."""
    links = snapshot.select(F.col("paperId").alias("_seg"), F.col("openAccessPdf").alias("_link"))
    joined = papers.withColumn("_seg", T.last_segment(F.col("openAccessPdf"))).join(links, "_seg", "left")
    return joined.withColumn("openAccessPdf", F.coalesce("_link", "openAccessPdf")).drop("_seg", "_link")


def chained_semi(text: DataFrame, kept_meta: DataFrame, key: str = "paperId") -> DataFrame:
    return text.join(kept_meta.select(key), key, "left_semi")


def drop_stored(snapshot: DataFrame, stored: DataFrame, key: str = "title") -> DataFrame:
    """Snapshot records whose key, compared in lower case, is not stored yet."""
    have = stored.select(F.lower(F.col(key)).alias("_k"))
    return snapshot.withColumn("_k", F.lower(F.col(key))).join(have, "_k", "left_anti").drop("_k")


def not_processed(work: DataFrame, done: Sequence[DataFrame], key: str = "paperId") -> DataFrame:
    """Work rows whose key is in none of the done tables."""
    return reduce(lambda w, d: w.join(d.select(key), key, "left_anti"), done, work)


def first_fields(meta: DataFrame) -> DataFrame:
    return meta.select(F.split_part("fieldsOfStudy", F.lit(","), F.lit(1)).alias("field")).distinct()


def overlaps_fields(snapshot: DataFrame, fields: DataFrame) -> DataFrame:
    """Snapshot papers of which any field is in ``fields``."""
    hit = snapshot.select("paperId", F.explode(F.split("fieldsOfStudy", ",")).alias("field")).join(
        fields, "field", "left_semi"
    )
    return snapshot.join(hit.select("paperId"), "paperId", "left_semi")


def of_year(df: DataFrame, year: int) -> DataFrame:
    return df.where(F.col("publicationYear").cast("int") == year)


def remap_status(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.na.replace(dict(mapping), subset=["status"])


def set_status(df: DataFrame, status: str, paper_ids: DataFrame | None = None) -> DataFrame:
    """Sets the status of all rows, or of the listed papers."""
    if paper_ids is None:
        return df.withColumn("status", F.lit(status))
    listed = paper_ids.select("paperId").distinct().withColumn("_hit", F.lit(True))
    changed = F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))
    return df.join(listed, "paperId", "left").withColumn("status", changed).drop("_hit").select(*df.columns)


def route_by_scheme(link: Column) -> Column:
    return F.when(F.startswith(link, F.lit("http")), "http").when(F.startswith(link, F.lit("gs")), "gs")


def blocked_status(
    url: Column,
    html: Column,
    block_markers: Sequence[str] = BLOCK_MARKERS,
    url_markers: Sequence[str] = PREVENTION_URLS,
    title_markers: Sequence[str] = ERROR_TITLES,
) -> Column:
    """The url when the page is a block or error page, else null."""
    title = F.lower(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))
    has = lambda text, marks: reduce(
        lambda a, b: a | b, [F.contains(text, F.lit(m.lower())) for m in marks], F.lit(False)
    )
    blocked = has(F.lower(html), block_markers) | has(url, url_markers) | has(title, title_markers)
    return F.when(blocked, url)


def sufficient_text(text: DataFrame, min_chars: int = 500) -> DataFrame:
    """Main and reference text with the title-and-abstract fallback; papers still too short are dropped.

    Columns: paperId, main_text, ref_text, pdf_extracted, title, abstract.
    """
    body = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(MISSING)), F.lit("")) if c in text.columns else F.lit("")
    fallback = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    filled = lambda c: F.when(F.length(c) < min_chars, fallback).otherwise(c)
    return text.select(
        "paperId",
        filled(body("main_text")).alias("main_text"),
        filled(body("ref_text")).alias("ref_text"),
        (F.length(T.strip(body("main_text"))) > min_chars).alias("pdf_extracted"),
        "title",
        "abstract",
    ).where(F.length("main_text") >= min_chars)


def payload_and_text(meta: DataFrame, text: DataFrame, min_chars: int = 500) -> DataFrame:
    """Metadata joined to sufficient text."""
    return meta.join(sufficient_text(text, min_chars), "paperId", "inner")


def discarded_count(meta: DataFrame, text: DataFrame, min_chars: int = 500) -> DataFrame:
    """How many papers of ``meta`` have too little text."""
    kept = sufficient_text(text, min_chars).select("paperId")
    return meta.join(kept, "paperId", "left_anti").agg(F.count(F.lit(1)).alias("discarded"))
