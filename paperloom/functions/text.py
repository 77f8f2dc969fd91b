"""Scalar string, list, link and date functions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Archive category codes and the field each belongs to.
CATEGORY_FIELDS = {
    "cs": "Computer Science",
    "q-bio": "Biology",
    "q-fin": "Mathematics",
    "stat": "Mathematics",
    "math": "Mathematics",
    "physics": "Physics",
    "astro-ph": "Physics",
    "cond-mat": "Physics",
    "gr-qc": "Physics",
    "hep-ex": "Physics",
    "hep-lat": "Physics",
    "hep-ph": "Physics",
    "hep-th": "Physics",
    "nlin": "Physics",
    "nucl-ex": "Physics",
    "nucl-th": "Physics",
    "quant-ph": "Physics",
    "eess": "Physics",
    "econ": "Mathematics",
    "physics.geo-ph": "Geology",
}
OTHER_FIELD = "Other"
PDF_PREFIX = "gs://arxiv-dataset/arxiv/arxiv/pdf/"
DOI_PREFIX = "10.48550/arXiv."
PUBLIC_LINK_PREFIX = "https://arxiv.org/pdf/"


def strip(c: Column) -> Column:
    """Removes white space of any kind from both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_strings(df: DataFrame) -> DataFrame:
    """Trims every string column and replaces bytes that are not UTF-8; nulls stay null."""
    changed = {
        f.name: F.regexp_replace(F.make_valid_utf8(strip(F.col(f.name))), "�", "")
        for f in df.schema.fields
        if isinstance(f.dataType, StringType)
    }
    return df.withColumns(changed)


def parse_bool(c: Column) -> Column:
    word = F.lower(c.cast("string"))
    return F.when(word == "true", True).when(word == "false", False)


def count_or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("int")


def join_list(items: Column, sep: str = ",") -> Column:
    """Joins a list without its null and empty items; a missing list gives ''."""
    return F.coalesce(F.array_join(F.filter(items, lambda e: e != ""), sep), F.lit(""))


def struct_field_list(structs: Column, field: str) -> Column:
    """One array per field from an array of structs."""
    return F.transform(structs, lambda s: s[field])


def first_id(ids: Column) -> Column:
    """DOI, else archive id, else corpus id, else ''; 'None' when there is no id record."""
    given = F.coalesce(
        F.nullif(ids["DOI"], F.lit("")),
        F.nullif(ids["ArXiv"], F.lit("")),
        F.nullif(ids["CorpusId"].cast("string"), F.lit("")),
        F.lit(""),
    )
    return F.when(ids.isNull(), F.lit("None")).otherwise(given)


def reference_ids(refs: Column) -> Column:
    return join_list(struct_field_list(refs, "paperId"), ";")


def reference_titles(refs: Column) -> Column:
    return join_list(F.transform(refs, lambda r: F.replace(r["title"], F.lit(";"), F.lit(","))), ";")


def map_categories(codes: Column) -> Column:
    """Space-separated codes to sorted distinct fields: exact code, else its part before '.', else Other."""
    table = F.create_map(*[F.lit(x) for pair in CATEGORY_FIELDS.items() for x in pair])
    field = lambda x: F.coalesce(table[x], table[F.split_part(x, F.lit("."), F.lit(1))], F.lit(OTHER_FIELD))
    parts = F.filter(F.split(codes, r"\s+"), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(F.transform(parts, field))), ",")


def pdf_link(paper_id: Column, versions: Column) -> Column:
    last = F.element_at(versions, -1)["version"]
    return F.concat(
        F.lit(PDF_PREFIX), F.split_part(paper_id, F.lit("."), F.lit(1)), F.lit("/"), paper_id, last, F.lit(".pdf")
    )


def author_commas(authors: Column) -> Column:
    return F.regexp_replace(authors, r"\s+and\s+", ", ")


def first_version_date(created: Column) -> Column:
    """The day of a mail-style date such as 'Mon, 2 Apr 2007 19:18:42 GMT'.

    The day is read as written, so the session's time zone cannot move it; the weekday
    carries no information and is not read.
    """
    day = F.regexp_extract(created, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    return F.to_date(F.try_to_timestamp(day, F.lit("d MMM yyyy")))


def default_doi(doi: Column, paper_id: Column) -> Column:
    return F.coalesce(doi, F.concat(F.lit(DOI_PREFIX), paper_id))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def public_link(link: Column) -> Column:
    """A bucket link to the public page of the same paper, without extension and version."""
    stem = F.regexp_replace(F.regexp_extract(link, r"([^/]+)\.pdf$", 1), r"v\d+$", "")
    return F.when(F.startswith(link, F.lit("gs://")), F.concat(F.lit(PUBLIC_LINK_PREFIX), stem)).otherwise(link)


def force_https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def version_fallbacks(link: Column, tries: int | None = None) -> Column:
    """The link, then the same link with lower versions down to v1, ``tries`` links at most where that is given."""
    version = F.try_cast(F.regexp_extract(link, r"v(\d+)\.pdf$", 1), "int") if hasattr(F, "try_cast") else (
        F.regexp_extract(link, r"v(\d+)\.pdf$", 1).try_cast("int")
    )
    last = F.greatest(version - 1, F.lit(0))
    steps = F.sequence(F.lit(0), last if tries is None else F.least(F.lit(tries - 1), last))
    lower = lambda k: F.regexp_replace(link, F.lit(r"v\d+\.pdf$"), F.concat(F.lit("v"), version - k, F.lit(".pdf")))
    return F.when(version.isNull(), F.array(link)).otherwise(F.transform(steps, lower))


def months_before(date: Column, months: int) -> Column:
    return F.add_months(date, -months)


def year_range(first: Column, last: Column) -> Column:
    return F.sequence(first, last)


def drop_glyph_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"\(cid:[^)]+\)", "")


def blank_number_lines(text: Column) -> Column:
    """Each line trimmed; lines of digits only become blank."""
    line = lambda x: F.when(F.rlike(strip(x), F.lit("^[0-9]+$")), F.lit("")).otherwise(strip(x))
    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def enough_letters(text: Column, more_than: int = 5) -> Column:
    return letter_count(text) > more_than


def normal_words(text: Column) -> Column:
    """How many space-separated words hold neither a digit nor an upper-case letter."""
    return F.size(F.filter(F.split(strip(text), " "), lambda w: ~F.rlike(w, F.lit(r"[\p{Nd}\p{Lu}]"))))


def undo_initial_dots(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_])([A-Z][a-z]*)\.", "$1")


def underscore_spaces(title: Column) -> Column:
    return F.regexp_replace(title, r"\s+", "_")


def find_section(text: Column, start: str, ends: list[str], max_chars: int) -> Column:
    """Text from a heading up to the nearest of the next headings, at most ``max_chars`` long; '' without the heading."""
    low = F.lower(text)
    at = F.locate(start, low)
    after = at + len(start)
    tail = F.substring(text, after, F.length(text))
    low_tail = F.lower(tail)
    stops = [F.nullif(F.locate(e, low_tail), F.lit(0)) for e in ends]
    stop = F.least(*stops) if len(stops) > 1 else stops[0]
    size = F.least(F.coalesce(stop - 1, F.length(tail)), F.lit(max_chars))
    return F.when(at > 0, F.substring(tail, F.lit(1), size)).otherwise(F.lit(""))


def clean_lines(text: Column, censored: list[str], more_than_words: int = 3) -> Column:
    """Lines with enough words and none of the censored ones."""
    banned = F.array(*[F.lit(w.lower()) for w in censored])

    def keep(line: Column) -> Column:
        ws = F.filter(F.split(F.lower(line), r"\s+"), lambda w: w != "")
        return (F.size(ws) > more_than_words) & ~F.arrays_overlap(ws, banned)

    return F.filter(F.split(text, "\n"), keep)
