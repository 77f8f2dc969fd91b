"""Text blocks of extracted documents.

A document's serialised text sits in one row, so parsing, body-font detection and
reference-section search run on arrays inside that row and need no shuffle. The block
table form, one row per block, serves margins and counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions import text as T
from paperloom.functions.rows import hold

# Block marker, reference headings, look-ahead and thresholds.
BLOCK_HEAD = "\n**BLOCK**fs==% .1f**p==% .1f**b==% .1f**t==% .1f**l==% .1f**r==% .1f**\n"
BLOCK_SPLIT = r"\*\*BLOCK\*\*fs=="
REF_HEADINGS = ("references", "References", "REFERENCES", "Literature Cited")
LOOK_AHEAD = 20
FIRST_YEAR = 1950
MARGINS = ("bottom", "top", "left", "right")
MARGIN_SHARE = 0.02
MARGIN_WORDS = 10
BODY_SHARE = 0.95
MIN_REF_BLOCKS = 5
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def raw_blocks(blocks: DataFrame) -> DataFrame:
    """Cleans block text and keeps blocks with more than five letters, with their word count."""
    cleaned = T.drop_glyph_marks(T.strip(T.blank_number_lines(F.col("content"))))
    return (
        blocks.withColumn("content", cleaned)
        .where(T.enough_letters(F.col("content")))
        .withColumn("nwords", F.size(F.split("content", " ")))
    )


def margin_limits(blocks: DataFrame, key: str) -> DataFrame:
    """Per document the low quantile of each margin, every block weighted by its words."""
    return blocks.groupBy(key).agg(
        *[F.percentile(m, F.lit(MARGIN_SHARE), F.col("nwords")).alias(f"{m}_limit") for m in MARGINS]
    )


def inside_margins(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks clear of all four margin limits, or long enough to be body text anyway."""
    joined = blocks.join(margin_limits(blocks, key), key)
    clear = reduce(lambda a, b: a & b, [F.col(m) > F.col(f"{m}_limit") for m in MARGINS])
    return joined.where(clear | (F.col("nwords") > MARGIN_WORDS)).select(*blocks.columns)


def serialise(blocks: DataFrame, key: str) -> DataFrame:
    """One text per document: a header of size, page and margins before each block."""
    head = F.format_string(
        BLOCK_HEAD,
        *[F.col(c).cast("double") for c in ("fontsize", "page", *MARGINS)],
    )
    rows = blocks.select(key, F.struct("block_idx", F.concat(head, F.col("content")).alias("t")).alias("s"))
    return rows.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "").alias("full_text")
    )


def parse_blocks(full_text: Column) -> Column:
    """Serialised text as an array of typed blocks; pieces with an unreadable header are skipped."""
    pieces = F.split(full_text, BLOCK_SPLIT)
    body = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def block(piece: Column) -> Column:
        parts = F.split(piece, r"\*\*", 7)
        number = lambda k: F.trim(F.element_at(F.split(F.get(parts, F.lit(k)), "=="), -1)).try_cast("double")
        content = F.element_at(parts, -1)
        return F.struct(
            number(0).alias("fontsize"),
            number(1).alias("page"),
            number(2).alias("bottom"),
            number(3).alias("top"),
            number(4).alias("left"),
            number(5).alias("right"),
            T.normal_words(content).alias("nwords"),
            content.alias("content"),
        )

    names = ("fontsize", "page", *MARGINS)
    readable = lambda b: reduce(lambda x, y: x & y, [b[n].isNotNull() for n in names])
    return F.filter(F.transform(body, block), readable)


def _mode(values: Column, weight) -> Column:
    """The value with the largest total weight, the first seen on a tie."""
    distinct = F.array_distinct(F.transform(values, lambda b: b["fontsize"]))
    total = lambda f: F.aggregate(
        values, F.lit(0).cast("bigint"), lambda s, b: s + F.when(b["fontsize"] == f, weight(b)).otherwise(0)
    )
    scored = F.transform(distinct, lambda f, i: F.struct(total(f).alias("n"), (-i).alias("i"), f.alias("f")))
    return F.array_max(scored)["f"]


def join_lines(text: Column) -> Column:
    """Line breaks to spaces; a final one is dropped."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK, " ")


def body_font(blocks: Column, whole_document: Column, max_sizes: int | None = None) -> Column:
    """Most frequent font size over normal words in the first half of the pages.

    0 without normal words, or with more than ``max_sizes`` sizes where that is given. When the first half has none,
    the whole document decides if ``whole_document`` holds, else 0.
    """
    worded = F.filter(blocks, lambda b: b["nwords"] > 0)
    last_page = F.array_max(F.transform(worded, lambda b: b["page"]))
    early = F.filter(worded, lambda b: b["page"] <= F.floor(last_page / 2))
    sizes = F.size(F.array_distinct(F.transform(worded, lambda b: b["fontsize"])))
    mode = _mode(early, lambda b: b["nwords"].cast("bigint"))
    anywhere = F.when(whole_document, _mode(worded, lambda b: b["nwords"].cast("bigint")))
    found = F.coalesce(mode, anywhere, F.lit(0.0))
    none = F.size(worded) == 0
    return F.when(none if max_sizes is None else none | (sizes > max_sizes), F.lit(0.0)).otherwise(found)


def total_words(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("bigint"), lambda s, b: s + b["nwords"])


def year_pattern(first: int, last: int) -> str:
    """A pattern for any year of the range, one alternative per decade."""
    decades: dict[int, list[int]] = {}
    for y in range(first, last + 1):
        decades.setdefault(y // 10, []).append(y % 10)
    return "|".join(f"{d}[{min(ys)}-{max(ys)}]" for d, ys in decades.items())


def _has_year(text: Column, as_of_year: int) -> Column:
    return F.rlike(text, F.lit(year_pattern(FIRST_YEAR, as_of_year - 1)))


def _is_heading(line: Column) -> Column:
    head = F.array_join(F.slice(F.split(line, " "), 1, 2), " ")
    return reduce(lambda a, b: a | b, [F.contains(head, F.lit(m)) for m in REF_HEADINGS])


def block_marks(blocks: Column, body: Column, as_of_year: int) -> Column:
    """What the reference search needs to know of each block, tested once per block."""

    def marks(b: Column) -> Column:
        lines = F.split(F.regexp_replace(b["content"], r"\n\z", ""), "\n")
        start = F.substring(F.regexp_replace(b["content"], "\n", ""), 1, 3)
        return F.struct(
            (b["content"] != "").alias("filled"),
            (b["fontsize"] < body).alias("small"),
            F.rlike(start, F.lit(r"\p{Nd}")).alias("digit"),
            _has_year(b["content"], as_of_year).alias("year"),
            (F.contains(b["content"], F.lit(".")) & F.contains(b["content"], F.lit(","))).alias("punctuated"),
            _is_heading(lines[0]).alias("top"),
            _is_heading(F.element_at(lines, -1)).alias("bottom"),
        )

    return F.transform(blocks, marks)


def reference_start(marks: Column) -> Column:
    """(start, small) of the reference section, or null: its 0-based first block and whether small print follows."""
    small = lambda ms: F.forall(ms, lambda m: m["small"])
    count = lambda ms, name: F.size(F.filter(ms, lambda m: m[name]))
    seen = lambda i: F.least(F.lit(LOOK_AHEAD), F.size(marks) - i)

    def by_heading(m: Column, i: Column) -> Column:
        nxt, here = F.slice(marks, i + 2, F.lit(LOOK_AHEAD)), F.slice(marks, i + 1, F.lit(LOOK_AHEAD))
        listed = small(nxt) | (count(nxt, "digit") > F.floor(seen(i) / 2)) | (count(here, "year") > F.floor(seen(i) / 3))
        found = F.struct(F.when(m["top"], i).otherwise(i + 1).alias("start"), small(nxt).alias("small"))
        return F.when(m["filled"] & (m["top"] | m["bottom"]) & listed, found)

    def by_shape(m: Column, i: Column) -> Column:
        here = F.slice(marks, i + 1, F.lit(LOOK_AHEAD))
        listed = small(here) | (count(here, "digit") > F.floor(seen(i) / 2))
        dated = (count(here, "year") > F.floor(seen(i) / 3)) & (count(here, "punctuated") > F.floor(seen(i) / 2))
        return F.when(m["filled"] & listed & dated, F.struct(i.alias("start"), small(here).alias("small")))

    first = lambda rule: F.get(F.filter(F.transform(marks, rule), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first(by_heading), first(by_shape))


def reference_end(blocks: Column, start: Column, small: Column, body: Column) -> Column:
    """First later block in body size with at least five words, when small print follows the start; else the end."""
    stops = F.filter(
        F.transform(
            blocks,
            lambda b, i: F.when(
                (i >= start)
                & (i < F.size(blocks) - 1)
                & (b["content"] != "")
                & (b["fontsize"] >= body)
                & (b["nwords"] >= 5),
                i,
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(small, F.coalesce(F.get(stops, F.lit(0)), F.size(blocks))).otherwise(F.size(blocks))


def main_text(blocks: Column, body: Column) -> Column:
    """Blocks in body size with words, joined by spaces; no blocks gives ''."""
    kept = F.filter(blocks, lambda b: (b["fontsize"] >= F.lit(BODY_SHARE) * body) & (b["nwords"] > 0))
    return join_lines(F.array_join(F.transform(kept, lambda b: b["content"]), " "))


def reference_font(section: Column) -> Column:
    """Most frequent font of the first half of the section's blocks."""
    half = F.slice(section, F.lit(1), F.floor(F.size(section) / 2).cast("int"))
    return _mode(half, lambda b: F.lit(1).cast("bigint"))


def reference_text(section: Column, start: Column, font: Column) -> Column:
    """Reference blocks in the section's usual font, without headings and dots after initials.

    Position 0 is not a section start: a document cannot begin with its references.
    """
    kept = F.filter(section, lambda b: b["fontsize"] == font)
    joined = join_lines(F.array_join(F.transform(kept, lambda b: b["content"]), " "))
    plain = reduce(lambda t, m: F.replace(t, F.lit(m), F.lit("")), REF_HEADINGS, joined)
    return F.when((start > 0) & (F.size(section) > MIN_REF_BLOCKS), T.undo_initial_dots(plain))


def clean_full_text(docs: DataFrame, with_references: bool, as_of_year: int, min_chars: int = 0) -> DataFrame:
    """Adds main_text and ref_text from full_text; null or less than ``min_chars`` of it gives empty ones."""
    short = F.coalesce(F.length("full_text") < min_chars, F.lit(True))
    b = F.col("_b")
    d = hold(docs, _b=parse_blocks(F.col("full_text")))
    if with_references:
        d = find_references(d, b, as_of_year)
        long_section = F.coalesce((F.col("_s") > 0) & (F.col("_e") - F.col("_s") > MIN_REF_BLOCKS), F.lit(False))
        d = hold(d, _f=body_font(b, long_section), _x=F.slice(b, F.col("_s") + 1, F.greatest(F.col("_e") - F.col("_s"), F.lit(0))))
        d = hold(d, _rf=reference_font(F.col("_x")))
        refs = F.when(F.size(b) == 0, "").otherwise(reference_text(F.col("_x"), F.col("_s"), F.col("_rf")))
    else:
        d = hold(d, _f=body_font(b, F.lit(False)))
        refs = F.when(F.size(b) == 0, "").cast("string")
    d = d.withColumn("main_text", F.when(short, "").otherwise(main_text(b, F.col("_f"))))
    return d.withColumn("ref_text", F.when(short, "").otherwise(refs)).select(*docs.columns, "main_text", "ref_text")


def find_references(docs: DataFrame, blocks: Column, as_of_year: int) -> DataFrame:
    """Adds the body font ``_g`` and the reference section's start ``_s`` and end ``_e`` (null when there is none)."""
    d = hold(docs, _g=body_font(blocks, total_words(blocks) > MIN_REF_BLOCKS))
    d = hold(d, _m=block_marks(blocks, F.col("_g"), as_of_year))
    d = hold(d, _r=reference_start(F.col("_m")))
    end = reference_end(blocks, F.col("_r.start"), F.col("_r.small"), F.col("_g"))
    return hold(d, _s=F.col("_r.start"), _e=F.when(F.col("_r").isNotNull(), end))


def font_modes(blocks: DataFrame, key: str, max_sizes: int | None = None) -> DataFrame:
    """Body font per document from the block table: two aggregations, the first combining before the shuffle."""
    worded = blocks.where(F.col("nwords") > 0)
    last = worded.groupBy(key).agg(
        F.max("page").alias("_last"), F.count_distinct("fontsize").alias("_sizes")
    )
    early = worded.join(last, key).where(F.col("page") <= F.floor(F.col("_last") / 2))
    counts = early.groupBy(key, "_sizes", "fontsize").agg(
        F.sum("nwords").alias("n"), F.min("block_idx").alias("first")
    )
    best = counts.groupBy(key, "_sizes").agg(F.max_by("fontsize", F.struct("n", -F.col("first"))).alias("fs"))
    docs = blocks.select(key).distinct()
    found = F.coalesce("fs", F.lit(0.0))
    return docs.join(best, key, "left").select(
        key, (found if max_sizes is None else F.when(F.col("_sizes") > max_sizes, 0.0).otherwise(found)).alias("body_font")
    )
