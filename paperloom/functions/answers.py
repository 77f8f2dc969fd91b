"""Parsing model answers and building prompts, cards and citations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.text import strip

# Answer schemas, as target field -> (key parts to look for, type).
ANSWER_SCHEMAS: dict[str, dict[str, tuple[tuple[str, ...], str]]] = {
    "title": {"title": (("title", "topic", "heading"), "string")},
    "parse": {
        "authorName": (("authorName", "author", "name"), "string"),
        "publicationDate_start": (("publicationDate_start", "start"), "string"),
        "publicationDate_end": (("publicationDate_end", "end"), "string"),
        "peer_reviewed_only": (("peer", "reviewed", "published"), "boolean"),
        "preprint_only": (("preprint", "repo"), "boolean"),
        "venues": (("venue", "journal"), "array<string>"),
        "citationCount": (("citationCount", "citation", "count"), "int"),
        "cleaned_query": (("cleaned_query", "cleaned"), "string"),
    },
    "expand": {
        "queries": (("sub_queries", "questions", "queries"), "array<string>"),
        "scientific": (("scientific", "search", "needed"), "boolean"),
        "cite_only": (("cite", "citation", "insert"), "boolean"),
        "ethical": (("ethical", "valid", "acceptable"), "boolean"),
        "details": (("details",), "boolean"),
        "search_paperIds": (("paperIds", "search", "paper"), "array<string>"),
    },
    "keywords": {
        "research_field": (("research_field", "research", "field", "discipline", "domain"), "array<string>"),
        "main_topics": (("main_topics", "main", "topics"), "array<string>"),
        "key_concepts": (("key_concepts", "key", "concept"), "array<string>"),
    },
    "relevance": {
        "relevant": (("relevant", "valid"), "boolean"),
        "paperIds": (("paperId", "paper", "article", "reference"), "array<string>"),
    },
    "questions": {
        "questions": (("question", "open"), "array<string>"),
        "paperIds": (("paper", "references", "papers"), "array<string>"),
    },
    "section": {
        "title": (("title", "topic"), "string"),
        "content": (("description", "content", "scope"), "string"),
        "paperIds": (("paper", "references", "papers"), "array<string>"),
    },
}
# Shapes of dates in answers and their formats.
DATE_FORMS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
    (r"^[A-Za-z]{4,} \d{4}$", "MMMM yyyy"),
    (r"^\d{4}$", "yyyy"),
)
ALL_PAPER_SECTIONS = ("introduction", "tldr")
NO_ARTICLES = "No article relevant to the query were found in the database"
CARD = "--- Article ---\nArticle ID: [%s]\nTitle: %s\nAuthors: %s et al.\nDate: %s\n%sExcerpt:\n%s\n"
CARD_ABSTRACT = "Abstract:\n%s\n"
CARD_EXCERPT = "'%s'\n"
THINK = r"(?s)<think>(.*?)</think>"


def think_part(answer: Column) -> Column:
    return strip(F.regexp_extract(answer, THINK, 1))


def content_part(answer: Column) -> Column:
    return strip(F.regexp_replace(answer, THINK, ""))


def loose_json(text: Column) -> Column:
    """The text between the first '{' and the last '}', with Python words and trailing commas repaired."""
    block = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    words = reduce(
        lambda c, w: F.replace(c, F.lit(w[0]), F.lit(w[1])),
        (("None", "null"), ("True", "true"), ("False", "false")),
        block,
    )
    return F.regexp_replace(words, r",\s*(?=\})", "")


def json_record(text: Column) -> Column:
    """The loose JSON object as a map of its fields' JSON text; null when it does not parse."""
    return F.from_json(loose_json(text), "map<string,string>")


def first_matching(record: Column, parts: Sequence[str]) -> Column:
    """The value of the first key that contains any of the parts, ignoring case."""
    fits = lambda k: reduce(lambda a, b: a | b, [F.contains(F.lower(k), F.lit(p.lower())) for p in parts])
    return F.get(F.filter(F.map_entries(record), lambda e: fits(e["key"])), F.lit(0))["value"]


def _typed(value: Column, dtype: str) -> Column:
    if dtype == "string":
        return value
    if dtype == "array<string>":
        # A single word where a list was asked for counts as a list of one.
        is_list = F.startswith(F.ltrim(value), F.lit("["))
        return F.when(is_list, F.from_json(value, dtype)).when(value.isNotNull(), F.array(value))
    return F.lower(value).try_cast(dtype)


def parse_answer(answer: Column, schema: str) -> Column:
    """A struct with the schema's fields from a raw model answer."""
    record = json_record(content_part(answer))
    fields = ANSWER_SCHEMAS[schema].items()
    return F.struct(*[_typed(first_matching(record, parts), dtype).alias(name) for name, (parts, dtype) in fields])


def parse_plan(answer: Column) -> Column:
    """(abstract, sections); sections titled introduction or tldr get the papers of all sections."""
    record = json_record(content_part(answer))
    raw = F.from_json(record["sections"], "array<map<string,string>>")
    schema = ANSWER_SCHEMAS["section"].items()
    section = lambda m: F.struct(*[_typed(first_matching(m, p), t).alias(n) for n, (p, t) in schema])
    sections = F.transform(raw, section)
    everything = F.flatten(F.transform(sections, lambda s: F.coalesce(s["paperIds"], F.array().cast("array<string>"))))

    def complete(s: Column) -> Column:
        overview = reduce(
            lambda a, b: a | b, [F.contains(F.lower(s["title"]), F.lit(w)) for w in ALL_PAPER_SECTIONS]
        )
        return s.withField("paperIds", F.when(overview, everything).otherwise(s["paperIds"]))

    return F.struct(record["abstract"].alias("abstract"), F.transform(sections, complete).alias("sections"))


def normal_date(text: Column) -> Column:
    """Full, month-year or year-only dates as yyyy-MM-dd; missing parts are 1."""
    title = F.initcap(F.trim(text))
    # A pattern picks the format, so a text is parsed once instead of failing through all of them.
    parsed = F.coalesce(
        *[F.when(F.rlike(title, F.lit(shape)), F.try_to_timestamp(title, F.lit(form))) for shape, form in DATE_FORMS]
    )
    return F.date_format(parsed, "yyyy-MM-dd")


def normal_dates(record: Column) -> Column:
    """Sorted dates of all fields whose key holds 'date'."""
    dated = F.filter(F.map_entries(record), lambda e: F.contains(e["key"], F.lit("date")) & e["value"].isNotNull())
    return F.array_sort(F.filter(F.transform(dated, lambda e: normal_date(e["value"])), lambda d: d.isNotNull()))


def field_list(fields: Mapping[str, str]) -> str:
    """The field descriptions of a schema as a bullet list."""
    return "\n".join(f"- {name}: {text or 'No description'}" for name, text in fields.items())


def build_prompt(template: Column, values: Mapping[str, Column]) -> Column:
    """Replaces each ``<NAME>`` placeholder by its value."""
    return reduce(lambda t, kv: F.replace(t, F.lit(f"<{kv[0]}>"), kv[1]), values.items(), template)


def article_card(paper: Mapping[str, Column], include_abstract: bool = False) -> Column:
    """The fixed text card of a paper; ``paper`` maps field names to columns, best_chunks to an array."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    author = F.split_part(paper["authorName"], F.lit(","), F.lit(1))
    abstract = F.format_string(CARD_ABSTRACT, shown(paper["abstract"])) if include_abstract else F.lit("")
    chunk = F.get(paper["best_chunks"], F.lit(0))
    excerpt = F.when(chunk.isNotNull(), F.format_string(CARD_EXCERPT, chunk)).otherwise(F.lit(""))
    fields = [shown(c) for c in (paper["paperId"], paper["title"], author, paper["publicationDate"])]
    return F.format_string(CARD, *fields, abstract, excerpt)


def article_cards(cards: Column) -> Column:
    """The card list, or one fixed sentence when there is none."""
    return F.when(F.coalesce(F.size(cards), F.lit(0)) > 0, cards).otherwise(F.array(F.lit(NO_ARTICLES)))


def model_messages(context: Column, cards: Column, prompt: Column) -> Column:
    """Context turns, one user message per card, then the prompt."""
    user = lambda text: F.struct(F.lit("user").alias("role"), text.alias("content"))
    return F.concat(context, F.transform(cards, user), F.array(user(prompt)))


def merge_query_plan(expand: Column, keywords: Column, parsed: Column) -> Column:
    """One record from the three parsed answers; later ones win.

    Paper ids count only when details are asked for; keywords and filters only for
    scientific and ethical queries; filters are dropped when papers were named.
    """
    ids = F.when(F.coalesce(expand["details"], F.lit(False)), F.coalesce(expand["search_paperIds"], F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>")
    )
    valid = F.coalesce(expand["scientific"], F.lit(False)) & F.coalesce(expand["ethical"], F.lit(False))
    filtered = valid & (F.size(ids) == 0)
    fields = [expand[n].alias(n) for n in ("queries", "scientific", "cite_only", "ethical", "details")]
    fields.append(ids.alias("search_paperIds"))
    fields += [F.when(valid, keywords[n]).alias(n) for n in ANSWER_SCHEMAS["keywords"]]
    fields += [F.when(filtered, parsed[n]).alias(n) for n in ANSWER_SCHEMAS["parse"]]
    return F.struct(*fields)


def citation_label(authors: Column, date: Column) -> Column:
    name = F.element_at(F.split(F.trim(F.split_part(authors, F.lit(","), F.lit(1))), r"\s+"), -1)
    year = F.year(F.to_date(date)).cast("string")
    return F.concat(F.when(name != "", name).otherwise(F.lit("Unknown")), F.lit(" et al., "), year)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), text, F.lit(r"\E"))


def loose_id_pattern(paper_id: Column) -> Column:
    """Any five-character run of the id, each character followed by optional dots, as the web client matches."""
    letter = lambda c: F.concat(_quoted(c), F.lit(r"\.*?"))
    run = lambda i: F.array_join(
        F.transform(F.sequence(i, i + 4), lambda k: letter(F.substring(paper_id, k, F.lit(1)))), ""
    )
    starts = F.sequence(F.lit(1), F.length(paper_id) - 4)
    return F.when(F.length(paper_id) >= 5, F.array_join(F.transform(starts, run), "|")).otherwise(_quoted(paper_id))


def linkify(text: Column, papers: Column, loose: bool = False) -> Column:
    """Replaces paper ids in a text by labelled links, longest id first, repeats collapsed.

    ``papers`` is an array of (paperId, label). Ids first become private marks and marks
    become links, so an id that is part of another id or of a label is never linked twice.
    """
    longest_first = F.array_sort(
        papers,
        lambda a, b: F.when(F.length(a["paperId"]) > F.length(b["paperId"]), -1)
        .when(F.length(a["paperId"]) < F.length(b["paperId"]), 1)
        .otherwise(F.when(a["paperId"] < b["paperId"], -1).when(a["paperId"] > b["paperId"], 1).otherwise(0)),
    )
    mark = lambda i: F.concat(F.lit("\ue000"), F.repeat(F.lit("\ue002"), i), F.lit("\ue001"))
    marked = F.transform(longest_first, lambda p, i: F.struct(p["paperId"].alias("id"), p["label"].alias("label"), mark(i).alias("mark")))

    def find(t: Column, p: Column) -> Column:
        pattern = loose_id_pattern(p["id"]) if loose else _quoted(p["id"])
        repeats = F.concat(F.lit("(?:"), pattern, F.lit(r")(?:\s*(?:"), pattern, F.lit("))*"))
        return F.regexp_replace(t, repeats, p["mark"])

    def link(t: Column, p: Column) -> Column:
        return F.replace(t, p["mark"], F.concat(F.lit("["), p["label"], F.lit("](#"), p["id"], F.lit(")")))

    return F.aggregate(marked, F.aggregate(marked, text, find), link)


def cited_ids(text: Column) -> Column:
    """Ids in bracketed citations: ``[id]``, ``[id1, id2]``; ``unsupported`` is kept as a mark."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.filter(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x)))), lambda x: x != "")


def fabricated_citations(answers: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cited ids an answer was not given; ``allowed`` has the keys and paperId."""
    cited = answers.select(*keys, F.explode(cited_ids(F.col("content"))).alias("paperId")).where(
        F.col("paperId") != "unsupported"
    )
    return cited.join(allowed, [*keys, "paperId"], "left_anti").distinct()
