"""Conditions on paper columns, built from filter lists and from parsed queries.

Every function returns a ``Column``, so filters reach the parquet scan and are combined freely.
A condition that is null drops its row. What nobody defined is an error, never a filter that is
silently missing; ``lenient`` skips such entries for callers that want the old behaviour.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# Payload fields by the way they are matched, and preprint venues.
KEYWORD_FIELDS = ("paperIdQ", "paperId", "venue", "venue_lower", "fieldsOfStudy")
TEXT_FIELDS = ("abstract", "main_text", "title", "authorName")
RANGE_FIELDS = ("publicationYear", "citationCount", "influentialCitationCount")
DATE_FIELDS = ("publicationDate",)
PREPRINT_VENUES = ("arxiv.org", "biorxiv")

# Operator names, as they must be written, and what each does to a column and a value.
_COMPARISONS = {
    "==": operator.eq,
    "eq": operator.eq,
    "!=": operator.ne,
    "ne": operator.ne,
    "<": operator.lt,
    "lt": operator.lt,
    "<=": operator.le,
    "lte": operator.le,
    ">": operator.gt,
    "gt": operator.gt,
    ">=": operator.ge,
    "gte": operator.ge,
    "in": lambda column, values: column.isin(*values),
    "not in": lambda column, values: ~column.isin(*values),
}
_ORDERED = ("lt", "lte", "gt", "gte")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _as_list(value: object) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def compare(column: Column, op: str, value: object) -> Column:
    """``column op value``; a membership test takes a list of values."""
    if op not in _COMPARISONS:
        raise ValueError(f"unsupported operator {op!r}")
    if op not in ("in", "not in"):
        return _COMPARISONS[op](column, F.lit(value))
    values = _as_list(value)
    return _COMPARISONS[op](column, values) if values else F.lit(op == "not in") & column.isNotNull()


def compile_filters(filters: Sequence[tuple] | None) -> Column:
    """``[(column, op, value), ...]`` joined by AND."""
    return all_of(compare(F.col(name), op, value) for name, op, value in filters or ())


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def text_match(column: Column, texts: Sequence[str], any_text: bool, mode: str = "substring") -> Column:
    """True when any (or every) text occurs in the column, as a substring or as a set of whole words."""
    if mode == "substring":
        found = [F.contains(column, F.lit(t)) for t in texts]
    elif mode == "token":
        found = [F.size(F.array_except(words(F.lit(t)), words(column))) == 0 for t in texts]
    else:
        raise ValueError(f"unknown text mode {mode!r}")
    if any_text:
        return ~all_of(~f for f in found)
    return all_of(found)


def _keyword(column: Column, op: str, value: object, mode: str) -> Column | None:
    membership = {"==": "in", "eq": "in", "in": "in", "!=": "not in", "ne": "not in", "not in": "not in"}.get(op)
    return compare(column, membership, _as_list(value)) if membership else None


def _text(column: Column, op: str, value: object, mode: str) -> Column | None:
    return text_match(column, _as_list(value), op == "any", mode) if op in ("any", "all", "==", "eq") else None


def _number(column: Column, op: str, value: object, mode: str) -> Column | None:
    return compare(column, op, value) if op in _ORDERED else None


def _date(column: Column, op: str, value: object, mode: str) -> Column | None:
    return compare(F.to_date(column), op, F.to_date(F.lit(value))) if op in _ORDERED else None


_MATCHERS = {
    **dict.fromkeys(KEYWORD_FIELDS, _keyword),
    **dict.fromkeys(TEXT_FIELDS, _text),
    **dict.fromkeys(RANGE_FIELDS, _number),
    **dict.fromkeys(DATE_FIELDS, _date),
}


def payload_filter(filters: Sequence[Sequence] | None, text_mode: str = "substring", lenient: bool = False) -> Column:
    """``[[field, op, value], ...]`` joined by AND; the field tells how it is matched.

    Keyword fields are one of the values or none of them, text fields hold any or all of them,
    counts and dates lie in a range. An unknown field, or an op that its field has not, raises.
    """
    found = []
    for field, op, value in filters or ():
        matcher = _MATCHERS.get(field)
        condition = matcher(F.col(field), op, value, text_mode) if matcher else None
        if condition is not None:
            found.append(condition)
        elif not lenient:
            raise ValueError(f"no filter {op!r} on field {field!r}")
    return all_of(found)


# Filters as data, so that each of many queries brings its own without a plan of its own.
FILTERS = "array<struct<field:string,op:string,values:array<string>>>"
# Fields that a request can filter on.
REQUEST_FIELDS = ("authorName", "publicationDate", "venue_lower", "citationCount")


def _iso(value: Column) -> Column:
    return F.to_date(value).cast("string")


def filter_row(field: str, op: str, values: Column) -> Column:
    """One filter as data: ``values`` is an array; dates are brought to one form."""
    values = values.cast("array<string>")
    values = F.transform(values, _iso) if field in DATE_FIELDS else values
    return F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), values.alias("values"))


def filter_payload(papers: DataFrame, fields: Sequence[str]) -> list[Column]:
    """The payload columns in the form in which ``payload_mask`` compares them."""
    return [(_iso(F.col(c)) if c in DATE_FIELDS else F.col(c).cast("double") if c in RANGE_FIELDS else F.col(c)).alias(c) for c in fields if c in papers.columns]


def comparable(payload: Mapping[str, pa.Array]) -> dict[str, pa.Array | np.ndarray]:
    """Payload columns of an Arrow batch as ``payload_mask`` reads them: numbers and days in numpy, where a null compares with nothing."""
    ready = dict(payload)
    for field, column in payload.items():
        if field in RANGE_FIELDS:
            ready[field] = column.to_numpy(zero_copy_only=False).astype(np.float64)
        elif field in DATE_FIELDS:
            ready[field] = pc.cast(column, pa.date32()).to_numpy(zero_copy_only=False).astype("datetime64[D]")
    return ready


_NUMPY = {"lt": np.less, "lte": np.less_equal, "gt": np.greater, "gte": np.greater_equal}


def payload_mask(filters: Sequence[dict], payload: Mapping[str, pa.Array | np.ndarray], n: int) -> np.ndarray:
    """Which of ``n`` papers of a batch of ``comparable`` columns pass all filters: what ``payload_filter`` says of columns."""
    mask = np.ones(n, bool)
    for f in filters or ():
        field, op, values = f["field"], f["op"], f["values"]
        column = payload.get(field)
        if column is None:
            raise ValueError(f"no payload field {field!r}")
        if field in RANGE_FIELDS + DATE_FIELDS and op in _ORDERED:
            mask &= _NUMPY[op](column, float(values[0]) if field in RANGE_FIELDS else np.datetime64(values[0], "D"))
            continue
        if field in KEYWORD_FIELDS and op in ("==", "eq", "in", "!=", "ne", "not in"):
            found = pc.is_in(column, pa.array(values, pa.string()))
            found = pc.and_(pc.invert(found) if op in ("!=", "ne", "not in") else found, pc.is_valid(column))
        elif field in TEXT_FIELDS and op in ("any", "all", "==", "eq"):
            join, found = (pc.or_, pa.scalar(False)) if op == "any" else (pc.and_, pa.scalar(True))
            for v in values:
                found = join(found, pc.match_substring(column, v))
            found = pc.and_(found, pc.is_valid(column))
        else:
            raise ValueError(f"no filter {op!r} on field {field!r}")
        mask &= pc.fill_null(found, False).to_numpy(zero_copy_only=False).astype(bool)
    return mask


class FilterTable:
    """Many filter lists, so that one call says which papers pass which list. Lists of ranges that differ in their values only are compared at once."""

    def __init__(self, lists: Sequence[Sequence[dict] | None]) -> None:
        places: dict[object, list[int]] = {}
        for i, filters in enumerate(lists):
            ranges = all(f["field"] in RANGE_FIELDS + DATE_FIELDS and f["op"] in _ORDERED for f in filters or ())
            places.setdefault(tuple((f["field"], f["op"]) for f in filters or ()) if ranges else repr(filters), []).append(i)
        self.group, self.place = np.zeros(len(lists), int), np.zeros(len(lists), int)
        self.filters, self.values = [], []
        for g, (key, rows) in enumerate(places.items()):
            self.group[rows], self.place[rows] = g, np.arange(len(rows))
            self.filters.append(lists[rows[0]] or ())
            given = [[lists[i][k]["values"][0] for i in rows] for k in range(len(key))] if isinstance(key, tuple) else []
            days = [f["field"] in DATE_FIELDS for f in self.filters[g]]
            self.values.append([np.array(v, "datetime64[D]") if day else np.array(list(map(float, v))) for v, day in zip(given, days)] if isinstance(key, tuple) else None)

    def masks(self, some: np.ndarray, payload: Mapping[str, pa.Array | np.ndarray], n: int) -> np.ndarray:
        """``payload_mask`` of ``some`` of the lists, shape (lists, papers)."""
        out = np.ones((len(some), n), bool)
        for g in np.unique(self.group[some]):
            mine = np.flatnonzero(self.group[some] == g)
            if self.values[g] is None:
                out[mine] = payload_mask(self.filters[g], payload, n)
                continue
            for f, values in zip(self.filters[g], self.values[g]):
                if f["field"] not in payload:
                    raise ValueError(f"no payload field {f['field']!r}")
                out[mine] &= _NUMPY[f["op"]](payload[f["field"]][None, :], values[self.place[some[mine]]][:, None])
        return out


def request_filter_rows(query: Column) -> Column:
    """The filters of a parsed query (a struct) as data; empty entries ask for nothing."""
    none, entry = F.array().cast(FILTERS), lambda name: query[name]
    asked = [
        (F.length(entry("authorName")) > 0, filter_row("authorName", "==", F.split(entry("authorName"), ","))),
        (F.length(entry("publicationDate_start")) > 0, filter_row("publicationDate", "gte", F.array(entry("publicationDate_start")))),
        (F.length(entry("publicationDate_end")) > 0, filter_row("publicationDate", "lte", F.array(entry("publicationDate_end")))),
        (F.size(entry("search_paperIds")) > 0, filter_row("paperId", "==", entry("search_paperIds"))),
        (entry("peer_reviewed_only"), filter_row("venue_lower", "!=", F.array(*map(F.lit, PREPRINT_VENUES)))),
        (entry("preprint_only"), filter_row("venue_lower", "==", F.array(*map(F.lit, PREPRINT_VENUES)))),
        (F.size(entry("venues")) > 0, filter_row("venue_lower", "==", F.transform(entry("venues"), F.lower))),
        (entry("citationCount") != 0, filter_row("citationCount", "gte", F.array(entry("citationCount")))),
    ]
    return F.flatten(F.array(*[F.when(wanted, F.array(row).cast(FILTERS)).otherwise(none) for wanted, row in asked]))


# What each entry of a parsed query asks for: field, op, and the value made of the entry's.
_REQUESTS = {
    "authorName": ("authorName", "==", lambda v: v.split(",")),
    "publicationDate_start": ("publicationDate", "gte", str),
    "publicationDate_end": ("publicationDate", "lte", str),
    "search_paperIds": ("paperId", "==", list),
    "peer_reviewed_only": ("venue_lower", "!=", lambda _: list(PREPRINT_VENUES)),
    "preprint_only": ("venue_lower", "==", lambda _: list(PREPRINT_VENUES)),
    "venues": ("venue_lower", "==", lambda v: [name.lower() for name in v]),
    "citationCount": ("citationCount", "gte", int),
}


def request_filters(parsed: dict) -> list[list]:
    """The filter list of a parsed query; empty entries ask for nothing. Venues are compared in lower case."""
    return [[field, op, value(parsed[entry])] for entry, (field, op, value) in _REQUESTS.items() if parsed.get(entry)]


def request_condition(parsed: dict) -> Column | None:
    """The condition of one parsed query, or None when it has no filter."""
    asked = request_filters(parsed)
    return payload_filter(asked) if asked else None


def lock_to_notebook(candidates: DataFrame, feedback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only papers already in the notebook and not trashed."""
    kept = feedback.where(F.col("user_score") >= 0).select(*keys)
    return candidates.join(kept, list(keys), "left_semi")


def drop_trashed(candidates: DataFrame, feedback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Papers the notebook trashed (user_score < 0) are never shown again."""
    trashed = feedback.where(F.col("user_score") < 0).select(*keys)
    return candidates.join(trashed, list(keys), "left_anti")


def select_allowed(df: DataFrame, fields: Sequence[str] | None, allowed: Sequence[str]) -> DataFrame:
    """Requested fields that are allowed, or all allowed ones when none is requested."""
    names = [f.strip() for f in fields if f in allowed] if fields else list(allowed)
    return df.select(*names)


def citation_floor(year: Column, min_per_year: float, as_of_year: int) -> Column:
    """Citations a paper of that year needs: per year of age beyond two, at most 20."""
    wanted = F.lit(min_per_year) * (F.lit(as_of_year - 2) - year)
    return F.greatest(F.lit(0.0), F.least(F.lit(20.0), wanted.cast("double")))


def work_list(only_new: bool, open_access: bool = False) -> list[tuple]:
    """The filter list of a refresh run."""
    filters: list[tuple] = [("status", "==", "None")] if only_new else [("status", "!=", "pdf_pushed")]
    return filters + [("isOpenAccess", "==", True)] if open_access else filters


def query_gate(queries: Column, ethical: Column, scientific: Column) -> Column:
    """A query is searched when it has sub-queries and no flag forbids it; a missing flag allows it."""
    return (F.coalesce(F.size(queries), F.lit(0)) > 0) & F.coalesce(ethical, F.lit(True)) & F.coalesce(
        scientific, F.lit(True)
    )


def score_fields(scores: Column) -> Column:
    """Map entries whose key names a score."""
    return F.map_filter(scores, lambda k, v: F.contains(k, F.lit("score")))
