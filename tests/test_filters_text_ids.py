import uuid

import pytest
from pyspark.sql import functions as F

from paperloom.functions import ids as I
from paperloom.functions import text as T
from paperloom.operators import filters as P


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture
def papers(spark):
    rows = [
        ("a", "arXiv.org", 5, "2020-01-31", "Deep nets", "Ann, Bo"),
        ("b", "Nature", 50, "2021-06-01", "Graph deep", "Bo"),
        ("c", None, None, None, None, None),
    ]
    return spark.createDataFrame(
        rows, "paperId string, venue string, citationCount int, publicationDate string, title string, authorName string"
    ).withColumn("venue_lower", F.lower("venue"))


def test_filter_list_ops_and_nulls(papers):
    keep = lambda f: ids(papers.where(P.compile_filters(f)).select("paperId"))
    assert keep([("citationCount", ">", 4), ("venue", "!=", "Nature")]) == ["a"]
    assert keep([("venue", "not in", ["Nature"])]) == ["a"]
    assert keep([("citationCount", "in", [50, 51])]) == ["b"]
    assert keep(None) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        P.compile_filters([("venue", "like", "x")])


def test_payload_filter_by_field_class(papers):
    keep = lambda f, **kw: ids(papers.where(P.payload_filter(f, **kw)).select("paperId"))
    assert keep([["venue", "==", "Nature"]]) == ["b"]
    assert keep([["venue", "!=", ["Nature"]]]) == ["a"]
    assert keep([["venue", "gt", "x"], ["citationCount", "gte", 5]], lenient=True) == ["a", "b"]
    for unknown in (["venue", "gt", "x"], ["venu", "==", "x"], ["citationCount", "==", 5], ["title", "gt", "a"]):
        with pytest.raises(ValueError):
            P.payload_filter([unknown])
    assert keep([["venue", "==", []]]) == [] and keep([["venue", "!=", []]]) == ["a", "b"]
    assert keep([["title", "any", ["nets", "Graph"]]]) == ["a", "b"]
    assert keep([["title", "==", ["deep", "Graph"]]]) == ["b"]
    assert keep([["title", "==", ["NETS deep"]]], text_mode="token") == ["a"]
    assert keep([["publicationDate", "lt", "2021-01-01"]]) == ["a"]


def test_request_filters_compare_venues_in_lower_case(papers):
    assert ids(papers.where(P.request_condition({"peer_reviewed_only": True})).select("paperId")) == ["b"]
    assert ids(papers.where(P.request_condition({"preprint_only": True})).select("paperId")) == ["a"]
    assert P.request_condition({}) is None


def test_query_gate(one):
    q, none = F.array(F.lit("q")), F.lit(None).cast("boolean")
    assert one(P.query_gate(q, none, F.lit(True))) is True
    assert one(P.query_gate(q, F.lit(False), none)) is False
    assert one(P.query_gate(F.array(), none, none)) is False
    assert one(P.query_gate(F.lit(None).cast("array<string>"), none, none)) is False


def test_links_and_versions(one):
    link = F.lit("gs://b/pdf/0704/0704.0001v6.pdf")
    assert one(T.version_fallbacks(link, 4)) == [f"gs://b/pdf/0704/0704.0001v{v}.pdf" for v in (6, 5, 4, 3)]
    assert one(T.version_fallbacks(F.lit("gs://b/xv2.pdf"))) == ["gs://b/xv2.pdf", "gs://b/xv1.pdf"]
    assert one(T.version_fallbacks(F.lit("http://h/x.pdf"))) == ["http://h/x.pdf"]
    assert one(T.public_link(link)) == "https://arxiv.org/pdf/0704.0001"
    assert one(T.force_https(F.lit("http://a/http://b"))) == "https://a/http://b"


def test_lists_ids_categories(one):
    nothing = F.lit(None).cast("string")
    assert one(T.join_list(F.array(F.lit("a"), F.lit(""), nothing, F.lit("b")))) == "a,b"
    assert one(T.join_list(F.lit(None).cast("array<string>"))) == ""
    record = lambda d, a, c: F.struct(d.alias("DOI"), a.alias("ArXiv"), c.alias("CorpusId"))
    assert one(T.first_id(record(F.lit(""), F.lit("9"), F.lit(3)))) == "9"
    assert one(T.first_id(record(nothing, nothing, F.lit(3)))) == "3"
    assert one(T.first_id(record(nothing, nothing, F.lit(None).cast("bigint")))) == ""
    assert one(T.map_categories(F.lit("cs.AI  physics.geo-ph nope"))) == "Computer Science,Geology,Other"


def test_dates_and_lines(one):
    assert str(one(T.first_version_date(F.lit("Mon, 2 Apr 2007 19:18:42 GMT")))) == "2007-04-02"
    assert one(T.first_version_date(F.lit("soon"))) is None
    assert one(T.blank_number_lines(F.lit(" a1 \n 12 \nb"))) == "a1\n\nb"
    assert one(T.drop_glyph_marks(F.lit("x(cid:12)y"))) == "xy"
    assert one(T.undo_initial_dots(F.lit("Smith, A. B. and al."))) == "Smith, A B and al."
    assert one(T.normal_words(F.lit("a B c1 dé"))) == 2


def test_find_section_takes_nearest_end(one):
    text = F.lit("Abstract one INTRODUCTION two Results three Methods four")
    assert one(T.find_section(text, "introduction", ["methods", "results"], 100)) == " two "
    assert one(T.find_section(text, "introduction", ["nowhere"], 5)) == " two "
    assert one(T.find_section(text, "absent", ["results"], 5)) == ""


def test_point_ids_equal_uuid5(one):
    for name in ("d0", "paper_1", "é"):
        assert one(I.point_id(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert one(I.chunk_point_id(F.lit("d1"), F.lit(3))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "d1_3"))
