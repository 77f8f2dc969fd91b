from pyspark.sql import functions as F

from paperloom.operators import catalog as C
from paperloom.plans import jobs
from paperloom.operators import embed as E


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_keep_one_with_a_hot_key_and_nulls(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id"
    )
    out = {r["k"]: r["id"] for r in C.keep_one(df, ["k"], F.col("id")).collect()}
    assert out["hot"] == 0 and out[None] == 2 and len(out) == 335
    last = {r["k"]: r["id"] for r in C.keep_one(df, ["k"], F.col("id"), last=True).collect()}
    assert last["hot"] == 999


def test_combine_first_values_keys_and_columns(spark):
    new = spark.createDataFrame([("1", None, "n1"), ("2", "x", "n2"), (None, "y", "n3")], "doi string, a string, b string")
    old = spark.createDataFrame([("1", "o", 7), ("3", "p", 8), ("None", "q", 9)], "doi string, a string, c int")
    merged = C.combine_first(new, old, "doi")
    assert merged.columns == ["doi", "a", "b", "c"]
    got = rows(merged, "doi", "a", "b", "c")
    want = [("1", "o", "n1", 7), ("2", "x", "n2", None), ("3", "p", None, 8), (None, "y", "n3", None), ("None", "q", None, 9)]
    assert got == sorted(want, key=str)


def test_combine_first_is_idempotent_on_keyed_rows(spark):
    new = spark.createDataFrame([("1", None), ("2", "x")], "doi string, a string")
    old = spark.createDataFrame([("1", "o"), ("3", "p")], "doi string, a string")
    once = C.combine_first(new, old, "doi")
    assert rows(C.combine_first(new, once, "doi"), "doi", "a") == rows(once, "doi", "a")


def test_text_sufficiency_edges(spark):
    long, note = "x" * 500, "y" * 510
    data = [
        ("a", "t", note, "x" * 499), ("b", None, None, long), ("c", "t", "u", "None"), ("d", "None", note, None), ("e", "t", "u", "x" * 501),
    ]
    text = spark.createDataFrame(data, "paperId string, title string, abstract string, main_text string")
    out = {r["paperId"]: r for r in C.sufficient_text(text).collect()}
    assert set(out) == {"a", "b", "d", "e"}
    assert out["a"]["main_text"] == "t " + note and not out["a"]["pdf_extracted"]
    assert out["b"]["main_text"] == long and not out["b"]["pdf_extracted"] and out["b"]["ref_text"] == " "
    assert out["d"]["main_text"] == "None " + note
    assert out["e"]["pdf_extracted"]


def test_sentinels(spark):
    df = spark.createDataFrame([("None", None, None), ("v", "None", 3)], "a string, b string, n int")
    assert rows(C.decode_missing(df), "a", "b") == sorted([(None, None), ("v", None)], key=str)
    assert rows(C.encode_missing(df, ["n"]), "a", "b", "n") == sorted([("None", "None", 0), ("v", "None", 3)], key=str)


def test_status_and_worklist(spark):
    text = spark.createDataFrame([("a", "None"), ("b", "extracted"), ("c", None)], "paperId string, status string")
    listed = spark.createDataFrame([("a",), ("a",)], "paperId string")
    assert rows(C.set_status(text, "x", listed), "paperId", "status") == [("a", "x"), ("b", "extracted"), ("c", None)]
    assert rows(C.set_status(text, "x"), "status") == [("x",)] * 3


def test_replace_links_joins_by_last_segment(spark):
    papers = spark.createDataFrame([("p", "http://x/1.2"), ("q", "http://x/9"), ("r", None)], "paperId string, openAccessPdf string")
    snap = spark.createDataFrame([("1.2", "gs://s/1.2v1.pdf")], "paperId string, openAccessPdf string")
    assert rows(C.replace_links(papers, snap), "paperId", "openAccessPdf") == [
        ("p", "gs://s/1.2v1.pdf"), ("q", "http://x/9"), ("r", None),
    ]


def test_blocked_status_uses_the_fixed_markers(spark):
    pages = [
        ("u1", "<title>ok</title> Please solve the CAPTCHA"), ("crawlprevention/x", ""), ("u3", "<TITLE>Just a Moment</TITLE>"), ("u4", "<title>fine</title>"),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    out = rows(df.select("url", C.blocked_status(F.col("url"), F.col("html")).alias("s")), "url", "s")
    assert [s for _, s in out] == ["crawlprevention/x", "u1", "u3", None]


def test_merge_extracted_keeps_the_rows_of_meta(spark):
    meta = spark.createDataFrame([("a",), ("b",), ("z",)], "paperId string")
    text = spark.createDataFrame([("1", "a", "old"), ("1", "b", "dup"), ("2", "c", "c")], "doi string, paperId string, title string")
    extracted = spark.createDataFrame([("1", "a", "body")], "doi string, paperId string, main_text string")
    out = rows(C.merge_extracted(extracted, text, meta, "paperId"), "paperId", "title", "main_text")
    assert out == [("a", "old", "body"), ("b", None, None), ("z", None, None)]


def test_refresh_vectors_finds_no_new_work_on_its_own_output(spark):
    words = " ".join(f"word{i} next{i} more{i}." if i % 2 else f"Word{i} alpha beta" for i in range(60))
    meta = spark.createDataFrame([("a", 2020), ("b", 2021)], "paperId string, publicationYear int")
    text = spark.createDataFrame(
        [("a", "t", "s", words, "None"), ("b", "t", "s", words, "pdf_pushed")],
        "paperId string, title string, abstract string, main_text string, status string",
    )
    vectors, advanced = jobs.refresh_vectors(meta, text, E.hashed_words(16), chunk_size=30)
    assert {r["paperId"] for r in vectors.collect()} == {"a"}
    assert rows(advanced, "paperId", "status") == [("a", "abstract_pushed"), ("b", "pdf_pushed")]
    again, _ = jobs.refresh_vectors(meta, advanced, E.hashed_words(16), chunk_size=30)
    assert again.count() == 0


def test_extracted_documents_update_the_text_table(spark):
    words = "plain body words that go on for a while in this block of text"
    full = "".join(f"\n**BLOCK**fs== 10.0**p== {i}.0**b== 0.1**t== 0.1**l== 0.1**r== 0.1**\n{words} {i}" for i in range(4))
    docs = spark.createDataFrame([("1", "a", full)], "doi string, paperId string, full_text string")
    text = spark.createDataFrame([("1", "a", "t", "None"), ("2", "b", "u", "None")], "doi string, paperId string, title string, status string")
    meta = spark.createDataFrame([("a",), ("b",)], "paperId string")
    out = {r["paperId"]: r for r in jobs.extract_text(docs, text, meta, as_of_year=2026).collect()}
    assert out["a"]["status"] == "extracted" and out["a"]["title"] == "t" and out["a"]["main_text"].count("plain body") == 4
    assert out["b"]["status"] == "None" and out["b"]["main_text"] is None
