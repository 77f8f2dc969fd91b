import random

from pyspark.sql import functions as F

from paperloom.functions import answers as A
from paperloom.operators.links import link_places, linkify_texts

PAPERS = "array<struct<paperId:string,label:string>>"


def test_one_pass_gives_what_a_pass_per_paper_gives(spark):
    rng = random.Random(5)
    ids = ["ab", "abc", "bca", "abcab", "c.c", "d+", "xyz", "yz", "zé", "a"]
    rows = []
    for k in range(150):
        papers = [{"paperId": i, "label": f"Label {i.upper()} {j}"} for j, i in enumerate(rng.sample(ids, rng.randint(0, 7)))]
        rows.append((k, "".join(rng.choice([*ids, " ", " ", "\n", ".", "q", "b"]) for _ in range(rng.randint(0, 40))), papers))
    table = spark.createDataFrame(rows, f"k int, text string, papers {PAPERS}")
    both = linkify_texts(table, F.col("text"), F.col("papers")).withColumn("plain", A.linkify(F.col("text"), F.col("papers")))
    bad = [r for r in both.collect() if r["linked"] != r["plain"]]
    assert not bad, bad[:3]
    assert both.where(F.contains("linked", F.lit("](#"))).count() > 100


def test_nulls_empty_ids_and_repeats(spark):
    rows = [(1, None, [("a", "A")]), (2, "a", None), (3, "a a  a.a", [("a", "A"), ("a", "A"), (None, "N"), ("", "E")]), (4, "a", [("a", None)]), (5, "", [])]
    table = spark.createDataFrame(rows, f"k int, text string, papers {PAPERS}")
    got = {r["k"]: r["linked"] for r in linkify_texts(table, F.col("text"), F.col("papers")).collect()}
    assert got == {1: None, 2: None, 3: "[A](#a).[A](#a)", 4: "a", 5: ""}


def test_time_does_not_grow_with_papers_times_text():
    import time

    ids = [f"{i:08x}" for i in range(5000)]
    text = " ".join(f"word {i} and" for i in ids)
    start = time.perf_counter()
    assert len(link_places(text, ids)) == 5000
    assert time.perf_counter() - start < 5
