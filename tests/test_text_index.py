import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import text_index as T


RNG = random.Random(3)
WORDS = ["alpha", "Beta", "gamma-ray", "délta", "ε", "zeta", "ab", "theta"]
TEXTS = {i: " ".join(RNG.choice(WORDS) + str(i % 50 // 5) for _ in range(RNG.randint(0, 5))) for i in range(150)}
TEXTS[150], TEXTS[151] = None, ""
FILTERS = [
    (1, ["alpha1", "ma-r"], True), (2, ["alpha1", "ma-r"], False), (3, ["ε7"], True), (4, ["a"], True), (5, ["nowhere at all"], True),
    (6, ["élt", "eta"], False), (7, ["Beta3 Beta3"], False), (8, ["ε", "zz"], True), (9, ["BETA1", "alpha1"], False),
]


def tokens(text):
    return {w for w in "".join(c.lower() if c.isalnum() else " " for c in text).split()}


def expected(mode):
    out = set()
    for q, texts, any_text in FILTERS:
        for i, t in TEXTS.items():
            holds = [] if t is None else [(x in t) if mode == "substring" else tokens(x) <= tokens(t) for x in texts]
            if holds and (any if any_text else all)(holds):
                out.add((q, i))
    return out


@pytest.mark.parametrize("mode", ["substring", "token"])
def test_index_passes_what_reading_all_passes(spark, tmp_path, monkeypatch, mode):
    monkeypatch.setattr(T, "PAPERS_PER_BLOCK", 2)
    papers = spark.createDataFrame([(i, t, i % 3) for i, t in TEXTS.items()], "paperId int, title string, grams int")
    filters = spark.createDataFrame(FILTERS, "query_id int, texts array<string>, any boolean")
    index = T.build(papers, str(tmp_path / mode), "title", mode=mode)
    hits, read = T.search(index, filters)
    assert {(r["query_id"], r["paperId"]) for r in hits.collect()} == expected(mode)
    shares = {r["query_id"]: r["blocks_read"] / r["blocks"] for r in read.collect()}
    assert shares[5] == 0 and shares[1] < 0.7 and len(shares) == len(FILTERS)
    if mode == "substring":
        assert shares[4] == 1.0  # too short for a trigram


def test_many_blocks_pass_the_first_bitmap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "PAPERS_PER_BLOCK", 0.01)  # numbers over 32,768
    papers = spark.range(900).select(F.col("id").alias("paperId"), F.concat(F.lit("paper "), F.col("id").cast("string"), F.lit(" end")).alias("title"))
    index = T.build(papers, str(tmp_path / "wide"), "title")
    assert index.grams.agg(F.max("bucket")).first()[0] > 1
    filters = spark.createDataFrame([(1, [" 77"], True)], "query_id int, texts array<string>, any boolean")
    assert sorted(r["paperId"] for r in T.search(index, filters)[0].collect()) == [77, *range(770, 780)]


def test_empty_table_and_unknown_mode(spark, tmp_path):
    papers = spark.createDataFrame([], "paperId int, title string")
    filters = spark.createDataFrame(FILTERS, "query_id int, texts array<string>, any boolean")
    assert T.search(T.build(papers, str(tmp_path / "e"), "title"), filters)[0].count() == 0
    with pytest.raises(ValueError, match="mode"):
        T.build(papers, str(tmp_path / "m"), "title", mode="fuzzy")


def test_stored_bitmaps_take_room_by_their_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "PAPERS_PER_BLOCK", 0.1)
    papers = spark.range(300).select(F.col("id").alias("paperId"), F.concat(F.lit("every w"), F.col("id").cast("string")).alias("title"))
    index = T.build(papers, str(tmp_path / "packed"), "title", mode="token")
    blocks = spark.read.parquet(str(tmp_path / "packed" / "papers")).select("block").distinct().count()
    sizes = sorted(r["n"] for r in index.grams.select(F.length("bits").alias("n")).collect())
    assert sizes == [2] * 300 + [2 * blocks] * 2  # 4,096 each before
    wide = spark.range(9000).select(F.col("id").alias("paperId"), F.lit("every").alias("title"))
    index = T.build(wide, str(tmp_path / "whole"), "title", mode="token")
    assert {r["n"] for r in index.grams.select(F.length("bits").alias("n")).collect()} == {T.BITMAP_BYTES}
    filters = spark.createDataFrame([(1, ["every"], True)], "query_id int, texts array<string>, any boolean")
    assert T.search(index, filters)[0].count() == 9000
