import random
import re
from collections import Counter

from pyspark.sql import functions as F

from paperloom.operators import blocks as B
from paperloom.operators import chunks as K


def expected_windows(text, size, cap, prefix):
    """Brute force on token lists."""
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text) if s.strip()]
    longest = size - prefix - 5
    pieces = []
    for s in sentences:
        words = s.split()
        pieces += [words[i : i + longest] for i in range(0, len(words), longest)]
    packed, open_chunk = [], []
    for words in pieces:
        if len(words) < 3:
            continue
        if len(packed) > cap + 2:
            break
        if len(open_chunk) + len(words) < size - prefix:
            open_chunk = open_chunk + words
        else:
            packed += [open_chunk] if open_chunk else []
            open_chunk = words
    if len(packed) < cap + 2 and open_chunk:
        packed.append(open_chunk)
    out = []
    for i in range(min(len(packed), cap + 1)):
        if i == 0:
            lo, hi = 0, 3
        elif i == len(packed) - 1:
            lo, hi = max(0, i - 2), i + 1
        else:
            lo, hi = i - 1, i + 2
        start = prefix + sum(len(c) for c in packed[lo:i])
        out.append((i, " ".join(w for c in packed[lo:hi] for w in c), start, start + len(packed[i])))
    return out


def test_chunks_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["", "Short one.", "A b. C d. E f."]
    for _ in range(40):
        sentences = []
        for _ in range(rng.randint(1, 30)):
            n = rng.choice([1, 2, 3, 5, 9, 25, 60])
            sentences.append("W" + " w".join(str(rng.randint(0, 9)) for _ in range(n)) + rng.choice(".!?"))
        texts.append(rng.choice(["  ", "\n", " "]).join(sentences))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, main_text string")
    got = {}
    for r in K.chunk_papers(df, chunk_size=24, max_chunks=3, prefix_len=2, min_sentence_tokens=3).collect():
        assert r["is_ref"] is False
        got.setdefault(r["id"], []).append((r["chunk_idx"], r["text"], r["core_start"], r["core_end"]))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == expected_windows(text, 24, 3, 2)


def test_single_chunk_papers_drop_out_if_asked(spark):
    df = spark.createDataFrame([(1, "Only a few words here.")], "id int, main_text string")
    assert K.chunk_papers(df, drop_single=True).count() == 0
    assert K.chunk_papers(df).count() == 1


def test_chunks_hold_every_token(spark):
    texts = ["Hi. " + "Some words go on. " * 900 + "w " * 700 + "No. A. End", "", "One", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, main_text string")
    spans = K.chunk_papers(df, chunk_size=24, prefix_len=2).groupBy("id").agg(F.sum(F.col("core_end") - F.col("core_start"))).collect()
    assert {r[0]: r[1] for r in spans} == {i: len(t.split()) for i, t in enumerate(texts) if t}


def test_role_prefixes(one):
    assert one(K.with_role_prefix(F.lit("t"), "x-e5-y", "Query")) == "query: t"
    assert one(K.with_role_prefix(F.lit("t"), "other", "document")) == " t"


def block(i, size, page, text):
    return (i, float(size), float(page), 0.1, 0.1, 0.1, 0.1, text)


SCHEMA = "block_idx int, fontsize double, page double, bottom double, top double, left double, right double, content string"


def one_doc(spark, blocks):
    return B.serialise(spark.createDataFrame(blocks, SCHEMA).withColumn("doc", F.lit("d")), "doc")


def test_parse_restores_blocks_and_skips_unreadable_ones(spark):
    doc = one_doc(spark, [block(0, 9, 1, "first **bold** words"), block(1, 10, 2, "second\nline")])
    broken = doc.withColumn("full_text", F.concat("full_text", F.lit("**BLOCK**fs==oops**p== 1.0**b==1**t==1**l==1**r==1**\nx")))
    parsed = broken.select(F.inline(B.parse_blocks(F.col("full_text")))).collect()
    assert [(r["fontsize"], r["page"], r["content"].strip("\n")) for r in parsed] == [
        (9.0, 1.0, "first **bold** words"), (10.0, 2.0, "second\nline"),
    ]


def test_body_font_first_seen_wins_a_tie(spark):
    words = "one two three"
    doc = one_doc(spark, [block(0, 12, 0, words), block(1, 9, 0, words), block(2, 7, 4, "late page words " * 9)])
    parsed = doc.select(B.body_font(B.parse_blocks(F.col("full_text")), F.lit(False)).alias("f")).first()
    assert parsed["f"] == 12.0
    table = doc.select("doc", F.posexplode(B.parse_blocks(F.col("full_text"))).alias("block_idx", "b")).select("doc", "block_idx", "b.*")
    assert B.font_modes(table, "doc").first()["body_font"] == 12.0


def test_references_are_cut_from_a_document(spark):
    body = [block(i, 10, i // 4, f"some plain body text of part {i} goes on and on") for i in range(12)]
    head = [block(12, 10, 3, "closing words of the paper\nReferences")]
    refs = [block(13 + i, 8, 4, f"[{i}] Smith, A. and Lee, B. Title of work, {1990 + i}.") for i in range(10)]
    after = [block(23, 10, 5, "appendix text that runs in body size again"), block(24, 10, 5, "the end of it all")]
    doc = one_doc(spark, body + head + refs + after)
    out = B.clean_full_text(doc, with_references=True, as_of_year=2026).first()
    assert out["main_text"].startswith(" some plain body") and "Smith" not in out["main_text"] and "appendix" in out["main_text"]
    assert "Smith, A and Lee, B Title" in out["ref_text"] and "appendix" not in out["ref_text"] and "\n" not in out["ref_text"]
    assert out["ref_text"].count("Smith") == 10


def test_short_documents_give_empty_texts(spark):
    docs = spark.createDataFrame([("a", "x" * 99), ("b", None), ("c", "y" * 100)], "doc string, full_text string")
    out = {r["doc"]: (r["main_text"], r["ref_text"]) for r in B.clean_full_text(docs, False, 2026, min_chars=100).collect()}
    assert out == {"a": ("", ""), "b": ("", ""), "c": ("", "")}


def test_margin_limits_are_weighted_by_words(spark):
    import numpy as np

    rng = random.Random(3)
    data = [(i, rng.random(), rng.randint(1, 40)) for i in range(60)]
    df = spark.createDataFrame(data, "block_idx int, m double, nwords int").withColumn("doc", F.lit("d"))
    df = df.withColumns({c: F.col("m") for c in B.MARGINS})
    want = np.quantile(np.repeat([m for _, m, _ in data], [n for _, _, n in data]), 0.02)
    assert abs(B.margin_limits(df, "doc").first()["top_limit"] - want) < 1e-12


def test_mode_counter_helper_agrees(spark):
    sizes = [9, 8, 8, 9, 7]
    doc = one_doc(spark, [block(i, s, 0, "two words") for i, s in enumerate(sizes)])
    got = doc.select(B.body_font(B.parse_blocks(F.col("full_text")), F.lit(False)).alias("f")).first()["f"]
    assert got == Counter(sizes).most_common(1)[0][0]
