import hashlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import substring
from tests.llm.conftest import prose, words

PASSAGE = prose(70, 1)
ROWS = [
    (5, prose(120, 2) + " " + PASSAGE + "\n" + prose(30, 3)),
    (2, prose(80, 4) + "\t" + PASSAGE),
    (9, PASSAGE),
    (7, prose(120, 2) + " " + PASSAGE + "\n" + prose(30, 3)),
    (1, prose(49, 5)),
    (3, prose(49, 5)),
    (4, None),
    (6, ""),
    (8, "again " * 200),
    (10, "again " * 60 + prose(60, 8)),
    (11, prose(60, 8)[:-1] + "Z " + PASSAGE[5:] + " ß é  nbsp"),
    (12, prose(20_000, 9, 10**6) + " " + prose(60, 8)),
    (13, prose(300, 10) + " " + prose(300, 10)),
    (14, prose(300, 10)),
]


def removed(rows):
    first = {}
    for i, text in rows:
        if i is not None:
            w = words(text)
            for p in range(len(w) - 49):
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ROWS, ROWS + ROWS[:3], ROWS + [(None, PASSAGE)], ROWS[:1], [(1, None)]])
def test_digest_is_brute_force(docs, rows):
    got = substring.digest(docs(rows, extra=("th", "spans", "whole")))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == removed(rows)


def test_cut_keeps_columns_and_drops_emptied(docs):
    table = docs(ROWS, extra=("th", "spans", "state"))
    out = substring.cut_repeats(table)
    assert out.columns == table.columns
    got = {r["doc_id"]: r for r in out.collect()}
    want = {i: (n, gone, sha) for i, n, gone, sha in removed(ROWS)}
    assert set(got) == {i for i, (n, gone, _) in want.items() if not n or gone < n}
    for i, r in got.items():
        assert hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == want[i][2]
        if not want[i][1]:
            assert r["text"] == dict(ROWS)[i]
        else:
            assert r["n_chars"] == len(r["text"])


def test_empty_table(docs):
    assert substring.digest(docs([])).count() == 0
    assert substring.cut_repeats(docs([])).count() == 0


def test_paths_with_other_words_than_their_source_remove_nothing(spark):
    """What a collision of names would make: a path whose words are not those at its source."""
    a, b, c = prose(120, 1), prose(120, 2), prose(30, 3) + " " + prose(120, 1) + " " + prose(20, 4)
    chosen = substring.keyed(spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string"))
    th = {r["doc_id"]: r["th"] for r in chosen.collect()}
    rows = [(2, th[2], 0, 71, 1, th[1], 0), (3, th[3], 30, 71, 1, th[1], 0), (3, th[3], 30, 70, 1, th[1], 1)]
    found = spark.createDataFrame(rows, "doc_id long, th long, start int, n int, source long, source_th long, source_start int")
    assert [(r["doc_id"], r["start"], r["n"]) for r in substring.verified(found, chosen).collect()] == [(3, 30, 71)]


def test_paths_are_the_longest_runs(spark):
    a, other = prose(200, 1), prose(200, 2)
    w, o = a.split(), other.split()
    c = " ".join(["x"] * 5 + w[20:90] + ["y"] + o[0:60] + w[100:160])
    chosen = substring.keyed(spark.createDataFrame([(1, a), (2, other), (3, c)], "doc_id long, text string"))
    full = F.array(F.struct(F.lit(0).alias("at"), (F.size(F.split("text", " ")) - 49).alias("span"))).alias("ranges")
    got = sorted((r["doc_id"], r["start"], r["n"], r["source"], r["source_start"]) for r in substring.paths(chosen.select("*", full)).collect())
    assert got == [(3, 5, 21, 1, 20), (3, 76, 11, 2, 0), (3, 136, 11, 1, 100)]


def test_any_column_names_pass(spark):
    text = prose(80, 9)
    table = spark.createDataFrame([(1, text, 1, 2), (2, text + " more words", 3, 4)], "doc_id long, text string, `my col` int, `a-b:c` int")
    got = {r["doc_id"]: (r["text"], r["my col"], r["a-b:c"]) for r in substring.cut_repeats(table).collect()}
    assert got == {1: (text, 1, 2), 2: ("more words", 3, 4)}
