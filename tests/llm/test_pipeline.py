"""The stages of the corpus pipeline, each against what it promises for its own input."""

import pytest

import corpus_pipeline
from paperloom.llm import quality
from paperloom.llm.tables import given
from tests.llm.conftest import words
from tests.llm.test_dartminhash import brute
from tests.llm.test_native import held, level
from tests.llm.test_substring import removed


@pytest.fixture(scope="module")
def runs(spark, sf):
    """(name, input, output) of each stage over the smallest tables, as lists of rows."""
    docs, out = given(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, sf), name)
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return {name: x for name, *x in out}


def test_stages_keep_the_columns(spark, sf, runs):
    assert list(runs) == [name for name, _ in corpus_pipeline.STAGES]
    assert all(x[2] == given(spark, sf, "documents").columns for x in runs.values())


def test_rejected_documents_go(spark, sf, runs):
    before, after, _ = runs["quality_classifier"]
    scores = quality.predictions(given(spark, sf, "documents"), given(spark, sf, "labels")).collect()
    good = {r["doc_id"] for r in scores if r["predicted"]}
    assert sorted(after, key=str) == sorted((r for r in before if r["doc_id"] in good), key=str) and len(after) < len(before)


def test_one_of_each_near_duplicate_class_stays(runs):
    before, after, _ = runs["near_dedup"]
    classes = brute([(r["doc_id"], r["text"]) for r in before])
    assert sorted(after, key=str) == sorted((r for r in before if classes[r["doc_id"]] == r["doc_id"]), key=str) and len(after) < len(before)


def test_repeated_words_are_cut(runs):
    before, after, _ = runs["substring_dedup"]
    want = {i: n - gone for i, n, gone, _ in removed([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"]: len(words(r["text"])) for r in after} == {i: n for i, n in want.items() if n or not words({r["doc_id"]: r["text"] for r in before}[i])}


def test_documents_with_benchmark_items_go(spark, sf, runs):
    before, after, _ = runs["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in given(spark, sf, "benchmark").collect()]
    leaks = {d for d, *_ in held([(r["doc_id"], r["text"]) for r in before], items, words)}
    assert sorted(after, key=str) == sorted((r for r in before if r["doc_id"] not in leaks), key=str)


def test_mix_meets_its_targets(runs):
    before, after, _ = runs["source_mixing"]
    sizes, taken, longest = {}, {}, max(len(words(r["text"])) for r in before)
    for rows, total in ((before, sizes), (after, taken)):
        for r in rows:
            total[r["source"]] = total.get(r["source"], 0) + len(words(r["text"]))
    for source, target in level(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 2 * longest
    copies = {}
    for r in after:
        copies[r] = copies.get(r, 0) + 1
    assert set(copies) <= set(before) and max(copies.values()) <= 3


def test_run_is_the_stages_in_turn(spark, sf, runs):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, runs["source_mixing"][1]))
