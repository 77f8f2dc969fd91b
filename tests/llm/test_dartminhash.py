import math

import numpy as np
import pytest

from paperloom.llm import dartminhash as dart
from tests.llm.conftest import prose, words


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows):
    """Classes by all pairs."""
    ids = [i for i, _ in rows if i is not None]
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    sets = [(i, shingle_set(t), tuple(words(t))) for i, t in rows if i is not None]
    for k, (a, x, u) in enumerate(sets):
        for b, y, v in sets[:k]:
            if u == v or x and y and len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: root(i) for i in ids}


def edited(text, places):
    w = words(text)
    for p in places:
        w[p] = f"new{p}"
    return " ".join(w)


def rows():
    base = prose(400, 21, 5000)
    out = [(100 + k, edited(base, [k * 9 % 400, (k * 31 + 7) % 400])) for k in range(40)]  # a chain of near copies
    out += [(k, prose(150, 300 + k, 3000)) for k in range(30)]
    out += [(60, out[45][1]), (61, edited(out[50][1], [3])), (62, edited(out[50][1], list(range(0, 150, 8))))]
    out += [(70, "one two"), (71, "one two"), (72, "one"), (73, None), (74, "   "), (75, "one two three four five"), (76, "a " * 300), (77, "a " * 310)]
    return out


def test_classes_are_brute_force(docs):
    got = {r["doc_id"]: r["class_id"] for r in dart.classes(docs(rows(), extra=("nid", "words", "band"))).collect()}
    assert got == brute(rows())


def test_repeated_text_is_of_the_class_of_the_text(docs):
    """Nearly the same shingle sets, with other counts."""
    table = []
    for k in range(12):
        text = prose(200, 700 + k, 5000)
        table += [(100 * k + n, " ".join([text] * n)) for n in (1, 2, 5, 20)]
        line = " ".join(words(text)[:30])
        table.append((100 * k + 50, text + (" " + line) * 40))
    want = brute(table)
    assert all(c == i // 100 * 100 + 1 for i, c in want.items())
    assert {r["doc_id"]: r["class_id"] for r in dart.classes(docs(table)).collect()} == want


def test_nulls_and_repeated_rows(docs):
    table = docs([(1, "x y z"), (1, "x y z"), (None, "x y z"), (None, "other words"), (2, "x y z")])
    got = sorted((tuple(r) for r in dart.classes(table).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 1)], key=str)
    kept = dart.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1]


def test_empty_table(docs):
    assert dart.classes(docs([])).count() == 0


def test_signature_agreement_is_weighted_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = np.repeat(pool[:50], 1 + np.arange(50) % 3), pool[10:]
    agree = []
    for seed in range(12):
        x, y = a ^ np.uint64(seed << 40), b ^ np.uint64(seed << 40)
        s = dart.signatures(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2)
        agree.append((s[0] == s[1]).mean())
    wa = {int(v): 1 + math.log(n) for v, n in zip(*np.unique(a, return_counts=True))}
    wb = {int(v): 1.0 for v in b}
    keys = set(wa) | set(wb)
    true = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
    assert abs(np.mean(agree) - true) < 0.05


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 30)] + [(50, 60), (55, 60)]
    got = {r["nid"]: r["label"] for r in dart.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 31)}, 50: 50, 55: 50, 60: 50}


@pytest.mark.parametrize("share", [20, 1 << 17])
def test_no_link_of_a_mixed_family_is_lost(spark, monkeypatch, share):
    """Members of one bucket in two groups whose only links avoid the first center."""
    monkeypatch.setattr(dart, "SHARE", share)
    sets = [(1, list(range(0, 10))), (2, list(range(100, 110))), (3, list(range(100, 109)) + [999]), (4, [7] * 1 + list(range(200, 209)))]
    sets += [(k, list(range(1000 * k, 1000 * k + 10))) for k in range(5, 40)] + [(40, list(range(39_000, 39_009)) + [1])]
    members = spark.createDataFrame([(9, k) for k, _ in sets], "band long, nid long")
    found, _ = dart.links(members, spark.createDataFrame(sets, "nid long, set array<long>"))
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [(2, 3), (39, 40)]


def test_short_notices_of_one_family_leave_nothing_to_compare(docs, monkeypatch):
    """Boilerplate with a number each: no two are alike, all of them meet in some bucket."""
    seen = []
    narrowed = dart._narrowed
    monkeypatch.setattr(dart, "_narrowed", lambda mixed: seen.append((mixed.count(), narrowed(mixed).count())) or narrowed(mixed))
    rows = [(k, f"this page was taken down by the staff on request {k} today") for k in range(3000)]
    rows += [(5000 + k, "this page was taken down by the staff on request soon today") for k in range(5)]
    got = {r["doc_id"]: r["class_id"] for r in dart.classes(docs(rows)).collect()}
    assert got == {k: 5000 if k >= 5000 else k for k, _ in rows}
    assert seen[0][0] > 2000 and seen[0][1] < 100


def test_open_nodes_find_all_links_in_small_shares(docs, monkeypatch):
    monkeypatch.setattr(dart, "SHARE_NODES", 3)
    got = {r["doc_id"]: r["class_id"] for r in dart.classes(docs(rows())).collect()}
    assert got == brute(rows())
    base = prose(60, 5, 900)
    near = [(k, edited(base, [k % 60, (k * 7 + 3) % 60][: 1 + k % 2])) for k in range(60)]  # around the threshold
    got = {r["doc_id"]: r["class_id"] for r in dart.classes(docs(near)).collect()}
    assert got == brute(near)


def test_sets_of_the_similarity_share_a_rare_shingle():
    rng = np.random.default_rng(2)
    import pyarrow as pa

    for _ in range(60):
        n = int(rng.integers(1, 60))
        a = rng.choice(5000, n, replace=False)
        shared = int(np.ceil(2 * 0.8 / 1.8 * n - 1e-9)) if n > 1 else n
        b = np.concatenate([a[:shared], 5000 + rng.choice(5000, n - shared, replace=False)])
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        sets = pa.array([a * 2**40, b * 2**40], pa.list_(pa.int64()))
        batch = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([1, 2]), pa.array([1, 2]), sets], names=["family", "nid", "label", "set"])
        counts = rng.integers(0, 9, dart.SLOTS)
        out = next(dart._prefixes(counts)([batch])).to_pandas()
        assert set(out[out.nid == 1].shingle) & set(out[out.nid == 2].shingle)
