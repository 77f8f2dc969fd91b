import hashlib
import math

import numpy as np
import pytest

from paperloom.llm import codes as C

SCHEMA = "vec_id long, embedding array<float>, label int, n int, part int, code string"


def brute(table):
    """Lloyd's rounds without trees, in Python's integers."""
    kept = [r for r in table if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) if kept else 0
    kept = [r for r in kept if len(r[1]) == width]
    size = -(-width // 8)
    points = [[math.floor(4096 * x) for x in r[1]] + [0] * (8 * size - width) for r in kept]
    parts = [[p[k * size : (k + 1) * size] for k in range(8)] for p in points]
    books = [[p[k] for p in parts[:16]] for k in range(8)]

    def nearest(v, book):
        gaps = [sum((x - y) ** 2 for x, y in zip(v, e)) for e in book]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(6):
        for k in range(8):
            mine = [nearest(p[k], books[k])[0] for p in parts]
            for e in range(len(books[k])):
                own = [p[k] for p, m in zip(parts, mine) if m == e]
                if own:
                    books[k] = books[k][:e] + [[sum(x) // len(own) for x in zip(*own)]] + books[k][e + 1 :]
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    rows = []
    for r, p in zip(kept, parts):
        found = [nearest(p[k], books[k]) for k in range(8)]
        rows.append((r[0], "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), r[2]))
    sums = {}
    for _, _, d, label in rows:
        sums[label] = sums.get(label, 0) + d
    return sorted(((i, c, d, sums[label], said) for i, c, d, label in rows), key=str)


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, width))
    rows = centres[rng.integers(0, 9, n)] + 0.2 * rng.standard_normal((n, width))
    return [(i * 7 % 1009, [float(np.float32(x)) for x in r], int(i % 3) if i % 5 else None) for i, r in enumerate(rows)]


def got(spark, table):
    rows = spark.createDataFrame([(*r, 1, 2, "x") for r in table], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in C.compressed(rows).collect()), key=str)


def odd(width):
    return [(5000, None, 1), (5001, [], 1), (5002, [float("nan")] * width, 1), (5003, [None] * width, 1), (5004, [float("inf")] * width, 1), (5005, [1.0], 2), (None, [0.5] * width, 2)]


@pytest.mark.parametrize("width", [16, 24, 13])
def test_codes_are_those_of_rounds_without_trees(spark, width):
    table = vectors(700, width, width) + odd(width)
    table += [(6000 + i, table[0][1], 1) for i in range(60)] + [table[3]] * 3  # copies, and rows with one id
    assert got(spark, table) == brute(table)


def test_few_and_equal_vectors(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    for table in ([(3, [0.25] * 8, None)], [(i, [0.25] * 8, 1) for i in range(40)], [(i, [0.25 * i] * 16, i) for i in range(5)]):
        assert got(spark, table) == brute(table)


def test_trees_prune_and_lose_no_tie():
    rng = np.random.default_rng(4)
    for trial in range(40):
        n, d, e = rng.integers(1, 400), rng.integers(1, 5), rng.integers(1, 17)
        points = rng.integers(-6, 7, (n, d)) * rng.integers(1, 4)
        book = rng.integers(-6, 7, (e, d))  # many ties, equal entries
        order = C.grown(points, C.LEAF)
        assert sorted(order.tolist()) == list(range(n))
        tree = C.Tree(points[order], C.LEAF)
        want = ((points[order][:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (C.coded(tree, book) == want).all()
        counts, sums = C.assigned(tree, book)
        assert (counts == np.bincount(want, minlength=e)).all()
        assert (sums == np.stack([points[order][want == k].sum(axis=0) for k in range(e)])).all()


def test_whole_nodes_are_served_without_their_parts():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4096, 4096, (16, 8))
    points = centres[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 8))
    tree = C.Tree(points[C.grown(points, C.LEAF)], C.LEAF)
    served, left = C.descend(tree, C.Tree(centres[C.grown(centres, 1)], 1))
    whole = sum(int(np.diff(tree.at[level])[nodes].sum()) for level, nodes, _ in served)
    assert whole > 3000 and len(left[0]) < 16 * len(tree.at[-1]) / 4


def test_large_components_fit(spark):
    table = [(i, [3e38 if i % 2 else -3e38, 20000.0, *[0.0] * 14], 1) for i in range(20)]
    rows = got(spark, table)
    assert len(rows) == 20 and all(r[2] == 0 for r in rows)
