import numpy as np

from paperloom.llm import hyperplanes as H

SCHEMA = "vec_id long, embedding array<float>, label int, name string, nid int, block int"


def clustered(seed=1, width=16):
    """Rows (vec_id, embedding, label): groups of near copies of different tightness, copies, and odd rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, (n, noise) in enumerate([(150, 0.035), (40, 0.02), (30, 0.045), (12, 0.03), (3, 0.001)]):
        base = rng.standard_normal(width)
        base /= np.linalg.norm(base)
        for _ in range(n):
            rows.append((base + noise * rng.standard_normal(width)).tolist())
    rows += rng.standard_normal((120, width)).tolist()
    labels = [i % 2 for i in range(len(rows))]
    table = [(1000 - i, [float(np.float32(x)) for x in r], l) for i, (r, l) in enumerate(zip(rows, labels))]
    table += [(2000 + i, table[i % 5][1], table[i % 5][2]) for i in range(25)]  # copies
    table += [(3000, [2 * x for x in table[0][1]], 0), (3001, table[0][1], None), (3002, None, 0), (3003, [], 0), (3004, [0.0] * width, 0)]
    table += [(3005, [float("nan")] * width, 0), (3006, [float("inf")] + [0.0] * (width - 1), 0), (3007, [None] + [1.0] * (width - 1), 0)]
    table += [(3008, [1.0, 1.0], 0), (3009, [1.0, 1.001], 0), (3010, [1e38, 1e38], 0), (3011, [1e-40, 1e-40], 0), (3012, [-0.0, 1.0], 1), (3013, [0.0, 1.0], 1)]
    table += [(None, table[40][1], table[40][2]), (999, table[1][1], table[1][2])]
    return table


def brute(table):
    fit = [
        r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) and r[2] is not None for r in table
    ]
    units = [np.array(r[1], np.float64) / np.abs(r[1]).max() if f else None for r, f in zip(table, fit)]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    n = len(table)
    label, links = list(range(n)), [0] * n
    edges = []
    for i in range(n):
        for j in range(i):
            if fit[i] and fit[j] and table[i][2] == table[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in edges:
        label[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i in range(n):
        if table[i][0] is not None:
            low[root(i)] = min(low.get(root(i), table[i][0]), table[i][0])
    out = []
    for i in range(n):
        c = low.get(root(i))
        out.append((table[i][0], links[i], c, c is not None and c == table[i][0]))
    return sorted(out, key=str)


def got(spark, table):
    rows = spark.createDataFrame([(*r, "x", 1, 2) for r in table], SCHEMA)
    return sorted((tuple(r) for r in H.grouped(rows).collect()), key=str)


def test_links_and_components_are_brute_force(spark, monkeypatch):
    table = clustered()
    want = brute(table)
    assert sum(w[1] > 50 for w in want) > 50 and len({w[2] for w in want}) > 100
    assert got(spark, table) == want
    monkeypatch.setattr(H, "SHARE", 16)  # buckets cut into shares that meet in blocks
    assert got(spark, table) == want


def test_empty_tables_and_tables_without_links(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 0), (2, [1.0], None), (2, [1.0], None)]) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_a_pair_at_the_threshold_is_found_for_nearly_certain():
    rng = np.random.default_rng(3)
    base = H.units(rng.standard_normal(64 * 3000), np.arange(3000) * 64, 64)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = H.SIMILARITY * base + np.sqrt(1 - H.SIMILARITY**2) * side
    planes = H.directions(64)
    same = ((base @ planes > 0) == (near @ planes > 0)).reshape(3000, H.TABLES, H.BITS).all(axis=2)
    assert same.any(axis=1).mean() > 0.999
