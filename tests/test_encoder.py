import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import encoder as E
from paperloom.operators import learn as L
from paperloom.operators import search as S

WIDTH = 8
RNG = np.random.default_rng(2)
PAPERS = {f"p{i}": RNG.normal(size=(n, WIDTH)) for i, n in enumerate([1, 3, 3, 0, 5, 140])}
QUERIES = {"q0": RNG.normal(size=(1, WIDTH)), "q1": RNG.normal(size=(4, WIDTH))}


def plain(x, w):
    """The encoder one vector, one head and one number at a time."""
    x = np.array([v + w.positions[min(i, len(w.positions) - 1)] for i, v in enumerate(x)])
    d = WIDTH // w.heads

    def norm(v, scale, shift):
        return (v - v.mean()) / np.sqrt(v.var() + 1e-5) * scale + shift

    for l in w.layers:
        heads = []
        for h in range(w.heads):
            part = lambda k: [l.attend[k * WIDTH + h * d : k * WIDTH + (h + 1) * d] @ v + l.offset[k * WIDTH + h * d : k * WIDTH + (h + 1) * d] for v in x]
            asks, keys, values = part(0), part(1), part(2)
            rows = []
            for a in asks:
                e = np.exp([a @ k / np.sqrt(d) for k in keys])
                rows.append(sum(p * v for p, v in zip(e / e.sum(), values)))
            heads.append(rows)
        mixed = [np.concatenate([heads[h][i] for h in range(w.heads)]) for i in range(len(x))]
        x = [norm(v + l.gather @ m + l.gather_offset, l.norms[0], l.norms[1]) for v, m in zip(x, mixed)]
        x = [norm(v + l.narrow @ np.maximum(l.widen @ v + l.widen_offset, 0) + l.narrow_offset, l.norms[2], l.norms[3]) for v in x]
    return np.array([w.projection @ v + w.projection_offset for v in x])


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frames(spark):
    papers = spark.createDataFrame([(p, v.tolist(), "x") for p, v in PAPERS.items()], "paperId string, vectors array<array<double>>, more string").repartition(2)
    queries = spark.createDataFrame([(q, i, v.tolist()) for q, vs in QUERIES.items() for i, v in enumerate(vs)], "query_id string, qi int, embedding array<double>")
    return papers, queries


def test_encoding_is_the_plain_formula(spark):
    weights = E.seeded(WIDTH, 1, places=128)
    papers, _ = frames(spark)
    got = {r["paperId"]: np.array(r["vectors"]) for r in E.encode(papers, weights).collect()}
    assert set(got) == set(PAPERS) and len(got["p3"]) == 0
    for p, v in PAPERS.items():
        if len(v):
            assert np.allclose(got[p], plain(v, weights))


def test_scores_of_encoded_pairs(spark):
    weights = E.seeded(WIDTH, 1)
    papers, queries = frames(spark)
    pairs = queries.select("query_id").distinct().crossJoin(papers.select("paperId")).where("paperId <> 'p5'")
    got = {(r["query_id"], r["paperId"]): r["score"] for r in S.score_pairs(pairs, papers, queries, encoder=weights).collect()}
    assert len(got) == 10
    for (q, p), score in got.items():
        d = PAPERS[p]
        want = (unit(plain(QUERIES[q], weights)) @ unit(plain(d, weights)).T).max(axis=1).sum() if len(d) else 0
        assert abs(score - want) < 2e-6


def test_untrained_weights_score_centred_cosines(spark):
    papers, queries = frames(spark)
    pairs = queries.select("query_id").distinct().crossJoin(papers.select("paperId"))
    rows = lambda df: sorted((r["query_id"], r["paperId"], r["score"]) for r in df.collect())
    a, b = rows(S.score_pairs(pairs, papers, queries, encoder=E.untrained(WIDTH))), rows(S.score_pairs(pairs, papers, queries, kind="centred"))
    assert [x[:2] for x in a] == [x[:2] for x in b] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b))


def test_evaluation_scores_what_the_model_sees(spark):
    weights = E.seeded(WIDTH, 4)
    ids = [("p1", "p2", "p4"), ("p0", "p4", "p1")]
    rows = [tuple(x for p in t for x in (p, PAPERS[p].tolist())) for t in ids]
    names = ", ".join(f"{r}_id string, {r}_vectors array<array<double>>" for r in ("query", "positive", "negative"))
    got = L.evaluate(spark.createDataFrame(rows, names), weights, temperature=0.1).first()
    score = lambda a, b: (unit(plain(PAPERS[a], weights)) @ unit(plain(PAPERS[b], weights)).T).max(axis=1).sum()
    want = [score(q, p) - score(q, n) for q, p, n in ids]
    assert got["triplets"] == 2 and abs(got["margin"] - np.mean(want)) < 1e-5 and got["accuracy"] == np.mean([w > 0 for w in want])
    assert got["loss"] > 0


def test_vectors_of_another_width_fail(spark):
    import pytest

    papers, _ = frames(spark)
    with pytest.raises(Exception, match="width"):
        E.encode(papers.where(F.col("paperId") == "p1"), E.untrained(16)).collect()
