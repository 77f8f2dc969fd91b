import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.functions import answers as A
from paperloom.operators import cells as C
from paperloom.operators import learn as L
from paperloom.operators import search as S


def test_density_equals_brute_force_with_a_dense_cell(spark):
    rng = random.Random(4)
    pts = [(i, rng.gauss(0, 0.02), rng.gauss(0, 0.02)) for i in range(120)]
    pts += [(1000 + i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(150)]
    eps, least = 0.4, 5
    near = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= eps * eps
    core = {a[0] for a in pts if sum(near(a, b) for b in pts) >= least}
    noise = {a[0] for a in pts if a[0] not in core and not any(b[0] in core and near(a, b) for b in pts)}
    out = L.density_labels(spark.createDataFrame(pts, "id int, x double, y double"), eps, least).collect()
    assert len(out) == len(pts)
    assert {r["id"] for r in out if r["core"]} == core and {r["id"] for r in out if r["outlier"]} == noise
    assert noise and core


def graph(spark):
    rng = np.random.default_rng(6)
    n = 30
    vectors = {f"d{i}": rng.normal(size=(1 + i % 3, 5)) for i in range(n)}
    meta = [(f"d{i}", f"20{10 + i % 9}-0{1 + i % 9}-15", ";".join([f"d{i * 3 % n}", f"d{i * 7 % n}", "lost", "d3"])) for i in range(n)]
    papers = spark.createDataFrame([(p, v.tolist()) for p, v in vectors.items() if p != "d7"], "paperId string, vectors array<array<float>>")
    return meta, vectors, spark.createDataFrame(meta, "paperId string, publicationDate string, referenceIds string"), papers


def test_triplets_equal_brute_force_in_many_blocks_and_through_an_index(spark, tmp_path, monkeypatch):
    meta, vectors, meta_df, papers = graph(spark)
    rank = lambda p, r: (F.length(p) + F.length(r)) % 4
    dates = {p: d for p, d, _ in meta}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = lambda a, b: round(float((unit(vectors[a]) @ unit(vectors[b]).T).max(axis=1).sum()), 6)
    want = set()
    for p, d, refs in meta:
        refs = {r for r in refs.split(";") if r in vectors}
        for r in refs:
            if p == "d7" or r == "d7":
                continue
            pool = [c for c in vectors if c != "d7" and dates[c] < d and c != p and c not in refs]
            pool.sort(key=lambda c: (-sim(r, c), c))
            k = (len(p) + len(r)) % 4
            if k < len(pool):
                want.add((p, r, pool[k]))
    assert want and {tuple(r) for r in L.mine_triplets(meta_df, papers, rank).collect()} == want
    monkeypatch.setattr(L, "CITED_PER_BLOCK", 8)
    monkeypatch.setattr(C, "PAPERS_PER_BLOCK", 2)
    monkeypatch.setattr(L, "PAIRS_PER_ROW", 2)  # a paper cited often is several rows
    assert {tuple(r) for r in L.mine_triplets(meta_df, papers, rank).collect()} == want
    index = L.mining_index(meta_df, papers, str(tmp_path / "index"), cells=3)
    assert {tuple(r) for r in L.mine_triplets(meta_df, papers, rank, index=index).collect()} == want


def test_triplet_scores_and_metrics(spark):
    rows = [("q", "p", "n", [[1.0, 0.0]], [[1.0, 0.0]], [[0.0, 1.0]])]
    f = spark.createDataFrame(rows, "query_id string, positive_id string, negative_id string, query_vectors array<array<float>>, positive_vectors array<array<float>>, negative_vectors array<array<float>>")
    s = L.score_triplets(f, temperature=1.0)
    row = s.first()
    assert (row["positive_score"], row["negative_score"]) == (1.0, 0.0)
    assert abs(row["loss"] - np.log1p(np.exp(-1))) < 1e-6
    m = L.triplet_metrics(s).first()
    assert (m["triplets"], m["accuracy"], m["margin"]) == (1, 1.0, 1.0)


def test_blend_needs_labels_of_two_classes(spark):
    rng = random.Random(8)
    rows = [(f"p{i}", i % 2, (i % 2) + rng.gauss(0, 0.3), rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "paperId string, user_score int, retrieval_score double, rerank_score double")
    assert L.fit_blend(df.limit(10)) is None and L.fit_blend(df.where("user_score = 1")) is None
    same = L.blend(df, None)
    assert same.where(F.col("blended_score") != F.col("rerank_score")).count() == 0
    out = L.blend(df, L.fit_blend(df))
    means = {r["user_score"]: r["m"] for r in out.groupBy("user_score").agg(F.avg("blended_score").alias("m")).collect()}
    assert means[1] > 0.7 > 0.3 > means[0]


def test_blend_by_task_is_newton_on_each_task(spark):
    rng = np.random.default_rng(4)
    rows = []
    for task, n in (("a", 60), ("b", 35), ("few", 8), ("one", 40)):
        for i in range(n):
            y = 1 if task == "one" else int(rng.random() < 0.4)
            rows.append((task, f"{task}{i}", y, float(y + rng.normal()), float(rng.random())))
    rows += [("a", "new", None, 0.4, 0.2), ("none", "x", None, 0.1, 0.9)]
    df = spark.createDataFrame(rows, "task_id string, paperId string, user_score int, retrieval_score double, rerank_score double")
    weights = L.fit_blend_by_task(df)
    got = {r["task_id"]: (r["b0"], r["b1"], r["b2"]) for r in weights.collect()}
    assert set(got) == {"a", "b"}
    for task, beta in got.items():
        data = np.array([(r[2], r[3], r[4]) for r in rows if r[0] == task and r[2] is not None], float)
        y, x = data[:, 0], (data[:, 1:] - data[:, 1:].mean(0)) / data[:, 1:].std(0)
        x = np.hstack([np.ones((len(y), 1)), x])
        w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        p = 1 / (1 + np.exp(-x @ np.array(beta)))
        gradient = x.T @ (w * (p - y)) + np.array([0, beta[1], beta[2]])
        assert np.abs(gradient).max() < 1e-8
    out = {r["paperId"]: r for r in L.blend_by_task(df, weights).collect()}
    assert out["x"]["scorer"] == "rerank" and out["x"]["blended_score"] == 0.9
    assert out["new"]["scorer"] == "fitted" and 0 < out["new"]["blended_score"] < 1 and len(out) == len(rows)


def test_attention_pooling_is_softmax_weighted(spark):
    rng = np.random.default_rng(9)
    data = {f"p{i}": rng.normal(size=(2 + i, 4)) for i in range(3)}
    w, b, q = rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=4)
    df = spark.createDataFrame([(p, v.tolist()) for p, v in data.items()], "paperId string, vectors array<array<double>>")
    for r in L.attention_pool(df, w, b, q).collect():
        x = data[r["paperId"]]
        s = (x @ w.T + b) @ q
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert np.allclose(r["embedding"], p @ x)


def test_split_is_stable_and_about_a_fifth(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("i"))
    a = df.where(L.split_share(F.col("i"))).count()
    assert 320 < a < 480 and a == df.repartition(7).where(L.split_share(F.col("i"))).count()


def parsed(one, text, schema):
    return one(A.parse_answer(F.lit(text), schema))


def test_loose_answers(one):
    text = 'Sure <think>hidden {"queries": ["no"]}</think> {"Sub_Queries": ["a", "b"], "ETHICAL": True, "scientific": None, "details": False, } bye'
    r = parsed(one, text, "expand")
    assert (r["queries"], r["ethical"], r["scientific"], r["details"], r["search_paperIds"]) == (["a", "b"], True, None, False, None)
    assert parsed(one, "no braces at all", "title")["title"] is None
    assert parsed(one, '{"topic": {"deep": 1}}', "title")["title"] == '{"deep":1}'
    assert parsed(one, "{broken", "title")["title"] is None
    assert one(A.think_part(F.lit("a <think> x </think> b"))) == "x"
    assert one(A.content_part(F.lit(" a <think>x</think> b "))) == "a  b"


def test_plan_and_dates(one):
    p = one(A.parse_plan(F.lit('{"abstract": "s", "sections": [{"title": "Introduction", "papers": []}, {"topic": "X", "references": ["1"]}]}')))
    assert p["abstract"] == "s" and [s["paperIds"] for s in p["sections"]] == [["1"], ["1"]]
    assert [one(A.normal_date(F.lit(d))) for d in ("nov 2016", "2020", "2021-03", "2021-03-04", "soon")] == [
        "2016-11-01", "2020-01-01", "2021-03-01", "2021-03-04", None,
    ]


def test_linkify_longest_first_repeats_and_loose_ids(one):
    papers = F.array(*[F.struct(F.lit(i).alias("paperId"), F.lit(label).alias("label")) for i, label in (("abcde", "A"), ("abcdef", "B abcde"))])
    assert one(A.linkify(F.lit("x abcdef abcdef, abcde."), papers)) == "x [B abcde](#abcdef), [A](#abcde)."
    solo = F.array(F.struct(F.lit("a1b2c3d4").alias("paperId"), F.lit("L").alias("label")))
    assert one(A.linkify(F.lit("see b2c3d."), solo, loose=True)).startswith("see [L](#a1b2c3d4)")


def test_citations_cards_messages(one):
    assert one(A.cited_ids(F.lit("a [x1] b [x2, x3] c [unsupported]"))) == ["x1", "x2", "x3", "unsupported"]
    paper = {"paperId": F.lit("p"), "title": F.lit("T"), "authorName": F.lit("Ann Lee,Bo"), "publicationDate": F.lit("2020-01-02"),
             "abstract": F.lit("abs"), "best_chunks": F.array(F.lit("c1"), F.lit("c2"))}
    card = one(A.article_card(paper))
    assert card == "--- Article ---\nArticle ID: [p]\nTitle: T\nAuthors: Ann Lee et al.\nDate: 2020-01-02\nExcerpt:\n'c1'\n\n"
    assert one(A.citation_label(F.lit("Ann Lee,Bo"), F.lit("2020-01-02"))) == "Lee et al., 2020"
    assert one(A.article_cards(F.array().cast("array<string>"))) == [A.NO_ARTICLES]


def test_split_has_a_test_row(spark):
    for n in (1, 2, 3, 50):
        df = spark.createDataFrame([(f"x{i}",) for i in range(n)], "k string")
        tests = L.split_rows(df, "k").where("test").count()
        assert tests == max(1, df.where(L.split_share(F.col("k"))).count())
    assert L.split_rows(df.where("false"), "k").count() == 0


def test_soft_pair_score_matches_formula(spark):
    q = spark.createDataFrame([("q", 0, [1.0, 0.0], "p")], "query_id string, qi int, embedding array<float>, paperId string")
    p = spark.createDataFrame([("p", [[1.0, 0.0], [0.0, 1.0]])], "paperId string, vectors array<array<float>>")
    assert abs(S.score_pairs(q, p, q, kind="soft", temperature=0.5).first()["score"] - np.log(np.exp(2) + 1)) < 1e-6
