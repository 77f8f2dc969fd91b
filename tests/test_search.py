import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.operators import cells as C
from paperloom.operators import search as S
from paperloom.operators.embed import embed_texts, hashed_words
from paperloom.operators.filters import FILTERS, FilterTable, comparable, filter_row, payload_mask

RNG = np.random.default_rng(5)
DIM = 6
PAPERS = {f"p{i}": RNG.normal(size=(RNG.integers(1, 5), DIM)) for i in range(40)}
PAPERS["empty"] = np.zeros((0, DIM))
PAPERS["zero"] = np.zeros((2, DIM))
QUERIES = {f"q{i}": RNG.normal(size=(1 + i % 3, DIM)) for i in range(7)}


def unit(m, centred=False):
    m = m - m.mean(axis=1, keepdims=True) if centred and len(m) else m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def score(q, d, centred=False):
    if len(d) == 0:
        return 0.0
    return float((unit(q, centred) @ unit(d, centred).T).max(axis=1).sum() / len(q))


def expected(qid, k, allowed=lambda p: True):
    s = [(-round(score(QUERIES[qid], d), 6), p) for p, d in PAPERS.items() if allowed(p)]
    return [p for _, p in sorted(s)[:k]]


@pytest.fixture(scope="module")
def papers(spark):
    rows = [(p, d.tolist(), i, 2000 + i % 9) for i, (p, d) in enumerate(PAPERS.items())]
    return spark.createDataFrame(rows, "paperId string, vectors array<array<float>>, citationCount int, publicationYear int").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(q, i, v.tolist(), 2 + len(vs)) for q, vs in QUERIES.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "query_id string, qi int, embedding array<float>, topK int")


def ranked(df, rank="retrieval_rank"):
    out = {}
    for r in df.orderBy("query_id", rank).collect():
        out.setdefault(r["query_id"], []).append(r["paperId"])
    return out


def test_top_k_is_exact(papers, queries):
    got = ranked(S.top_k(papers, queries))
    assert got == {q: expected(q, 2 + len(v)) for q, v in QUERIES.items()}


def test_blocks_do_not_change_the_answer(papers, queries, monkeypatch):
    want = ranked(S.top_k(papers, queries))
    monkeypatch.setattr(C, "VECTORS_PER_BLOCK", 3)
    assert ranked(S.top_k(papers, queries)) == want


def filtered(queries):
    """The first query sees all papers, query k those cited at least 3 k times from before 2007."""
    k = F.substring("query_id", 2, 9).cast("int")
    rows = F.array(filter_row("citationCount", "gte", F.array(3 * k)), filter_row("publicationYear", "lt", F.array(F.lit(2007))))
    return queries.withColumn("filters", F.when(k > 0, rows).otherwise(F.array()).cast(FILTERS))


def allowed(q):
    number = {p: i for i, p in enumerate(PAPERS)}
    return lambda p: q == "q0" or number[p] >= 3 * int(q[1]) and number[p] % 9 < 7


def test_each_query_has_its_own_filter(papers, queries):
    got = ranked(S.top_k(papers, filtered(queries)))
    assert got == {q: expected(q, 2 + len(v), allowed(q)) for q, v in QUERIES.items()}


def test_excluded_papers_use_up_no_rank(spark, papers, queries):
    out = {q: expected(q, 3) for q in ("q1", "q4")}
    pairs = spark.createDataFrame([(q, p) for q, ps in out.items() for p in ps] + [("q9", "p1")], "query_id string, paperId string")
    got = ranked(S.top_k(papers, queries, exclude=pairs))
    assert got == {q: expected(q, 2 + len(v), lambda p, q=q: p not in out.get(q, ())) for q, v in QUERIES.items()}


def test_the_index_gives_the_answer_of_reading_all(spark, papers, queries, tmp_path, monkeypatch):
    index = C.build(papers, str(tmp_path / "plain"), cells=6)
    assert ranked(C.search(index, queries)[0]) == {q: expected(q, 2 + len(v)) for q, v in QUERIES.items()}
    monkeypatch.setattr(C, "PAPERS_PER_BLOCK", 1)
    monkeypatch.setattr(C, "VECTORS_PER_BLOCK", 3)
    index = C.build(papers, str(tmp_path / "years"), ("citationCount", "publicationYear"), cells=4, by=F.col("publicationYear"))
    assert index.header.select(F.size("cells")).first()[0] > 9 and index.blocks.where("part > 0").count() > 0
    hits, read = C.search(index, filtered(queries), rerank=True)
    assert ranked(hits) == {q: expected(q, 2 + len(v), allowed(q)) for q, v in QUERIES.items()}
    plain = {tuple(r) for r in S.top_k(papers, filtered(queries), rerank=True).collect()}
    assert {tuple(r) for r in hits.collect()} == plain
    # cells whose years or citations cannot pass are not read
    cells = {r["name"]: r["cells_read"] for r in read.collect()}
    assert set(cells) == set(QUERIES) and all(cells[q] < read.first()["cells"] for q in cells if q != "q0")
    out = {q: expected(q, 3) for q in ("q1", "q4")}
    pairs = spark.createDataFrame([(q, p) for q, ps in out.items() for p in ps], "query_id string, paperId string")
    assert ranked(C.search(index, queries, exclude=pairs)[0]) == ranked(S.top_k(papers, queries, exclude=pairs))


def test_queries_near_a_cell_leave_far_cells_unread(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = unit(rng.normal(size=(30, 32)))
    of = rng.integers(0, 30, 600)
    vectors = centres[of] + 0.02 * rng.normal(size=(600, 32))
    rows = [(f"p{i}", [v.tolist()]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "paperId string, vectors array<array<double>>")
    index = C.build(frame, str(tmp_path / "near"), cells=30)
    asked = spark.createDataFrame([(f"q{i}", 0, (centres[i] + 0.01 * rng.normal(size=32)).tolist(), 5) for i in range(30)], "query_id string, qi int, embedding array<double>, topK int")
    hits, read = C.search(index, asked)
    assert ranked(hits) == ranked(S.top_k(frame, asked))
    shares = [r["cells_read"] / r["cells"] for r in read.collect()]
    assert len(shares) == 30 and np.median(shares) < 0.4


def test_an_index_is_built_over_papers_of_a_sort_merge_join(spark, tmp_path):
    # the first join of a task to end frees its sorters, and k-means reads its points twice in one task
    rows = [(f"p{i}", RNG.normal(size=(2, DIM)).tolist()) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "paperId string, vectors array<array<float>>")
    years = spark.createDataFrame([(p, 2000 + i % 9) for i, (p, _) in enumerate(rows)], "paperId string, publicationYear int")
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        index = C.build(vectors.join(years, "paperId"), str(tmp_path / "joined"), ("publicationYear",), by=F.col("publicationYear"))
    finally:
        spark.conf.set(size, before)
    assert index.blocks.select(F.sum(F.size("members"))).first()[0] == 1500


def moved(df, column):
    """Rows that the shuffles of an executed table wrote with a column."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        here = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" and column in plan.output().toString() else 0
        return here + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_the_second_visit_shuffles_a_cell_once_for_each_share(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(f"p{i:03d}", rng.normal(size=(2, DIM)).tolist(), 2000 + i % 9) for i in range(600)]
    known = {p: (np.float32(v).astype(float), y) for p, v, y in rows}
    papers = spark.createDataFrame(rows, "paperId string, vectors array<array<float>>, publicationYear int")
    vectors = {f"q{i:02d}": rng.normal(size=(2, DIM)) for i in range(80)}
    asked = [(q, i, v.tolist(), 3, "lt", [str(2003 + int(q[1:]) % 7)]) for q, vs in vectors.items() for i, v in enumerate(vs)]
    queries = spark.createDataFrame(asked, "query_id string, qi int, embedding array<double>, topK int, op string, value array<string>")
    queries = queries.withColumn("filters", F.array(filter_row("publicationYear", "lt", F.col("value"))).cast(FILTERS))
    index = C.build(papers, str(tmp_path / "cells"), ("publicationYear",), cells=100)
    monkeypatch.setattr(C, "LATE_SHARES", 2)
    monkeypatch.setattr(C, "VECTORS_PER_BLOCK", 4)
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        found, _ = C.search_cuts(index, C.query_rows(queries), C.block_count(queries))
        hits = found.collect()
    finally:
        spark.conf.set(size, before)
    # about 40 query blocks and 100 cells: a cell went to its join and to every query block before, now to its join and to two shares
    assert index.blocks.count() > 80 and moved(found, "members") < 3 * index.blocks.count() + 41 * C.COPIES
    for q, vs in vectors.items():
        mine = sorted((-r["retrieval_score"], r["paperId"]) for r in hits if r["query_id"] == q)
        assert len(mine) == len(set(mine))
        want = sorted((-round(score(vs, d), 6), p) for p, (d, y) in known.items() if y < 2003 + int(q[1:]) % 7)[:3]
        assert mine[:3] == want


def test_a_table_of_filters_is_each_filter_of_its_own():
    day = lambda op, v: {"field": "publicationDate", "op": op, "values": [v]}
    count = lambda op, v: {"field": "citationCount", "op": op, "values": [v]}
    venue = {"field": "venue", "op": "!=", "values": ["a", "b"]}
    lists = [[day("lt", f"2020-0{m}-15")] for m in range(1, 9)] + [[day("lt", None)], [], None, [venue], [count("gte", "3"), day("gt", "2020-03-01")]]
    lists += [[count("gte", "5"), day("gt", "2020-05-01")], [venue, count("lt", "4")], [venue]]
    dates = [f"2020-0{1 + i % 9}-1{i % 7}" if i % 5 else None for i in range(40)]
    payload = comparable({"publicationDate": pa.array(dates), "citationCount": pa.array([float(i % 8) if i % 6 else None for i in range(40)]), "venue": pa.array(["a", "c", None, "d"] * 10)})
    some = np.array([0, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15, 2])
    got = FilterTable(lists).masks(some, payload, 40)
    assert got.tolist() == [payload_mask(lists[i], payload, 40).tolist() for i in some]
    assert got.any() and not got.all()


def test_bounds_hold(spark):
    rng = np.random.default_rng(9)
    for _ in range(20):
        centre = unit(rng.normal(size=(1, 8)))
        members = centre + rng.uniform(0.05, 2) * rng.normal(size=(40, 8))
        radius = np.arccos(np.clip(unit(members) @ centre.T, -1, 1)).max()
        q = rng.normal(size=(3, 8))
        score = (unit(q) @ unit(members).T).max(axis=1).mean()
        assert C.bounds(q, np.array([3]), centre, np.array([radius]))[0, 0] >= score - 1e-12


def test_search_moves_no_vector_and_knows_no_query_in_its_plan(spark, papers, queries, tmp_path):
    path = str(tmp_path / "papers")
    papers.write.parquet(path)
    stored = spark.read.parquet(path)
    many = queries.crossJoin(spark.range(50)).withColumn("query_id", F.concat("query_id", F.lit("x"), F.col("id").cast("string"))).drop("id")
    plans = []
    for name, asked in (("few", queries), ("many", many)):
        asked.write.parquet(str(tmp_path / name))
        plans.append(S.top_k(stored, spark.read.parquet(str(tmp_path / name)))._jdf.queryExecution().executedPlan().toString())
    few, many = plans
    assert few.count("MapInArrow") == many.count("MapInArrow") == 2 and len(few.splitlines()) == len(many.splitlines())
    assert not any("vectors" in x for x in few.splitlines() if "Exchange hashpartitioning(paperId" in x)


def test_empty_papers_and_queries_through_the_index(spark, papers, queries, tmp_path):
    index = C.build(papers, str(tmp_path / "some"), cells=3)
    assert C.search(index, queries.where("false"))[0].count() == 0
    none = C.build(papers.where("false"), str(tmp_path / "none"))
    assert C.search(none, queries)[0].count() == 0


def test_rerank_never_promotes_from_the_tail_before_truncation(papers, queries):
    hits = S.top_k(papers, queries, factor=5, rerank=True)
    got = ranked(S.rerank_and_sort(hits), "rank")
    for q, v in QUERIES.items():
        first = expected(q, 2 + len(v))
        again = sorted(first, key=lambda p: (-round(score(v, PAPERS[p], True), 6), p))
        assert got[q] == again
    late = ranked(S.rerank_and_sort(hits, truncate="after"), "rank")
    for q, v in QUERIES.items():
        pool = expected(q, 5 * (2 + len(v)))
        assert late[q] == sorted(pool, key=lambda p: (-round(score(v, PAPERS[p], True), 6), p))[: 2 + len(v)]


def test_top_k_over_the_corpus_size_and_user_score_zero(spark, papers, queries):
    many = S.top_k(papers, queries.withColumn("topK", F.lit(500)))
    assert many.groupBy("query_id").count().where(F.col("count") != len(PAPERS)).count() == 0
    hits = S.top_k(papers, queries, rerank=True).withColumn("user_score", F.lit(0))
    assert S.rerank_and_sort(hits).where(F.col("score") != 0).count() == 0


def test_no_queries_and_empty_markers(papers, queries):
    assert S.top_k(papers, queries.where(F.lit(False))).count() == 0
    cited = F.array(filter_row("citationCount", "gt", F.array(F.lit(1000)))).cast(FILTERS)
    none = S.top_k(papers, queries.withColumn("filters", cited))
    marked = S.keep_empty_queries(none, queries).collect()
    assert len(marked) == len(QUERIES) and all(r["paperId"] is None for r in marked)


def test_a_vector_of_another_width_fails(spark, papers):
    wrong = spark.createDataFrame([("q", 0, [1.0, 2.0], 1)], "query_id string, qi int, embedding array<float>, topK int")
    with pytest.raises(Exception, match="width"):
        S.top_k(papers, wrong).collect()


def test_packing_orders_chunks_and_refuses_wild_numbers(spark):
    rows = [("a", 1, [1.0]), ("a", 0, [0.0]), ("b", 0, [5.0])]
    chunks = spark.createDataFrame(rows, "paperId string, chunk_idx int, embedding array<float>")
    got = {r["paperId"]: r["vectors"] for r in S.pack_vectors(chunks).collect()}
    assert got == {"a": [[0.0], [1.0]], "b": [[5.0]]}
    with pytest.raises(Exception, match="cap"):
        S.pack_vectors(chunks.withColumn("chunk_idx", F.lit(10**6))).collect()


def test_default_encoder_counts_words(spark):
    df = spark.createDataFrame([("a", "x y x"), ("b", "")], "id string, text string")
    out = {r["id"]: r["embedding"] for r in embed_texts(df, "text", hashed_words(8)).collect()}
    assert sum(out["a"]) == 3 and max(out["a"]) >= 2 and sum(out["b"]) == 0


def test_a_mean_without_weight_is_nan_and_leaves_the_other_groups(spark):
    from paperloom.operators.embed import masked_mean

    rows = [("a", [1.0, 2.0], 1), ("a", [5.0, 4.0], 3), ("a", [9.0, float("inf")], 0), ("b", [1.0, 1.0], 0), ("b", [2.0, 2.0], None)]
    tokens = spark.createDataFrame(rows, "paperId string, embedding array<double>, mask int")
    got = {r["paperId"]: r["embedding"] for r in masked_mean(tokens, "paperId", "mask").collect()}
    assert got["a"] == [4.0, 3.5]
    assert len(got["b"]) == 2 and all(np.isnan(x) for x in got["b"])


def test_a_task_passes_on_its_best_hits_only(spark):
    rows = [(f"p{i:03d}", RNG.normal(size=(2, DIM)).tolist()) for i in range(320)]
    known = {p: np.array(v) for p, v in rows}
    papers = spark.createDataFrame(rows, "paperId string, vectors array<array<float>>").coalesce(1)
    asked = [(q, i, v.tolist(), 3) for q, vs in QUERIES.items() for i, v in enumerate(vs)]
    queries = spark.createDataFrame(asked, "query_id string, qi int, embedding array<float>, topK int")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "4")
    try:
        # seven query blocks in two shares, eighty blocks of papers
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(C, "SHARES", 2)
            patch.setattr(C, "VECTORS_PER_BLOCK", 2)
            hits = C.meet_all(papers, C.query_rows(queries), C.block_count(queries), (), rerank=False).collect()
    finally:
        spark.conf.set(size, "10000")
    for q, vs in QUERIES.items():
        mine = sorted((-r["retrieval_score"], r["paperId"]) for r in hits if r["query_id"] == q)
        assert len(mine) <= 3 * C.COPIES  # 240 when each block passed on three
        want = sorted((-round(score(vs, np.float32(d)), 6), p) for p, d in known.items())[:3]
        assert [p for _, p in mine[:3]] == [p for _, p in want]


def test_kept_hits_are_the_best_of_all_parts():
    rows = [(f"q{RNG.integers(3)}", f"p{RNG.integers(40)}", float(RNG.integers(4)), 0.0, None) for _ in range(500)]
    schema = pa.schema([("query_id", pa.string()), ("paperId", pa.string()), ("retrieval_score", pa.float64()), ("rerank_score", pa.float64()), ("topK", pa.int32())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[a : a + 60]], schema) for a in range(0, 500, 60)]
    keeps = {"q0": 1, "q1": 7, "q2": 10_000}
    got = [tuple(r.values())[:3] for b in C._best_of_task((b, keeps) for b in batches) for r in b.to_pylist()]
    want = []
    for q, keep in keeps.items():
        best = sorted({(-s, p) for n, p, s, *_ in rows if n == q})[:keep]
        want += [r[:3] for r in rows if r[0] == q and (-r[2], r[1]) in best]
    assert sorted(got) == sorted(want)


def test_floors_rise_to_the_last_kept_hit_while_a_task_goes_on(monkeypatch):
    monkeypatch.setattr(C, "HELD_HITS", 100)
    rng = np.random.default_rng(13)
    rows = [(f"q{rng.integers(3)}", f"p{i}", round(float(rng.uniform()), 2), 0.0, None) for i in range(900)]
    schema = pa.schema([("query_id", pa.string()), ("paperId", pa.string()), ("retrieval_score", pa.float64()), ("rerank_score", pa.float64()), ("topK", pa.int32())])
    keeps, floors, sent = {"q0": 2, "q1": 9, "q2": 10_000}, C._Floors(), []

    def batches():
        for at in range(0, 900, 60):
            live = [r for r in rows[at : at + 60] if r[2] >= floors.get(r[0], -1)]
            sent.extend(live)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in live], schema), keeps

    got = [tuple(r.values()) for b in C._best_of_task(batches(), floors) for r in b.to_pylist()]
    best = lambda some, q: sorted((-r[2], r[1]) for r in some if r[0] == q)[: keeps[q]]
    assert all(best(got, q) == best(rows, q) for q in keeps)
    assert len(sent) < 900 and floors.turn > 2 and set(floors) == {"q0", "q1"}
    assert all(floors[q] <= -best(rows, q)[-1][0] for q in floors)
