import json
import os

import pytest
from pyspark.sql import functions as F

from paperloom.operators import embed as E
from paperloom.sources import feeds, parquet, results, vector_store
from paperloom.sources import requests as Q
from paperloom.sources import schemas
from paperloom.streaming import search as RS
from paperloom.streaming import state, sync


def run(stream, folder):
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append")
    writer.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def test_parquet_overwrite_leaves_no_stale_part(spark, tmp_path):
    path = str(tmp_path / "t")
    parquet.save(spark.range(25, numPartitions=1), path, rows_per_file=10)
    assert sum(f.endswith(".parquet") for f in os.listdir(path)) == 3
    parquet.save(spark.range(5, numPartitions=1), path, rows_per_file=10)
    assert parquet.scan(spark, path).count() == 5
    assert parquet.scan(spark, path, [("id", ">", 3)]).count() == 1
    with pytest.raises(Exception):
        parquet.scan(spark, str(tmp_path / "absent"))


def test_year_tables_pairs_and_csv(spark, tmp_path):
    meta = spark.createDataFrame([("a", 2020, 1), ("b", 2021, 9), ("c", 2021, 0)], "paperId string, publicationYear int, n int")
    text = meta.select("paperId", "publicationYear", F.lit('say "hi",\nthere').alias("t"))
    m, t = str(tmp_path / "m"), str(tmp_path / "t")
    parquet.save_by_year(meta, m)
    parquet.save_by_year(text, t)
    assert parquet.load_years(spark, m, [2021]).count() == 2 and parquet.load_years(spark, m).count() == 3
    got = parquet.load_pair(spark, m, t, [2021], [("n", ">", 1)])
    assert [df.count() for df in got] == [1, 1]
    parquet.save_by_year(text.where("paperId <> 'b'"), str(tmp_path / "t2"))
    with pytest.raises(ValueError):
        parquet.load_pair(spark, m, str(tmp_path / "t2"))
    parquet.save_csv_sample(text, "paperId", str(tmp_path / "csv"), 2)
    back = parquet.read_csv(spark, str(tmp_path / "csv"), "paperId string, publicationYear int, t string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, text.orderBy("paperId").limit(2).collect()))
    with pytest.raises(ValueError):
        parquet.save_pair(text, meta.where("n > 0"), str(tmp_path / "pair"))
    parquet.save_pair(text, meta, str(tmp_path / "pair"))
    assert spark.read.parquet(str(tmp_path / "pair" / "text")).count() == 3


def test_snapshot_is_read_normalised_and_cached(spark, tmp_path):
    record = {
        "id": "0704.0001", "authors": "A and B", "title": "T", "categories": "hep-ph", "abstract": "x", "doi": None,
        "versions": [{"version": "v1", "created": "Mon, 2 Apr 2007 19:18:42 GMT"}, {"version": "v2", "created": "Tue, 24 Jul 2007 20:10:27 GMT"}],
        "authors_parsed": [["A", "", ""]],
    }
    src, dst = tmp_path / "s.json", str(tmp_path / "cache")
    src.write_text(json.dumps(record) + "\n")
    row = feeds.load_snapshot(spark, str(src), dst).first()
    assert (row["paperId"], row["authorName"], row["fieldsOfStudy"], row["doi"]) == ("0704.0001", "A, B", "Physics", "10.48550/arXiv.0704.0001")
    assert row["openAccessPdf"].endswith("/0704/0704.0001v2.pdf") and row["publicationDate"] == "2007-04-02"
    src.write_text("")
    assert feeds.load_snapshot(spark, str(src), dst).count() == 1
    late = F.current_timestamp() + F.expr("INTERVAL 8 DAYS")
    assert feeds.is_fresh(spark.read.parquet(dst), now=late).first()["fresh"] is False


def test_pages_must_be_complete(spark, tmp_path):
    page = {"total": 2, "token": None, "data": [{"paperId": "a", "title": "t", "venue": "Nature", "authors": [{"authorId": "1", "name": "Ann"}]}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    pages = feeds.read_pages(spark, str(tmp_path / "p.json"))
    assert feeds.incomplete_pages(pages).count() == 1
    assert feeds.incomplete_pages(pages.withColumn("total", F.lit(1))).count() == 0
    assert feeds.flatten_pages(pages).first()["authorName"] == "Ann"


def test_results_survive_corrupt_lines_and_missing_folders(spark, tmp_path):
    path = str(tmp_path / "r")
    assert results.load_results(spark, path).count() == 0
    rows = spark.createDataFrame([("u/1", "q", "p", 0.5)], "task_id string, query_id string, paperId string, score double")
    results.append_results(rows, path)
    results.append_results(rows, path)
    folder = next(d for d in os.listdir(path) if d.startswith("task_id="))
    with open(os.path.join(path, folder, "part-bad.json"), "w") as f:
        f.write('{"paperId": "x", \n')
    assert results.load_results(spark, path).count() == 2


def test_upsert_then_delete_restores(spark, tmp_path):
    old = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "paperId string, chunk_idx int")
    new = spark.createDataFrame([("c", 0), ("a", 0)], "paperId string, chunk_idx int")
    both = vector_store.upsert(old, new)
    assert sorted(map(tuple, both.collect())) == [("a", 0), ("b", 0), ("c", 0)]
    assert sorted(map(tuple, vector_store.delete(both, new).collect())) == [("b", 0)]
    root = str(tmp_path / "store")
    assert vector_store.read_current(spark, root) is None
    assert [vector_store.sync(old, root), vector_store.sync(new, root)] == [1, 2]
    assert sorted(map(tuple, vector_store.read_current(spark, root).collect())) == [("a", 0), ("b", 0), ("c", 0)]


def test_batches_of_a_run_stand_together(spark, tmp_path):
    root = str(tmp_path / "store")

    def put(rows, run, batch):
        return vector_store.sync(spark.createDataFrame(rows, "paperId string, chunk_idx int, t string"), root, run, batch)

    put([("a", 0, "x"), ("b", 0, "x")], "r1", 0)
    put([("a", 1, "x"), ("a", 2, "x")], "r1", 1)
    assert put([("a", 1, "again")], "r1", 1) == 2
    put([("a", 0, "y")], "r2", 0)
    put([("a", 1, "y")], "r2", 1)
    assert put([], "r2", 2) == 4
    got = sorted(map(tuple, vector_store.read_current(spark, root).select("paperId", "chunk_idx", "t").collect()))
    assert got == [("a", 0, "y"), ("a", 1, "y"), ("b", 0, "x")]
    left = {x for x in os.listdir(root) if x.startswith("v")}
    named = {f.split("/")[0] for line in vector_store._latest(spark, root, vector_store.KEPT) for f in line["folders"] if f}
    assert left == named and "v3" not in {f.split("/")[0] for f in vector_store._latest(spark, root)[0]["folders"] if f}


def test_payload_update_touches_allowed_fields_only(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "paperId string, citationCount int, title string")
    new = spark.createDataFrame([("a", None, "changed")], "paperId string, citationCount int, title string")
    out = {r["paperId"]: (r["citationCount"], r["title"]) for r in vector_store.update_payload(old, new, schemas.CHUNK_PAYLOAD).collect()}
    assert out == {"a": (None, "x"), "b": (2, "y")}


def expected_admission(events):
    running, waiting, out = None, [], []
    for kind, q in events:
        if kind == "request" and running is None:
            running = q
            out.append((q, "start"))
        elif kind == "request":
            waiting.append(q)
            out.append((q, "wait"))
        elif running is None:
            out.append((q, "ignored"))
        else:
            out.append((running, "cancelled" if kind == "cancel" else "done"))
            running = waiting.pop(0) if waiting else None
            if running:
                out.append((running, "start"))
    return out


def test_admission_keeps_state_over_batches(spark, tmp_path):
    events = [("cancel", "c0"), ("request", "r1"), ("request", "r2"), ("done", "-"), ("request", "r3"), ("cancel", "-"), ("done", "-"), ("done", "-")]
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"task_id": "t", "seq": i, "kind": k, "query_id": q} for i, (k, q) in enumerate(events)]
    for i in range(0, len(rows), 3):
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i : i + 3]))
        os.utime(src / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("task_id string, seq int, kind string, query_id string").option("maxFilesPerTrigger", 1).json(str(src))
    got = run(state.admit_requests(stream), str(tmp_path / "out")).collect()
    assert sorted((r["query_id"], r["action"]) for r in got) == sorted(expected_admission(events))


def test_token_pieces_rebuild_the_answer(spark, tmp_path):
    tokens = ["word "] * 30 + ["<think>"] + ["mind "] * 50 + ["</think>"] + ["end"]
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"stream_id": "s", "seq": i, "token": t} for i, t in enumerate([*tokens, None])]
    for i in range(0, len(rows), 40):
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i : i + 40]))
        os.utime(src / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("stream_id string, seq int, token string").option("maxFilesPerTrigger", 1).json(str(src))
    got = run(state.flush_tokens(stream), str(tmp_path / "out")).collect()
    assert sum(len(r["content"]) for r in got) == 30 * 5 + 3 and sum(len(r["think"]) for r in got) == 250
    assert max(max(len(r["content"]), len(r["think"])) for r in got) <= 105


def test_silent_tasks_and_streams_are_given_up(spark, tmp_path):
    import time

    def silent(name, schema, rows, step, columns, want):
        """Runs a stream on one file until it has given up what is open, or for 40 seconds."""
        src, out = tmp_path / f"{name}-in", str(tmp_path / f"{name}-out")
        src.mkdir()
        (src / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
        made = step(spark.readStream.schema(schema).json(str(src)))
        writer = made.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").outputMode("append")
        query = writer.trigger(processingTime="500 milliseconds").start(f"{out}/rows")
        got, end = [], time.time() + 40
        while got != want and time.time() < end:
            time.sleep(1)
            if os.path.isdir(f"{out}/rows/_spark_metadata"):
                got = sorted(tuple(r[c] for c in columns) for r in spark.read.schema(made.schema).parquet(f"{out}/rows").collect())
        query.stop()
        assert got == want

    event = lambda seq, query: {"task_id": "a", "seq": seq, "kind": "request", "query_id": query}
    silent(
        "admit", "task_id string, seq int, kind string, query_id string", [event(0, "q0"), event(1, "q1")],
        lambda s: state.admit_requests(s, give_up_after=2), ("query_id", "action"),
        [("q0", "expired"), ("q0", "start"), ("q1", "expired"), ("q1", "wait")],
    )
    silent(
        "flush", "stream_id string, seq int, token string", [{"stream_id": "s", "seq": 0, "token": "left over"}],
        lambda s: state.flush_tokens(s, give_up_after=2), ("stream_id", "content"), [("s", "left over")],
    )


def test_late_rows_are_dropped_and_duplicates_ignored(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    batches = [[("a", 1000)], [("b", 9000)], [("a", 1001), ("late", 10), ("b", 9001)], [("c", 9002)]]
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"paperId": p, "t": t}) for p, t in rows))
        os.utime(src / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("paperId string, t bigint").option("maxFilesPerTrigger", 1).json(str(src))
    timed = stream.withColumn("ts", F.timestamp_seconds("t"))
    got = run(sync.new_only(timed, "paperId", "ts", "10 minutes"), str(tmp_path / "out")).collect()
    assert sorted(r["paperId"] for r in got) == ["a", "b", "c"]


def test_search_requests_lock_trash_and_empty(spark, tmp_path):
    papers = spark.createDataFrame(
        [("p1", "alpha beta", 10), ("p2", "alpha", 60), ("p3", "gamma", 70)], "paperId string, text string, citationCount int"
    )
    vectors = E.embed_texts(papers, "text", E.hashed_words(32)).withColumn("vectors", F.array("embedding")).drop("embedding")
    make = lambda qid, task, text, cites, lock: {
        "task_id": task, "query": {"queries": [text] if text else [], "citationCount": cites}, "user_id": "u", "query_id": qid,
        "notebook_id": "n", "topK": 2, "paperLock": lock,
    }
    asked = [make("q1", "t1", "alpha", None, False), make("q2", "t2", "alpha", 65, False), make("q3", "t1", "alpha", None, True), make("q4", "t3", None, None, False)]
    src = tmp_path / "topic"
    frame = spark.createDataFrame([(json.dumps(a),) for a in asked], "value string")
    Q.write_folder(Q.decode(frame, schemas.SEARCH_REQUEST), str(src))
    feedback = spark.createDataFrame([("t1", "p2", -1), ("t1", "p3", 1)], "task_id string, paperId string, user_score int")
    stream = Q.stream_folder(spark, str(src), schemas.SEARCH_REQUEST)
    answer = lambda b: RS.search_requests(b, vectors, E.hashed_words(32), feedback)
    RS.answer_stream(stream, answer, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    rows = spark.read.schema("query_id string, paperId string, rank int").json(str(tmp_path / "out")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"] or 0):
        got.setdefault(r["query_id"], []).append(r["paperId"])
    assert got == {"q1": ["p1", "p3"], "q2": ["p3"], "q3": ["p3"], "q4": [None]}


def test_requery_skips_returned_papers_without_losing_ranks(spark):
    p = spark.createDataFrame([("a", [[1.0, 0.0]]), ("b", [[0.9, 0.1]]), ("c", [[0.0, 1.0]])], "paperId string, vectors array<array<float>>")
    q = spark.createDataFrame([("q", 0, [1.0, 0.0], 2)], "query_id string, qi int, embedding array<float>, topK int")
    seen = spark.createDataFrame([("q", "a"), ("other", "b")], "query_id string, paperId string")
    got = RS.requery_new_papers(p, q, seen).orderBy("retrieval_rank").collect()
    assert [r["paperId"] for r in got] == ["b", "c"]




def test_questions_and_blended_search(spark):
    from paperloom.operators import learn as L

    asked = [{"task_id": "t", "query": {"queries": ["alpha", "gamma"]}, "query_id": "q", "topK": 2, "paperLock": False, "user_id": "u", "notebook_id": "n"}]
    requests = Q.decode(spark.createDataFrame([(json.dumps(a),) for a in asked], "value string"), schemas.SEARCH_REQUEST)
    papers = spark.createDataFrame([("p1", "alpha alpha"), ("p2", "alpha beta")], "paperId string, text string")
    embedded = E.embed_texts(papers, "text", E.hashed_words(32), prefix="query: ")
    pooled = embedded.select(F.lit("t").alias("task_id"), "embedding")
    scores = {r["question"]: r["score"] for r in RS.score_questions(requests, pooled, E.hashed_words(32)).collect()}
    assert set(scores) == {"alpha", "gamma"} and scores["alpha"] > scores["gamma"]

    vectors = embedded.select("paperId", F.array("embedding").alias("vectors"))
    flipped = lambda hits: hits.withColumn("blended_score", -F.col("rerank_score"))
    plain = RS.search_requests(requests, vectors, E.hashed_words(32)).orderBy("rank").collect()
    blended = RS.search_requests(requests, vectors, E.hashed_words(32), blend=flipped).orderBy("rank").collect()
    assert [r["paperId"] for r in plain] == [r["paperId"] for r in blended][::-1]
    unlabelled = RS.search_requests(requests, vectors, E.hashed_words(32), blend=lambda h: L.blend(h, None)).orderBy("rank").collect()
    assert [r["paperId"] for r in unlabelled] == [r["paperId"] for r in plain]


def test_standing_queries_keep_their_lists_over_restarts(spark, tmp_path):
    import numpy as np

    from paperloom.operators import search as S

    rng = np.random.default_rng(4)
    vectors = {f"p{i}": rng.normal(size=(1 + i % 2, 5)).tolist() for i in range(60)}
    asked = [(f"q{i}", 0, rng.normal(size=5).tolist(), 3) for i in range(6)]
    queries = spark.createDataFrame(asked, "query_id string, qi int, embedding array<double>, topK int")
    returned = spark.createDataFrame([("q0", "p3"), ("q1", "p9")], "query_id string, paperId string")
    schema = "paperId string, vectors array<array<double>>"
    papers = spark.createDataFrame(list(vectors.items()), schema)
    src, root = str(tmp_path / "new"), str(tmp_path / "lists")
    for k in range(5):  # each batch in a run of its own; one paper comes again in the last
        ids = [f"p{i}" for i in range(60) if i % 5 == k] + (["p0"] if k == 4 else [])
        spark.createDataFrame([(i, vectors[i]) for i in ids], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        RS.requery_stream(stream, queries, returned, root, str(tmp_path / "state"), once=True).awaitTermination()
        seen = papers.where(F.substring("paperId", 2, 9).cast("int") % 5 <= k)
        want = {tuple(r) for r in S.top_k(seen, queries, exclude=returned).select("query_id", "paperId", "retrieval_score", "retrieval_rank").collect()}
        assert {tuple(r)[:4] for r in RS.standing_lists(spark, root).collect()} == want
    assert len(want) == 18


def test_writers_at_one_time_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "table")
    schema = "paperId string, chunk_idx int, value int"
    make = lambda who: spark.createDataFrame([(f"p{who}-{i}", c, who) for i in range(20) for c in range(2)] + [("both", who, who)], schema)
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda who: vector_store.sync(make(who), root, f"run{who}", 0), range(4)))
    assert sorted(versions) == [1, 2, 3, 4]
    rows = vector_store.read_current(spark, root).collect()
    assert sum(r["paperId"] != "both" for r in rows) == 4 * 40
    # the paper that all bring is that of the last one
    assert [r["value"] for r in rows if r["paperId"] == "both"] == [versions.index(4)]
    assert vector_store.sync(make(0), root, "run0", 0) == 4  # a batch that is there does nothing
    line = {"version": 4, "run": "x", "batch": 0, "folders": []}
    assert not vector_store._publish(spark, root, line)


def test_old_folders_go_and_kept_versions_stay(spark, tmp_path):
    root = str(tmp_path / "table")
    for k in range(7):
        vector_store.sync(spark.createDataFrame([("p", 0, k)], "paperId string, chunk_idx int, value int"), root)
    assert sum(f.startswith("v") for f in os.listdir(root)) == vector_store.KEPT
    assert [r["value"] for r in vector_store.read_current(spark, root).collect()] == [6]


@pytest.mark.parametrize("parts", [0, 3])
def test_given_tables_stream_as_one_file_or_as_a_folder_of_parts(spark, tmp_path, parts):
    from paperloom.plans import QUERIES

    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(12)], "vec_id long, embedding array<float>, label int")
    rows.repartition(parts or 1).write.parquet(str(tmp_path / "embeddings.parquet" if parts else tmp_path / "made"))
    if not parts:
        made = next(f for f in os.listdir(tmp_path / "made") if f.endswith(".parquet"))
        os.rename(tmp_path / "made" / made, tmp_path / "embeddings.parquet")
    got = QUERIES["stream_vector_sync"](spark, str(tmp_path)).collect()
    assert sorted((r["paperId"], r["chunk_idx"], r["label"]) for r in got) == sorted((f"d{i // 5}", i % 5, i % 2) for i in range(12))
    assert QUERIES["stream_distinct_keys"](spark, str(tmp_path)).count() == 3
