import random

from pyspark.sql import functions as F

from paperloom.operators import messages as M
from paperloom.operators import metrics as R
from paperloom.operators.running import running_total

SCHEMA = (
    "task_id string, timestamp bigint, seq int, query_id string, role string, mode string, content string, model string, "
    "notebook_title string, papers array<struct<paperId:string,user_score:int>>"
)


def message(task, seq, query, role, content="w", mode="reply", papers=None, model="m"):
    return (task, 100 + seq, seq, query, role, mode, content, model, f"title {seq}", papers)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def keys(df):
    return sorted((r["task_id"], r["seq"]) for r in df.collect())


def test_running_total_over_ranges_spreads_a_hot_key(spark):
    rows = [("hot", i // 3, i, i % 7 - 3) for i in range(400)] + [(None, 5, 1, 2), ("b", 1, 1, 5), ("b", 1, 2, 6), (None, None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, i int, j int, v int").repartition(3)
    for flip in (False, True):
        for how in ("sum", "max"):
            out = running_total(df, ["k"], ["i", "j"], F.col("v"), None, "s", newest_first=flip, how=how)
            got = {(r["k"], r["i"], r["j"]): r["s"] for r in out.collect()}
            for k in ("hot", "b", None):
                own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1], r[2]), reverse=flip)
                for n, r in enumerate(own):
                    part = [x[3] for x in own[: n + 1]]
                    assert got[r[:3]] == (sum(part) if how == "sum" else max(part)), (flip, how, r)
    from paperloom.operators.running import ranged

    sizes = [r["n"] for r in ranged(df, ["k"], ["i", "j"]).groupBy("_bin").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 2 and max(sizes) < 250


def test_running_total_over_bins_equals_one_pass(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randint(-5, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for flip in (False, True):
        out = running_total(df, ["k"], ["i"], F.col("v"), F.floor(F.col("i") / 16), "s", newest_first=flip).collect()
        want, sums = {}, {}
        for k, i, v in sorted(rows, key=lambda r: r[1], reverse=flip):
            sums[k] = sums.get(k, 0) + v
            want[i] = sums[k]
        assert {r["i"]: r["s"] for r in out} == want


def test_summary_cut_counts_turns_of_all_roles(spark):
    rows = []
    for i in range(12):
        role = "assistant" if i % 2 else "user"
        rows.append(message("long", i, f"q{i // 2}", role, " ".join(["w"] * 40)))
    rows += [message("short", i, "q", "assistant", "few words") for i in range(4)]
    rows += [message("big", 0, "q0", "assistant", " ".join(["w"] * 900))]
    cut = {r["task_id"]: r for r in M.summary_cut(frame(spark, rows), min_words=100).collect()}
    # Newest answers of 40 and 80 words do not pass 100, so the two newest turns stay.
    assert set(cut) == {"long"}
    assert (cut["long"]["kept"], cut["long"]["summary_ts"], cut["long"]["summary_query_id"]) == (2, 109, "q4")


def test_truncate_reset_and_delete(spark):
    rows = [message("t", 0, "a", "user"), message("t", 1, "a", "assistant"), message("t", 2, "b", "user"),
            message("t", 3, "b", "assistant", mode="expand"), message("u", 0, "b", "user")]
    m = frame(spark, rows)
    req = spark.createDataFrame([("t", "b", "reply")], "task_id string, query_id string, mode string")
    assert keys(M.truncate_from(m, req)) == [("t", 0), ("t", 1), ("u", 0)]
    assert keys(M.truncate_from(m, req, keep_user_message=True)) == [("t", 0), ("t", 1), ("t", 2), ("u", 0)]
    assert keys(M.reset_for_mode(m, req)) == [("t", 0), ("t", 1), ("u", 0)]
    assert keys(M.reset_for_mode(m, req.withColumn("mode", F.lit("expand")))) == [("t", 0), ("t", 1), ("t", 2), ("u", 0)]
    assert keys(M.delete_role(m, req, "assistant", ["update"])) == keys(m)
    gone = M.deleted_rows(m, M.delete_queries(m, req), ["task_id"])
    assert {r["task_id"]: r["deleted"] for r in gone.collect()} == {"t": 2, "u": 0}


def test_papers_null_empty_and_repeated(spark):
    p = lambda *xs: [(x, s) for x, s in xs]
    rows = [message("t", 0, "a", "user", papers=None), message("t", 1, "a", "assistant", papers=[]),
            message("t", 2, "b", "user", papers=p(("x", 1), ("y", -1), ("x", 0))), message("t", 3, "b", "assistant", papers=p(("y", 2), ("z", 1)))]
    m = frame(spark, rows)
    first = {r["paperId"]: r["user_score"] for r in M.all_first_seen_papers(m).collect()}
    assert first == {"x": 1, "y": -1, "z": 1}
    assert {r["paperId"] for r in M.first_seen_papers(m, trash=True).collect()} == {"y"}
    changed = M.set_scores_nested(m, F.array(F.lit("x")), {"user_score": F.lit(5), "other": F.lit(9)})
    lists = {r["seq"]: r["papers"] for r in changed.collect()}
    assert lists[0] is None and lists[1] == [] and [q["user_score"] for q in lists[2]] == [5, -1, 5]
    pair = M.last_pair(m).first()
    assert (pair["query_id"], [q["paperId"] for q in pair["papers"]]) == ("b", ["x", "y", "x"])


def test_prefix_anti_equals_pairwise_test(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    names, keep = {word(rng.randint(1, 6)) for _ in range(40)}, {word(rng.randint(2, 7)) for _ in range(15)}
    n = spark.createDataFrame([(x,) for x in names], "n string")
    k = spark.createDataFrame([(x,) for x in keep], "k string")
    got = {r["n"] for r in M.prefix_anti(n, "n", k, "k", name_is_prefix=True).collect()}
    assert got == {x for x in names if not any(y.startswith(x) for y in keep)}
    got = {r["n"] for r in M.prefix_anti(n, "n", k, "k", name_is_prefix=False).collect()}
    assert got == {x for x in names if not any(x.startswith(y) for y in keep)}


def test_modes_and_history_text(spark, one):
    assert one(M.route_mode(F.lit("*Notebook UPDATE*"), F.lit("reply"))) == "update"
    assert one(M.route_mode(F.lit("hi"), F.lit("reply"))) == "reply"
    rows = [message("t", 0, "s", "assistant", "old", model="summarizer"), message("t", 1, "a", "user", "hello"),
            message("t", 2, "a", "user", "card", model="search-worker"), message("t", 3, "a", "assistant", "hi")]
    text = M.history_text(frame(spark, rows)).first()["history"]
    assert text == "- PREVIOUS SUMMARIES:\n  + old\n- RECENT HISTORY:\n  + User: hello\n  + Assistant: hi\n"


def test_stalled_equals_pairwise_test(spark):
    rng = random.Random(3)
    starts = [(i, rng.choice(["hot", "a"]), rng.randint(0, 2000)) for i in range(150)]
    ends = [(rng.choice(["hot", "a", "b"]), rng.randint(0, 2000)) for _ in range(40)]
    s = spark.createDataFrame(starts, "id int, k string, t int").select("id", "k", F.timestamp_seconds("t").alias("ts"))
    f = spark.createDataFrame(ends, "k string, t int").select("k", F.timestamp_seconds("t").alias("ts"))
    got = {r["id"] for r in R.stalled(s, f, "k", 60).collect()}
    assert got == {i for i, k, t in starts if not any(k == q and t <= u <= t + 60 for q, u in ends)}


def test_histogram_is_cumulative(spark):
    e = spark.createDataFrame([("GET", "/x", 0.01), ("GET", "/x", 3.0), ("GET", "/x", 99.0)], "method string, endpoint string, latency double")
    h = {r["le"]: r["n"] for r in R.latency_histogram(e).collect()}
    assert (h["0.005"], h["0.01"], h["2.5"], h["5.0"], h["10.0"], h["+Inf"]) == (0, 1, 1, 2, 2, 3)


def test_gauge_counts_starts_before_ends_and_never_drops_below_zero(spark):
    e = spark.createDataFrame([(1, 0, 10.0), (2, 10, 5.0), (3, 4000, 1.0)], "event_id int, t int, latency double")
    e = e.withColumn("ts", F.timestamp_seconds("t")).withColumn("k", F.lit("k"))
    out = [r["open_requests"] for r in R.in_progress(e, ["k"]).orderBy("at", F.desc("delta")).collect()]
    assert out == [1, 2, 1, 0, 1, 0]
