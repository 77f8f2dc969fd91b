"""Notebook queries over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import ids as I
from paperloom.operators import messages as M
from paperloom.operators.filters import score_fields
from paperloom.plans import fixtures as X
from paperloom.plans.registry import query
from paperloom.session import read_table

_M = X.with_ctes(X.MESSAGES)
# Every notebook asks about its second query.
_RQ = X.with_ctes(X.MESSAGES, "rq AS (SELECT DISTINCT task_id, conv_id || '_1' AS query_id, list_extract(['reply', 'expand', 'regenerate'], conv_id % 3 + 1) AS mode FROM m)")
# The message papers, one row each.
_MP = """mp AS (SELECT task_id, query_id, role, "timestamp", turn, pos, p."paperId" AS "paperId", p.user_score AS user_score FROM (
  SELECT task_id, query_id, role, "timestamp", turn, unnest(papers) AS p, unnest(range(len(papers))) AS pos FROM m))"""


def _requests(spark, sf):
    conv = read_table(spark, sf, "conversations").select("conv_id").distinct()
    key = F.col("conv_id").cast("string")
    modes = F.array(F.lit("reply"), F.lit("expand"), F.lit("regenerate"))
    return conv.select(
        F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string"), F.lit("/"), key).alias("task_id"),
        F.concat(key, F.lit("_1")).alias("query_id"),
        F.element_at(modes, (F.col("conv_id") % 3 + 1).cast("int")).alias("mode"),
    )


def _key(df):
    return df.select("conv_id", "turn")


@query("history_cutoff", _M + """SELECT conv_id, turn FROM m WHERE "timestamp" <= conv_id * 1000 + 3""")
def history_cutoff(spark, sf):
    return _key(M.history_until(X.messages(spark, sf), F.col("conv_id") * 1000 + 3))


@query("visible_history", _M + "SELECT conv_id, turn, role FROM m WHERE access = 'all'")
def visible_history(spark, sf):
    return M.visible(X.messages(spark, sf)).select("conv_id", "turn", "role")


@query("writing_context", _M + "SELECT conv_id, turn FROM m WHERE model <> 'search-worker'")
def writing_context(spark, sf):
    return _key(M.without_worker(X.messages(spark, sf)))


@query("load_query", _RQ + "SELECT conv_id, turn FROM m SEMI JOIN rq USING (task_id, query_id)")
def load_query(spark, sf):
    return _key(M.load_query(X.messages(spark, sf), _requests(spark, sf)))


@query("delete_query", _RQ + "SELECT conv_id, turn FROM m ANTI JOIN rq USING (task_id, query_id)")
def delete_query(spark, sf):
    return _key(M.delete_queries(X.messages(spark, sf), _requests(spark, sf)))


@query(
    "delete_assistant_messages",
    _RQ + """SELECT conv_id, turn FROM m WHERE NOT (role = 'assistant' AND mode IN ('expand', 'update')
  AND EXISTS (SELECT 1 FROM rq WHERE rq.task_id = m.task_id AND rq.query_id = m.query_id))""",
)
def delete_assistant_messages(spark, sf):
    return _key(M.delete_role(X.messages(spark, sf), _requests(spark, sf), "assistant", ["expand", "update"]))


@query(
    "delete_user_messages",
    _RQ + """SELECT conv_id, turn FROM m WHERE NOT (role = 'user' AND EXISTS (SELECT 1 FROM rq WHERE rq.task_id = m.task_id AND rq.query_id = m.query_id))""",
)
def delete_user_messages(spark, sf):
    return _key(M.delete_role(X.messages(spark, sf), _requests(spark, sf), "user"))


@query(
    "mode_reset",
    _RQ + """SELECT conv_id, turn FROM m WHERE NOT EXISTS (SELECT 1 FROM rq WHERE rq.task_id = m.task_id AND rq.query_id = m.query_id AND (
    (rq.mode = 'reply' AND (m.role = 'user' OR (m.role = 'assistant' AND m.mode IN ('reply', 'expand'))))
 OR (rq.mode = 'expand' AND m.role = 'assistant' AND m.mode = 'expand')
 OR (rq.mode = 'regenerate' AND (m.role = 'user' OR (m.role = 'assistant' AND m.mode = 'regenerate')))))""",
)
def mode_reset(spark, sf):
    return _key(M.reset_for_mode(X.messages(spark, sf), _requests(spark, sf)))


@query(
    "truncate_from",
    _RQ + """, cut AS (SELECT task_id, min("timestamp") AS c FROM m SEMI JOIN rq USING (task_id, query_id) WHERE role = 'assistant' GROUP BY task_id)
SELECT conv_id, turn FROM m LEFT JOIN cut USING (task_id) WHERE c IS NULL OR "timestamp" < c""",
)
def truncate_from(spark, sf):
    return _key(M.truncate_from(X.messages(spark, sf), _requests(spark, sf), keep_user_message=True))


@query(
    "deleted_counts",
    _RQ + "SELECT task_id, count(*) - count_if(NOT hit) AS deleted FROM (SELECT m.task_id, EXISTS (SELECT 1 FROM rq WHERE rq.task_id = m.task_id AND rq.query_id = m.query_id) AS hit FROM m) GROUP BY task_id",
)
def deleted_counts(spark, sf):
    m = X.messages(spark, sf)
    return M.deleted_rows(m, M.delete_queries(m, _requests(spark, sf)), ["task_id"])


@query(
    "rename_notebooks",
    _M + "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'New ' || task_id ELSE notebook_title END AS notebook_title FROM m",
)
def rename_notebooks(spark, sf):
    m = X.messages(spark, sf)
    titles = m.where(F.col("conv_id") % 2 == 0).select("task_id").distinct()
    titles = titles.withColumn("new_title", F.concat(F.lit("New "), "task_id"))
    return M.rename(m, titles).select("conv_id", "turn", "notebook_title")


@query(
    "stamp_update",
    _M + "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 5000000 + conv_id END AS timestamp_update FROM m",
)
def stamp_update(spark, sf):
    m = X.messages(spark, sf)
    tasks = m.where(F.col("conv_id") % 2 == 0)
    return M.stamp_update(m, tasks, 5_000_000 + F.col("conv_id")).select("conv_id", "turn", "timestamp_update")


@query(
    "updated_notebooks",
    _M + """SELECT task_id FROM m GROUP BY task_id HAVING arg_max(conv_id % 2 = 0 AND conv_id > 20 AND mode = 'update', turn)""",
)
def updated_notebooks(spark, sf):
    m = X.messages(spark, sf)
    stamped = M.stamp_update(m, m.where(F.col("conv_id") % 2 == 0), 5_000_000 + F.col("conv_id"))
    return M.updated_notebooks(stamped, F.lit(5_000_020))


@query(
    "nested_scores",
    X.with_ctes(X.MESSAGES, _MP) + """SELECT task_id, turn, pos, "paperId",
  CASE WHEN "paperId" IN ('d1', 'd5', 'd20') OR "paperId" = 'd' || turn THEN -1 ELSE user_score END AS user_score FROM mp""",
)
def nested_scores(spark, sf):
    ids = F.array(F.lit("d1"), F.lit("d5"), F.lit("d20"), F.concat(F.lit("d"), F.col("turn").cast("string")))
    changed = M.set_scores_nested(
        X.messages(spark, sf), ids, {"user_score": F.lit(-1).cast("bigint"), "venue": F.lit("ignored")}
    )
    return changed.select("task_id", "turn", F.posexplode("papers").alias("pos", "p")).select(
        "task_id", "turn", F.col("pos").cast("bigint").alias("pos"), "p.paperId", "p.user_score"
    )


@query(
    "result_scores",
    X.with_ctes(X.MESSAGES, _MP, X.FEEDBACK) + """SELECT task_id, turn, pos, mp."paperId", coalesce(fb.user_score, mp.user_score) AS user_score FROM mp LEFT JOIN fb ON mp."paperId" = fb."paperId" """,
)
def result_scores(spark, sf):
    rows = M.message_papers(X.messages(spark, sf))
    marks = rows.select("task_id", "paperId").distinct().join(X.feedback(spark, sf), "paperId").withColumnRenamed("user_score", "new_score")
    out = M.set_scores_flat(rows, marks)
    return out.select("task_id", F.col("seq").alias("turn"), F.col("pos").cast("bigint").alias("pos"), "paperId", "user_score")


@query("unanswered_cleanup", _M + """SELECT conv_id, turn FROM m WHERE (task_id, query_id) IN (SELECT (task_id, query_id) FROM m WHERE role = 'assistant')""")
def unanswered_cleanup(spark, sf):
    return _key(M.answered_only(X.messages(spark, sf)))


def _results(spark, sf):
    """Three result rows per message: sub-query ids in front, papers of the corpus."""
    m = X.messages(spark, sf)
    n = F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))).alias("k")
    rows = m.select("task_id", "query_id", "conv_id", "turn", n)
    return rows.select(
        "task_id",
        F.concat_ws("_", F.lit("0"), "query_id").alias("query_id"),
        F.concat(F.lit("d"), (F.col("conv_id") + F.col("turn") * F.col("k")).cast("string")).alias("paperId"),
        (F.col("turn") * 10 + F.col("k")).alias("seq"),
        F.when(F.col("k") < 7, F.concat(F.lit("10.1/"), F.col("turn").cast("string"))).otherwise("").alias("doi"),
    )


_RESULTS = """rs AS (SELECT task_id, '0_' || query_id AS query_id, 'd' || (conv_id + turn * k) AS "paperId", turn * 10 + k AS seq,
   CASE WHEN k < 7 THEN '10.1/' || turn ELSE '' END AS doi FROM (SELECT *, unnest([1, 2, 7]) AS k FROM m))"""


@query(
    "result_cleanup",
    X.with_ctes(X.MESSAGES, _MP, _RESULTS) + """SELECT task_id, "paperId", arg_max(query_id, seq) AS query_id, max(seq) AS seq FROM rs
WHERE (task_id, regexp_replace(query_id, '^[^_]*_', '')) IN (SELECT (task_id, query_id) FROM m WHERE role = 'assistant')
  AND (task_id, "paperId") IN (SELECT (task_id, "paperId") FROM mp) GROUP BY task_id, "paperId" """,
)
def result_cleanup(spark, sf):
    return M.clean_results(_results(spark, sf), X.messages(spark, sf)).drop("doi")


@query("doi_list", X.with_ctes(X.MESSAGES, _RESULTS) + "SELECT task_id, doi FROM rs WHERE doi <> ''")
def doi_list(spark, sf):
    return M.doi_list(_results(spark, sf))


@query(
    "sub_query_results",
    X.with_ctes(X.MESSAGES, _RESULTS) + """SELECT task_id, "paperId", seq FROM rs WHERE query_id = '0_' || split_part(task_id, '/', 2) || '_1' """,
)
def sub_query_results(spark, sf):
    own = F.concat(F.split_part("task_id", F.lit("/"), F.lit(2)), F.lit("_1"))
    return M.own_results(_results(spark, sf), 0, own).select("task_id", "paperId", "seq")


_SEEN = """SELECT task_id, "paperId", arg_min(user_score, "timestamp" * 10 + pos) AS user_score, min(turn) AS first_turn FROM mp {0} GROUP BY task_id, "paperId" """


@query("keep_first_papers", X.with_ctes(X.MESSAGES, _MP) + _SEEN.format(""))
def keep_first_papers(spark, sf):
    rows = M.all_first_seen_papers(X.messages(spark, sf))
    return rows.select("task_id", "paperId", "user_score", F.col("seq").alias("first_turn"))


@query("trashed_papers", X.with_ctes(X.MESSAGES, _MP) + _SEEN.format("WHERE user_score < 0"))
def trashed_papers(spark, sf):
    rows = M.first_seen_papers(X.messages(spark, sf), trash=True)
    return rows.select("task_id", "paperId", "user_score", F.col("seq").alias("first_turn"))


@query(
    "selected_papers",
    X.with_ctes(X.MESSAGES, _MP) + """, f AS (SELECT DISTINCT task_id, "paperId" FROM mp WHERE user_score >= 0),
s AS (SELECT DISTINCT task_id, "paperId" FROM mp WHERE query_id = split_part(task_id, '/', 2) || '_1')
SELECT f.task_id, f."paperId", s."paperId" IS NOT NULL AS matches FROM f LEFT JOIN s ON f.task_id = s.task_id AND f."paperId" = s."paperId" """,
)
def selected_papers(spark, sf):
    m = X.messages(spark, sf)
    return M.flag_selected(M.first_seen_papers(m), m, _requests(spark, sf)).select("task_id", "paperId", "matches")


@query("notebook_list", _M + """SELECT task_id, arg_max(notebook_title, turn) AS title, min("timestamp") AS date FROM m GROUP BY task_id""")
def notebook_list(spark, sf):
    return M.list_notebooks(X.messages(spark, sf))


_PAIR = """, u AS (SELECT task_id, arg_max(query_id, turn) AS query_id, arg_max(content, turn) AS "user", arg_max(papers, turn) AS up FROM m WHERE role = 'user' GROUP BY task_id),
a AS (SELECT task_id, query_id, arg_max(content, turn) AS assistant FROM m WHERE role = 'assistant' GROUP BY task_id, query_id)"""


@query(
    "last_pair",
    _M + _PAIR + """SELECT task_id, query_id, "user", assistant, list_aggregate(list_transform(up, lambda p: p."paperId"), 'string_agg', ',') AS papers FROM u JOIN a USING (task_id, query_id)""",
)
def last_pair(spark, sf):
    pairs = M.last_pair(X.messages(spark, sf))
    ids = F.array_join(F.transform("papers", lambda p: p["paperId"]), ",")
    return pairs.withColumn("papers", ids).select("task_id", "query_id", "user", "assistant", "papers")


@query(
    "query_papers",
    _RQ + """, u AS (SELECT task_id, query_id, arg_max(CASE WHEN turn % 2 = 0 THEN [] ELSE papers END, turn) AS up FROM m SEMI JOIN rq USING (task_id, query_id) WHERE role = 'user' GROUP BY ALL),
a AS (SELECT task_id, query_id, arg_max(papers, turn) AS ap FROM m WHERE role = 'assistant' GROUP BY ALL)
SELECT task_id, query_id, list_aggregate(list_transform(CASE WHEN len(up) > 0 THEN up ELSE ap END, lambda p: p."paperId"), 'string_agg', ',') AS ids FROM u LEFT JOIN a USING (task_id, query_id)""",
)
def query_papers(spark, sf):
    """User messages at even turns list no papers, so the answer's count."""
    m = X.messages(spark, sf)
    empty = F.slice("papers", 1, 0)
    m = m.withColumn("papers", F.when((F.col("role") == "user") & (F.col("turn") % 2 == 0), empty).otherwise(F.col("papers")))
    out = M.query_papers(m, _requests(spark, sf))
    return out.select("task_id", "query_id", F.array_join(F.transform("papers", lambda p: p["paperId"]), ",").alias("ids"))


@query("query_timestamps", _RQ + """SELECT task_id, query_id, max("timestamp") AS "timestamp" FROM m SEMI JOIN rq USING (task_id, query_id) GROUP BY ALL""")
def query_timestamps(spark, sf):
    return M.query_timestamp(X.messages(spark, sf), _requests(spark, sf))


@query(
    "last_message_per_role",
    _M + "SELECT task_id, query_id, role, arg_max(content, turn) AS last_content FROM m GROUP BY ALL",
)
def last_message_per_role(spark, sf):
    return M.last_message(X.messages(spark, sf), ["task_id", "query_id", "role"], ["content"])


_RUNNING = (
    _M + """SELECT task_id, turn, len(string_split(content, ' ')) AS words, CAST(sum(len(string_split(content, ' '))) OVER (
  PARTITION BY task_id ORDER BY "timestamp" DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS words_so_far FROM m WHERE role = 'assistant'"""
)


@query("running_words", _RUNNING)
def running_words(spark, sf):
    rows = M.running_words(X.messages(spark, sf))
    return rows.select("task_id", "turn", F.col("words").cast("bigint").alias("words"), "words_so_far")


@query("running_words_ranged", _RUNNING)
def running_words_ranged(spark, sf):
    """The same sums in ranges of like size."""
    rows = M.running_words(X.messages(spark, sf), bin_turns=None)
    return rows.select("task_id", "turn", F.col("words").cast("bigint").alias("words"), "words_so_far")


@query(
    "summary_cut",
    _M + """, w AS (SELECT task_id, sum(len(string_split(content, ' '))) OVER (PARTITION BY task_id ORDER BY "timestamp" DESC ROWS UNBOUNDED PRECEDING) AS c FROM m WHERE role = 'assistant'),
k AS (SELECT task_id, max(c) AS total, count_if(c <= 60) AS kept FROM w GROUP BY task_id HAVING max(c) > 120 AND count_if(c <= 60) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY "timestamp" DESC) AS z FROM m)
SELECT r.task_id, kept, max("timestamp") AS summary_ts, arg_max(query_id, turn) AS summary_query_id FROM r JOIN k USING (task_id) WHERE z > kept GROUP BY r.task_id, kept""",
)
def summary_cut(spark, sf):
    return M.summary_cut(X.messages(spark, sf), min_words=60)


_SUMMARIES = """sm AS (SELECT task_id, max("timestamp") AS "timestamp", arg_max(query_id, turn) AS query_id, 'sum of ' || task_id AS content
   FROM m WHERE turn < 3 AND conv_id % 2 = 0 GROUP BY task_id)"""


def _summaries(spark, sf):
    """Every other notebook has a summary of its first three turns."""
    m = X.messages(spark, sf).where((F.col("turn") < 3) & (F.col("conv_id") % 2 == 0))
    cut = m.groupBy("task_id").agg(
        F.max("timestamp").alias("summary_ts"), F.max_by("query_id", "turn").alias("summary_query_id")
    )
    texts = cut.select("task_id", F.concat(F.lit("sum of "), "task_id").alias("content"))
    empty = X.messages(spark, sf).where(F.lit(False)).select("task_id", "timestamp", "query_id", "content", "role", "model", "access", "mode")
    return M.append_summaries(empty, cut, texts)


@query(
    "append_summaries",
    X.with_ctes(X.MESSAGES, _SUMMARIES) + """SELECT *, 'assistant' AS role, 'summarizer' AS model, 'assistant' AS access, 'summary' AS mode FROM sm""",
)
def append_summaries(spark, sf):
    return _summaries(spark, sf)


@query(
    "recent_turns",
    X.with_ctes(X.MESSAGES, _SUMMARIES) + """SELECT conv_id, turn FROM m LEFT JOIN (SELECT task_id, "timestamp" AS last FROM sm) USING (task_id) WHERE last IS NULL OR "timestamp" > last""",
)
def recent_turns(spark, sf):
    return _key(M.newer_than_summary(X.messages(spark, sf), _summaries(spark, sf)))


_CONTEXT = """cx AS (SELECT task_id, 0 AS part, "timestamp", -1 AS turn, 'assistant' AS role, 'summarizer' AS model, content, NULL AS notebook_title FROM sm
 UNION ALL SELECT m.task_id, 1, m."timestamp", turn, role, model, m.content, notebook_title FROM m LEFT JOIN sm ON m.task_id = sm.task_id WHERE sm."timestamp" IS NULL OR m."timestamp" > sm."timestamp")"""


@query(
    "context_assembly",
    X.with_ctes(X.MESSAGES, _SUMMARIES, _CONTEXT) + """SELECT task_id, part, "timestamp", content FROM cx""",
)
def context_assembly(spark, sf):
    rows = M.context(X.messages(spark, sf), _summaries(spark, sf))
    return rows.select("task_id", "part", "timestamp", "content")


@query(
    "title_carry_over",
    X.with_ctes(X.MESSAGES, _SUMMARIES, _CONTEXT) + """, t AS (SELECT task_id, arg_max(notebook_title, part * 100000000 + "timestamp") AS t FROM cx GROUP BY task_id)
SELECT DISTINCT m.task_id, coalesce(t.t, 'hello ' || m.task_id) AS notebook_title FROM m LEFT JOIN t ON m.task_id = t.task_id AND split_part(m.task_id, '/', 1) <> 'u3' """,
)
def title_carry_over(spark, sf):
    """Notebooks of user u3 have no context yet and take the user's words."""
    context = M.context(X.messages(spark, sf), _summaries(spark, sf)).where(~F.startswith("task_id", F.lit("u3/")))
    asked = _requests(spark, sf).select("task_id", F.concat(F.lit("hello "), "task_id").alias("content"))
    return M.carried_title(context, asked).select("task_id", "notebook_title")


@query(
    "history_flatten",
    X.with_ctes(X.MESSAGES, _SUMMARIES, _CONTEXT) + """SELECT task_id, '- PREVIOUS SUMMARIES:' || chr(10) || coalesce(string_agg('  + ' || content || chr(10), '' ORDER BY "timestamp") FILTER (WHERE model = 'summarizer'), '')
  || '- RECENT HISTORY:' || chr(10) || coalesce(string_agg('  + ' || upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || content || chr(10), '' ORDER BY "timestamp", turn) FILTER (WHERE model <> 'summarizer'), '') AS history
FROM cx WHERE model <> 'search-worker' GROUP BY task_id""",
)
def history_flatten(spark, sf):
    return M.history_text(M.context(X.messages(spark, sf), _summaries(spark, sf)))


@query(
    "message_splice",
    _M + """SELECT conv_id, turn, CASE WHEN "timestamp" > conv_id * 1000 + 2 THEN 2 ELSE 0 END AS place, content FROM m
UNION ALL SELECT DISTINCT conv_id, CAST(NULL AS BIGINT), 1, 'new in ' || task_id FROM m""",
)
def message_splice(spark, sf):
    m = X.messages(spark, sf)
    tasks = m.select("task_id", "conv_id").distinct()
    new = tasks.select("task_id", "conv_id", (F.col("conv_id") * 1000 + 2).alias("timestamp"), F.concat(F.lit("new in "), "task_id").alias("content"))
    cut = tasks.select("task_id", (F.col("conv_id") * 1000 + 2).alias("cutoff"))
    return M.splice(m, new, cut).select("conv_id", "turn", "place", "content")


@query(
    "mode_routing",
    _M + """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'update' WHEN 1 THEN 'question' ELSE mode END AS routed FROM m""",
)
def mode_routing(spark, sf):
    t = F.col("turn") % 4
    content = F.when(t == 0, "*Notebook Update*").when(t == 1, "*explore QUESTIONS*").otherwise(F.col("content"))
    return X.messages(spark, sf).select("conv_id", "turn", M.route_mode(content, F.col("mode")).alias("routed"))


@query(
    "update_query_batch",
    _M + """SELECT task_id, query_id, content AS search_query, row_number() OVER (PARTITION BY task_id ORDER BY "timestamp") - 1 AS prefix FROM m WHERE role = 'user' AND turn % 3 < 2""",
)
def update_query_batch(spark, sf):
    m = X.messages(spark, sf).withColumn("search_query", F.when(F.col("turn") % 3 < 2, F.col("content")))
    return M.update_queries(m)


@query(
    "empty_notebooks",
    """SELECT 'u' || (c_custkey % 7) || '/' || c_custkey AS task_id FROM customer WHERE c_custkey NOT IN (SELECT conv_id FROM conversations)""",
)
def empty_notebooks(spark, sf):
    """Customers as notebooks; those without a conversation are empty."""
    key = F.col("c_custkey")
    notebooks = read_table(spark, sf, "customer").select(
        I.task_id(F.concat(F.lit("u"), (key % 7).cast("string")), key.cast("string")).alias("task_id")
    )
    return M.empty_notebooks(notebooks, X.messages(spark, sf))


@query(
    "delete_notebooks",
    X.with_ctes(X.MESSAGES, _RESULTS) + """SELECT 'messages' AS part, conv_id % 7 AS u, count(*) AS n FROM m WHERE turn >= 0 AND conv_id NOT IN (SELECT conv_id FROM m WHERE turn > 6) GROUP BY ALL
UNION ALL SELECT 'results', CAST(substr(task_id, 2, 1) AS BIGINT), count(*) FROM rs WHERE CAST(split_part(task_id, '/', 2) AS BIGINT) NOT IN (SELECT conv_id FROM m WHERE turn > 6) GROUP BY ALL""",
)
def delete_notebooks(spark, sf):
    m = X.messages(spark, sf)
    kept_m, kept_r = M.delete_notebooks([m, _results(spark, sf)], m.where(F.col("turn") > 6))
    count = lambda df, part: df.groupBy(F.lit(part).alias("part"), F.substring("task_id", 2, 1).cast("bigint").alias("u")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return count(kept_m, "messages").unionByName(count(kept_r, "results"))


@query(
    "relevance_filter",
    X.with_ctes(X.MESSAGES, _RESULTS) + """SELECT query_id, "paperId", seq FROM rs WHERE ("paperId" = 'd' || split_part(task_id, '/', 2) OR "paperId" LIKE '%5') AND "paperId" NOT LIKE '%15' """,
)
def relevance_filter(spark, sf):
    """The model named papers ending in 5 and the notebook's own number; those ending in 15 were used before."""
    rows = _results(spark, sf)
    own = F.concat(F.lit("d"), F.split_part("task_id", F.lit("/"), F.lit(2)))
    named = F.when((F.col("paperId") == own) | F.endswith("paperId", F.lit("5")), F.col("paperId"))
    relevance = rows.groupBy("query_id").agg(F.collect_set(named).alias("paperIds"))
    used = rows.groupBy("query_id").agg(F.collect_set(F.when(F.endswith("paperId", F.lit("15")), F.col("paperId"))).alias("paperIds"))
    return M.relevant_results(rows, relevance, used).select("query_id", "paperId", "seq")


@query(
    "section_papers",
    X.with_ctes(X.MESSAGES, _MP) + """SELECT DISTINCT s.task_id, s.section, s."paperId", f.user_score FROM (SELECT task_id, 's' || turn AS section, "paperId" FROM mp) s
JOIN (SELECT task_id, "paperId", arg_min(user_score, "timestamp" * 10 + pos) AS user_score FROM mp GROUP BY ALL) f USING (task_id, "paperId")""",
)
def section_papers(spark, sf):
    """Messages as plan sections."""
    m = X.messages(spark, sf)
    sections = m.select(
        "task_id", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("section"),
        F.transform("papers", lambda p: p["paperId"]).alias("paperIds"),
    )
    papers = M.all_first_seen_papers(m).select("task_id", "paperId", "user_score")
    return M.section_papers(sections, papers)


@query(
    "ghost_users",
    """WITH v AS (SELECT substr(sha256('user' || c_custkey), 1, 20) AS h FROM customer WHERE c_custkey % 3 > 0),
u AS (SELECT substr(sha256('user' || c_custkey), 1, 6 + c_custkey % 5) AS uid FROM customer)
SELECT uid FROM u WHERE NOT EXISTS (SELECT 1 FROM v WHERE starts_with(v.h, u.uid))""",
)
def ghost_users(spark, sf):
    """Stored users, by hash heads of five lengths, without a valid account."""
    c = read_table(spark, sf, "customer").withColumn("u", F.concat(F.lit("user"), F.col("c_custkey").cast("string")))
    valid = c.where(F.col("c_custkey") % 3 > 0).select(I.hash_id(F.col("u"), 20).alias("h"))
    full = I.hash_id(F.col("u"), 64)
    users = c.select(F.substring(full, F.lit(1), (F.lit(6) + F.col("c_custkey") % 5).cast("int")).alias("uid"))
    return M.prefix_anti(users, "uid", valid, "h", name_is_prefix=True)


@query(
    "orphan_files",
    """WITH f AS (SELECT DISTINCT conv_id || CASE WHEN turn % 2 = 0 THEN '.chat.json' ELSE '.summaries.json' END AS file FROM conversations),
k AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id FROM conversations WHERE turn > 5)
SELECT file FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE starts_with(f.file, k.id))""",
)
def orphan_files(spark, sf):
    """Files that start with no kept notebook id."""
    c = read_table(spark, sf, "conversations")
    key = F.col("conv_id").cast("string")
    ending = F.when(F.col("turn") % 2 == 0, ".chat.json").otherwise(".summaries.json")
    files = c.select(F.concat(key, ending).alias("file")).distinct()
    return M.prefix_anti(files, "file", c.where(F.col("turn") > 5).select(key.alias("id")).distinct(), "id", name_is_prefix=False)


@query(
    "positive_scores",
    X.with_ctes(X.MESSAGES, _MP) + """SELECT task_id, turn, pos, "paperId" FROM mp WHERE user_score > 0""",
)
def positive_scores(spark, sf):
    rows = M.message_papers(X.messages(spark, sf)).where(F.col("user_score") > 0)
    return rows.select("task_id", F.col("seq").alias("turn"), F.col("pos").cast("bigint").alias("pos"), "paperId")


@query("score_keys", _M + "SELECT conv_id, turn, 'blended_score,user_score' AS keys FROM m")
def score_keys(spark, sf):
    scores = F.create_map(
        F.lit("user_score"), F.col("turn"), F.lit("title"), F.col("turn"), F.lit("blended_score"), F.col("conv_id")
    )
    return X.messages(spark, sf).select(
        "conv_id", "turn", F.array_join(F.array_sort(F.map_keys(score_fields(scores))), ",").alias("keys")
    )
