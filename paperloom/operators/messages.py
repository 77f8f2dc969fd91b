"""Notebook message tables: history, cleanup, nested paper lists.

All notebooks are handled at once, keyed by task_id; requests are rows too. Order
inside a notebook is (timestamp, seq) where ``seq`` is the position of the message.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.operators.catalog import keep_one
from paperloom.operators.running import running_total

# Words that switch a turn's mode, worker and summary model names.
UPDATE_TEXT = "*notebook update*"
QUESTION_TEXT = "*explore questions*"
WORKER_MODEL = "search-worker"
SUMMARY_MODEL = "summarizer"
HISTORY_WORDS = 1000
SUMMARY_HEAD, RECENT_HEAD = "- PREVIOUS SUMMARIES:\n", "- RECENT HISTORY:\n"
# Roles and modes that each mode drops before its turn runs again.
RESET_RULES = (
    ("reply", "assistant", "reply"),
    ("reply", "assistant", "expand"),
    ("reply", "user", None),
    ("expand", "assistant", "expand"),
    ("regenerate", "assistant", "regenerate"),
    ("regenerate", "user", None),
)
# Running sums are cut into bins of this many messages.
BIN_TURNS = 256


def _position() -> Column:
    return F.struct("timestamp", "seq")


def history_until(messages: DataFrame, cutoff: Column) -> DataFrame:
    return messages.where(F.col("timestamp") <= cutoff)


def visible(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("access") == "all")


def without_worker(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("model") != WORKER_MODEL)


def load_query(messages: DataFrame, requests: DataFrame) -> DataFrame:
    return messages.join(requests.select("task_id", "query_id"), ["task_id", "query_id"], "left_semi")


def delete_queries(messages: DataFrame, requests: DataFrame) -> DataFrame:
    return messages.join(requests.select("task_id", "query_id"), ["task_id", "query_id"], "left_anti")


def delete_role(
    messages: DataFrame, requests: DataFrame, role: str, modes: Sequence[str] | None = None
) -> DataFrame:
    """Removes a query's messages of one role, for assistants only those of the given modes."""
    hit = requests.select("task_id", "query_id").withColumn("role", F.lit(role))
    if modes is None:
        return messages.join(hit, ["task_id", "query_id", "role"], "left_anti")
    hit = hit.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return messages.join(hit, ["task_id", "query_id", "role", "mode"], "left_anti")


def reset_for_mode(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Drops what the requested mode will write again; ``requests`` has task_id, query_id, mode."""
    rules = F.array(
        *[
            F.struct(F.lit(m).alias("when"), F.lit(r).alias("role"), F.lit(d).cast("string").alias("drop"))
            for m, r, d in RESET_RULES
        ]
    )
    wanted = requests.select("task_id", "query_id", "mode", F.explode(rules).alias("r")).where("r.when = mode")
    by_mode = wanted.where("r.drop IS NOT NULL").select("task_id", "query_id", "r.role", F.col("r.drop").alias("mode"))
    by_role = wanted.where("r.drop IS NULL").select("task_id", "query_id", "r.role")
    return messages.join(by_mode, ["task_id", "query_id", "role", "mode"], "left_anti").join(
        by_role, ["task_id", "query_id", "role"], "left_anti"
    )


def truncate_from(messages: DataFrame, requests: DataFrame, keep_user_message: bool = False) -> DataFrame:
    """Messages older than the query's first user (or assistant) message; other notebooks stay whole."""
    role = "assistant" if keep_user_message else "user"
    cut = (
        load_query(messages, requests)
        .where(F.col("role") == role)
        .groupBy("task_id")
        .agg(F.min_by("timestamp", _position()).alias("_cut"))
    )
    kept = messages.join(cut, "task_id", "left")
    return kept.where(F.col("_cut").isNull() | (F.col("timestamp") < F.col("_cut"))).drop("_cut")


def rename(messages: DataFrame, titles: DataFrame) -> DataFrame:
    """``titles`` (task_id, new_title): sets the title on every message of the notebook."""
    return (
        messages.join(titles, "task_id", "left")
        .withColumn("notebook_title", F.coalesce("new_title", "notebook_title"))
        .drop("new_title")
    )


def stamp_update(messages: DataFrame, tasks: DataFrame, when: Column) -> DataFrame:
    marked = tasks.select("task_id").distinct().withColumn("_hit", F.lit(True))
    return messages.join(marked, "task_id", "left").withColumn("timestamp_update", F.when(F.col("_hit"), when)).drop("_hit")


def set_scores_nested(messages: DataFrame, paper_ids: Column, scores: Mapping[str, Column]) -> DataFrame:
    """Sets the score fields of matching papers inside each message; keys without 'score' are ignored."""
    fields = {k: v for k, v in scores.items() if "score" in k}

    def update(p: Column) -> Column:
        changed = reduce(lambda acc, kv: acc.withField(kv[0], kv[1]), fields.items(), p)
        return F.when(F.array_contains(paper_ids, p["paperId"]), changed).otherwise(p)

    return messages.withColumn("papers", F.transform("papers", update))


def set_scores_flat(results: DataFrame, marks: DataFrame) -> DataFrame:
    """The same for result rows; ``marks`` is (task_id, paperId, new_score)."""
    return (
        results.join(marks, ["task_id", "paperId"], "left")
        .withColumn("user_score", F.coalesce("new_score", "user_score"))
        .drop("new_score")
    )


def answered_only(messages: DataFrame) -> DataFrame:
    """Messages whose query has an assistant message."""
    answered = messages.where(F.col("role") == "assistant").select("task_id", "query_id")
    return messages.join(answered, ["task_id", "query_id"], "left_semi")


def message_papers(messages: DataFrame) -> DataFrame:
    """One row per paper listed in a message, with its position in the list."""
    return messages.select("task_id", "query_id", "role", "timestamp", "seq", F.posexplode("papers").alias("pos", "p")).select(
        "task_id", "query_id", "role", "timestamp", "seq", "pos", "p.*"
    )


def clean_results(results: DataFrame, messages: DataFrame) -> DataFrame:
    """Results of answered queries whose paper is still listed, the last one per paper.

    A result's query id carries the sub-query prefix before its first '_'.
    """
    answered = messages.where(F.col("role") == "assistant").select("task_id", F.col("query_id").alias("_qid"))
    listed = message_papers(messages).select("task_id", "paperId")
    kept = (
        results.withColumn("_qid", F.regexp_replace("query_id", "^[^_]*_", ""))
        .join(answered, ["task_id", "_qid"], "left_semi")
        .join(listed, ["task_id", "paperId"], "left_semi")
        .drop("_qid")
    )
    return keep_one(kept, ["task_id", "paperId"], F.col("seq"), last=True)


def first_seen_papers(messages: DataFrame, trash: bool = False) -> DataFrame:
    """One row per paper of a notebook, first seen wins; trashed or kept papers only."""
    mark = F.col("user_score") < 0 if trash else F.col("user_score") >= 0
    rows = message_papers(messages).where(mark)
    return keep_one(rows, ["task_id", "paperId"], F.struct("timestamp", "seq", "pos"))


def all_first_seen_papers(messages: DataFrame) -> DataFrame:
    return keep_one(message_papers(messages), ["task_id", "paperId"], F.struct("timestamp", "seq", "pos"))


def flag_selected(papers: DataFrame, messages: DataFrame, selected: DataFrame) -> DataFrame:
    """Papers with ``matches``: whether a selected query lists them."""
    chosen = message_papers(load_query(messages, selected)).select("task_id", "paperId").distinct()
    return papers.join(chosen.withColumn("_m", F.lit(True)), ["task_id", "paperId"], "left").withColumn(
        "matches", F.coalesce("_m", F.lit(False))
    ).drop("_m")


def list_notebooks(messages: DataFrame) -> DataFrame:
    """Last title, first time, newest first."""
    return (
        messages.groupBy("task_id")
        .agg(F.max_by("notebook_title", _position()).alias("title"), F.min_by("timestamp", _position()).alias("date"))
        .orderBy(F.desc("date"), "task_id")
    )


def last_message(messages: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The newest message of each key as columns ``last_<field>``."""
    newest = messages.groupBy(*keys).agg(F.max_by(F.struct(*fields), _position()).alias("_m"))
    return newest.select(*keys, *[F.col(f"_m.{f}").alias(f"last_{f}") for f in fields])


def last_pair(messages: DataFrame) -> DataFrame:
    """Newest user message with the answer to its query; papers of the user message, else of the answer."""
    user = last_message(messages.where(F.col("role") == "user"), ["task_id"], ["query_id", "content", "papers"])
    user = user.select(
        "task_id",
        F.col("last_query_id").alias("query_id"),
        F.col("last_content").alias("user"),
        F.col("last_papers").alias("_up"),
    )
    return _with_answer(user, messages)


def _with_answer(user: DataFrame, messages: DataFrame) -> DataFrame:
    answer = last_message(messages.where(F.col("role") == "assistant"), ["task_id", "query_id"], ["content", "papers"])
    given = F.when(F.size("_up") > 0, F.col("_up")).otherwise(F.col("last_papers"))
    return (
        user.join(answer, ["task_id", "query_id"], "inner")
        .withColumn("papers", given)
        .withColumnRenamed("last_content", "assistant")
        .drop("_up", "last_papers")
    )


def query_papers(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Papers of each requested query's user message, else of its answer."""
    asked = load_query(messages, requests)
    user = last_message(asked.where(F.col("role") == "user"), ["task_id", "query_id"], ["papers"])
    answer = last_message(asked.where(F.col("role") == "assistant"), ["task_id", "query_id"], ["papers"])
    a = answer.withColumnRenamed("last_papers", "_ap")
    chosen = F.when(F.size("last_papers") > 0, F.col("last_papers")).otherwise(F.col("_ap"))
    return user.join(a, ["task_id", "query_id"], "left").select("task_id", "query_id", chosen.alias("papers"))


def empty_notebooks(notebooks: DataFrame, messages: DataFrame) -> DataFrame:
    return notebooks.join(messages.select("task_id"), "task_id", "left_anti")


def delete_notebooks(tables: Sequence[DataFrame], tasks: DataFrame) -> list[DataFrame]:
    """Every table without the rows of the given notebooks."""
    return [t.join(tasks.select("task_id"), "task_id", "left_anti") for t in tables]


def doi_list(results: DataFrame) -> DataFrame:
    return results.where(F.col("doi").isNotNull() & (F.col("doi") != "")).select("task_id", "doi")


def newer_than_summary(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Turns after the notebook's last summary; all turns when it has none."""
    last = summaries.groupBy("task_id").agg(F.max("timestamp").alias("_last"))
    recent = messages.join(last, "task_id", "left")
    return recent.where(F.col("_last").isNull() | (F.col("timestamp") > F.col("_last"))).drop("_last")


def context(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries, then turns newer than the last one; ``part`` keeps the two apart in the order."""
    recent = newer_than_summary(messages, summaries).withColumn("part", F.lit(1))
    return summaries.withColumn("part", F.lit(0)).unionByName(recent, allowMissingColumns=True)


def carried_title(context_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """The last title of the context, else the user's message."""
    last = context_rows.groupBy("task_id").agg(
        F.max_by("notebook_title", F.struct("part", "timestamp", "seq")).alias("_t")
    )
    return requests.join(last, "task_id", "left").withColumn("notebook_title", F.coalesce("_t", "content")).drop("_t")


def updated_notebooks(messages: DataFrame, started: Column) -> DataFrame:
    """Notebooks whose last message is an update newer than ``started``."""
    last = last_message(messages, ["task_id"], ["timestamp_update", "mode"])
    return last.where((F.col("last_timestamp_update") > started) & (F.col("last_mode") == "update")).select("task_id")


def route_mode(content: Column, mode: Column) -> Column:
    low = F.lower(content)
    return F.when(low == UPDATE_TEXT, "update").when(low == QUESTION_TEXT, "question").otherwise(mode)


def update_queries(messages: DataFrame) -> DataFrame:
    """All past user queries of a notebook, numbered in order, as the batch of an update run."""
    asked = messages.where((F.col("role") == "user") & F.col("search_query").isNotNull())
    return running_total(
        asked, ["task_id"], ["timestamp", "seq"], F.lit(1), F.floor(F.col("seq") / BIN_TURNS), "_n"
    ).select("task_id", "query_id", "search_query", (F.col("_n") - 1).alias("prefix"))


def running_words(messages: DataFrame, bin_turns: int | None = BIN_TURNS) -> DataFrame:
    """Assistant words from the newest turn back, in bins of turns or, without ``bin_turns``, in ranges of like size."""
    turns = messages.where(F.col("role") == "assistant").withColumn("words", F.size(F.split("content", " ")))
    return running_total(
        turns,
        ["task_id"],
        ["timestamp", "seq"],
        F.col("words"),
        None if bin_turns is None else F.floor(F.col("seq") / bin_turns),
        "words_so_far",
        newest_first=True,
    )


def summary_cut(messages: DataFrame, min_words: int = HISTORY_WORDS) -> DataFrame:
    """Where a long notebook is cut for summarising.

    With more than twice ``min_words`` assistant words, the newest ``kept`` turns
    stay, ``kept`` being the number of newest answers that together do not pass
    ``min_words``; the turns before them are summarised up to ``summary_ts``.
    """
    words = running_words(messages).groupBy("task_id").agg(
        F.max("words_so_far").alias("total"), F.count_if(F.col("words_so_far") <= min_words).alias("kept")
    )
    due = words.where((F.col("total") > 2 * min_words) & (F.col("kept") > 0))
    from_end = running_total(
        messages, ["task_id"], ["timestamp", "seq"], F.lit(1), F.floor(F.col("seq") / BIN_TURNS), "from_end", newest_first=True
    )
    older = from_end.join(due, "task_id").where(F.col("from_end") > F.col("kept"))
    return older.groupBy("task_id", "kept").agg(
        F.max("timestamp").alias("summary_ts"), F.max_by("query_id", _position()).alias("summary_query_id")
    )


def append_summaries(summaries: DataFrame, cuts: DataFrame, texts: DataFrame) -> DataFrame:
    """One new summary row per cut notebook; ``texts`` is (task_id, content)."""
    new = cuts.join(texts, "task_id").select(
        "task_id",
        F.col("summary_ts").alias("timestamp"),
        F.col("summary_query_id").alias("query_id"),
        "content",
        F.lit("assistant").alias("role"),
        F.lit(SUMMARY_MODEL).alias("model"),
        F.lit("assistant").alias("access"),
        F.lit("summary").alias("mode"),
    )
    return summaries.unionByName(new, allowMissingColumns=True)


def splice(history: DataFrame, new: DataFrame, cutoff: DataFrame) -> DataFrame:
    """History with each new message placed after the turns up to its notebook's cutoff.

    ``place`` orders the result: 0 before the cut, 1 the new message, 2 after it.
    """
    placed = history.join(cutoff, "task_id", "left").withColumn(
        "place", F.when(F.col("timestamp") > F.col("cutoff"), 2).otherwise(0)
    )
    return placed.drop("cutoff").unionByName(new.withColumn("place", F.lit(1)), allowMissingColumns=True)


def query_timestamp(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest timestamp of each requested query."""
    return load_query(messages, requests).groupBy("task_id", "query_id").agg(
        F.max_by("timestamp", _position()).alias("timestamp")
    )


def relevant_results(results: DataFrame, relevance: DataFrame, used: DataFrame) -> DataFrame:
    """Results whose paper was named relevant, without those already used by the query."""
    named = relevance.select("query_id", F.explode("paperIds").alias("paperId"))
    seen = used.select("query_id", F.explode("paperIds").alias("paperId"))
    keys = ["query_id", "paperId"]
    return results.join(named, keys, "left_semi").join(seen, keys, "left_anti")


def section_papers(sections: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers of each plan section, by exploding the section's id list."""
    ids = sections.select("task_id", "section", F.explode(F.array_distinct("paperIds")).alias("paperId"))
    return ids.join(papers, ["task_id", "paperId"], "inner")


def own_results(results: DataFrame, index: int, query_id: Column) -> DataFrame:
    """Results of one submitted sub-query that hold a paper."""
    wanted = F.concat_ws("_", F.lit(str(index)), query_id)
    return results.where((F.col("query_id") == wanted) & F.col("paperId").isNotNull())


def prefix_anti(names: DataFrame, name: str, keys: DataFrame, key: str, name_is_prefix: bool) -> DataFrame:
    """Rows of ``names`` that no key matches by prefix, as an equi anti join.

    ``name_is_prefix``: the row is dropped when some key starts with its name;
    otherwise when its name starts with some key. The longer side is cut at
    the lengths that occur on the other side, which are few, so there is no pairwise test.
    """
    short, long = (names.select(F.col(name).alias("s")), keys.select(F.col(key).alias("l"))) if name_is_prefix else (
        keys.select(F.col(key).alias("s")), names.select(F.col(name).alias("l"))
    )
    lengths = short.agg(F.collect_set(F.length("s"))).scalar()
    cut = F.explode(F.filter(F.col("lengths"), lambda n: n <= F.length("l"))).alias("n")
    heads = long.withColumn("lengths", lengths).select("l", cut).select("l", F.substring(F.col("l"), F.lit(1), F.col("n")).alias("head"))
    if name_is_prefix:
        return names.join(heads.select(F.col("head").alias(name)), name, "left_anti")
    hit = heads.join(short.select(F.col("s").alias("head")), "head", "left_semi").select(F.col("l").alias(name))
    return names.join(hit, name, "left_anti")


def deleted_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows removed per key: count before minus count after, in one aggregation."""
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_n"))
    return side(before, 1).unionByName(side(after, -1)).groupBy(*keys).agg(F.sum("_n").alias("deleted"))


def history_text(messages: DataFrame) -> DataFrame:
    """Two text sections per notebook: previous summaries and recent turns, worker turns skipped."""
    turns = messages.where(F.col("model") != WORKER_MODEL)
    is_summary = F.col("model") == SUMMARY_MODEL
    head = F.concat(F.upper(F.substring("role", 1, 1)), F.lower(F.expr("substring(role, 2)")))
    line = F.when(is_summary, F.concat(F.lit("  + "), "content", F.lit("\n"))).otherwise(
        F.concat(F.lit("  + "), head, F.lit(": "), "content", F.lit("\n"))
    )
    ordered = lambda keep: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("timestamp", "seq", "line")))), lambda s: s["line"]), ""
    )
    return (
        turns.withColumn("line", line)
        .groupBy("task_id")
        .agg(ordered(is_summary).alias("_p"), ordered(~is_summary).alias("_r"))
        .select(
            "task_id",
            F.concat(F.lit(SUMMARY_HEAD), "_p", F.lit(RECENT_HEAD), "_r").alias("history"),
        )
    )
