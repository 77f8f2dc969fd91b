"""Search and question requests answered from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators import search as S
from paperloom.operators.cells import CellIndex, search
from paperloom.operators.chunks import with_role_prefix
from paperloom.operators.embed import Encoder, embed_texts
from paperloom.operators.filters import FILTERS, filter_row, request_filter_rows
from paperloom.sources.requests import BATCH_PACE

MODEL = "e5"


def sub_queries(requests: DataFrame, encoder: Callable[[], Encoder]) -> DataFrame:
    """One embedded row per sub-query of each request."""
    rows = requests.where(F.coalesce(F.size("query.queries"), F.lit(0)) > 0).select(
        "task_id", "query_id", "topK", "query", *(["filters"] if "filters" in requests.columns else []), F.posexplode("query.queries").alias("qi", "text")
    )
    return embed_texts(rows.withColumn("text", with_role_prefix(F.col("text"), MODEL, "query")), "text", encoder)


def with_filters(requests: DataFrame, feedback: DataFrame | None) -> DataFrame:
    """Requests with their filters as data; a locked request may only see the papers its notebook kept."""
    filters = request_filter_rows(F.col("query"))
    if feedback is None:
        return requests.withColumn("filters", filters)
    kept = feedback.where(F.col("user_score") >= 0).groupBy("task_id").agg(F.collect_set("paperId").alias("_kept"))
    lock = F.array(filter_row("paperId", "==", F.coalesce("_kept", F.array().cast("array<string>")))).cast(FILTERS)
    locked = F.when(F.col("paperLock"), F.concat(filters, lock)).otherwise(filters)
    return requests.join(kept, "task_id", "left").withColumn("filters", locked).drop("_kept")


def search_requests(
    requests: DataFrame,
    papers: DataFrame | CellIndex,
    encoder: Callable[[], Encoder],
    feedback: DataFrame | None = None,
    blend: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ranked results of a request batch; a request without hits keeps one row with a null paperId.

    ``papers`` has paperId, vectors and the payload columns, or is an index of them; ``feedback`` has
    (task_id, paperId, user_score), and papers a notebook trashed are never among its hits. ``blend``
    adds blended_score from a fitted scorer. What a request filters on or leaves out travels with its
    query, so papers are not joined with anything but queries.
    """
    queries = sub_queries(with_filters(requests, feedback), encoder)
    trashed = None
    if feedback is not None:
        trashed = feedback.where(F.col("user_score") < 0).join(requests.select("task_id", "query_id"), "task_id").select("query_id", "paperId").distinct()
    if isinstance(papers, CellIndex):
        hits, _ = search(papers, queries, S.OVERFETCH, trashed, rerank=True)
    else:
        hits = S.top_k(papers, queries, S.OVERFETCH, trashed, rerank=True)
    if blend is None:
        ranked = S.rerank_and_sort(hits)
    else:
        ranked = S.rerank_and_sort(blend(hits), blended=F.col("blended_score"))
    rows = ranked.select("query_id", "paperId", "retrieval_score", "rerank_score", "score", "rank")
    return requests.select("task_id", "user_id", "notebook_id", "query_id").join(rows, "query_id", "left")


def score_questions(requests: DataFrame, pooled: DataFrame, encoder: Callable[[], Encoder]) -> DataFrame:
    """Mean cosine of each question with the notebook's papers; ``pooled`` has task_id and embedding."""
    asked = sub_queries(requests, encoder).select("task_id", F.element_at("query.queries", F.col("qi") + 1).alias("question"), "embedding")
    return S.question_scores(asked, pooled)


def answer_stream(
    stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Answers each micro-batch and writes it under its batch number, so a retried batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").json(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=BATCH_PACE)).start()


def requery_new_papers(new_papers: DataFrame, stored_queries: DataFrame, returned: DataFrame) -> DataFrame:
    """Stored queries over newly added papers only, without papers they returned before.

    Papers already returned are taken out before the cut, so they use up no rank.
    """
    hits = S.top_k(new_papers, stored_queries, exclude=returned)
    return hits.select("query_id", "paperId", "retrieval_score", "retrieval_rank")


_STANDING = "query_id string, paperId string, retrieval_score double, retrieval_rank int, topK int"


def _standing(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The lists of the last batch, or of the last one before a batch."""
    try:
        lists = spark.read.schema(_STANDING + ", batch long").parquet(root)
    except AnalysisException:  # nothing is written yet
        return spark.createDataFrame([], _STANDING)
    lists = lists if before is None else lists.where(F.col("batch") < before)
    return lists.where(F.col("batch") == lists.agg(F.max("batch")).scalar()).drop("batch")


def standing_lists(spark: SparkSession, root: str) -> DataFrame:
    """The best papers of every stored query so far: query_id, paperId, retrieval_score, retrieval_rank, topK."""
    return _standing(spark, root)


def requery_stream(stream: DataFrame, stored_queries: DataFrame, returned: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps each stored query's best papers up to date with a stream of new papers (paperId, vectors).

    The state is the list of every query, a table below ``root`` for each batch: the score of a full
    list's last paper is the query's floor. New papers meet a query only where the bound of their block
    reaches its floor, and what scores less is not returned. A batch reads the lists of the batch before
    it and writes its own, so a batch that is run again replaces itself, and a stream that is started
    again goes on from the last. A paper that comes again replaces its earlier score where it still is
    in a list.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = _standing(spark, root, batch_id)
        full = old.groupBy("query_id").agg(F.min("retrieval_score").alias("floor"), F.count("*").alias("n"), F.first("topK").alias("k"))
        floors = full.where("n >= k").select("query_id", "floor")
        # nothing arrives twice in one batch as far as lists go: one row per paper
        papers = batch.dropDuplicates(["paperId"])
        hits = S.top_k(papers, stored_queries, exclude=returned, floors=floors)
        kept = old.join(papers.select("paperId"), "paperId", "left_anti")
        both = kept.select("query_id", "paperId", "retrieval_score", "topK").unionByName(hits.select("query_id", "paperId", "retrieval_score", "topK"))
        order = Window.partitionBy("query_id").orderBy(F.desc("retrieval_score"), "paperId")
        ranked = both.withColumn("retrieval_rank", F.row_number().over(order)).where("retrieval_rank <= topK")
        ranked.select("query_id", "paperId", "retrieval_score", "retrieval_rank", "topK").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=BATCH_PACE)).start()
