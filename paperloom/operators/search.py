"""Exact multi-vector search.

A query holds one or more sub-query vectors, a paper holds one vector per chunk, and their score
is the late-interaction MaxSim. ``top_k`` reads every paper once, in blocks that meet the blocks of
queries (``operators.cells``); with an index of cells, ``cells.search`` reads what could matter only.
Both take filters as data: a column ``filters`` of the query table, see ``operators.filters``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from paperloom.functions import vectors as V
from paperloom.functions.matrices import centred_rows, starts_of, unit_rows, vector_matrix
from paperloom.operators import cells as C
from paperloom.operators.encoder import Weights, encode
from paperloom.operators.filters import DATE_FIELDS, KEYWORD_FIELDS, RANGE_FIELDS, TEXT_FIELDS

# The chunker numbers windows from 0 and stops far below this, so a packed paper is bounded.
MAX_CHUNK_IDX = 4096

OVERFETCH = 5
DECIMALS = C.DECIMALS


def pack_vectors(chunks: DataFrame, key: str = "paperId", payload: tuple[str, ...] = ()) -> DataFrame:
    """Chunk rows to one row per paper with its vectors in chunk order.

    The group is bounded because chunk numbers are unique per paper and capped by
    the chunker; a number past the cap is malformed input and fails the job
    before anything is collected.
    """
    checked = F.when(F.col("chunk_idx") <= MAX_CHUNK_IDX, F.col("chunk_idx")).otherwise(
        F.raise_error(F.lit("chunk_idx exceeds the chunker's cap")).cast("bigint")
    )
    return (
        chunks.select(key, *payload, F.struct(checked.alias("i"), F.col("embedding").alias("v")).alias("c"))
        .groupBy(key)
        .agg(
            F.transform(F.sort_array(F.collect_list("c")), lambda c: c["v"]).alias("vectors"),
            *[F.first(p).alias(p) for p in payload],
        )
    )


def top_k(
    papers: DataFrame,
    queries: DataFrame,
    factor: int = 1,
    exclude: DataFrame | None = None,
    rerank: bool = False,
    decimals: int = DECIMALS,
    floors: DataFrame | None = None,
) -> DataFrame:
    """The ``factor * topK`` nearest papers of every query (query_id, qi, embedding, topK and maybe filters).

    A query's own filters read the payload columns of ``papers``. ``exclude`` holds (query_id, paperId)
    pairs to leave out before the cut: a query keeps that many more, which are taken out of its list.
    ``floors`` (query_id, floor) leaves out papers that score less, and with them whole blocks.
    Returns (query_id, paperId, retrieval_score, rerank_score, retrieval_rank, topK).
    """
    more = None if exclude is None else exclude.groupBy("query_id").agg(F.count("*").alias("more"))
    rows, n_blocks = C.query_rows(queries, factor, more, floors), C.block_count(queries)
    fields = KEYWORD_FIELDS + TEXT_FIELDS + RANGE_FIELDS + DATE_FIELDS if "filters" in queries.columns else ()
    return C.best(C.meet_all(papers, rows, n_blocks, fields, rerank, decimals), factor, exclude)


def rerank_and_sort(hits: DataFrame, truncate: str = "before", blended: Column | None = None) -> DataFrame:
    """Cut the over-fetched hits to topK and sort by the final score.

    ``before`` cuts by retrieval score first, so re-ranking reorders but never
    promotes a paper from the tail; ``after`` cuts by the final score. A paper
    with user_score 0 gets score 0.
    """
    if truncate not in ("before", "after"):
        raise ValueError("truncate is 'before' or 'after'")
    score = F.col("rerank_score") if blended is None else blended
    if "user_score" in hits.columns:
        score = F.when(F.col("user_score") == 0, F.lit(0.0)).otherwise(score)
    if truncate == "before":
        hits = hits.where(F.col("retrieval_rank") <= F.col("topK"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "paperId")
    ranked = hits.withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.col("topK"))


def query_vectors(queries: DataFrame) -> DataFrame:
    """(query_id, query_vectors): the sub-query vectors of each query in order."""
    subs = F.sort_array(F.collect_list(F.struct("qi", "embedding")))
    return queries.groupBy("query_id").agg(F.transform(subs, lambda s: s["embedding"]).alias("query_vectors"))


def _pair_scores(kind: str, temperature: float, decimals: int):
    """Scores of rows with a query's and a paper's vectors, as one matrix product per row."""

    def score(q: np.ndarray, d: np.ndarray) -> float:
        sims = q @ d.T
        if kind != "soft":
            return float(sims.max(axis=1).sum()) if len(d) else 0.0
        top = sims.max(axis=1, keepdims=True)
        return float(((top[:, 0] + temperature * np.log(np.exp((sims - top) / temperature).sum(axis=1))) / temperature).mean())

    def run(batches):
        shape = centred_rows if kind == "centred" else unit_rows
        for batch in batches:
            sides = [vector_matrix(batch.column(c)) for c in ("query_vectors", "vectors")]
            (q, q_counts), (d, d_counts) = [(shape(m) if len(m) else m, n) for m, n in sides]
            q_at, d_at = starts_of(q_counts), starts_of(d_counts)
            scores = [
                score(q[q_at[i] : q_at[i + 1]], d[d_at[i] : d_at[i + 1]].reshape(-1, q.shape[1])) if kind != "soft" or d_counts[i] else None
                for i in range(batch.num_rows)
            ]
            scores = [None if x is None else round(x, decimals) for x in scores]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("paperId"), pa.array(scores, pa.float64())], names=["query_id", "paperId", "score"])

    return run


def score_pairs(
    pairs: DataFrame,
    papers: DataFrame,
    queries: DataFrame,
    kind: str = "maxsim",
    temperature: float = 0.01,
    decimals: int = DECIMALS,
    encoder: Weights | None = None,
) -> DataFrame:
    """(query_id, paperId, score) of the given pairs: ``maxsim``, ``soft`` or ``centred`` (the untrained re-ranker).

    Pairs are retrieved candidates, so as many rows leave as came; nothing is scored against all papers.
    With an encoder both sides are encoded first, each query and each candidate paper once.
    """
    if kind not in ("maxsim", "soft", "centred"):
        raise ValueError(f"unknown score {kind!r}")
    sides, known = query_vectors(queries), papers.select("paperId", "vectors")
    if encoder is not None:
        known = encode(known.join(pairs.select("paperId").distinct(), "paperId", "left_semi"), encoder)
        sides = encode(sides, encoder, ("query_vectors",))
    asked = pairs.select("query_id", "paperId").join(sides, "query_id").join(known, "paperId")
    schema = StructType([asked.schema["query_id"], asked.schema["paperId"], *StructType.fromDDL("score double").fields])
    return asked.select("query_id", "paperId", "query_vectors", "vectors").mapInArrow(_pair_scores(kind, temperature, decimals), schema)


def best_chunks(
    hits: DataFrame, chunks: DataFrame, queries: DataFrame, per_paper: int = 1, first_sub_query_only: bool = False
) -> DataFrame:
    """The ``per_paper`` best chunks of every hit, by the best sub-query or the first one only."""
    subs = queries.where(F.col("qi") == 0) if first_sub_query_only else queries
    wanted = subs.select("query_id", F.col("embedding").alias("q"))
    pairs = hits.select("query_id", "paperId").join(wanted, "query_id").join(chunks, "paperId")
    sims = pairs.groupBy("query_id", "paperId", "chunk_idx").agg(
        F.round(F.max(V.cosine(F.col("q"), F.col("embedding"))), DECIMALS).alias("similarity")
    )
    best = Window.partitionBy("query_id", "paperId").orderBy(F.desc("similarity"), "chunk_idx")
    return sims.withColumn("chunk_rank", F.row_number().over(best)).where(F.col("chunk_rank") <= per_paper)


def attach_best_chunks(hits: DataFrame, chunk_hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with ``best_chunks``, the texts of their best chunks in rank order."""
    with_text = chunk_hits.join(texts, ["paperId", "chunk_idx"])
    lists = with_text.groupBy("query_id", "paperId").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("chunk_rank", "text"))), lambda c: c["text"]
        ).alias("best_chunks")
    )
    return hits.join(lists, ["query_id", "paperId"], "left")


def keep_empty_queries(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds one marker row (null paperId) for every query without a hit."""
    return queries.select("query_id").distinct().join(hits, "query_id", "left")


def page(ranked: DataFrame, rank: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset + 1 .. offset + limit`` of each ranking."""
    return ranked.where(F.col(rank).between(offset + 1, offset + limit))


def mean_vector(chunks: DataFrame, keys: Sequence[str] = ("paperId",), weight: str | None = None) -> DataFrame:
    """The (weighted) mean vector of each group, as (keys, embedding): one running mean per group and task
    is shuffled, never the vectors. The mean of a group without weight is NaN at every place."""
    vector = array_to_vector(V.as_doubles(F.col("embedding")))
    if weight is None:
        means = chunks.groupBy(*keys).agg(Summarizer.mean(vector).alias("_m"))
        return means.select(*keys, vector_to_array("_m").alias("embedding"))
    # a Summarizer fails on a group without weight, so that such groups go beside it
    weighed = chunks.withColumn("_w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    means = weighed.where("_w <> 0").groupBy(*keys).agg(Summarizer.mean(vector, F.col("_w")).alias("_m"))
    sizes = weighed.groupBy(*keys).agg(F.max(F.abs("_w")).alias("_most"), F.max(F.size("embedding")).alias("_size")).where("_most = 0")
    nothing = F.array_repeat(F.lit(float("nan")), F.col("_size")).alias("embedding")
    return means.select(*keys, vector_to_array("_m").alias("embedding")).unionByName(sizes.select(*keys, nothing))


def centre_vectors(chunks: DataFrame) -> DataFrame:
    """Vectors minus the corpus mean, then L2-normalised. The mean is one row of vector width."""
    mean = mean_vector(chunks, ()).scalar()
    shifted = F.zip_with(V.as_doubles(F.col("embedding")), F.col("_mean"), lambda x, m: x - m)
    return chunks.withColumn("_mean", mean).withColumn("embedding", V.unit(shifted)).drop("_mean")


def question_scores(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """Mean cosine of each question with the pooled vector of each paper of its task.

    The mean of cosines is the dot product with the mean unit vector, so a task's papers
    shrink to one vector before they meet its questions and no pair is formed.
    """
    units = papers.select("task_id", V.unit(F.col("embedding")).alias("embedding"))
    centre = mean_vector(units, ("task_id",)).withColumnRenamed("embedding", "centre")
    asked = questions.join(centre, "task_id")
    return asked.select(
        "task_id", "question", F.round(V.dot(V.unit(F.col("embedding")), F.col("centre")), DECIMALS).alias("score")
    )
