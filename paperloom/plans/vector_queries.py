"""Search queries over the chunk vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import vectors as V
from paperloom.operators import cells as C
from paperloom.operators import encoder
from paperloom.operators import search as S
from paperloom.operators.filters import FILTERS, filter_row
from paperloom.plans import fixtures as X
from paperloom.plans.registry import query
from paperloom.session import new_folder

_BASE = X.with_ctes(X.CHUNK_VECTORS, X.LABEL_QUERIES)
_SCORED = _BASE + """,
best AS (SELECT query_id, "topK", qi, "paperId", any_value("publicationYear") AS "publicationYear",
                any_value("citationCount") AS "citationCount", max(list_cosine_similarity(qe, e)) AS s
         FROM q, v GROUP BY query_id, "topK", qi, "paperId"),
scored AS (SELECT query_id, "topK", "paperId", any_value("publicationYear") AS "publicationYear",
                  any_value("citationCount") AS "citationCount",
                  round(sum(s) / count(*), 6) AS retrieval_score
           FROM best GROUP BY query_id, "topK", "paperId")"""
_CENTRED = """,
vc AS (SELECT "paperId", list_transform(e, lambda x: x - list_avg(e)) AS e FROM v),
qc AS (SELECT query_id, qi, list_transform(qe, lambda x: x - list_avg(qe)) AS qe FROM q),
rr AS (SELECT query_id, "paperId", round(sum(s) / count(*), 6) AS rerank_score
       FROM (SELECT query_id, qi, "paperId", max(list_cosine_similarity(qe, e)) AS s FROM qc, vc
             GROUP BY query_id, qi, "paperId") GROUP BY query_id, "paperId")"""
_FILTER = '"publicationYear" >= 2017 AND "citationCount" < 90'


def _papers(spark, sf):
    return S.pack_vectors(X.chunk_vectors(spark, sf), payload=("publicationYear", "citationCount"))


def _positions(vectors, *keys):
    """One row per vector position."""
    keys = keys or ("paperId",)
    rows = vectors.select(*keys, F.posexplode("embedding").alias("pos", "value"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


def _filtered_queries(spark, sf):
    year = filter_row("publicationYear", "gte", F.array(F.lit(2015) + F.col("query_id").cast("int")))
    cited = filter_row("citationCount", "gte", F.array(10 * F.col("topK")))
    return X.label_queries(spark, sf).withColumn("filters", F.array(year, cited).cast(FILTERS))


def _payload_filter():
    return (F.col("publicationYear") >= 2017) & (F.col("citationCount") < 90)


@query(
    "search_filtered_rerank",
    _SCORED + _CENTRED + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rr0
           FROM scored WHERE {_FILTER}),
cut AS (SELECT query_id, "topK", "paperId", retrieval_score, rerank_score
        FROM ranked JOIN rr USING (query_id, "paperId") WHERE rr0 <= "topK")
SELECT query_id, "paperId", retrieval_score, rerank_score, rerank_score AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, "paperId") AS "rank"
FROM cut""",
)
def search_filtered_rerank(spark, sf):
    # The filter runs on chunk rows, below the packing shuffle.
    papers = S.pack_vectors(X.chunk_vectors(spark, sf).where(_payload_filter()))
    hits = S.top_k(papers, X.label_queries(spark, sf), factor=S.OVERFETCH, rerank=True)
    return S.rerank_and_sort(hits).select(
        "query_id", "paperId", "retrieval_score", "rerank_score", "score", "rank"
    )


@query(
    "search_topk_per_query",
    _SCORED + """
SELECT query_id, "paperId", retrieval_score, rn AS "rank"
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rn FROM scored)
WHERE rn <= "topK" """,
)
def search_topk_per_query(spark, sf):
    hits = S.top_k(S.pack_vectors(X.chunk_vectors(spark, sf)), X.label_queries(spark, sf))
    return hits.select("query_id", "paperId", "retrieval_score", F.col("retrieval_rank").alias("rank"))


@query(
    "search_filter_per_query",
    _SCORED + """
SELECT query_id, "paperId", retrieval_score, rn AS "rank"
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rn
      FROM scored WHERE "publicationYear" >= 2015 + CAST(query_id AS INT) AND "citationCount" >= 10 * "topK")
WHERE rn <= "topK" """,
)
def search_filter_per_query(spark, sf):
    """Each query has its own filter: a first year and a least citation count."""
    hits = S.top_k(_papers(spark, sf), _filtered_queries(spark, sf))
    return hits.select("query_id", "paperId", "retrieval_score", F.col("retrieval_rank").alias("rank"))


@query(
    "search_indexed_topk",
    _SCORED + """
SELECT query_id, "paperId", retrieval_score, rn AS "rank"
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rn FROM scored)
WHERE rn <= "topK" """,
)
def search_indexed_topk(spark, sf):
    """The answer of reading every paper, through a stored index of cells."""
    index = C.build(_papers(spark, sf), new_folder(spark, "index"))
    hits, _ = C.search(index, X.label_queries(spark, sf))
    return hits.select("query_id", "paperId", "retrieval_score", F.col("retrieval_rank").alias("rank"))


@query(
    "search_indexed_filters",
    _SCORED + """
SELECT query_id, "paperId", retrieval_score, rn AS "rank"
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rn
      FROM scored WHERE "publicationYear" >= 2015 + CAST(query_id AS INT) AND "citationCount" >= 10 * "topK")
WHERE rn <= "topK" """,
)
def search_indexed_filters(spark, sf):
    """Filters per query through the index: cells cut by year, left out where their values cannot pass."""
    index = C.build(_papers(spark, sf), new_folder(spark, "index"), ("publicationYear", "citationCount"), by=F.col("publicationYear"))
    hits, _ = C.search(index, _filtered_queries(spark, sf))
    return hits.select("query_id", "paperId", "retrieval_score", F.col("retrieval_rank").alias("rank"))


@query(
    "search_without_hits",
    _SCORED + """,
hits AS (SELECT query_id, "paperId", retrieval_score FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rn
           FROM scored WHERE "citationCount" >= 1000 OR CAST(query_id AS INT) % 2 = 0) WHERE rn <= "topK")
SELECT q0.query_id, h."paperId", h.retrieval_score
FROM (SELECT DISTINCT query_id FROM q) q0 LEFT JOIN hits h USING (query_id)""",
)
def search_without_hits(spark, sf):
    """Queries whose filter leaves nothing keep one marker row."""
    cited = filter_row("citationCount", "gte", F.array(F.lit(1000)))
    filters = F.when(F.col("query_id").cast("int") % 2 == 0, F.array()).otherwise(F.array(cited))
    queries = X.label_queries(spark, sf).withColumn("filters", filters.cast(FILTERS))
    hits = S.top_k(_papers(spark, sf), queries)
    return S.keep_empty_queries(hits.select("query_id", "paperId", "retrieval_score"), queries)


@query(
    "search_offset_page",
    _SCORED + """
SELECT query_id, "paperId", retrieval_score, rn AS "rank"
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rn FROM scored)
WHERE rn BETWEEN 3 AND 5""",
)
def search_offset_page(spark, sf):
    queries = X.label_queries(spark, sf).withColumn("topK", F.lit(5))
    hits = S.top_k(S.pack_vectors(X.chunk_vectors(spark, sf)), queries)
    return S.page(hits, "retrieval_rank", 2, 3).select(
        "query_id", "paperId", "retrieval_score", F.col("retrieval_rank").alias("rank")
    )


@query(
    "search_single_vector_topk",
    _BASE + """,
mq AS (SELECT query_id, list(m ORDER BY pos) AS qe FROM (
         SELECT query_id, pos, avg(x) AS m FROM (
           SELECT CAST(label AS VARCHAR) AS query_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v)
         GROUP BY query_id, pos) GROUP BY query_id)
SELECT query_id, vec_id, similarity, rn AS "rank" FROM (
  SELECT query_id, p * 5 + chunk_idx AS vec_id, round(list_cosine_similarity(qe, e), 6) AS similarity,
         row_number() OVER (PARTITION BY query_id
           ORDER BY round(list_cosine_similarity(qe, e), 6) DESC, CAST(p * 5 + chunk_idx AS VARCHAR)) AS rn
  FROM mq, v) WHERE rn <= 10""",
)
def search_single_vector_topk(spark, sf):
    """The ten nearest single vectors of each label's mean vector."""
    v = X.chunk_vectors(spark, sf)
    keyed = v.withColumn("query_id", F.col("label").cast("string"))
    queries = S.mean_vector(keyed, ("query_id",)).select(
        "query_id", F.lit(0).alias("qi"), "embedding", F.lit(10).alias("topK")
    )
    singles = v.select((F.col("p") * 5 + F.col("chunk_idx")).cast("string").alias("paperId"), F.array("embedding").alias("vectors"))
    hits = S.top_k(singles, queries)
    return hits.select(
        "query_id",
        F.col("paperId").cast("bigint").alias("vec_id"),
        F.col("retrieval_score").alias("similarity"),
        F.col("retrieval_rank").alias("rank"),
    )


_HITS = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS n FROM scored),
hit AS (SELECT query_id, "paperId" FROM ranked WHERE n <= 5 * "topK")"""


def _hit_scores(spark, sf, **how):
    """Scores of the over-fetched hits of every label's query."""
    papers, queries = S.pack_vectors(X.chunk_vectors(spark, sf)), X.label_queries(spark, sf)
    return S.score_pairs(S.top_k(papers, queries, factor=S.OVERFETCH), papers, queries, **how)


@query(
    "maxsim_scores",
    _SCORED + _HITS + 'SELECT query_id, "paperId", round(sum(s), 6) AS score FROM best SEMI JOIN hit USING (query_id, "paperId") GROUP BY query_id, "paperId"',
)
def maxsim_scores(spark, sf):
    return _hit_scores(spark, sf)


@query(
    "soft_maxsim_scores",
    _SCORED + _HITS + """,
c AS (SELECT query_id, qi, "paperId", list_cosine_similarity(qe, e) / 0.05 AS s FROM q, v),
t AS (SELECT query_id, qi, "paperId", max(s) AS top FROM c GROUP BY ALL),
l AS (SELECT query_id, qi, "paperId", any_value(top) + ln(sum(exp(s - top))) AS lse FROM c JOIN t USING (query_id, qi, "paperId")
      GROUP BY query_id, qi, "paperId")
SELECT query_id, "paperId", round(avg(lse), 6) AS score FROM l SEMI JOIN hit USING (query_id, "paperId") GROUP BY query_id, "paperId" """,
)
def soft_maxsim_scores(spark, sf):
    return _hit_scores(spark, sf, kind="soft", temperature=0.05)


@query(
    "rerank_scores",
    _SCORED + _CENTRED + _HITS + 'SELECT query_id, "paperId", round(sum(s), 6) AS score FROM (SELECT query_id, qi, "paperId", '
    'max(list_cosine_similarity(qe, e)) AS s FROM qc, vc GROUP BY query_id, qi, "paperId") SEMI JOIN hit USING (query_id, "paperId") GROUP BY query_id, "paperId"',
)
def rerank_scores(spark, sf):
    return _hit_scores(spark, sf, kind="centred")


@query(
    "rerank_scores_untrained_encoder",
    _SCORED + _CENTRED + _HITS + 'SELECT query_id, "paperId", round(sum(s), 6) AS score FROM (SELECT query_id, qi, "paperId", '
    'max(list_cosine_similarity(qe, e)) AS s FROM qc, vc GROUP BY query_id, qi, "paperId") SEMI JOIN hit USING (query_id, "paperId") GROUP BY query_id, "paperId"',
)
def rerank_scores_untrained_encoder(spark, sf):
    """The encoder with the weights a training starts from: all four heads and both layers run."""
    return _hit_scores(spark, sf, encoder=encoder.untrained(64))


@query("rerank_scores_encoder")
def rerank_scores_encoder(spark, sf):
    """The encoder with fixed drawn weights."""
    return _hit_scores(spark, sf, encoder=encoder.seeded(64, seed=3))


@query(
    "search_truncate_after_rerank",
    _SCORED + _CENTRED + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rr0 FROM scored),
cut AS (SELECT query_id, "topK", "paperId", retrieval_score, rerank_score,
               row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, "paperId") AS "rank"
        FROM ranked JOIN rr USING (query_id, "paperId") WHERE rr0 <= 5 * "topK")
SELECT query_id, "paperId", retrieval_score, rerank_score AS score, "rank" FROM cut WHERE "rank" <= "topK" """,
)
def search_truncate_after_rerank(spark, sf):
    papers = S.pack_vectors(X.chunk_vectors(spark, sf))
    hits = S.top_k(papers, X.label_queries(spark, sf), factor=S.OVERFETCH, rerank=True)
    return S.rerank_and_sort(hits, truncate="after").select("query_id", "paperId", "retrieval_score", "score", "rank")


@query(
    "best_chunks_per_paper",
    _SCORED + """,
hits AS (SELECT query_id, "paperId" FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rn FROM scored)
         WHERE rn <= "topK"),
cs AS (SELECT query_id, "paperId", chunk_idx, round(max(list_cosine_similarity(qe, e)), 6) AS similarity
       FROM hits JOIN q USING (query_id) JOIN v USING ("paperId") GROUP BY query_id, "paperId", chunk_idx)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "paperId" ORDER BY similarity DESC, chunk_idx) AS chunk_rank FROM cs)
WHERE chunk_rank <= 2""",
)
def best_chunks_per_paper(spark, sf):
    chunks, queries = X.chunk_vectors(spark, sf), X.label_queries(spark, sf)
    hits = S.top_k(S.pack_vectors(chunks), queries)
    return S.best_chunks(hits, chunks, queries, per_paper=2)


@query(
    "best_chunk_texts",
    _SCORED + ",\n" + X.PAPERS_TEXT + """,
hits AS (SELECT query_id, "paperId", rn AS "rank" FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS rn FROM scored)
         WHERE rn <= "topK"),
cs AS (SELECT query_id, "paperId", chunk_idx, round(list_cosine_similarity(qe, e), 6) AS similarity
       FROM hits JOIN q USING (query_id) JOIN v USING ("paperId") WHERE qi = 0),
top1 AS (SELECT query_id, "paperId", chunk_idx FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id, "paperId" ORDER BY similarity DESC, chunk_idx) AS r FROM cs) WHERE r = 1)
SELECT query_id, "paperId", "rank", chunk_idx || ': ' || title AS best_chunk
FROM hits JOIN top1 USING (query_id, "paperId") JOIN pt USING ("paperId")""",
)
def best_chunk_texts(spark, sf):
    """Hits with their best chunk's text, chosen by the first sub-query."""
    chunks, queries = X.chunk_vectors(spark, sf), X.label_queries(spark, sf)
    hits = S.top_k(S.pack_vectors(chunks), queries)
    best = S.best_chunks(hits, chunks, queries, per_paper=1, first_sub_query_only=True)
    texts = chunks.join(X.papers_text(spark, sf), "paperId").select(
        "paperId", "chunk_idx", F.concat(F.col("chunk_idx").cast("string"), F.lit(": "), "title").alias("text")
    )
    return S.attach_best_chunks(hits, best, texts).select(
        "query_id", "paperId", F.col("retrieval_rank").alias("rank"), F.col("best_chunks")[0].alias("best_chunk")
    )


@query(
    "paper_mean_vector",
    X.with_ctes(X.CHUNK_VECTORS) + """SELECT "paperId", pos, round(avg(x), 6) AS value FROM (
  SELECT "paperId", unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM v) GROUP BY "paperId", pos""",
)
def paper_mean_vector(spark, sf):
    return _positions(S.mean_vector(X.chunk_vectors(spark, sf)))


@query(
    "centroid_centering",
    X.with_ctes(X.CHUNK_VECTORS) + """,
mean AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM (
           SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY pos)),
c AS (SELECT "paperId", chunk_idx, list_transform(list_zip(e, m), lambda z: z[1] - z[2]) AS d FROM v, mean),
u AS (SELECT "paperId", chunk_idx, list_transform(d, lambda x: x / sqrt(list_inner_product(d, d))) AS u FROM c)
SELECT "paperId", chunk_idx, generate_subscripts(u, 1) - 1 AS pos, round(unnest(u), 6) AS value FROM u""",
)
def centroid_centering(spark, sf):
    return _positions(S.centre_vectors(X.chunk_vectors(spark, sf)), "paperId", "chunk_idx")


@query(
    "vector_primitives",
    X.with_ctes(X.CHUNK_VECTORS) + """
SELECT a."paperId", b.chunk_idx, round(list_inner_product(a.e, b.e), 6) AS dot,
       round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(sqrt(list_inner_product(b.e, b.e)), 6) AS norm
FROM v a JOIN v b USING ("paperId") WHERE a.chunk_idx = 0""",
)
def vector_primitives(spark, sf):
    """Dot product, cosine and norm of each chunk against the first chunk of its paper."""
    v = X.chunk_vectors(spark, sf)
    first = v.where(F.col("chunk_idx") == 0).select("paperId", F.col("embedding").alias("a"))
    pairs = v.join(first, "paperId")
    r = lambda c: F.round(c, 6)
    return pairs.select(
        "paperId",
        "chunk_idx",
        r(V.dot(F.col("a"), F.col("embedding"))).alias("dot"),
        r(V.cosine(F.col("a"), F.col("embedding"))).alias("cosine"),
        r(V.norm(F.col("embedding"))).alias("norm"),
    )


@query(
    "masked_mean_pooling",
    X.with_ctes(X.CHUNK_VECTORS) + """
SELECT "paperId", pos, round(sum(x * w) / sum(w), 6) AS value FROM (
  SELECT "paperId", CASE WHEN chunk_idx BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS w, unnest(e) AS x,
         generate_subscripts(e, 1) - 1 AS pos FROM v) GROUP BY "paperId", pos""",
)
def masked_mean_pooling(spark, sf):
    """Chunk vectors as token vectors, positions 1 to 3 as the core span."""
    from paperloom.operators.embed import masked_mean

    v = X.chunk_vectors(spark, sf).withColumn("mask", F.col("chunk_idx").between(1, 3).cast("int"))
    return _positions(masked_mean(v, "paperId", "mask"))


@query(
    "question_scores",
    X.with_ctes(X.CHUNK_VECTORS) + """,
pv AS (SELECT "paperId", p % 7 AS t, list(m ORDER BY pos) AS pe FROM (
         SELECT "paperId", p, pos, avg(x) AS m FROM (SELECT "paperId", p, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v)
         GROUP BY "paperId", p, pos) GROUP BY "paperId", p),
qs AS (SELECT label % 7 AS t, CAST(label AS VARCHAR) AS question, list(m ORDER BY pos) AS qe FROM (
         SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v)
         GROUP BY label, pos) GROUP BY label)
SELECT CAST(t AS VARCHAR) AS task_id, question, round(avg(list_cosine_similarity(qe, pe)), 6) AS score
FROM qs JOIN pv USING (t) GROUP BY t, question""",
)
def question_scores(spark, sf):
    """Labels as open questions, papers spread over seven notebooks."""
    v = X.chunk_vectors(spark, sf).withColumn("question", F.col("label").cast("string"))
    task = lambda c: (c % 7).cast("string").alias("task_id")
    papers = S.mean_vector(v, ("paperId", "p")).select(task(F.col("p")), "embedding")
    questions = S.mean_vector(v, ("question",)).select(
        task(F.col("question").cast("bigint")), "question", "embedding"
    )
    return S.question_scores(questions, papers)


@query(
    "attention_pooling",
    X.with_ctes(X.CHUNK_VECTORS) + """,
s AS (SELECT "paperId", chunk_idx, e, 0.5 + list_sum(list_transform(e, lambda x, i: x * (i % 3 - 1))) AS s FROM v),
w AS (SELECT "paperId", e, exp(s - max(s) OVER (PARTITION BY "paperId")) AS w FROM s)
SELECT "paperId", pos, round(sum(x * w) / sum(w), 6) AS value FROM (
  SELECT "paperId", w, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM w) GROUP BY "paperId", pos""",
)
def attention_pooling(spark, sf):
    """Softmax pooling with the identity as linear layer and a fixed query direction."""
    import numpy as np

    from paperloom.operators.learn import attention_pool

    papers = S.pack_vectors(X.chunk_vectors(spark, sf))
    width = 64
    direction = np.array([(i + 1) % 3 - 1 for i in range(width)], dtype=float)
    bias = 0.5 * direction / (direction @ direction)
    return _positions(attention_pool(papers, np.eye(width), bias, direction))
