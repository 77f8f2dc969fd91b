"""Learning-data and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import vectors as V
from paperloom.operators import embed as E
from paperloom.operators import encoder
from paperloom.operators import learn as L
from paperloom.operators import search as S
from paperloom.operators.chunks import chunk_papers, with_role_prefix
from paperloom.plans import fixtures as X
from paperloom.plans.registry import query
from paperloom.session import new_folder, read_table, spread


def _rank(paper, ref):
    """A rank that SQL can repeat: from the two ids' numbers."""
    number = lambda c: F.substring(c, F.lit(2), F.length(c)).cast("bigint")
    return (number(paper) * 7919 + number(ref) * 31 + 17) % 50


_PAIRS = X.with_ctes(X.CHUNK_VECTORS, X.PAPERS_META) + """,
ed AS (SELECT DISTINCT doc_id, "paperId", r AS ref, "publicationDate" FROM (
         SELECT doc_id, "paperId", "publicationDate", unnest(['d' || (doc_id * 3 % m), 'd' || ((doc_id * 5 + 1) % m), 'd' || ((doc_id + 7) % m)]) AS r
         FROM pm, (SELECT count(DISTINCT "paperId") AS m FROM v)) WHERE r IN (SELECT "paperId" FROM pm)),
pr AS (SELECT *, (doc_id * 7919 + CAST(substr(ref, 2) AS BIGINT) * 31 + 17) % 50 AS k,
              strftime(CAST("publicationDate" AS DATE) - INTERVAL 1 MONTH, '%Y-%m-%d') AS before
       FROM ed WHERE "paperId" IN (SELECT "paperId" FROM v) AND ref IN (SELECT "paperId" FROM v)),
sim AS (SELECT ref, cand, round(sum(s), 6) AS score FROM (
          SELECT a."paperId" AS ref, a.chunk_idx, b."paperId" AS cand, max(list_cosine_similarity(a.e, b.e)) AS s
          FROM v a, v b WHERE a."paperId" IN (SELECT ref FROM pr) GROUP BY ALL) GROUP BY ref, cand),
rk AS (SELECT pr."paperId", pr.ref, pr.k, cand, row_number() OVER (PARTITION BY pr."paperId", pr.ref ORDER BY score DESC, cand) AS n
       FROM pr JOIN sim USING (ref) JOIN pm ON pm."paperId" = cand
       WHERE pm."publicationDate" < pr.before AND cand <> pr."paperId"
         AND NOT EXISTS (SELECT 1 FROM ed x WHERE x."paperId" = pr."paperId" AND x.ref = cand)),
tr AS (SELECT "paperId" AS query_id, ref AS positive_id, cand AS negative_id FROM rk WHERE n = k + 1)"""


def _citing(spark, sf):
    """Papers that cite only papers with vectors."""
    m = X.row_count(X.chunk_vectors(spark, sf).select("paperId").distinct())
    i, meta = F.col("doc_id"), X.papers_meta(spark, sf).withColumn("m", m)
    cited = [F.concat(F.lit("d"), (n % F.col("m")).cast("string")) for n in (i * 3, i * 5 + 1, i + 7)]
    return meta.withColumn("referenceIds", F.concat_ws(";", *cited)).drop("m")


def _triplets(spark, sf, innovation=False):
    papers = S.pack_vectors(X.chunk_vectors(spark, sf))
    return L.mine_triplets(_citing(spark, sf), papers, _rank, months_before=1, for_innovation=innovation)


@query("triplet_mining", _PAIRS + "SELECT * FROM tr")
def triplet_mining(spark, sf):
    return _triplets(spark, sf)


@query("triplet_mining_indexed", _PAIRS + "SELECT * FROM tr")
def triplet_mining_indexed(spark, sf):
    """The same triplets through a stored index whose cells are cut by year."""
    papers, citing = S.pack_vectors(X.chunk_vectors(spark, sf)), _citing(spark, sf)
    index = L.mining_index(citing, papers, new_folder(spark, "index"))
    return L.mine_triplets(citing, papers, _rank, months_before=1, index=index)


@query("triplet_mining_innovation", _PAIRS + "SELECT positive_id AS query_id, query_id AS positive_id, negative_id FROM tr")
def triplet_mining_innovation(spark, sf):
    return _triplets(spark, sf, innovation=True)


_SCORES = """,
sc AS (SELECT t.query_id, t.positive_id, t.negative_id, p.side, a.chunk_idx, max(list_cosine_similarity(a.e, b.e)) AS s,
              list(list_cosine_similarity(a.e, b.e) / 0.05) AS l
       FROM tr t, (VALUES ('p'), ('n')) p(side), v a, v b
       WHERE a."paperId" = t.query_id AND b."paperId" = CASE p.side WHEN 'p' THEN t.positive_id ELSE t.negative_id END GROUP BY ALL),
ss AS (SELECT query_id, positive_id, negative_id, side, sum(s) AS hard,
              avg(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))))) AS soft FROM sc GROUP BY ALL),
sw AS (SELECT p.query_id, p.positive_id, p.negative_id, round(p.hard, 6) AS positive_score, round(n.hard, 6) AS negative_score,
              round(ln(1 + exp(n.soft - p.soft)), 6) AS loss
       FROM ss p JOIN ss n USING (query_id, positive_id, negative_id) WHERE p.side = 'p' AND n.side = 'n')"""


def _scored(spark, sf):
    papers = S.pack_vectors(X.chunk_vectors(spark, sf))
    return L.score_triplets(L.triplet_features(_triplets(spark, sf), papers), temperature=0.05)


@query("triplet_scores", _PAIRS + _SCORES + "SELECT * FROM sw")
def triplet_scores(spark, sf):
    return _scored(spark, sf)


@query("triplet_metrics_encoder")
def triplet_metrics_encoder(spark, sf):
    """The evaluation of a model: triplets encoded with its weights, their scores, losses and metrics."""
    papers = S.pack_vectors(X.chunk_vectors(spark, sf))
    features = L.triplet_features(_triplets(spark, sf), papers)
    return L.evaluate(features, encoder.seeded(64, seed=3), temperature=0.05)


@query(
    "triplet_metrics",
    _PAIRS + _SCORES + """SELECT count(*) AS triplets, round(avg(CASE WHEN positive_score > negative_score THEN 1 ELSE 0 END), 6) AS accuracy,
  round(avg(positive_score - negative_score), 6) AS margin, round(avg(loss), 6) AS loss FROM sw""",
)
def triplet_metrics(spark, sf):
    return L.triplet_metrics(_scored(spark, sf))


@query(
    "triplet_features_innovation",
    _PAIRS + """SELECT positive_id AS query_id, query_id AS positive_id, negative_id, (SELECT count(*) FROM v WHERE "paperId" = positive_id) AS query_vectors, 1 AS positive_vectors, 1 AS negative_vectors FROM tr""",
)
def triplet_features_innovation(spark, sf):
    papers = S.pack_vectors(X.chunk_vectors(spark, sf))
    f = L.triplet_features(_triplets(spark, sf, innovation=True), papers, first_only=True)
    sizes = [F.size(f"{r}_vectors").cast("bigint").alias(f"{r}_vectors") for r in ("query", "positive", "negative")]
    return f.select("query_id", "positive_id", "negative_id", *sizes)


@query(
    "cosine_losses",
    X.with_ctes(X.CHUNK_VECTORS) + """, d AS (SELECT 1 - list_cosine_similarity(a.e, b.e) AS d FROM v a JOIN v b ON a."paperId" = b."paperId" AND b.chunk_idx = 0)
SELECT round(avg(d), 6) AS cosine_loss, round(avg(greatest(d, 0.2)), 6) AS margin_loss FROM d""",
)
def cosine_losses(spark, sf):
    v = X.chunk_vectors(spark, sf)
    first = v.where(F.col("chunk_idx") == 0).select("paperId", F.col("embedding").alias("target"))
    return L.cosine_losses(v.select("paperId", F.col("embedding").alias("predicted")).join(first, "paperId"))


@query(
    "seeded_split",
    X.with_ctes(X.PAPERS_META) + """SELECT ('0x' || substr(md5("paperId" || ':123'), 1, 8))::BIGINT % 100 < 20 AS test, count(*) AS n FROM pm GROUP BY 1""",
)
def seeded_split(spark, sf):
    """Share of triplet-style rows on each side of the hash split."""
    ids = L.split_rows(X.papers_meta(spark, sf).select("paperId"), "paperId")
    return ids.groupBy("test").agg(F.count(F.lit(1)).alias("n"))


def _runs(spark, sf):
    k = F.col("n_nationkey").cast("bigint")
    status = F.element_at(F.array(F.lit("Staging"), F.lit("production"), F.lit("archived")), (k % 3 + 1).cast("int"))
    return read_table(spark, sf, "nation").select(
        F.concat(F.lit("model "), F.col("n_regionkey").cast("string")).alias("name"),
        k.alias("version"),
        status.alias("status"),
        F.when(k % 4 > 0, k * 37 % 100 / 100).alias("margin"),
        (k * 11 % 25).alias("start_time"),
    )


_RUNS = """WITH r AS (SELECT 'model ' || n_regionkey AS name, CAST(n_nationkey AS BIGINT) AS version, list_extract(['Staging', 'production', 'archived'], n_nationkey % 3 + 1) AS status,
  CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey * 37 % 100 / 100.0 END AS margin, n_nationkey * 11 % 25 AS start_time FROM nation)"""


@query(
    "best_version",
    _RUNS + """, b AS (SELECT name, arg_max(version, margin * 1000 - version / 1000.0) AS best FROM r WHERE status <> 'archived' AND margin IS NOT NULL GROUP BY name)
SELECT name, version, CASE WHEN version = best THEN 'production' WHEN status = 'production' AND margin IS NOT NULL THEN NULL ELSE status END AS status FROM r LEFT JOIN b USING (name)""",
)
def best_version(spark, sf):
    return L.promote_best(_runs(spark, sf), "margin").select("name", "version", "status")


@query(
    "retained_runs",
    _RUNS + """, k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY margin DESC NULLS LAST, version) AS a, row_number() OVER (PARTITION BY name ORDER BY start_time DESC, version DESC) AS z FROM r)
SELECT name, version FROM k WHERE (a <= 2 AND margin IS NOT NULL) OR z = 1""",
)
def retained_runs(spark, sf):
    return L.keep_top_runs(_runs(spark, sf), "margin", k=2).select("name", "version")


def _scored_feedback(spark, sf):
    """Every labelled paper with scores from its text."""
    text = X.papers_text(spark, sf).select("paperId", "main_text", "title")
    share = lambda c, part: F.regexp_count(c, F.lit(part)) / (F.length(c) + 1)
    return text.join(X.feedback(spark, sf), "paperId").select(
        F.concat(F.lit("u/"), (F.substring("paperId", 2, 9).cast("long") % 5 % 4).cast("string")).alias("task_id"),
        "paperId",
        "user_score",
        share(F.col("main_text"), "e").alias("retrieval_score"),
        share(F.col("title"), "[aeiou]").alias("rerank_score"),
    )


@query(
    "blend_scores",
    X.with_ctes(X.FEEDBACK) + """,
t AS (SELECT 'u/' || (CAST(substr("paperId", 2) AS BIGINT) % 5 % 4) AS task_id, count(*) AS papers, count(user_score) AS labels,
             count_if(user_score > 0) AS good FROM fb GROUP BY 1)
SELECT task_id, papers, CASE WHEN labels >= 40 AND good > 0 AND good < labels THEN 'fitted' ELSE 'rerank' END AS scorer, 0.0::DOUBLE AS residual, 0::BIGINT AS outside FROM t""",
)
def blend_scores(spark, sf):
    """One scorer per notebook: which one it is, how far its fit is from the optimum, and scores outside 0 to 1."""
    scored = _scored_feedback(spark, sf)
    weights = L.fit_blend_by_task(scored, min_labels=40)
    left = L.blend_residuals(scored, weights).select("task_id", "residual")
    out = L.blend_by_task(scored, weights).groupBy("task_id", "scorer").agg(
        F.count("*").alias("papers"), F.count_if(~F.col("blended_score").between(0, 1)).alias("outside")
    )
    residual = F.round(F.coalesce("residual", F.lit(0.0)), 6) + 0.0
    return out.join(left, "task_id", "left").select("task_id", "papers", "scorer", residual.alias("residual"), "outside")


@query("benchmark_nearest")
def benchmark_nearest(spark, sf):
    """The five nearest documents of every benchmark text, over hashed word vectors of their chunks."""
    encoder = E.hashed_words()
    docs = spread(read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("main_text")))
    chunks = chunk_papers(docs).select(
        F.col("doc_id").cast("string").alias("paperId"), "chunk_idx", with_role_prefix(F.col("text"), "e5", "document").alias("text")
    )
    papers = S.pack_vectors(E.embed_texts(chunks, "text", encoder))
    items = read_table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.lit(0).alias("qi"),
        F.lit(5).alias("topK"),
        with_role_prefix(F.col("text"), "e5", "query").alias("text"),
    )
    hits = S.top_k(papers, E.embed_texts(items, "text", encoder))
    return hits.select("query_id", "paperId", "retrieval_score", F.col("retrieval_rank").alias("rank"))


@query(
    "density_outliers",
    """WITH p AS (SELECT c_custkey AS id, c_acctbal / 10 AS x, c_nationkey * 40.0 AS y FROM customer),
n AS (SELECT a.id, count(*) >= 8 AS core FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4900.0 GROUP BY a.id),
c AS (SELECT p.* FROM p JOIN n USING (id) WHERE core)
SELECT n.id, n.core, NOT n.core AND NOT EXISTS (SELECT 1 FROM c JOIN p q ON q.id = n.id WHERE (c.x - q.x) ** 2 + (c.y - q.y) ** 2 <= 4900.0) AS outlier FROM n""",
)
def density_outliers(spark, sf):
    """Customers as points of balance and nation."""
    points = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_nationkey") * 40.0).alias("y")
    )
    return L.density_labels(points, eps=70.0, min_samples=8).select("id", "core", "outlier")


@query("vector_plane_outliers")
def vector_plane_outliers(spark, sf):
    """Chunk vectors on their first two principal components, outliers marked."""
    v = X.chunk_vectors(spark, sf).withColumn("id", F.concat_ws("_", "paperId", F.col("chunk_idx").cast("string")))
    points = L.plane_points(v, "id")
    return L.density_labels(points, eps=0.05, min_samples=25).select("id", "core", "outlier")


@query(
    "pair_losses",
    X.with_ctes(X.CHUNK_VECTORS) + """SELECT a."paperId", a.chunk_idx, round(ln(1 + exp(list_inner_product(a.e, c.e) - list_inner_product(a.e, b.e))), 6) AS loss
FROM v a JOIN v b ON a."paperId" = b."paperId" AND b.chunk_idx = 0 JOIN v c ON a."paperId" = c."paperId" AND c.chunk_idx = 4""",
)
def pair_losses(spark, sf):
    v = X.chunk_vectors(spark, sf)
    at = lambda k, name: v.where(F.col("chunk_idx") == k).select("paperId", F.col("embedding").alias(name))
    rows = v.join(at(0, "pos"), "paperId").join(at(4, "neg"), "paperId")
    loss = L.pair_loss(V.dot(F.col("embedding"), F.col("pos")), V.dot(F.col("embedding"), F.col("neg")))
    return rows.select("paperId", "chunk_idx", F.round(loss, 6).alias("loss"))
