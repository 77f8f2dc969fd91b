"""Training data, ranker evaluation and run selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions import vectors as V
from paperloom.functions.rows import hold
from paperloom.functions.matrices import vector_matrix, vectors_column
from paperloom.operators import cells as C
from paperloom.operators.encoder import Weights, encode
from paperloom.operators.filters import FILTERS, filter_row
from paperloom.session import new_folder, stored

DECIMALS = 6
# Negatives are drawn from this many nearest papers of the cited one.
NEAR_RANKS = 50
# Citing papers of one cited paper in one query row, and cited papers in one query block.
PAIRS_PER_ROW, CITED_PER_BLOCK = 1000, 512
MIN_LABELS = 30


def citation_edges(meta: DataFrame) -> DataFrame:
    """Distinct (paperId, refId) edges whose target is a paper of the corpus."""
    edges = meta.select("paperId", F.explode(F.split("referenceIds", ";")).alias("refId")).where(F.col("refId") != "")
    corpus = meta.select(F.col("paperId").alias("refId"))
    # A cited paper may hold a third of all edges; AQE splits such join partitions.
    return edges.join(corpus, "refId", "left_semi").distinct().select("paperId", "refId")


def seeded_rank(paper: Column, ref: Column, seed: int, ranks: int = NEAR_RANKS) -> Column:
    """A reproducible 0-based rank per pair."""
    return F.pmod(F.xxhash64(paper, ref, F.lit(seed)), F.lit(ranks)).cast("int")


def _mining_rows(
    meta: DataFrame, edges: DataFrame, papers: DataFrame, rank: Callable[[Column, Column], Column], months_before: int
) -> tuple[DataFrame, DataFrame]:
    """Query rows of the cited papers, with a cut for each paper that cites them, and the pairs (name, paperId, refId, rank, cites).

    A pair keeps as many papers as its rank and all that it cites could need. The pairs of a paper
    cited very often are dealt to several rows.
    """
    has_date = F.col("publicationDate").isNotNull() & (F.col("publicationDate") != "None")
    dated = meta.select("paperId", "publicationDate").where(has_date)
    limit = F.date_format(F.add_months(F.to_date("publicationDate"), -months_before), "yyyy-MM-dd")
    known = papers.select("paperId", "vectors").where(F.size("vectors") > 0)
    pairs = (
        edges.join(known.select("paperId"), "paperId", "left_semi")
        .join(known.select(F.col("paperId").alias("refId")), "refId", "left_semi")
        .join(dated, "paperId")
        .join(edges.groupBy("paperId").agg(F.count("*").alias("cites")), "paperId")
    )
    spread = pairs.groupBy("refId").agg(F.ceil(F.count("*") / PAIRS_PER_ROW).alias("parts"))
    drawn = rank(F.col("paperId"), F.col("refId"))
    named = pairs.join(spread, "refId").select(
        F.to_json(F.array("paperId", "refId")).alias("name"), "paperId", "refId", drawn.alias("rank"), "cites", limit.alias("before"),
        F.pmod(F.xxhash64("paperId"), "parts").alias("part"),
    )
    earlier = F.array(filter_row("publicationDate", "lt", F.array("before"))).cast(FILTERS)
    named = stored(named, "pairs")
    cut = F.struct("name", (F.col("rank") + F.col("cites") + 2).cast("long").alias("keep"), earlier.alias("filters"), F.lit(None).cast("int").alias("topK")).cast(C.CUT)
    cuts = named.groupBy("refId", "part").agg(F.collect_list(cut).alias("cuts"))
    rows = cuts.join(known.withColumnRenamed("paperId", "refId"), "refId").select(
        F.to_json(F.array("refId", F.col("part").cast("string"))).alias("query_id"), "vectors", "cuts"
    )
    return rows, named.select("name", "paperId", "refId", "rank", "cites")


def mining_papers(meta: DataFrame, papers: DataFrame) -> DataFrame:
    """The dated papers among which negatives are looked for: paperId, vectors, publicationDate."""
    has_date = F.col("publicationDate").isNotNull() & (F.col("publicationDate") != "None")
    dated = meta.where(has_date).select("paperId", "publicationDate")
    return papers.select("paperId", "vectors").where(F.size("vectors") > 0).join(dated, "paperId")


def mining_index(meta: DataFrame, papers: DataFrame, root: str, cells: int | None = None) -> C.CellIndex:
    """An index of the dated papers, its cells cut by year, so that pairs visit cells with earlier papers only."""
    year = F.year(F.to_date("publicationDate"))
    return C.build(mining_papers(meta, papers), root, ("publicationDate",), cells, by=year)


def mine_triplets(
    meta: DataFrame,
    papers: DataFrame,
    rank: Callable[[Column, Column], Column],
    months_before: int = 0,
    for_innovation: bool = False,
    index: C.CellIndex | None = None,
) -> DataFrame:
    """(query_id, positive_id, negative_id) rows from citations.

    For each citing paper and cited paper that both have vectors, the negative is the
    paper at a given rank among the nearest of the cited one that were published
    before the citing paper and that it does not cite. ``papers`` has paperId, vectors.

    A cited paper is one query whose pairs are cuts of its ranking: each reads what was published
    before its citing paper. With an index (``mining_index``) a pair visits only the cells of earlier
    years whose bound reaches its last kept paper; without one each block of papers meets each
    block of cited papers once. What a paper cites is taken out afterwards by a join.
    """
    edges = stored(citation_edges(meta), "edges")
    rows, pairs = _mining_rows(meta, edges, papers, rank, months_before)
    n_blocks = papers.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CITED_PER_BLOCK)).cast("int")).scalar()
    if index is None:
        hits = C.meet_all(mining_papers(meta, papers), rows, n_blocks, ("publicationDate",), rerank=False)
    else:
        hits, _ = C.search_cuts(index, rows, n_blocks)
    near = hits.select(F.col("query_id").alias("name"), F.col("paperId").alias("negative_id"), F.col("retrieval_score").alias("similarity")).join(pairs, "name")
    # each task gave its best; those of all tasks are cut where the join has dealt them already
    by_name = Window.partitionBy("name").orderBy(F.desc("similarity"), "negative_id")
    near = near.withColumn("_n", F.dense_rank().over(by_name)).where(F.col("_n") <= F.col("rank") + F.col("cites") + 2).drop("_n", "name", "cites")
    cites = edges.withColumnRenamed("refId", "negative_id")
    free = near.where("negative_id <> paperId").join(cites, ["paperId", "negative_id"], "left_anti")
    nearest = Window.partitionBy("paperId", "refId").orderBy(F.desc("similarity"), "negative_id")
    picked = free.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") == F.col("rank") + 1)
    query, positive = ("refId", "paperId") if for_innovation else ("paperId", "refId")
    return picked.select(F.col(query).alias("query_id"), F.col(positive).alias("positive_id"), "negative_id")


def triplet_features(triplets: DataFrame, papers: DataFrame, first_only: bool = False) -> DataFrame:
    """Triplets with the vectors of the three papers; the innovation model sees one vector of two of them."""
    out = triplets
    for role in ("query", "positive", "negative"):
        side = papers.select(F.col("paperId").alias(f"{role}_id"), F.col("vectors").alias(f"{role}_vectors"))
        if first_only and role != "query":
            side = side.withColumn(f"{role}_vectors", F.slice(f"{role}_vectors", 1, 1))
        out = out.join(side, f"{role}_id", "inner")
    return out


def split_share(ids: Column, seed: int = 123, test_percent: int = 20) -> Column:
    """True for rows of the test part: a hash split that depends on nothing but the row.

    The hash is one that other engines have too, so that they split alike.
    """
    return _split_hash(ids, seed) % 100 < test_percent


def _split_hash(ids: Column, seed: int) -> Column:
    name = F.md5(F.concat_ws(":", ids.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(name, 1, 8), 16, 10).cast("long")


def split_rows(df: DataFrame, key: str, seed: int = 123, test_percent: int = 20) -> DataFrame:
    """Adds ``test``: the hash split, or the row of the smallest hash where the split finds none."""
    shared = split_share(F.col(key), seed, test_percent)
    found = df.agg(F.max(shared)).scalar()
    least = df.agg(F.min(_split_hash(F.col(key), seed))).scalar()
    return df.withColumn("test", shared | (~F.coalesce(found, F.lit(False)) & (_split_hash(F.col(key), seed) == least)))


def pair_loss(positive: Column, negative: Column) -> Column:
    """Two-way cross entropy of choosing the positive."""
    return F.log1p(F.exp(negative - positive))


def score_triplets(features: DataFrame, temperature: float = 0.01) -> DataFrame:
    """Hard scores and the soft-score loss of each triplet."""
    roles = ("query", "positive", "negative")
    features = features.withColumns({f"_{r}": V.units(F.col(f"{r}_vectors")) for r in roles})
    q, p, n = (F.col(f"_{r}") for r in roles)
    soft = pair_loss(V.soft_max_sim(q, p, temperature), V.soft_max_sim(q, n, temperature))
    return features.select(
        "query_id",
        "positive_id",
        "negative_id",
        F.round(V.max_sim(q, p), DECIMALS).alias("positive_score"),
        F.round(V.max_sim(q, n), DECIMALS).alias("negative_score"),
        F.round(soft, DECIMALS).alias("loss"),
    )


def triplet_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, margin and mean loss over all triplets."""
    p, n = F.col("positive_score"), F.col("negative_score")
    return scored.agg(
        F.count(F.lit(1)).alias("triplets"),
        F.round(F.avg((p > n).cast("int")), DECIMALS).alias("accuracy"),
        F.round(F.avg(p - n), DECIMALS).alias("margin"),
        F.round(F.avg("loss"), DECIMALS).alias("loss"),
    )


def evaluate(features: DataFrame, weights: Weights, temperature: float = 0.01) -> DataFrame:
    """Metrics of a re-rank model on triplets with the vectors of their three papers."""
    encoded = encode(features, weights, ("query_vectors", "positive_vectors", "negative_vectors"))
    return triplet_metrics(score_triplets(encoded, temperature))


def cosine_losses(pairs: DataFrame, margin: float = 0.2) -> DataFrame:
    """Mean cosine loss and mean margin loss of (predicted, target) vectors."""
    cos = V.cosine(F.col("predicted"), F.col("target"))
    return pairs.select((1 - cos).alias("d")).agg(
        F.round(F.avg("d"), DECIMALS).alias("cosine_loss"),
        F.round(F.avg(F.greatest(F.col("d"), F.lit(margin))), DECIMALS).alias("margin_loss"),
    )


def attention_pool(papers: DataFrame, linear: np.ndarray, bias: np.ndarray, query: np.ndarray) -> DataFrame:
    """Softmax-weighted sum of a paper's vectors, weights by ``(W x + b) . q``, which is ``x . (q W) + b . q``."""
    direction, offset = (query @ linear).astype(float), float(bias @ query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            raw, counts = vector_matrix(batch.column("vectors"))
            filled = np.flatnonzero(counts)
            first = np.concatenate([[0], np.cumsum(counts[filled])[:-1]]).astype(int)
            scores = raw @ direction + offset
            spread = np.exp(scores - np.repeat(np.maximum.reduceat(scores, first), counts[filled]))
            weights = spread / np.repeat(np.add.reduceat(spread, first), counts[filled])
            pooled = np.add.reduceat(raw * weights[:, None], first, axis=0)
            ids = batch.column("paperId").take(pa.array(filled))
            yield pa.RecordBatch.from_arrays([ids, vectors_column(pooled)], names=["paperId", "embedding"])

    return papers.where(F.size("vectors") > 0).select("paperId", "vectors").mapInArrow(
        run, "paperId string, embedding array<double>"
    )


def fit_blend(scored: DataFrame):
    """Class-balanced logistic regression of feedback on (retrieval_score, rerank_score).

    Returns the fitted model, or None with fewer than 30 labels or a single class.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    labelled = scored.where(F.col("user_score").isNotNull()).withColumn("label", (F.col("user_score") > 0).cast("double"))
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    total = sum(counts.values())
    if total < MIN_LABELS or len(counts) < 2:
        return None
    weight = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, total / (len(counts) * c))])
    ready = VectorAssembler(inputCols=["retrieval_score", "rerank_score"], outputCol="features").transform(
        labelled.withColumn("weight", weight[F.col("label")])
    )
    return LogisticRegression(weightCol="weight", regParam=1.0 / total).fit(ready)


def blend(scored: DataFrame, model) -> DataFrame:
    """Adds blended_score: the model's probability, or the re-rank score without a model."""
    if model is None:
        return scored.withColumn("blended_score", F.col("rerank_score"))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=["retrieval_score", "rerank_score"], outputCol="features").transform(scored)
    out = model.transform(ready).withColumn("blended_score", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


_FEATURES = ("retrieval_score", "rerank_score")


def _blend_terms(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Labelled rows with inputs (1, x, y) standardised by task, probability and class-balanced weight."""
    rows = scored.where(F.col("user_score").isNotNull()).join(weights, "task_id")
    x = [F.lit(1.0), *[(F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in _FEATURES]]
    label = (F.col("user_score") > 0).cast("double")
    weight = F.col("n") / (2 * F.when(label > 0, F.col("good")).otherwise(F.col("n") - F.col("good")))
    rows = hold(rows, x0=x[0], x1=x[1], x2=x[2], label=label, w=weight)
    return rows.withColumn("p", 1 / (1 + F.exp(-(F.col("b0") * F.col("x0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2")))))


def _gradients() -> list[Column]:
    return [F.sum(F.col("w") * (F.col("p") - F.col("label")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(3)]


def fit_blend_by_task(scored: DataFrame, min_labels: int = MIN_LABELS, rounds: int = 12) -> DataFrame:
    """One class-balanced logistic regression of feedback on the two scores per task, as a table of weights.

    ``scored`` has task_id, user_score and the scores. Inputs are standardised by task, with a
    ridge of one label's weight. All tasks take each Newton step together, in one aggregate of sums;
    nothing but plans comes to the driver. Tasks under ``min_labels`` or of one class have no row.
    """
    labelled = scored.where(F.col("user_score").isNotNull())
    spread = [f(F.col(c)).alias(f"{n}_{c}") for c in _FEATURES for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    start = labelled.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("user_score") > 0).alias("good"), *spread)
    start = start.where((F.col("n") >= min_labels) & (F.col("good") > 0) & (F.col("good") < F.col("n")))
    start = start.withColumns({f"sd_{c}": F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(1.0) for c in _FEATURES})
    columns = [*start.columns, "b0", "b1", "b2"]
    weights = start.withColumns({f"b{i}": F.lit(0.0) for i in range(3)})
    folder = new_folder(scored.sparkSession, "blend")
    for turn in range(rounds + 1):
        weights.write.parquet(f"{folder}/{turn}")
        weights = scored.sparkSession.read.parquet(f"{folder}/{turn}")
        if turn == rounds:
            return weights
        curve = F.col("w") * F.col("p") * (1 - F.col("p"))
        sums = _gradients() + [F.sum(curve * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)]
        step = weights.join(_blend_terms(scored, weights).groupBy("task_id").agg(*sums), "task_id")
        weights = hold(step, s=_newton_step()).select(*columns[:-3], *[(F.col(f"b{i}") - F.col("s")[i]).alias(f"b{i}") for i in range(3)])


def _newton_step() -> Column:
    """H^-1 g of a symmetric 3 x 3 system with the ridge on both slopes, by cofactors."""
    h = {(i, j): F.col(f"h{min(i, j)}{max(i, j)}") + (1.0 if i == j and i else 0.0) for i in range(3) for j in range(3)}
    g = [F.col("g0"), *[F.col(f"g{i}") + F.col(f"b{i}") for i in (1, 2)]]

    def cofactor(i: int, j: int) -> Column:
        (a, b), (c, d) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return (h[a, c] * h[b, d] - h[a, d] * h[b, c]) * (-1) ** (i + j)

    det = sum((h[0, j] * cofactor(0, j) for j in range(1, 3)), h[0, 0] * cofactor(0, 0))
    return F.array(*[sum((cofactor(i, j) * g[j] for j in range(1, 3)), cofactor(i, 0) * g[0]) / det for i in range(3)])


def blend_residuals(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """(task_id, residual): the largest entry of the fitted objective's gradient, 0 at its optimum."""
    sums = _blend_terms(scored, weights).groupBy("task_id", "b1", "b2").agg(*_gradients())
    parts = [F.abs("g0"), F.abs(F.col("g1") + F.col("b1")), F.abs(F.col("g2") + F.col("b2"))]
    return sums.select("task_id", F.greatest(*parts).alias("residual"))


def blend_by_task(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds blended_score and ``scorer``: the task's fitted probability, or the re-rank score where none is fitted."""
    x = [(F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in _FEATURES]
    fitted = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * x[0] + F.col("b2") * x[1])))
    joined = scored.join(weights, "task_id", "left")
    return joined.select(
        *[joined[c] if c != "task_id" else F.col("task_id") for c in scored.columns],
        F.coalesce(fitted, "rerank_score").alias("blended_score"),
        F.when(F.col("b0").isNotNull(), "fitted").otherwise("rerank").alias("scorer"),
    )


def promote_best(runs: DataFrame, metric: str) -> DataFrame:
    """Best staging or production version becomes production; other production versions lose the tag."""
    tagged = F.lower("status").isin("staging", "production") & F.col(metric).isNotNull()
    best = runs.where(tagged).groupBy("name").agg(F.max_by("version", F.struct(metric, -F.col("version"))).alias("_best"))
    status = (
        F.when(F.col("version") == F.col("_best"), "production")
        .when(tagged & (F.lower("status") == "production"), F.lit(None).cast("string"))
        .otherwise(F.col("status"))
    )
    return runs.join(best, "name", "left").withColumn("status", status).drop("_best")


def keep_top_runs(runs: DataFrame, metric: str, k: int = 3) -> DataFrame:
    """Runs among the k best by metric, or the most recent one, of each model."""
    by_metric = Window.partitionBy("name").orderBy(F.desc_nulls_last(metric), "version")
    best = runs.where(F.col(metric).isNotNull()).withColumn("_r", F.row_number().over(by_metric)).where(F.col("_r") <= k)
    newest = runs.groupBy("name").agg(F.max_by("version", F.struct("start_time", "version")).alias("version"))
    keep = best.select("name", "version").union(newest.select("name", "version")).distinct()
    return runs.join(keep, ["name", "version"], "left_semi")


def density_labels(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Points (id, x, y) with ``core`` and ``outlier`` of density clustering, exact.

    The plane is cut into cells whose diagonal is ``eps``. All points of a cell with
    ``min_samples`` points are core without a distance test, however many there are.
    Only points of thinner cells are compared with their surroundings: any point meets
    at most 21 cells of fewer than ``min_samples`` such points, so the work is linear.
    """
    side = eps / 2**0.5
    celled = points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    sizes = celled.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("in_cell"))
    celled = celled.join(sizes, ["cx", "cy"])
    dense = F.col("in_cell") >= min_samples
    shifts = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
            for i in range(-2, 3)
            for j in range(-2, 3)
            if abs(i) + abs(j) < 4
        ]
    )

    def near(asking: DataFrame, others: DataFrame) -> DataFrame:
        a = asking.select("id", "x", "y", "cx", "cy", F.explode(shifts).alias("s")).select(
            "id", "x", "y", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy")
        )
        o = others.select(F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy")
        gap = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
        return a.join(o, ["cx", "cy"]).where(gap <= eps * eps)

    thin = celled.where(~dense)
    thin_core = near(thin, celled).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples)
    core_ids = thin_core.select("id").withColumn("_c", F.lit(True))
    marked = celled.join(core_ids, "id", "left").withColumn("core", dense | F.coalesce("_c", F.lit(False))).drop("_c")
    border = near(marked.where(~F.col("core")), marked.where("core")).select("id").distinct().withColumn("_b", F.lit(True))
    return marked.join(border, "id", "left").select(
        "id", "x", "y", "core", (~F.col("core") & F.col("_b").isNull()).alias("outlier")
    )


def plane_points(chunks: DataFrame, key: str) -> DataFrame:
    """The first two principal components of unit vectors, as (id, x, y)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    units = chunks.select(F.col(key).alias("id"), array_to_vector(V.unit(F.col("embedding"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(units)
    p = vector_to_array("p")
    return model.transform(units).select("id", p[0].alias("x"), p[1].alias("y"))
