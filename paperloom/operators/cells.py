"""Blocks of papers, blocks of queries, and an index of cells that says which of them must meet.

A block row holds some papers with their vectors and the payload that filters read; a query block
row holds some queries with their vectors, filters and how many papers each keeps. They meet by
equi joins of Spark, which broadcasts the query blocks while they are small and shuffles both sides
when they are not; a task scores one pair of blocks as one matrix product and returns each query's
best papers of the block. Nothing passes the driver, and the plan is the same for one query or many.

``build`` deals papers into cells: nearest of the centres that k-means finds in the papers' mean unit
vectors. The header keeps, per cell, the centre, the largest angle of any of its papers' vectors to
it, and the least and largest value of each number that filters read. The cosine of a query vector
with any vector of a cell is at most ``cos(angle to the centre - radius)``, so the mean over a query's
vectors bounds the score of every paper of the cell. A query first visits the cells of largest bound
that hold a few times the papers it keeps; the score of its last kept paper is then the floor, and of
the other cells it visits those whose bound reaches it and whose values its filters can meet. The
answer is that of reading every paper. On the first visit the few queries of a cell go to its papers;
on the second one papers go to shares of the query blocks, which a task holds while papers pass by.

Cells larger than ``PAPERS_PER_BLOCK`` are several blocks. The header is one row of at most
``CELLS_MAX`` cells. Papers without a vector other than zero are a cell of their own, with bound 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from paperloom.functions.matrices import centred_rows, listed, max_sim_matrix, starts_of, unit_rows, vector_matrix, vectors_column
from paperloom.operators.filters import DATE_FIELDS, FILTERS, RANGE_FIELDS, FilterTable, comparable, filter_payload, payload_mask
from paperloom.session import stored

DECIMALS = 6
PAPERS_PER_BLOCK = 1024
# Sub-query vectors in one query block, on average.
VECTORS_PER_BLOCK = 2048
PAPERS_PER_CELL = 128
CELLS_MAX = 4096
# A cell's number is that of its centre and that of its group.
GROUPS = 10_000
# Papers of the first visited cells, as a multiple of those that are kept.
FIRST = 4
# Query blocks stand in so many copies, so that a join by shuffle spreads the papers of one query block.
COPIES = 8
# Where all papers meet all queries, query blocks are dealt into so many shares at most: a paper is shuffled once for each.
SHARES = 32
# A second visit deals query blocks into so many shares, or more where a share would have more blocks than a task should hold.
LATE_SHARES, HELD_BLOCKS = 16, 64
# Queries of a cell in one row of the first visit, and cuts that are compared with a block of papers at once.
QUERIES_PER_ROW, CUTS_AT_ONCE = 512, 1024
# Cuts whose visits are packed into bits at once (a multiple of 8), and visited cells in one batch of the first visit.
BITS, CELLS_AT_ONCE = 4096, 16
# Hits that a task holds at most before it passes on the best of them.
HELD_HITS = 1 << 21
HITS = "query_id string, paperId string, retrieval_score double, rerank_score double, topK int"


def paper_blocks(papers: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """(cell, members): the papers (paperId, vectors, payload) of each Arrow batch, cut into blocks. Nothing is shuffled."""
    rows = papers.select("paperId", "vectors", *filter_payload(papers, [c for c in fields if c != "paperId"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAPERS_PER_BLOCK):
                part = batch.slice(at, PAPERS_PER_BLOCK)
                rows = pa.StructArray.from_arrays(part.columns, names=part.schema.names)
                block = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), block], names=["cell", "members"])

    schema = StructType([StructField("cell", IntegerType()), StructField("members", ArrayType(rows.schema))])
    return rows.mapInArrow(run, schema)


CUT = "struct<name:string,keep:bigint,filters:" + FILTERS + ",topK:int>"


def query_rows(queries: DataFrame, factor: int = 1, more: DataFrame | None = None, floors: DataFrame | None = None) -> DataFrame:
    """(query_id, vectors, cuts): the sub-queries of each query in order, and what is kept of its ranking.

    A cut is a named list of the ``keep`` best papers that pass some filters; a query has one cut of
    its own name here. Its hits carry ``topK``, so that they are ranked without the queries. ``more`` has (query_id, more): how many further papers a query must keep;
    ``floors`` has (query_id, floor): papers that score less are not wanted.
    """
    filters = F.first("filters") if "filters" in queries.columns else F.array().cast(FILTERS)
    subs = F.sort_array(F.collect_list(F.struct("qi", "embedding")))
    rows = queries.groupBy("query_id").agg(
        F.transform(subs, lambda s: s["embedding"].cast("array<double>")).alias("vectors"), F.first("topK").cast("long").alias("topK"), filters.alias("filters")
    )
    keep = F.col("topK") * factor
    if more is not None:
        rows, keep = rows.join(more, "query_id", "left"), keep + F.coalesce("more", F.lit(0))
    cut = F.struct(F.col("query_id").cast("string").alias("name"), keep.alias("keep"), "filters", "topK").cast(CUT)
    if floors is not None:
        rows, cut = rows.join(floors, "query_id", "left"), cut.withField("floor", F.col("floor").cast("double"))
    return rows.select("query_id", "vectors", F.array(cut).alias("cuts"))


def block_count(queries: DataFrame):
    """How many blocks the sub-queries make, as a scalar subquery."""
    return queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / VECTORS_PER_BLOCK)).cast("int")).scalar()


def query_blocks(rows: DataFrame, n_blocks) -> DataFrame:
    """(qblock, queries): query rows dealt into blocks, each block's queries in the order of their ids."""
    blocks = rows.withColumn("n_blocks", n_blocks).withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.col("n_blocks")).cast("int"))
    return blocks.groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct("query_id", "vectors", "cuts"))).alias("queries"))


def _top(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """The best ``keep`` of the rows, ties by id."""
    s = scores[rows]
    if len(rows) > keep > 0:
        rows = rows[s >= np.partition(s, -keep)[-keep]]
        s = scores[rows]
    return rows[np.lexsort((ids[rows], -s))[: max(0, keep)]]


def cut_rows(asked: pa.StructArray) -> tuple[pa.StructArray, np.ndarray]:
    """All cuts of some queries one after the other, and the query of each."""
    cuts = asked.field("cuts")
    return cuts.flatten(), np.repeat(np.arange(len(asked)), cuts.value_lengths().to_numpy())


def _hopeful(cuts: pa.StructArray, asked: pa.StructArray, of_query: np.ndarray, vectors: pa.Array) -> tuple[pa.StructArray, pa.StructArray, np.ndarray]:
    """The cuts whose floor a block may reach, by the bound of all its vectors as one cell, with their queries."""
    units = unit_rows(vector_matrix(vectors)[0])
    units = units[units.any(axis=1)]
    most = np.zeros(len(asked))
    sub, sizes = vector_matrix(asked.field("vectors"))
    if len(units) and units.shape[1] == sub.shape[1]:
        centre = unit_rows(units.mean(axis=0, keepdims=True))
        radius = np.arccos(np.clip(units @ centre.T, -1, 1)).max() if centre.any() else np.pi
        most = bounds(sub, sizes, centre, np.array([radius]))[:, 0]
    floors = np.array([-np.inf if f is None else f for f in cuts.field("floor").to_pylist()])
    at = np.flatnonzero(most[of_query] + 10.0**-DECIMALS >= floors)
    live, spot = np.unique(of_query[at], return_inverse=True)
    return cuts.take(pa.array(at)), asked.take(pa.array(live)), spot


class _Floors(dict):
    """By name, the score of the last paper that a task keeps of a cut whose list is full; ``turn`` says how often they rose."""

    turn = 0


def _kept(parts: list[pa.Table], keeps: dict[str, int], floors: _Floors | None = None) -> pa.Table:
    """Of some hits each cut's best ``keep`` papers, ties by id; further rows of a kept paper stay with it. Raises ``floors``."""
    hits = pa.concat_tables(parts).combine_chunks()
    names, ids = (hits.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "paperId"))
    wanted = np.array([keeps[n] for n in names.dictionary.to_pylist()], np.int64)
    place = np.argsort(np.argsort(ids.dictionary.to_numpy(zero_copy_only=False).astype(str)))
    name, paper = names.indices.to_numpy(), place[ids.indices.to_numpy()]
    score = hits.column("retrieval_score").to_numpy()
    order = np.lexsort((paper, -score, name))
    name, paper, score = name[order], paper[order], score[order]
    first = np.append(True, name[1:] != name[:-1])
    new = first | np.append(True, (paper[1:] != paper[:-1]) | (score[1:] != score[:-1]))
    nth = np.cumsum(new)
    nth -= np.repeat(nth[first], np.diff(np.append(np.flatnonzero(first), len(name)))) - 1
    if floors is not None:
        last = new & (nth == wanted[name])
        for n, least in zip(names.dictionary.take(pa.array(name[last])).to_pylist(), score[last].tolist()):
            floors[n] = max(least, floors.get(n, -np.inf))
        floors.turn += 1
    return hits.take(pa.array(order[nth <= wanted[name]]))


def _best_of_task(hits: Iterator[tuple[pa.RecordBatch, dict[str, int]]], floors: _Floors | None = None) -> Iterator[pa.RecordBatch]:
    """The hits of a task's blocks without those that others of the task push out of their cuts."""
    parts, keeps, held = [], {}, 0
    for batch, wanted in hits:
        parts.append(pa.Table.from_batches([batch]))
        for name, keep in wanted.items():
            keeps[name] = max(keep, keeps.get(name, 0))
        held += batch.num_rows
        if held > HELD_HITS:
            parts = [_kept(parts, keeps, floors)]
            held = parts[0].num_rows
            if held > HELD_HITS // 2:
                yield from parts[0].to_batches()
                parts, keeps, held = [], {}, 0
    if parts:
        yield from _kept(parts, keeps).to_batches()


def _scored(rerank: bool, decimals: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best_of_task(hits(batches))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, int]]]:
        for batch in batches:
            for row in range(batch.num_rows):
                members, asked = batch.column("members")[row].values, batch.column("queries")[row].values
                cuts, of_query = cut_rows(asked)
                payload = {f.name: members.field(i) for i, f in enumerate(members.type)}
                if "floor" in cuts.type.names:
                    cuts, asked, of_query = _hopeful(cuts, asked, of_query, payload["vectors"])
                    if not len(cuts):
                        continue
                ids = payload["paperId"].to_numpy(zero_copy_only=False).astype(str)
                raw, counts = vector_matrix(payload["vectors"])
                sub, sizes = vector_matrix(asked.field("vectors"))
                if raw.shape[1] not in (0, sub.shape[1]):
                    raise ValueError("query and paper vectors differ in width")
                starts = starts_of(sizes)
                ready = comparable(payload)
                scores = np.round(max_sim_matrix(unit_rows(sub), starts, unit_rows(raw), counts) / sizes[:, None], decimals)
                masks, picks = {}, []
                for i, keep, filters in zip(of_query, cuts.field("keep").to_pylist(), cuts.field("filters").to_pylist()):
                    key = repr(filters)
                    if key not in masks:
                        masks[key] = np.flatnonzero(payload_mask(filters, ready, len(ids)))
                    picks.append(_top(scores[i], masks[key], ids, keep))
                if "floor" in cuts.type.names:
                    floors = [-np.inf if f is None else f for f in cuts.field("floor").to_pylist()]
                    picks = [p[scores[i, p] >= f] for i, p, f in zip(of_query, picks, floors)]
                n = np.array([len(p) for p in picks], np.int64)
                if not n.sum():
                    continue
                at, of_cut = np.concatenate(picks), np.repeat(np.arange(len(picks)), n)
                of = of_query[of_cut]
                again = np.zeros(len(at))
                if rerank:
                    used = np.unique(at)
                    vectors = raw[np.isin(np.repeat(np.arange(len(counts)), counts), used)]
                    close = max_sim_matrix(centred_rows(sub), starts, centred_rows(vectors), counts[used]) / sizes[:, None]
                    again = np.round(close[of, np.searchsorted(used, at)], decimals)
                names = cuts.field("name").take(pa.array(of_cut))
                found = pa.RecordBatch.from_arrays(
                    [names, payload["paperId"].take(pa.array(at)), pa.array(scores[of, at]), pa.array(again), cuts.field("topK").take(pa.array(of_cut))],
                    names=["query_id", "paperId", "retrieval_score", "rerank_score", "topK"],
                )
                wanted = {}
                for name, keep in zip(cuts.field("name").to_pylist(), cuts.field("keep").to_pylist()):
                    wanted[name] = max(keep, wanted.get(name, 0))
                yield found, wanted

    return run


def meet(blocks: DataFrame, asked: DataFrame, rerank: bool, decimals: int = DECIMALS, on: str = "share") -> DataFrame:
    """The hits of blocks that carry the number of a query block or of a share (``on``) with its queries, under the names of their cuts."""
    copy = F.pmod(F.xxhash64(F.get("members", F.lit(0))["paperId"]), F.lit(COPIES)).cast("int")
    copies = asked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    # a task goes through its query blocks one by one and holds the papers' blocks beside them
    met = copies.join(blocks.withColumn("copy", copy), [on, "copy"])
    return met.select("members", "queries").mapInArrow(_scored(rerank, decimals), HITS)


def meet_all(papers: DataFrame, rows: DataFrame, n_blocks, fields: Sequence[str], rerank: bool, decimals: int = DECIMALS) -> DataFrame:
    """The hits of all papers with all query rows; a paper is shuffled ``SHARES`` times at most, however many the query blocks."""
    blocks = paper_blocks(papers, fields).withColumn("last", F.least(n_blocks, F.lit(SHARES)) - 1)
    each = blocks.select("members", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("share"))
    asked = query_blocks(rows, n_blocks).select((F.col("qblock") % SHARES).alias("share"), "queries")
    return meet(each, asked, rerank, decimals)


def best(hits: DataFrame, factor: int, excluded: DataFrame | None = None) -> DataFrame:
    """The ``factor * topK`` best hits of each query with their rank, without the (query_id, paperId) rows of ``excluded``."""
    if excluded is not None:
        hits = hits.join(excluded.select("query_id", "paperId"), ["query_id", "paperId"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("retrieval_score"), "paperId")
    ranked = hits.withColumn("retrieval_rank", F.row_number().over(order)).where(F.col("retrieval_rank") <= F.col("topK") * factor)
    return ranked.select("query_id", "paperId", "retrieval_score", "rerank_score", "retrieval_rank", "topK")


@dataclass(frozen=True)
class CellIndex:
    """A stored index: ``header`` is one row with all cells, ``blocks`` has (cell, part, members)."""

    header: DataFrame
    blocks: DataFrame


_CELL = "cell int, centre array<double>, radius double, n long, low array<double>, high array<double>"


def _mean_units(m: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The unit vector of the mean unit vector of each paper."""
    out = np.zeros((len(counts), m.shape[1]))
    np.add.at(out, np.repeat(np.arange(len(counts)), counts), unit_rows(m))
    return unit_rows(out)


def build(
    papers: DataFrame, root: str, fields: Sequence[str] = (), cells: int | None = None, by: Column | None = None, rounds: int = 5, seed: int = 7
) -> CellIndex:
    """Writes the index of papers (paperId, vectors, payload) below ``root`` and opens it.

    If not given, ``cells`` is the root of the number of papers, or as many as leave ``PAPERS_PER_CELL``
    papers in a cell, ``CELLS_MAX`` at most; the centres, as many vectors, are all that comes to the
    driver. ``by``, a small number such as a year, cuts each
    cell further, so that the values by which cells are left out lie close together in each.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = papers.sparkSession
    group = F.lit(0) if by is None else F.pmod(F.coalesce(by, F.lit(0)), F.lit(GROUPS))
    rows = papers.select("paperId", "vectors", *filter_payload(papers, [c for c in fields if c != "paperId"]), group.cast("int").alias("group"))
    rows = stored(rows, "papers")

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, counts = vector_matrix(batch.column("vectors"))
            mean = _mean_units(raw, counts)
            mean = mean[mean.any(axis=1)]
            if len(mean):
                yield pa.RecordBatch.from_arrays([vectors_column(mean)], names=["mean"])

    # k-means zips its points with their norms: a task computes them twice at once, and of two equal merge joins the first to end frees the other's sorter
    means = stored(rows.select("vectors").mapInArrow(middle, "mean array<double>"), "means")
    total = rows.agg(F.count("*").alias("n"), F.approx_count_distinct("group").alias("groups")).first()
    fit = min(math.isqrt(total["n"]), total["n"] // PAPERS_PER_CELL // max(1, total["groups"]))
    wanted = min(CELLS_MAX, cells or fit)
    points = means.select(array_to_vector("mean").alias("features"))
    centres = np.zeros((0, 0))
    if not points.isEmpty():
        model = KMeans(k=max(2, wanted), maxIter=rounds, initMode="random", seed=seed, distanceMeasure="cosine").fit(points)
        centres = unit_rows(np.array(model.clusterCenters()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each paper's cell, and the largest angle of its vectors to the cell's centre."""
        for batch in batches:
            raw, counts = vector_matrix(batch.column("vectors"))
            units = unit_rows(raw)
            mean = _mean_units(raw, counts)
            cell = (mean @ centres.T).argmax(axis=1) if mean.any() else np.zeros(len(counts), int)
            cell[~mean.any(axis=1)] = -1
            of = np.repeat(np.arange(len(counts)), counts)
            far = np.zeros(len(counts))
            live = (cell[of] >= 0) & units.any(axis=1)  # a zero vector's cosines are 0, which every bound allows
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", units[live], centres[cell[of[live]]]), -1, 1))
            np.maximum.at(far, of[live], angle)
            # papers whose vectors cancel out have no direction, but may be near anything
            lost = np.bincount(of, units.any(axis=1), len(counts)).astype(bool) & (cell < 0)
            far[lost] = np.pi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    numbers = [c for c in fields if c in RANGE_FIELDS + DATE_FIELDS and c in rows.columns]
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), *StructType.fromDDL("far double").fields])
    placed = rows.mapInArrow(place, schema).withColumn("cell", F.col("cell") * GROUPS + F.col("group")).drop("group")
    folder = f"{root}/placed"
    placed.write.mode("overwrite").parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    number = lambda c: F.unix_date(F.to_date(c)) if c in DATE_FIELDS else F.col(c)
    zone = lambda f: F.array(*[f(number(c)) for c in numbers]).cast("array<double>")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), zone(F.min).alias("low"), zone(F.max).alias("high"))
    parts = sizes.select("cell", F.ceil(F.col("n") / PAPERS_PER_BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("paperId"), "parts").cast("int")
    blocks = placed.join(parts, "cell").groupBy("cell", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "group"]))).alias("members"))
    blocks.write.mode("overwrite").parquet(f"{root}/blocks")
    centre_rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(-1, [0.0] * centres.shape[1])], "centre_id int, centre array<double>")
    header = sizes.join(centre_rows, F.floor(F.col("cell") / GROUPS) == F.col("centre_id")).select("cell", "centre", "radius", "n", "low", "high")
    one = header.agg(F.sort_array(F.collect_list(F.struct(*header.columns))).alias("cells")).withColumn("numbers", F.lit(numbers).cast("array<string>"))
    one.write.mode("overwrite").parquet(f"{root}/header")
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> CellIndex:
    return CellIndex(spark.read.parquet(f"{root}/header"), spark.read.parquet(f"{root}/blocks"))


def bounds(sub: np.ndarray, sizes: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest score any paper of a cell can have, for queries (rows of ``sub``, ``sizes`` each), shape (queries, cells)."""
    angle = np.arccos(np.clip(unit_rows(sub) @ centres.T, -1, 1))
    near = np.cos(np.maximum(angle - radius, 0))
    return np.add.reduceat(np.maximum(near, 0), starts_of(sizes)[:-1], axis=0) / sizes[:, None]


def _can_pass(filters: list[dict] | None, numbers: list[str], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which cells hold values that the range filters can meet; a cell of nulls only meets none."""
    ok = np.ones(len(low), bool)
    for f in filters or ():
        if f["field"] in numbers:
            k, value = numbers.index(f["field"]), f["values"][0]
            value = float(np.datetime64(value, "D").astype(int)) if f["field"] in DATE_FIELDS else float(value)
            op, lo, hi = f["op"], low[:, k], high[:, k]
            ok &= {"lt": lo < value, "lte": lo <= value, "gt": hi > value, "gte": hi >= value}.get(op, True)
    return ok


def _visits(first: bool) -> Callable:
    """The cells that the cuts of a block's queries visit: those of largest bound, or the others that reach the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked, cells = batch.column("queries")[row].values, batch.column("cells")[row].values
                if not len(cells):
                    continue
                numbers = batch.column("numbers")[row].as_py()
                centres = cells.field("centre").flatten().to_numpy().reshape(len(cells), -1)
                n, radius = (cells.field(c).to_numpy() for c in ("n", "radius"))
                low, high = (np.array(cells.field(c).to_pylist(), np.float64).reshape(len(cells), -1) for c in ("low", "high"))
                sub, sizes = vector_matrix(asked.field("vectors"))
                if centres.shape[1] not in (0, sub.shape[1]):
                    raise ValueError("query and paper vectors differ in width")
                most = bounds(sub, sizes, centres, radius) if centres.shape[1] else np.zeros((len(asked), len(cells)))
                cuts, of_query = cut_rows(asked)
                floors = [None] * len(cuts) if first else cuts.field("floor").to_pylist()
                asks = zip(of_query, cuts.field("keep").to_pylist(), cuts.field("filters").to_pylist(), floors)
                bits = []
                for at in range(0, len(cuts), BITS):
                    seen = np.zeros((min(BITS, len(cuts) - at), len(cells)), bool)
                    for mine, (i, keep, filters, floor) in zip(seen, asks):
                        order = np.argsort(-most[i], kind="stable")
                        order = order[_can_pass(filters, numbers, low[order], high[order])]
                        near = np.cumsum(n[order]) - n[order] < FIRST * keep
                        # scores are rounded, so a bound may lie half a unit below the score it bounds
                        mine[order[near if first else ~near if floor is None else ~near & (most[i, order] + 10.0**-DECIMALS >= floor)]] = True
                    bits.append(np.packbits(seen.T, axis=1))
                bits = np.concatenate(bits, axis=1) if bits else np.zeros((len(cells), 0), np.uint8)
                visited = np.flatnonzero(bits.any(axis=1))
                for some in np.array_split(visited, max(1, len(visited) // CELLS_AT_ONCE)):
                    block = pa.array(np.full(len(some), batch.column("qblock")[row].as_py(), np.int32))
                    out = [cells.field("cell").take(pa.array(some)), block, pa.array([b.tobytes() for b in bits[some]], pa.binary())]
                    if first:
                        out.append(_visitors(asked, cuts, of_query, [_spots(b, len(cuts)) for b in bits[some]]))
                    yield pa.RecordBatch.from_arrays(out, names=["cell", "qblock", "who", "queries"][: len(out)])

    return run


def _spots(bits: np.ndarray, n: int) -> np.ndarray:
    """The cuts that a bitmap names."""
    return np.flatnonzero(np.unpackbits(bits, count=n))


def _visitors(asked: pa.StructArray, cuts: pa.StructArray, of_query: np.ndarray, spots: list[np.ndarray]) -> pa.ListArray:
    """For each list of cuts, their queries with these cuts only."""
    wanted, cell = np.concatenate([*spots, np.zeros(0, int)]), np.repeat(np.arange(len(spots)), [len(s) for s in spots])
    query = of_query[wanted]
    at = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (cell[1:] != cell[:-1]))[: len(query)])
    mine, who = listed(cuts.take(pa.array(wanted)), np.diff(np.append(at, len(query)))), pa.array(query[at])
    rows = pa.StructArray.from_arrays([asked.field("query_id").take(who), asked.field("vectors").take(who), mine], names=["query_id", "vectors", "cuts"])
    return listed(rows, np.bincount(cell[at], minlength=len(spots)))


def _visit(index: CellIndex, asked: DataFrame, first: bool) -> DataFrame:
    """(cell, qblock, who): a bitmap of the cuts of a block's queries that visit a cell; on the first visit also their queries."""
    # the header is one row, so this is a join on a constant that meets each query block once, where the block is
    met = asked.withColumn("one", F.lit(1)).join(F.broadcast(index.header.withColumn("one", F.lit(1))), "one")
    schema = StructType([*StructType.fromDDL("cell int, qblock int, who binary").fields, *([asked.schema["queries"]] if first else [])])
    return met.select("qblock", "queries", "cells", "numbers").mapInArrow(_visits(first), schema)


def _meet_first(blocks: DataFrame, early: DataFrame, rerank: bool) -> DataFrame:
    """The hits of the queries that each cell's papers meet first; the queries of a cell are dealt into rows of like size."""
    sizes = early.groupBy("cell").agg(F.ceil(F.sum(F.size("queries")) / QUERIES_PER_ROW).cast("int").alias("n_rows"))
    nth = F.pmod(F.xxhash64("qblock"), "n_rows").cast("int")
    asked = early.join(sizes, "cell").groupBy("cell", nth.alias("nth")).agg(F.flatten(F.collect_list("queries")).alias("queries"))
    each = blocks.join(sizes, "cell").select("cell", "members", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("nth"))
    return asked.join(each, ["cell", "nth"]).select("members", "queries").mapInArrow(_scored(rerank, DECIMALS), HITS)


class _Held:
    """A query block as a task of the second visit holds it."""

    def __init__(self, asked: pa.StructArray, rerank: bool) -> None:
        cuts, self.of_query = cut_rows(asked)
        sub, self.sizes = vector_matrix(asked.field("vectors"))
        self.units, self.centred = unit_rows(sub), centred_rows(sub) if rerank else None
        self.names, self.top_k = cuts.field("name"), cuts.field("topK")
        self.keep, self.filters = cuts.field("keep").to_numpy(), FilterTable(cuts.field("filters").to_pylist())
        self.floors = np.array([-np.inf if f is None else f for f in cuts.field("floor").to_pylist()])
        self.turn = 0

    def raise_to(self, floors: _Floors) -> None:
        if self.turn != floors.turn:
            self.floors = np.maximum(self.floors, [floors.get(n, -np.inf) for n in self.names.to_pylist()])
            self.turn = floors.turn


def _passing(rerank: bool) -> Callable:
    """Papers pass by the query blocks of their share, which come before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = _Floors()
        return _best_of_task(hits(batches, floors), floors)

    def hits(batches: Iterator[pa.RecordBatch], floors: _Floors) -> Iterator[tuple[pa.RecordBatch, dict[str, int]]]:
        at, held = None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("share", "copy", "qblock"))))
            for row, (*key, qblock) in enumerate(keys):
                if key != at:
                    at, held = key, {}
                if qblock is not None:
                    held[qblock] = _Held(batch.column("queries")[row].values, rerank)
                    continue
                members = batch.column("members")[row].values
                payload = {f.name: members.field(i) for i, f in enumerate(members.type)}
                raw, counts = vector_matrix(payload["vectors"])
                units, ready = unit_rows(raw), comparable(payload)
                for visit in batch.column("visits")[row].as_py():
                    asked = held[visit["qblock"]]
                    asked.raise_to(floors)
                    if raw.shape[1] not in (0, asked.units.shape[1]):
                        raise ValueError("query and paper vectors differ in width")
                    wanted = _spots(np.frombuffer(visit["who"], np.uint8), len(asked.keep))
                    live, of = np.unique(asked.of_query[wanted], return_inverse=True)
                    rows, sizes = np.repeat(np.isin(np.arange(len(asked.sizes)), live), asked.sizes), asked.sizes[live]
                    starts = starts_of(sizes)
                    scores = np.round(max_sim_matrix(asked.units[rows], starts, units, counts) / sizes[:, None], DECIMALS)
                    for start in range(0, len(wanted), CUTS_AT_ONCE):
                        some, i = wanted[start : start + CUTS_AT_ONCE], of[start : start + CUTS_AT_ONCE]
                        good = asked.filters.masks(some, ready, len(members)) & ~(scores[i] < asked.floors[some, None])
                        cut, paper = np.nonzero(good)
                        if not len(cut):
                            continue
                        again = np.zeros(len(cut))
                        if rerank:
                            used = np.unique(paper)
                            vectors = raw[np.isin(np.repeat(np.arange(len(counts)), counts), used)]
                            close = max_sim_matrix(asked.centred[rows], starts, centred_rows(vectors), counts[used]) / sizes[:, None]
                            again = np.round(close[i[cut], np.searchsorted(used, paper)], DECIMALS)
                        who = pa.array(some[cut])
                        found = [asked.names.take(who), payload["paperId"].take(pa.array(paper)), pa.array(scores[i[cut], paper]), pa.array(again), asked.top_k.take(who)]
                        busy = some[np.unique(cut)]
                        keeps: dict[str, int] = {}
                        for name, keep in zip(asked.names.take(pa.array(busy)).to_pylist(), asked.keep[busy].tolist()):
                            keeps[name] = max(keep, keeps.get(name, 0))
                        yield pa.RecordBatch.from_arrays(found, names=["query_id", "paperId", "retrieval_score", "rerank_score", "topK"]), keeps

    return run


def _meet_again(blocks: DataFrame, late: DataFrame, asked: DataFrame, rerank: bool) -> DataFrame:
    """The hits of the second visit: a paper is shuffled once for each share that wants its cell, however many the query blocks."""
    shares = asked.agg(F.greatest(F.lit(LATE_SHARES), F.ceil((F.max("qblock") + 1) / HELD_BLOCKS)).cast("int")).scalar()
    share = F.pmod("qblock", shares).alias("share")
    visits = late.select("cell", share, F.struct("qblock", "who").alias("visit")).groupBy("cell", "share").agg(F.collect_list("visit").alias("visits"))
    copy = F.pmod(F.xxhash64("cell", "part"), F.lit(COPIES)).cast("int")
    papers = blocks.join(visits, "cell").select("share", copy.alias("copy"), "members", "visits")
    queries = asked.select(share, F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"), "qblock", "queries")
    # query blocks first, so that a task holds those of one share while its papers pass by
    dealt = queries.unionByName(papers, allowMissingColumns=True).repartition("share", "copy").sortWithinPartitions("share", "copy", F.col("qblock").isNull())
    return dealt.mapInArrow(_passing(rerank), HITS)


def _count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many cells of a batch each cut visits."""
    for batch in batches:
        seen: dict[int, np.ndarray] = {}
        for qblock, who in zip(*(batch.column(c).to_pylist() for c in ("qblock", "who"))):
            bits = np.unpackbits(np.frombuffer(who, np.uint8)).astype(np.int64)
            seen[qblock] = seen[qblock] + bits if qblock in seen else bits
        for qblock, n in seen.items():
            spots = np.flatnonzero(n)
            out = [pa.array(np.full(len(spots), qblock, np.int32)), pa.array(spots.astype(np.int32)), pa.array(n[spots])]
            yield pa.RecordBatch.from_arrays(out, names=["qblock", "spot", "n"])


def search_cuts(index: CellIndex, rows: DataFrame, n_blocks, rerank: bool = False) -> tuple[DataFrame, DataFrame]:
    """The hits of query rows through the index, at least the best ``keep`` of each cut, and (name, cells_read, cells).

    What the first cells give is written to the shared folder: it sets the floors and is part of the answer.
    """
    asked = stored(query_blocks(rows, n_blocks), "asked")
    early = stored(_visit(index, asked, True), "early")
    first = stored(_meet_first(index.blocks, early, rerank), "first")
    order = Window.partitionBy("query_id").orderBy(F.desc("retrieval_score"), "paperId")
    cuts = asked.select("qblock", F.posexplode("queries").alias("at", "q")).select("qblock", "at", F.posexplode("q.cuts").alias("nth", "cut"))
    keeps = cuts.select(F.col("cut.name").alias("query_id"), F.col("cut.keep").alias("keep"))
    nth = first.withColumn("r", F.dense_rank().over(order)).join(keeps, "query_id").where("r = keep")
    nth = nth.groupBy(F.col("query_id").alias("name")).agg(F.max("retrieval_score").alias("floor"))
    floors = cuts.join(nth, F.col("cut.name") == F.col("name"), "left")
    floored = floors.groupBy("qblock", "at").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", F.struct("cut.name", "cut.keep", "cut.filters", "cut.topK", "floor").alias("cut")))), lambda c: c["cut"]).alias("cuts")
    )
    again = asked.select("qblock", F.posexplode("queries").alias("at", "q")).join(floored, ["qblock", "at"])
    rows_again = again.groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct("at", "q.query_id", "q.vectors", "cuts"))).alias("queries"))
    rows_again = stored(rows_again, "floored")
    late = stored(_visit(index, rows_again, False), "late")
    hits = first.unionByName(_meet_again(index.blocks, late, rows_again, rerank))
    counted = early.select("qblock", "who").unionByName(late.select("qblock", "who")).mapInArrow(_count_visits, "qblock int, spot int, n long")
    visits = counted.groupBy("qblock", "spot").agg(F.sum("n").alias("cells_read"))
    order = Window.partitionBy("qblock").orderBy("at", "nth")
    names = cuts.select("qblock", (F.row_number().over(order) - 1).alias("spot"), "cut.name")
    total = index.header.select(F.size("cells").alias("cells")).scalar()
    report = names.join(visits, ["qblock", "spot"], "left").select("name", F.coalesce("cells_read", F.lit(0)).alias("cells_read"), total.alias("cells"))
    return hits, report


def search(
    index: CellIndex, queries: DataFrame, factor: int = 1, exclude: DataFrame | None = None, rerank: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The hits of ``search.top_k`` through the index, and (name, cells_read, cells) for each query."""
    more = None if exclude is None else exclude.groupBy("query_id").agg(F.count("*").alias("more"))
    hits, report = search_cuts(index, query_rows(queries, factor, more), block_count(queries), rerank)
    return best(hits, factor, exclude), report
