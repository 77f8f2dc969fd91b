"""Vector codes of eight parts by Lloyd's rounds over two trees, in whole numbers.

Each component x becomes floor(4096 x); a vector is cut into ``PARTS`` equal parts, and each part
position has a codebook of ``ENTRIES`` entries. Vectors are stored in blocks. A block holds, for
each position, a tree over its parts - halved at the median of the widest component, level by level
- with the box, the count and the sum of every node. The few entries of a codebook form a second
such tree in every round. Both are descended together: a pair of nodes is dropped where the least
distance of its boxes is above the largest distance of another pair of the same parts, so where one
entry is left the whole node goes to it by its cached sum. Only parts of leaves that several entries
may still serve are compared one by one. All bounds and distances are exact integers, an entry that
could tie is never dropped, and ties go to the lower index, so that rounds equal those without trees.

A task returns one row per position and entry; their sums are the next codebooks, which are bounded
by ``PARTS * ENTRIES`` entries and travel with the next round's plan. Trees are built once.

Defined results: rows whose vector is null, empty or holds null or non-finite components have no
code and no row. All vectors have the width of the first (smallest vec_id, nulls last); others have no
row. A width that eight does not divide is filled up with zeros. Components beyond 16,384 count as
16,384, so that every squared distance fits a long. Fewer than 16 vectors give as many entries.
Repeated rows are coded each; rows with one vec_id are ordered by their vectors. A sum over a label
that does not fit a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.tables import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 26
# Vectors of a block, parts of a leaf, and distances held at once.
BLOCK, LEAF, HELD = 1 << 13, 16, 1 << 20


def whole(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _bounds(n: int, leaf: int) -> list[np.ndarray]:
    """Per level, where the nodes of a tree over ``n`` ordered rows begin, with ``n`` at the end."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        at = levels[-1]
        levels.append(np.unique(np.concatenate([at, (at[:-1] + at[1:]) // 2])))
    return levels


def grown(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of ``points`` in which each level's nodes are runs, halved at the median of their widest component."""
    order = np.arange(len(points))
    for at in _bounds(len(points), leaf)[:-1]:
        held = points[order]
        low, high = (f.reduceat(held, at[:-1], axis=0) for f in (np.minimum, np.maximum))
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = order[np.lexsort((held[np.arange(len(held)), (high - low).argmax(axis=1)[node]], node))]
    return order


class Tree:
    """Levels of a tree over ordered points: bounds, boxes, counts and sums of the nodes, and each node's children."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points = points
        self.at = _bounds(len(points), leaf)
        self.low = [np.minimum.reduceat(points, at[:-1], axis=0) for at in self.at]
        self.high = [np.maximum.reduceat(points, at[:-1], axis=0) for at in self.at]
        self.sums = [np.add.reduceat(points, at[:-1], axis=0) for at in self.at]

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each node's children in the next level begin and end."""
        edges = np.searchsorted(self.at[level + 1], self.at[level])
        return edges[:-1], edges[1:]


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers first[i] .. last[i] - 1, and the i of each."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def descend(tree: Tree, entries: Tree) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Descends both trees. ``entries`` has leaves of one entry.

    Returns (level, nodes, entry) of nodes that one entry serves, and the pairs (leaf, entry) that are left.
    """
    served, level, depth = [], 0, 0
    a, b = np.zeros(1, int), np.zeros(1, int)
    while True:
        # bounds of the pairs' distances; an entry as near as another one stays
        apart = np.maximum(np.maximum(tree.low[level][a] - entries.high[depth][b], entries.low[depth][b] - tree.high[level][a]), 0)
        across = np.maximum(tree.high[level][a] - entries.low[depth][b], entries.high[depth][b] - tree.low[level][a])
        least, most = (apart * apart).sum(axis=1), (across * across).sum(axis=1)
        best = np.full(len(tree.at[level]) - 1, np.iinfo(np.int64).max)
        np.minimum.at(best, a, most)
        stay = least <= best[a]
        a, b = a[stay], b[stay]
        if depth + 1 == len(entries.at):
            one = np.bincount(a, minlength=len(best))[a] == 1
            served.append((level, a[one], b[one]))
            a, b = a[~one], b[~one]
        if level + 1 == len(tree.at) and depth + 1 == len(entries.at) or not len(a):
            return served, (a, b)
        if depth + 1 < len(entries.at):
            first, last = entries.children(depth)
            b, of = _expand(first[b], last[b])
            a, depth = a[of], depth + 1
        if level + 1 < len(tree.at):
            first, last = tree.children(level)
            a, of = _expand(first[a], last[a])
            b, level = b[of], level + 1


def _nearest(tree: Tree, leaf: np.ndarray, entry: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the leaves in pairs (leaf, entry), and the nearest of their entries, ties to the lower index."""
    order = np.lexsort((entry, leaf))
    leaf, entry = leaf[order], entry[order]
    leaves, first, n = np.unique(leaf, return_index=True, return_counts=True)
    width = n.max() if len(n) else 0
    at = tree.at[-1]
    rows, of = _expand(at[leaves], at[leaves + 1])
    best = np.zeros(len(rows), np.int64)
    step = max(1, HELD // max(1, width * codebook.shape[1]))
    for s in range(0, len(rows), step):
        mine = of[s : s + step]
        slots = np.minimum(np.arange(width), n[mine, None] - 1) + first[mine, None]
        choice = entry[slots]  # entries in ascending order, the last one repeated
        gap = tree.points[rows[s : s + step], None, :] - codebook[choice]
        nearest = (gap * gap).sum(axis=2).argmin(axis=1)
        best[s : s + step] = choice[np.arange(len(mine)), nearest]
    return rows, best


def assigned(tree: Tree, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and component sums of each entry's parts."""
    order = grown(codebook, 1)
    served, left = descend(tree, Tree(codebook[order], 1))
    counts, sums = np.zeros(len(codebook), np.int64), np.zeros(codebook.shape, np.int64)
    for level, nodes, entry in served:
        np.add.at(counts, order[entry], np.diff(tree.at[level])[nodes])
        np.add.at(sums, order[entry], tree.sums[level][nodes])
    rows, best = _nearest(tree, left[0], order[left[1]], codebook)
    np.add.at(counts, best, 1)
    np.add.at(sums, best, tree.points[rows])
    return counts, sums


def coded(tree: Tree, codebook: np.ndarray) -> np.ndarray:
    """The entry of each part, in the tree's order."""
    order = grown(codebook, 1)
    served, left = descend(tree, Tree(codebook[order], 1))
    out = np.zeros(len(tree.points), np.int64)
    for level, nodes, entry in served:
        at = tree.at[level]
        rows, of = _expand(at[nodes], at[nodes + 1])
        out[rows] = order[entry][of]
    rows, best = _nearest(tree, left[0], order[left[1]], codebook)
    out[rows] = best
    return out


def _planted(width: int):
    """Blocks of vectors as trees: one row per block, with ids, labels, and the ordered parts of all positions."""
    size = -(-width // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                points = np.zeros((n, PARTS * size), np.int64)
                points[:, :width] = whole(pc.cast(part.column("embedding").flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(n, width))
                points = points.reshape(n, PARTS, size)
                orders = np.stack([grown(points[:, p], LEAF) for p in range(PARTS)])
                ordered = np.stack([points[orders[p], p] for p in range(PARTS)]).astype(np.int32)
                whole_rows = [pa.array([x]) for x in (ordered.tobytes(), orders.astype(np.int32).tobytes())]
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, *whole_rows], names=["vec_id", "label", "points", "orders"])

    return run


def _trees(points: bytes, n: int) -> list[Tree]:
    ordered = np.frombuffer(points, np.int32).reshape(PARTS, n, -1).astype(np.int64)
    return [Tree(ordered[p], LEAF) for p in range(PARTS)]


def _sums(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(codebooks.shape[:2], np.int64)
        sums = np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            for points, n in zip(batch.column("points"), batch.column("n").to_pylist()):
                for p, tree in enumerate(_trees(points.as_buffer(), n)):
                    c, s = assigned(tree, codebooks[p])
                    counts[p] += c
                    sums[p] += s
        p, e, k = (x.reshape(-1) for x in np.indices(codebooks.shape))
        columns = (p, e, k, np.repeat(counts.reshape(-1), codebooks.shape[2]), sums.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["part", "entry", "place", "n", "total"])

    return run


def _codes(codebooks: np.ndarray, label: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("vec_id")[row].values, batch.column("label")[row].values
                n = len(ids)
                orders = np.frombuffer(batch.column("orders")[row].as_buffer(), np.int32).reshape(PARTS, n)
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(_trees(batch.column("points")[row].as_buffer(), n)):
                    best = coded(tree, codebooks[p])
                    gap = tree.points - codebooks[p][best]
                    codes[orders[p], p] = best
                    error[orders[p]] += (gap * gap).sum(axis=1)
                text = [bytes(c).hex() for c in codes]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def fitted(vectors: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """The blocks of trees, the codebooks after all rounds (part, entry, place) and the number of their entries."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where((F.size("embedding") > 0) & ~bad)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = kept.orderBy(*order).limit(1).collect()  # one row, for the width
    width = len(first[0]["embedding"]) if first else PARTS
    kept = kept.where(F.size("embedding") == width)
    start = np.array([r["embedding"] for r in kept.orderBy(*order).limit(ENTRIES).collect()], np.float64).reshape(-1, width)
    size = -(-width // PARTS)
    books = np.zeros((len(start), PARTS * size), np.int64)
    books[:, :width] = whole(start)
    books = books.reshape(-1, PARTS, size).transpose(1, 0, 2)
    label = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id array<long>, label array<{label}>, points binary, orders binary"
    blocks = stored(kept.mapInArrow(_planted(width), schema), "trees").withColumn("n", F.size("vec_id"))
    for _ in range(ROUNDS if len(start) else 0):
        sums = blocks.select("points", "n").mapInArrow(_sums(books), "part long, entry long, place long, n long, total long")
        sums = sums.where("n > 0").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        # ENTRIES * width rows at most; the mean goes down to a whole number
        moved = sums.select("part", "entry", "place", F.expr("(total - pmod(total, n)) div n").alias("mean")).collect()
        books = books.copy()
        for r in moved:
            books[r["part"], r["entry"], r["place"]] = r["mean"]
    return blocks, books, len(start)


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of ``vectors`` (vec_id, embedding, label)."""
    blocks, books, entries = fitted(vectors)
    said = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    label = blocks.schema["label"].dataType.elementType
    schema = f"vec_id long, label {label.simpleString()}, code string, error long"
    coded_rows = blocks.select("vec_id", "label", "points", "orders").mapInArrow(_codes(books, label), schema)
    rows = stored(coded_rows, "codes")
    by_label = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
