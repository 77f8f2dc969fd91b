"""Near-duplicate vectors by sign hashing on random hyperplanes, exact cosines and components.

Vectors are compared only under one label. Equal vectors are one node with their number. Each of
``TABLES`` tables names a node by the signs of its products with ``BITS`` random directions; a
sign agrees between two vectors with probability 1 - angle/pi, so two with a cosine of 0.98 share
a name in some table with probability 1 - (1 - 0.936^20)^32 = 0.99995, closer ones with more.

What shares a name is a bucket. Buckets of one node go before any vector moves. The others are cut
into shares of at most about ``SHARE`` nodes, and two shares meet in one block: a task's memory is
bounded whatever the bucket, and a bucket that holds a third of all rows is spread over all tasks.
Blocks stream through numpy, sorted, many to an Arrow batch: each pair's cosine is computed in
double precision, and a pair of several tables counts in the first one only. Pairs are never rows:
a block returns, per node, its number of new links and its root among the block's links. The roots
are the edges of the distributed connected components.

The number of links of a vector is its links to other nodes, each as often as that node has rows,
and the other rows of its own. Counting links of a group of near copies takes its pairs' products
in arithmetic, which the asked count itself amounts to.

Defined results: a row that is null, empty, zero or holds a null or non-finite component, and one
whose label is null, has no link; neither have vectors of different widths. Repeated rows are
links of each other. A component's id is the smallest vec_id that is not null in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.dartminhash import components
from paperloom.llm.tables import stored

SIMILARITY = 0.98
TABLES, BITS = 32, 20
SEED = 12
# Nodes of a bucket in one share, and products held at once.
SHARE, STRIP = 512, 1 << 20


def directions(width: int) -> np.ndarray:
    """The normals of all tables' hyperplanes, the same in every task."""
    return np.random.default_rng([SEED, width]).standard_normal((width, TABLES * BITS))


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: flat components in double precision, each row's start and its width, 0 for a row without links."""
    width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(width)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    fit = (bad[start[1:]] == bad[start[:-1]]) & (some[start[1:]] > some[start[:-1]])
    return flat, start[:-1], np.where(fit, width, 0)


def units(flat: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The rows that begin at ``start`` as unit vectors; scaled first, so that no square overflows."""
    m = flat[start[:, None] + np.arange(width)]
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit name of label and vector for every row that can have links."""
    for batch in batches:
        flat, start, width = rows_of(batch.column("embedding"))
        labels = batch.column("label").to_pylist()
        zero = flat + 0.0  # -0.0 and 0.0 are one value
        names = [
            hashlib.sha256(f"{label}:".encode() + zero[a : a + w].tobytes()).digest()[:16] if w and label is not None else None
            for label, a, w in zip(labels, start.tolist(), width.tolist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), batch.column("embedding"), pa.array(names, pa.binary())],
            names=["vec_id", "label", "embedding", "name"],
        )


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket of each node in each table: label and width apart, table above the signs."""
    planes = {}
    for batch in batches:
        flat, start, width = rows_of(batch.column("embedding"))
        codes = np.zeros((batch.num_rows, TABLES), np.int64)
        for w in np.unique(width):
            if w not in planes:
                planes[w] = directions(int(w))
            at = np.flatnonzero(width == w)
            signs = (units(flat, start[at], int(w)) @ planes[w] > 0).reshape(len(at), TABLES, BITS)
            codes[at] = signs @ (1 << np.arange(BITS, dtype=np.int64)) + (np.arange(TABLES, dtype=np.int64) << BITS)
        cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TABLES)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(width, pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(codes.reshape(-1)))],
            names=[*batch.schema.names, "width", "codes"],
        )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' component, of the links (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _block(u: np.ndarray, codes: np.ndarray, start: int, side: np.ndarray, table: int) -> tuple[np.ndarray, ...]:
    """Links of the block whose rows begin at ``start``: both ends, and which are new."""
    whole = side[0] == 0
    mine = start + (np.arange(len(side)) if whole else np.flatnonzero(side == 1))
    other = mine if whole else start + np.flatnonzero(side == 2)
    found = [(np.zeros(0, int), np.zeros(0, int))]
    step = max(1, STRIP // max(len(other), 1))
    for at in range(0, len(mine), step):
        i, j = np.nonzero(u[mine[at : at + step]] @ u[other].T >= SIMILARITY)
        i += at
        if whole:
            i, j = i[i < j], j[i < j]
        found.append((mine[i], other[j]))
    a, b = (np.concatenate(x) for x in zip(*found))
    new = np.ones(len(a), bool)
    for at in range(0, len(a), STRIP):
        new[at : at + STRIP] = (codes[a[at : at + STRIP]] == codes[b[at : at + STRIP]]).argmax(axis=1) == table
    return a, b, new


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the blocks of one partition, whose rows come block by block."""

    def fresh(t: pa.Table) -> np.ndarray:
        """Where a block begins, but for the first."""
        return np.flatnonzero((np.diff(t["block"].to_numpy()) != 0) | (np.diff(t["code"].to_numpy()) != 0)) + 1

    def links(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        n, width = t.num_rows, t["width"][0].as_py()
        ids, copies, side = (t[c].to_numpy() for c in ("nid", "copies", "side"))
        u = units(t["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64), np.arange(n) * width, width)
        codes = t["codes"].combine_chunks().flatten().to_numpy().reshape(n, TABLES)
        table = (t["code"].to_numpy() >> BITS).astype(int)
        bounds = np.concatenate([[0], fresh(t), [n]])
        sizes = np.diff(bounds)
        ends = []
        for size in np.unique(sizes):
            starts = bounds[:-1][sizes == size]
            if size <= 24:  # all small blocks of one size at once
                i, j = np.triu_indices(size, 1)
                step = max(1, STRIP // (width * max(len(i), 1)))
                for at in range(0, len(starts), step):
                    a = (starts[at : at + step, None] + i).reshape(-1)
                    b = (starts[at : at + step, None] + j).reshape(-1)
                    use = (side[a] == 0) | (side[a] != side[b])  # in a block of two shares, of both sides
                    a, b = a[use], b[use]
                    near = np.einsum("ij,ij->i", u[a], u[b]) >= SIMILARITY
                    a, b = a[near], b[near]
                    ends.append((a, b, (codes[a] == codes[b]).argmax(axis=1) == table[a]))
            else:
                for s in starts:
                    ends.append(_block(u, codes, s, side[s : s + size], table[s]))
        a, b, new = (np.concatenate(x) for x in zip(*ends))
        count = np.bincount(a[new], copies[b[new]], n) + np.bincount(b[new], copies[a[new]], n)
        root = _roots(n, a, b)
        keep = np.flatnonzero((count > 0) | (root != np.arange(n)))
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[root[keep]]), pa.array(count[keep].astype(np.int64))], names=["nid", "root", "links"])

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        starts, width = fresh(t), t["width"].to_numpy()
        if not len(starts):
            continue
        # the last block may go on in the next batch; widths are apart
        for w in np.unique(width[: starts[-1]]):
            yield links(t.take(pa.array(np.flatnonzero(width[: starts[-1]] == w))))
        held = t.slice(starts[-1]).to_batches()
    if held:
        yield links(pa.Table.from_batches(held))


def links(nodes: DataFrame) -> DataFrame:
    """(nid, root, links) rows from nodes with buckets: new links per block and the block's connections."""
    rows = nodes.select("nid", "label", "width", F.explode("codes").alias("code"))
    key = ["label", "width", "code"]
    several = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    members = stored(rows.join(several, key), "members")
    # shares of a bucket, and the blocks in which a share meets every other and itself
    shares = F.ceil(F.col("n") / SHARE)
    dealt = members.select("nid", *key, shares.alias("shares"), F.pmod(F.xxhash64("nid", F.lit(1)), shares).alias("mine"))
    dealt = dealt.select("nid", *key, "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    block = F.xxhash64(*key, F.least("mine", "other"), F.greatest("mine", "other"))
    blocks = dealt.select("nid", "code", block.alias("block"), side.alias("side"))
    # vectors go to the members of buckets with several nodes only; blocks spread over the tasks by their hash
    full = blocks.join(nodes.select("nid", "copies", "width", "embedding", "codes"), "nid")
    return full.repartition("block").sortWithinPartitions("block", "code").mapInArrow(_compare, "nid long, root long, links long")


def grouped(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), "embedding")
    element = rows.schema["embedding"].dataType.simpleString()
    label = rows.schema["label"].dataType.simpleString()
    named = stored(rows.mapInArrow(_name, f"vec_id long, label {label}, embedding {element}, name binary"), "named")
    distinct = named.where("name IS NOT NULL").groupBy("name").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    nodes = stored(distinct.withColumn("nid", F.monotonically_increasing_id()), "distinct")
    signed = nodes.select("nid", "copies", "label", "embedding").mapInArrow(
        _sign, f"nid long, copies long, label {label}, embedding {element}, width int, codes array<long>"
    )
    met = stored(links(stored(signed, "signed")), "links")
    counts = met.groupBy("nid").agg(F.sum("links").alias("links"))
    labels = components(met.where("nid <> root").select(F.col("nid").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("name", "nid", "low", "copies").join(counts, "nid", "left").join(labels, "nid", "left")
    placed = placed.withColumn("place", F.coalesce("label", "nid"))
    least = placed.groupBy("place").agg(F.min("low").alias("component_id"))
    known = placed.join(least, "place").select("name", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    out = named.select("vec_id", "name").join(known, "name", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
