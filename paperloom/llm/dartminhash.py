"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification.

A document is the set of its five-word shingles; a text of one to four words is one shingle. Darts
are thrown into the region weight x rank of every element: each unit cell of the region holds a
Poisson number of darts drawn from a hash of the element and the cell, so documents that share an
element share its darts. Every weight is 1 here, however often a shingle stands in the text, as a
link is a matter of sets: a text and the same text pasted twice must meet. Of the darts below a
rank bound, chosen so that about ``K * (ln K + 2.5)`` hit whatever the text's length, each of the
``K`` coordinates keeps the earliest; a document with an empty coordinate throws again to twice
the rank. A coordinate agrees between two documents with the probability of their similarity. ``BANDS`` bands of ``ROWS`` coordinates meet at similarity 0.8 with probability
1 - (1 - 0.8^5)^20 > 0.9995.

Documents with equal words are one node. A bucket's nodes are compared with the smallest node of
the bucket only, and each node with one such center. What the buckets connect is a family; most
families are then one class. In a family that is not, the nodes outside its largest class are open.
Of its nodes only those stay that share one of their rarest shingles with a node of another class, as
any two that are alike do, and such shingles part the family anew. The open nodes are then compared
with all nodes of their part, in shares bounded in shingles and in nodes and within the tasks, so that
no pair is ever a row and no link is lost. A link needs an exact Jaccard similarity of 0.8 of
the shingle sets. Classes are connected components.

Defined results: null and wordless texts are copies of each other; a row with a null doc_id takes
the class of equal text that has an id, else null; rows with one doc_id are one document; the
class id is the smallest doc_id in the class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.tables import stored
from paperloom.llm.words import Piece, hash_runs, hash_words, mix, pieces, within

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
K = BANDS * ROWS
# Shingles in one share of a family (up to the last text), and columns of a matrix that counts shared ones.
SHARE, COLUMNS = 1 << 17, 4096
# Nodes in one share of a family, and slots that count how common a shingle is.
SHARE_NODES, SLOTS = 1 << 11, 1 << 18
# Bytes of text worked on at a time: each costs some hundred bytes of darts.
_PIECE = 1 << 18
_THROWS = K * (math.log(K) + 2.5)
_U = np.uint64
_SLOT = _U(64 - SLOTS.bit_length() + 1)
_CELL, _RANK, _DART, _SPOT = (_U(x) for x in np.random.default_rng(5).integers(1, 2**63, 4) * 2 + 1)
# Poisson(1): how many darts a hash stands for.
_POISSON = np.array([min(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)), 1 - 2**-53) * 2**64 for n in range(18)], np.uint64)


def shingles(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a piece, and the row of each."""
    words = hash_words(p)
    starts, bounds = within(p.of, SHINGLE)
    values = hash_runs(words, SHINGLE)[starts] if len(starts) else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    short = np.flatnonzero((p.n_words > 0) & (p.n_words < SHINGLE))
    whole = np.array([hash_runs(words[p.of[i] : p.of[i + 1]], int(p.n_words[i]))[0] for i in short], np.uint64)
    return np.concatenate([values, whole]), np.concatenate([rows, short])


def _throw(signature: np.ndarray, element: np.ndarray, weight: np.ndarray, row: np.ndarray, bound: np.ndarray) -> None:
    """Throws the darts of all elements up to each row's rank bound, keeping the earliest per coordinate."""
    # one entry per unit of weight, the last one maybe a part of a unit
    units = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(element)), units)
    unit = np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)
    seed, room, row = mix(element[of] + unit.astype(np.uint64) * _CELL), weight[of] - unit, row[of]
    # one entry per cell of rank
    cells = np.ceil(bound[row]).astype(np.int64)
    of = np.repeat(np.arange(len(seed)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = mix(seed[of] + cell.astype(np.uint64) * _RANK)
    darts = np.searchsorted(_POISSON, seed, "right")
    # one entry per dart
    hit = np.repeat(np.arange(len(seed)), darts)
    nth = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
    first = mix(seed[hit] + (nth + 1).astype(np.uint64) * _DART)
    second = mix(first + _SPOT)
    rank = cell[hit] + (first >> _U(11)).astype(np.float64) * 2.0**-53
    row = row[of[hit]]
    inside = (rank < bound[row]) & ((second >> _U(32)).astype(np.float64) * 2.0**-32 < room[of[hit]])
    at = row[inside] * K + ((second[inside] & _U(0xFFFFFFFF)) % _U(K)).astype(np.int64)
    # positive floats order as their bits do; two darts with one rank are one dart
    np.minimum.at(signature.reshape(-1), at, rank[inside].view(np.uint64))


def signatures(values: np.ndarray, rows: np.ndarray, n_rows: int, counted: bool = True) -> np.ndarray:
    """The ``n_rows x K`` signatures; rows without elements keep the largest value everywhere.

    ``counted`` gives an element the weight ``1 + ln(count)``, else each has the weight 1.
    """
    never = np.iinfo(np.uint64).max
    out = np.full((n_rows, K), never, np.uint64)
    _, at, count = np.unique(values ^ mix(rows.astype(np.uint64)), return_index=True, return_counts=True)
    element, row, weight = values[at], rows[at], 1 + np.log(count) if counted else np.ones(len(at))
    total = np.bincount(row, weight, n_rows)
    bound = _THROWS / np.maximum(total, 1)
    while len(element):
        _throw(out, element, weight, row, bound)
        open_rows = (out == never).any(axis=1) & (total > 0)
        bound = np.where(open_rows, bound * 2, 0)
        stay = open_rows[row]
        element, row, weight = element[stay], row[stay], weight[stay]
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = mix(key * _U(31) + parts[:, :, i])
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column("text"), size=_PIECE):
            n = len(p.rows) - 1
            keys = _bands(signatures(*shingles(p), n, counted=False))
            filled = p.n_words > 0
            cuts = np.concatenate([[0], np.cumsum(np.where(filled, BANDS, 0))]).astype(np.int32)
            raw = p.text.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[a:b].split())).digest()[:16] for a, b in zip(p.rows[:-1].tolist(), p.rows[1:].tolist())]
            bands = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[filled].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(p.first, n), pa.array(sha, pa.binary()), bands], names=["doc_id", "words", "bands"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column("text"), size=_PIECE):
            n = len(p.rows) - 1
            values, rows = shingles(p)
            _, at = np.unique(values ^ mix(rows.astype(np.uint64)), return_index=True)
            at = at[np.argsort(rows[at], kind="stable")]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(rows[at], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("nid").slice(p.first, n), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values[at].view(np.int64)))],
                names=["nid", "set"],
            )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose shingle sets have the similarity."""
    left, right = (sets.select(F.col("nid").alias(n), F.col("set").alias(f"set_{n}")) for n in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = F.size("set_a") + F.size("set_b")
    return pairs.join(left, "a").join(right, "b").where(shared >= F.lit(SIMILARITY) * (both - shared)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(nid, label): the smallest node of the component of each node in ``links`` (a, b).

    Nodes take the least label around them, then the label of their label, until nothing changes.
    """
    edges = stored(links.union(links.select("b", "a")).toDF("u", "v").distinct(), "edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("nid"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["nid"]).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["nid"] == near["u"]).select("nid", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        root = labels.select(F.col("nid").alias("low"), F.col("label").alias("deep"))
        step = stored(lower.join(root, "low").select("nid", "old", F.least("low", "deep").alias("label")), "labels")
        labels = step.select("nid", "label")
        if step.where("label < old").isEmpty():
            return labels


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Links between the open nodes of one share and the nodes of another share of a family.

    Shared shingles of all pairs are counted at once, as a product of 0/1 matrices over the
    shingles that both sides have, ``COLUMNS`` at a time. One link per pair of labels is enough.
    """
    open_side = table.filter(table["open"]).combine_chunks()
    rest = table.filter(pc.invert(table["open"])).combine_chunks()
    sizes = [t["set"].combine_chunks().value_lengths().to_numpy() for t in (open_side, rest)]
    values = [t["set"].combine_chunks().flatten().to_numpy() for t in (open_side, rest)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    common = np.intersect1d(*values)
    shared = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    places = [np.searchsorted(common, v) for v in values]
    known = [common[np.minimum(p, len(common) - 1)] == v if len(common) else np.zeros(len(v), bool) for p, v in zip(places, values)]
    for at in range(0, len(common), COLUMNS):
        sides = []
        for n, p, k, row in zip(sizes, places, known, rows):
            use = k & (p >= at) & (p < at + COLUMNS)
            side = np.zeros((len(n), min(COLUMNS, len(common) - at)), np.float32)
            side[row[use], p[use] - at] = 1
            sides.append(side)
        shared += sides[0] @ sides[1].T
    either = sizes[0][:, None] + sizes[1][None, :] - shared
    labels = [t["label"].to_numpy() for t in (open_side, rest)]
    i, j = np.nonzero((shared >= SIMILARITY * either) & (shared > 0) & (labels[0][:, None] != labels[1][None, :]))
    _, one = np.unique(np.stack([labels[0][i], labels[1][j]]), axis=1, return_index=True)
    ids = [t["nid"].to_numpy() for t in (open_side, rest)]
    x, y = ids[0][i[one]], ids[1][j[one]]
    return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the shingles of each slot stand in the sets of a partition."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        values = batch.column("set").flatten().to_numpy().view(np.uint64)
        counts += np.bincount((values >> _SLOT).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def _prefixes(counts: np.ndarray):
    """The rarest shingles of each set, so many that two sets of the similarity share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("set").value_lengths().to_numpy().astype(np.int64)
            values = batch.column("set").flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            # one order for all sets: rare slots first, then the values
            order = np.lexsort((values, counts[(values.view(np.uint64) >> _SLOT).astype(np.int64)], row))
            place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            first = order[place < np.repeat(n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1, n)]
            of = pa.array(row[first])
            columns = [batch.column(c).take(of) for c in ("family", "nid", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values[first])], names=["family", "nid", "label", "shingle"])

    return run


def _narrowed(mixed: DataFrame) -> DataFrame:
    """The nodes of mixed families that share a rare shingle with a node of another label, in families of such.

    Two sets of the similarity share one of the first ``n - 0.8 n + 1`` shingles of each, in any one order
    of all shingles; here the rarest come first, by counts in ``SLOTS`` slots. Texts that are alike for their
    common words only, such as notices with a number each, so leave no pair to compare.
    """
    counts = np.zeros(SLOTS, np.int64)
    for r in mixed.select("set").mapInArrow(_common, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    rare = stored(mixed.select("family", "nid", "label", "set").mapInArrow(_prefixes(counts), "family long, nid long, label long, shingle long"), "rare")
    shared = rare.groupBy("family", "shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("nid").alias("center")).where("lo < hi")
    met = rare.join(shared.select("family", "shingle", "center"), ["family", "shingle"]).where("center < nid").select("center", "nid").distinct()
    within = components(met.toDF("a", "b")).withColumnRenamed("label", "part")
    return mixed.join(within, "nid").select(F.col("part").alias("family"), "nid", "label", "set", "open")


def links(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified pairs and their components, from (band, nid) rows of buckets with several nodes."""
    low = members.groupBy("band").agg(F.min("nid").alias("center"))
    near = stored(members.join(low, "band").where("center < nid").select("center", "nid").distinct(), "near")
    first = near.groupBy("nid").agg(F.min("center").alias("a")).select("a", F.col("nid").alias("b"))
    found = stored(_verified(first, sets), "links")
    labels = components(found)
    # families: what the buckets connect, whether or not it is alike
    family = components(near.toDF("a", "b")).withColumnRenamed("label", "family")
    placed = family.join(labels, "nid", "left").select("nid", "family", F.coalesce("label", "nid").alias("label"))
    counts = placed.groupBy("family", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    main = stored(main.select("family", "main"), "mixed")
    mixed = stored(placed.join(main, "family").join(sets, "nid").select("family", "nid", "label", "set", (F.col("label") != F.col("main")).alias("open")), "mixed")
    mixed = stored(_narrowed(mixed), "narrowed")
    # shares of a family, so many that the shingles and the nodes of one share are bounded
    nodes, opened = F.lit(True), F.col("open")
    parts = lambda who: F.greatest(F.ceil(F.sum(F.when(who, F.size("set"))) / SHARE), F.ceil(F.count(F.when(who, 1)) / SHARE_NODES))
    shares = mixed.groupBy("family").agg(parts(nodes).alias("n_all"), parts(opened).alias("n_open")).where("n_open > 0")
    shares = stored(shares, "shares")
    dealt = mixed.join(shares, "family").withColumn("hash", F.xxhash64("nid"))
    mine = dealt.where("open").select(
        "family", F.pmod("hash", "n_open").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1)).alias("j"), "nid", "label", "set", F.lit(True).alias("open")
    )
    others = dealt.select(
        "family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_open") - 1)).alias("i"), F.pmod("hash", "n_all").alias("j"), "nid", "label", "set", F.lit(False).alias("open")
    )
    more = mine.unionByName(others).groupBy("family", "i", "j").applyInArrow(_compare, "a long, b long")
    found = stored(found.union(more).distinct(), "links")
    return found, components(found)


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and class_id."""
    signed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign, "doc_id long, words binary, bands array<long>"), "signed")
    nodes = stored(signed.groupBy("words").agg(F.min("doc_id").alias("nid")), "nodes")
    owners = signed.join(nodes, "words").where("doc_id = nid")
    rows = stored(owners.select("nid", F.explode("bands").alias("band")), "bands")
    shared = rows.groupBy("band").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).where("lo < hi").select("band")
    members = stored(rows.join(shared, "band", "left_semi").distinct(), "members")
    wanted = members.select("nid").distinct()
    # shuffled at any size, so that the plan is the same for few and for many
    texts = docs.select(F.col("doc_id").cast("long").alias("nid"), "text").join(wanted.hint("merge"), "nid", "left_semi")
    sets = stored(texts.mapInArrow(_sets, "nid long, set array<long>"), "sets")
    _, labels = links(members, sets)
    return (
        signed.select("doc_id", "words")
        .join(nodes, "words")
        .join(labels, "nid", "left")
        .select("doc_id", F.coalesce("label", "nid").alias("class_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the class's id; rows with a null doc_id stay."""
    kept = classes(docs).where("doc_id = class_id").groupBy("doc_id").count()
    kept = stored(kept, "kept")
    ids = kept.select(F.col("doc_id").alias("__kept"))
    out = docs.join(ids, docs["doc_id"].cast("long") == ids["__kept"], "left_semi")
    if not kept.where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where(F.col("doc_id").isNull()))
