"""A quality score by random Fourier features, ridge regression and isotonic calibration.

A text is described by word, byte and line statistics of its whole length. Random Fourier features
``sqrt(2 / D) cos(W x + b)`` of the standardised statistics approximate a Gaussian kernel, so a
linear ridge fit on them is a kernel fit. Each partition sums its part of the normal equations;
Spark adds the parts, and only the D x D system comes to the driver. Another fold of the labelled
rows calibrates: Spark counts labels by score bin, and pooling adjacent violators makes the rates
of the bins rise with the score.

All labelled rows outside the held-out fold are learned from: folds are crc32(doc_id) mod 5, 0 is
held out, 4 calibrates, 1 to 3 fit.

Defined results: a null or empty text has all statistics 0 and gets the score that follows from
them; without labels of both kinds every score is the share of good labels, 1 if there is none; a
null doc_id is held out; a document with several labels counts with each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.tables import stored
from paperloom.llm.words import Piece, hash_runs, hash_words, mix, pieces, within

FEATURES = 192
WIDTH = 4.0
RIDGE = 1e-3
BINS = 400
ACCEPT = 0.3
HELD_OUT, CALIBRATES, FOLDS = 0, 4, 5
N_STATS = 14
# Byte classes: blank, lower, upper, digit, sentence mark, other mark, symbol, beyond ASCII, newline.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:!?"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\^~=+@_/"]] = 6
_CLASS[128:], _CLASS[10] = 7, 8


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(values ^ mix(rows.astype(np.uint64)), return_index=True)
    return np.bincount(rows[at], minlength=n)


def describe(p: Piece) -> np.ndarray:
    """``n_rows x N_STATS`` statistics."""
    n, words = len(p.rows) - 1, p.n_words.astype(np.float64)
    row_of_word = np.repeat(np.arange(n), p.n_words)
    size = (p.end - p.start).astype(np.float64)
    row_of_byte = np.repeat(np.arange(n), np.diff(p.rows))
    kinds = np.bincount(row_of_byte * 9 + _CLASS[p.text], minlength=9 * n).reshape(n, 9).astype(np.float64)
    hashes = hash_words(p)
    starts, bounds = within(p.of, 3)
    runs = hash_runs(hashes, 3)[starts] if len(starts) else np.zeros(0, np.uint64)
    row_of_run = np.repeat(np.arange(n), np.diff(bounds))
    # lines: the sum of a line's word hashes, weighed by their place in it, names the line
    line_of_word = np.cumsum(p.text == 10)[p.start] + row_of_word if len(p.start) else np.zeros(0, np.int64)
    new = np.append(True, line_of_word[1:] != line_of_word[:-1]) if len(line_of_word) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes)))) if len(first) else first
    names = np.add.reduceat(mix(hashes + (place + 1).astype(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
    lines = np.bincount(row_of_word[first], minlength=n)
    some, letters = np.maximum(words, 1), np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 7], 1)
    mean = np.bincount(row_of_word, size, n) / some
    spread = np.sqrt(np.maximum(np.bincount(row_of_word, size**2, n) / some - mean**2, 0))
    used = np.maximum(np.diff(p.rows), 1)
    stats = [
        np.log1p(words), mean, spread, kinds[:, 6] / some, kinds[:, 4] / some, kinds[:, 5] / some, kinds[:, 3] / used,
        kinds[:, 2] / letters, kinds[:, 7] / used, np.log1p(lines), lines / some, _distinct(hashes, row_of_word, n) / some**0.8,
        _distinct(runs, row_of_run, n) / np.maximum(np.diff(bounds), 1), _distinct(names, row_of_word[first], n) / np.maximum(lines, 1),
    ]
    return np.stack(stats, axis=1)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column("text"), size=1 << 19):
            n = len(p.rows) - 1
            values = pa.array(describe(p).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * N_STATS), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(p.first, n), lists], names=["doc_id", "stats"])


def fold() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)), F.lit(HELD_OUT))


class Kernel:
    """Standardisation and the random features; the same numbers on every machine."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / WIDTH, (N_STATS, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b)
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def _normal_parts(kernel: Kernel):
    """Per partition: row i of the summed Z'Z with Z'y at its end, as (i, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, y = kernel(_matrix(batch.column("stats"))), batch.column("label").to_numpy(zero_copy_only=False)
            total += np.hstack([z.T @ z, (z.T @ y)[:, None]])
        n, m = total.shape
        i, j = np.divmod(np.arange(n * m), m)
        upper = (j >= i) | (j == m - 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * m)[upper]), pa.array(total.reshape(-1)[upper])], names=["cell", "part"])

    return run


def solve(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """Ridge weights from the summed normal equations."""
    cells = rows.mapInArrow(_normal_parts(kernel), "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect()
    n, m = FEATURES + 1, FEATURES + 2
    total = np.zeros(n * m)
    total[[c["cell"] for c in cells]] = [c["part"] for c in cells]
    total = total.reshape(n, m)
    a = np.triu(total[:, :n])
    a = a + np.triu(a, 1).T
    count = max(a[-1, -1], 1)
    ridge = RIDGE * count / FEATURES * np.eye(n)
    ridge[-1, -1] = 1e-9
    return np.linalg.solve(a + ridge, total[:, -1])


def pool(bins: np.ndarray, counts: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: knots (mean bin, rate) of the rising step function."""
    blocks: list[list[float]] = []
    for x, n, h in zip(bins, counts, hits):
        blocks.append([x * n, n, h])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _score(kernel: Kernel, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel(_matrix(batch.column("stats"))) @ weights
            score = raw if knots is None else np.clip(np.interp(raw, *knots), 0, 1)
            yield batch.drop_columns(["stats"]).append_column("score", pa.array(score))

    return run


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score) of every document; ``labels`` has doc_id and the label (0 or 1)."""
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stats, "doc_id long, stats array<double>")
    stats = stored(stats, "stats").withColumn("fold", fold())
    marks = labels.select("doc_id", F.col(label).cast("double").alias("label")).where("label IN (0, 1)")
    known = stored(stats.where(F.col("fold") != HELD_OUT).join(marks, "doc_id"), "labelled")
    moments = known.agg(
        F.count("*"), F.sum("label"), *[f(F.get("stats", F.lit(i))) for i in range(N_STATS) for f in (F.mean, F.stddev_pop)]
    ).first()
    n, good = moments[0], moments[1] or 0.0
    out = stats.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "stats")
    if not 0 < good < n:
        return out.select("doc_id", "held_out", F.lit(good / n if n else 1.0).alias("score"))
    mean, scale = (np.array(moments[2 + i :: 2], float) for i in (0, 1))
    kernel = Kernel(mean, np.where(scale > 1e-9, scale, 1.0))
    fit = known.where(F.col("fold") != CALIBRATES)
    weights = solve(fit, kernel)
    rated = known.where(F.col("fold") == CALIBRATES).select("stats", "label").mapInArrow(_score(kernel, weights, None), "label double, score double")
    bins = (
        rated.groupBy(F.round(F.least(F.greatest(F.col("score"), F.lit(-1.0)), F.lit(2.0)) * BINS).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
        .orderBy("bin")
        .collect()
    )  # at most 3 * BINS + 1 rows
    if bins:
        x, rate = pool(*(np.array([b[c] for b in bins], float) for c in ("bin", "n", "hits")))
    else:
        x, rate = np.array([0.0, BINS]), np.array([0.0, 1.0])
    return out.mapInArrow(_score(kernel, weights, (x / BINS, rate)), "doc_id long, held_out boolean, score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).select("doc_id", "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at least ``ACCEPT``; rows with a null doc_id stay. Rows with one
    doc_id go only if all of them are rejected."""
    good = predictions(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("__good")).distinct()
    kept = docs.join(good, docs["doc_id"].cast("long") == good["__good"], "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
