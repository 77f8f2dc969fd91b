"""Vectors of Arrow list columns as numpy matrices, for operators that run on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def centred_rows(m: np.ndarray) -> np.ndarray:
    return unit_rows(m - m.mean(axis=1, keepdims=True))


def vector_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list<list<float>> column as (stacked vectors, number of vectors per row)."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = column.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(inner), -1) if len(inner) else flat.reshape(0, 0), counts


def max_sim_matrix(q: np.ndarray, q_starts: np.ndarray, d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MaxSim of every query (rows of ``q`` grouped by ``q_starts``) with every paper, shape (queries, papers)."""
    filled = np.flatnonzero(counts)
    scores = np.zeros((len(q_starts) - 1, len(counts)))
    if len(filled):
        first = np.concatenate([[0], np.cumsum(counts[filled])[:-1]])
        best = np.maximum.reduceat(q @ d.T, first, axis=1)
        scores[:, filled] = np.add.reduceat(best, q_starts[:-1], axis=0)
    return scores


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def listed(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Values cut into one list per count."""
    return pa.ListArray.from_arrays(pa.array(starts_of(counts), pa.int32()), values)


def vectors_column(m: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    flat = pa.array(np.ascontiguousarray(m).reshape(-1), kind)
    return listed(flat, np.full(len(m), m.shape[1]))
