"""The re-rank encoder: a small transformer over the vectors of a paper or of a query, with given weights.

Vectors get a learned offset by position, pass layers of self-attention and a feed-forward part, each
added to its input and normed, and a projection. Weights are arrays that the user supplies, broadcast
once; their size is that of the model. Rows of one number of vectors run together, so nothing is padded
and nothing needs a mask. With all attention and feed-forward weights zero and the projection the
identity, a layer only norms, and the score is that of ``search.score_pairs(kind="centred")``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from paperloom.functions.matrices import listed, vector_matrix, vectors_column

# Numbers in one activation of a run.
HELD = 1 << 21
EPSILON = 1e-5


@dataclass(frozen=True)
class Layer:
    """``attend`` and ``offset``: the query, key and value maps one below the other; ``gather``: from the heads to the sum."""

    attend: np.ndarray
    offset: np.ndarray
    gather: np.ndarray
    gather_offset: np.ndarray
    widen: np.ndarray
    widen_offset: np.ndarray
    narrow: np.ndarray
    narrow_offset: np.ndarray
    norms: np.ndarray  # scale and shift after attention, scale and shift after the feed-forward part


@dataclass(frozen=True)
class Weights:
    """``positions`` has one row per place; later places share the last one's."""

    positions: np.ndarray
    layers: tuple[Layer, ...]
    projection: np.ndarray
    projection_offset: np.ndarray
    heads: int = 4


def untrained(width: int, layers: int = 2, places: int = 128, heads: int = 4) -> Weights:
    """The weights a training starts from."""
    norms = np.stack([np.ones(width), np.zeros(width), np.ones(width), np.zeros(width)])
    square, flat = np.zeros((width, width)), np.zeros(width)
    layer = Layer(np.zeros((3 * width, width)), np.zeros(3 * width), square, flat, square, flat, square, flat, norms)
    return Weights(np.zeros((places, width)), (layer,) * layers, np.eye(width), flat, heads)


def seeded(width: int, seed: int, layers: int = 2, places: int = 128, heads: int = 4) -> Weights:
    """Weights of a fixed draw, as an untrained model with no symmetry left."""
    rng = np.random.default_rng([seed, width])
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(width)
    norms = lambda: np.stack([1 + 0.1 * draw(width), 0.1 * draw(width), 1 + 0.1 * draw(width), 0.1 * draw(width)])
    made = tuple(
        Layer(draw(3 * width, width), draw(3 * width), draw(width, width), draw(width), draw(width, width), draw(width), draw(width, width), draw(width), norms())
        for _ in range(layers)
    )
    return Weights(draw(places, width), made, np.eye(width) + draw(width, width), draw(width), heads)


def _norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + EPSILON) * scale + shift


def _attention(x: np.ndarray, layer: Layer, heads: int) -> np.ndarray:
    rows, n, width = x.shape
    split = (x @ layer.attend.T + layer.offset).reshape(rows, n, 3, heads, width // heads).transpose(2, 0, 3, 1, 4)
    asks, keys, values = split
    match = asks @ keys.swapaxes(-1, -2) / np.sqrt(width // heads)
    match = np.exp(match - match.max(axis=-1, keepdims=True))
    mixed = match / match.sum(axis=-1, keepdims=True) @ values
    return mixed.transpose(0, 2, 1, 3).reshape(rows, n, width) @ layer.gather.T + layer.gather_offset


def forward(x: np.ndarray, weights: Weights) -> np.ndarray:
    """Encodes rows of equally many vectors, shape (rows, vectors, width)."""
    places = np.minimum(np.arange(x.shape[1]), len(weights.positions) - 1)
    x = x + weights.positions[places]
    for layer in weights.layers:
        x = _norm(x + _attention(x, layer, weights.heads), *layer.norms[:2])
        inner = np.maximum(x @ layer.widen.T + layer.widen_offset, 0)
        x = _norm(x + inner @ layer.narrow.T + layer.narrow_offset, *layer.norms[2:])
    return x @ weights.projection.T + weights.projection_offset


def encode_stacked(vectors: np.ndarray, counts: np.ndarray, weights: Weights) -> np.ndarray:
    """Encodes stacked vectors, ``counts`` of them for each row."""
    out = np.empty(vectors.shape)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int) if len(counts) else np.zeros(0, int)
    for n in np.unique(counts[counts > 0]):
        rows = np.flatnonzero(counts == n)
        step = max(1, HELD // int(n * max(vectors.shape[1] * 4, n * weights.heads)))
        for at in range(0, len(rows), step):
            places = starts[rows[at : at + step], None] + np.arange(n)
            out[places] = forward(vectors[places], weights)
    return out


def encode(df: DataFrame, weights: Weights, columns: Sequence[str] = ("vectors",)) -> DataFrame:
    """Replaces columns of vectors by their encodings; rows without vectors keep none. Any other columns pass."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    schema = StructType([StructField(f.name, ArrayType(ArrayType(DoubleType()))) if f.name in columns else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name in columns:
                    raw, counts = vector_matrix(column)
                    if raw.shape[1] not in (0, shared.value.projection.shape[0]):
                        raise ValueError("vectors and weights differ in width")
                    flat = encode_stacked(raw, counts, shared.value) if len(raw) else np.zeros((0, 1))
                    column = listed(vectors_column(flat, pa.float64()), counts)
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return df.mapInArrow(run, schema)
