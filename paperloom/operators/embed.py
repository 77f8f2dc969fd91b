"""Embedding texts with an encoder the user supplies.

An encoder turns a list of texts into one vector per text. It is built once per task from
a factory, so model files load on the executor and never travel in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from paperloom.operators.search import mean_vector

Encoder = Callable[[Sequence[str]], np.ndarray]
BATCH_TEXTS = 64


def hashed_words(width: int = 256) -> Callable[[], Encoder]:
    """The default encoder: counts of hashed words, so jobs run without model files."""

    def factory() -> Encoder:
        def encode(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for i, text in enumerate(texts):
                slots = [zlib.crc32(w.encode()) % width for w in text.lower().split()]
                np.add.at(out[i], slots, 1.0)
            return out

        return encode

    return factory


def letter_counts(letters: str = "abcdefghijklmnop") -> Callable[[], Encoder]:
    """An encoder that any engine can repeat: how often each of some letters stands in the text."""

    def factory() -> Encoder:
        return lambda texts: np.array([[t.count(c) for c in letters] for t in texts], np.float64).reshape(len(texts), len(letters))

    return factory


def embed_texts(df: DataFrame, text: str, encoder: Callable[[], Encoder], prefix: str = "", suffix: str = "") -> DataFrame:
    """Adds ``embedding``. Rows are sorted by length inside a partition so model batches pad little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = [prefix + (t or "") + suffix for t in batch.column(text).to_pylist()]
            parts = [encode(texts[i : i + BATCH_TEXTS]) for i in range(0, len(texts), BATCH_TEXTS)]
            vectors = pa.array(list(np.concatenate(parts).astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, "embedding"])

    ordered = df.sortWithinPartitions(F.length(text))
    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return ordered.mapInArrow(run, schema)


def masked_mean(tokens: DataFrame, key: str, mask: str) -> DataFrame:
    """Mean of token vectors over the masked-in tokens; ``tokens`` has the key, embedding and mask."""
    return mean_vector(tokens, (key,), weight=mask)
