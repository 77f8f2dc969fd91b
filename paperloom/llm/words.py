"""Words of Arrow text columns as hashed numpy arrays, for operators that run on Arrow batches.

A word is a run of bytes outside space and ``\\x09-\\x0D``; those are ASCII, so splitting the
UTF-8 bytes equals splitting the text. Hashes are differences of prefix sums: one pass over
the bytes, no Python object per word. Batches are cut into pieces of about ``PIECE`` bytes so
that temporary arrays stay small; a longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
# Two unrelated families, so that a pair of hashes is a 128-bit name.
_BASE = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_TABLE = tuple(np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1) for seed in (17, 71))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Piece(NamedTuple):
    """Some rows of a batch. ``text`` holds their bytes, ``rows`` the byte bounds of each row,
    ``start``/``end`` the byte bounds of each word, ``of`` the word bounds of each row."""

    first: int
    text: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.of)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if family not in _powers or len(_powers[family][0]) < n:
        size, base = max(n, PIECE + 1), _BASE[family]
        _powers[family] = tuple(np.cumprod(np.full(size, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    up, down = _powers[family]
    return up[:n], down[:n]


def pieces(column: pa.Array, folded: np.ndarray | None = None, size: int = PIECE) -> Iterator[Piece]:
    """Cuts a string column, nulls as empty texts, into pieces with their words found.

    ``folded`` maps each byte to the one that stands for it; ``size`` is that of a piece in bytes.
    """
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    bounds = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        rows = bounds[first : last + 1] - bounds[first]
        text = data[bounds[first] : bounds[last]]
        if folded is not None:
            text = folded[text]
        inside = ~_SPACE[text]
        fresh = np.ones(len(text) + 1, bool)  # a word may start here: a blank or a row bound stands before
        fresh[1:] = ~np.append(inside, False)[:-1]
        fresh[rows] = True
        start = np.flatnonzero(inside & fresh[:-1])
        over = np.append(~inside[1:], True) if len(text) else np.zeros(0, bool)
        over[rows[1:-1][rows[1:-1] > 0] - 1] = True
        end = np.flatnonzero(inside & over) + 1
        yield Piece(first, text, rows, start, end, np.searchsorted(start, rows))
        first = last


def hash_words(p: Piece, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = _power(len(p.text) + 1, family)
    sums = np.zeros(len(p.text) + 1, np.uint64)
    np.cumsum(_TABLE[family][p.text] * up[:-1], out=sums[1:])
    return mix((sums[p.end] - sums[p.start]) * down[p.start])


def hash_runs(words: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive words, also across rows."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _power(len(words) + 1, family)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1] + _U(n))


def within(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``n`` words that lie in one row, and the bounds of each row's runs."""
    counts = np.maximum(np.diff(of) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(bounds[-1]) - bounds[row] + of[row], bounds


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a run of ``n`` that starts at one of ``starts``."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + n, total), -1)
    return np.cumsum(steps[:-1]) > 0
