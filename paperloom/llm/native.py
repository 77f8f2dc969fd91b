"""Words and shingles of texts as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = "[\\x20\\x09-\\x0D]+"


def word_list(text: str | Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def run_hashes(n: int, h: str = "h") -> Column:
    """The hashes of all runs of ``n`` elements of a column of word hashes, none if there are fewer."""
    every = F.transform(h, lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    return F.slice(every, 1, F.greatest(F.lit(0), F.size(h) - (n - 1)))


def word_hashes(words: Column | str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))
