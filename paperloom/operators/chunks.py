"""Sentence-packed overlapping chunks.

Everything happens inside the paper's row: sentences become one flat token array,
a fold over sentence lengths finds where chunks end, and chunks and their context
windows are slices of that array. No shuffle, no window function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.rows import hold
from paperloom.functions.text import strip

# Chunking defaults and prompts of the e5 model family.
CHUNK_SIZE = 170
SPARE_TOKENS = 5
MODEL_MAX_TOKENS = 512
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])"
ROLE_PREFIXES = {"document": "passage: ", "query": "query: "}


def sentences(text: Column) -> Column:
    """Sentences: text cut at white space after .!? and before a capital, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), strip), lambda s: s != "")


def whitespace_tokens(sentence: Column) -> Column:
    """Tokens of a trimmed, non-empty sentence."""
    return F.split(sentence, r"\s+")


def split_long(token_lists: Column, max_len: int) -> Column:
    """Token lists longer than ``max_len`` cut into equal slices."""
    cut = lambda t: F.transform(
        F.sequence(F.lit(0), F.size(t) - 1, F.lit(max_len)), lambda i: F.slice(t, i + 1, F.lit(max_len))
    )
    return F.flatten(F.transform(token_lists, lambda t: F.when(F.size(t) > max_len, cut(t)).otherwise(F.array(t))))


def chunk_ends(lengths: Column, limit: int, max_chunks: int | None = None) -> Column:
    """Where chunks end in the flat token array: sentences are added while the total stays under ``limit``.

    With ``max_chunks`` the search ends two chunks behind it.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("ends"), F.lit(0).alias("cur"), F.lit(0).alias("pos")
    )

    def add(acc: Column, n: Column) -> Column:
        fits = acc["cur"] + n < limit
        closed = F.when(fits | (acc["cur"] == 0), acc["ends"]).otherwise(F.concat(acc["ends"], F.array(acc["pos"])))
        grown = F.struct(
            closed.alias("ends"),
            F.when(fits, acc["cur"] + n).otherwise(n).alias("cur"),
            (acc["pos"] + n).alias("pos"),
        )
        return grown if max_chunks is None else F.when(F.size(acc["ends"]) > max_chunks + 2, acc).otherwise(grown)

    def close(acc: Column) -> Column:
        open_chunk = acc["cur"] > 0
        if max_chunks is not None:
            open_chunk = open_chunk & (F.size(acc["ends"]) < max_chunks + 2)
        return F.when(open_chunk, F.concat(acc["ends"], F.array(acc["pos"]))).otherwise(acc["ends"])

    return F.aggregate(lengths, start, add, close)


def windows(tokens: Column, ends: Column, max_chunks: int | None, prefix_len: int) -> Column:
    """Each chunk with its neighbours: one on both sides, two after the first, two before the last."""
    n = F.size(ends)
    end = lambda i: F.get(ends, i)
    begin = lambda i: F.when(i <= 0, F.lit(0)).otherwise(F.get(ends, i - 1))

    def window(i: Column) -> Column:
        first, last = i == 0, i == n - 1
        lo = F.when(first, F.lit(0)).when(last, begin(i - 2)).otherwise(begin(i - 1))
        hi = F.when(first, end(F.least(F.lit(2), n - 1))).when(last, end(i)).otherwise(end(i + 1))
        core = begin(i) - lo + prefix_len
        return F.struct(
            i.alias("chunk_idx"),
            F.array_join(F.slice(tokens, lo + 1, hi - lo), " ").alias("text"),
            F.least(core, F.lit(MODEL_MAX_TOKENS)).alias("core_start"),
            F.least(core + end(i) - begin(i), F.lit(MODEL_MAX_TOKENS)).alias("core_end"),
        )

    count = n if max_chunks is None else F.least(n, F.lit(max_chunks + 1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), window)).otherwise(
        F.array().cast("array<struct<chunk_idx:int,text:string,core_start:int,core_end:int>>")
    )


def chunk_papers(
    papers: DataFrame,
    text_column: str = "main_text",
    chunk_size: int = CHUNK_SIZE,
    max_chunks: int | None = None,
    prefix_len: int = 0,
    drop_single: bool = False,
    min_sentence_tokens: int = 0,
    tokenise: Callable[[Column], Column] = whitespace_tokens,
) -> DataFrame:
    """One row per chunk with all paper fields, the chunk text, its core span and ``is_ref`` = false.

    By default the chunks hold every token of the text. ``max_chunks`` cuts long texts,
    ``drop_single`` leaves out papers of one chunk, and shorter sentences than
    ``min_sentence_tokens`` are left out of the chunks.
    """
    token_lists = split_long(F.transform(sentences(F.col(text_column)), tokenise), chunk_size - prefix_len - SPARE_TOKENS)
    if min_sentence_tokens > 1:
        token_lists = F.filter(token_lists, lambda t: F.size(t) >= min_sentence_tokens)
    d = hold(papers, _s=token_lists)
    ends = chunk_ends(F.transform("_s", F.size), chunk_size - prefix_len, max_chunks)
    d = hold(d, _t=F.flatten("_s"), _e=ends)
    spans = windows(F.col("_t"), F.col("_e"), max_chunks, prefix_len)
    if drop_single:
        spans = F.when(F.size("_e") > 1, spans)
    d = d.withColumn("_w", spans)
    return d.select(*papers.columns, F.inline("_w"), F.lit(False).alias("is_ref"))


def with_role_prefix(text: Column, model: str, role: str) -> Column:
    prefix = ROLE_PREFIXES.get(role.lower(), " ") if "e5" in model else " "
    return F.concat(F.lit(prefix), text)
