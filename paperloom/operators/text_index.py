"""Text filters through a stored index: which blocks of papers can hold a text.

Papers are dealt into blocks. The index has, for each gram, bitmaps of the blocks that hold it: byte
trigrams of the text for substring filters, hashed words for filters on whole words. A filter's text can
stand only where all its grams do, so its bitmaps are unpacked and brought together by AND, and only papers of the
blocks that are left are read and tested by ``filters.text_match``'s rule. A text of fewer than three
bytes has no trigram: the gram that every block holds leaves all of them. The answer is that of reading every paper.

A bitmap has 4,096 bytes, however few blocks hold its gram, so no shuffle or sort holds bitmaps: pairs of
gram and block are sorted and become bitmaps one after the other, and a stored one with few blocks is packed.

Filters are rows, so that one search answers any number of them: (query_id, texts, any), where ``any``
asks for one of the texts and else for all. Papers with a null text pass no filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom.functions.matrices import listed
from paperloom.operators.filters import words
from paperloom.session import stored

PAPERS_PER_BLOCK = 64
MODES = ("substring", "token")
# The gram that every block holds, for texts that have none.
EVERY = -1
BITMAP_BYTES = 4096


@dataclass(frozen=True)
class TextIndex:
    """``papers`` has the columns of the indexed table and ``block``; ``grams`` has (gram, bucket, bits), the bits packed."""

    papers: DataFrame
    grams: DataFrame
    text: str
    mode: str


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different byte trigrams of each text."""
    for batch in batches:
        found = []
        for t in batch.column("text").to_pylist():
            raw = np.frombuffer((t or "").encode(), np.uint8).astype(np.int64)
            found.append(np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) if len(raw) > 2 else np.zeros(0, np.int64))
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        grams = listed(pa.array(flat), np.array([len(x) for x in found], np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, grams], names=[*batch.schema.names, "grams"])


def _with_grams(rows: DataFrame, mode: str) -> DataFrame:
    """Rows (..., text) with the grams of the text."""
    if mode not in MODES:
        raise ValueError(f"unknown text mode {mode!r}")
    if mode == "token":
        return rows.withColumn("grams", F.transform(F.array_distinct(words(F.coalesce("text", F.lit("")))), lambda w: F.xxhash64(w)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_trigrams, f"{fields}, grams array<bigint>")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps in fewer bytes: the places of the set bits, two bytes each, where that is shorter."""
    for batch in batches:
        bits = []
        for raw in batch.column("bits").to_pylist():
            at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))
            bits.append(raw if 2 * len(at) >= BITMAP_BYTES else at.astype("<u2").tobytes())
        yield batch.set_column(batch.schema.get_field_index("bits"), "bits", pa.array(bits, pa.binary()))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = []
        for raw in batch.column("bits").to_pylist():
            if len(raw) < BITMAP_BYTES:
                whole = np.zeros(8 * BITMAP_BYTES, np.uint8)
                whole[np.frombuffer(raw, "<u2")] = 1
                raw = np.packbits(whole, bitorder="little").tobytes()
            bits.append(raw)
        yield batch.set_column(batch.schema.get_field_index("bits"), "bits", pa.array(bits, pa.binary()))


def build(papers: DataFrame, root: str, text: str, key: str = "paperId", mode: str = "substring") -> TextIndex:
    """Writes the index of a text column below ``root`` and opens it."""
    spark = papers.sparkSession
    # a count of blocks, so that a block's papers are few whatever the table's size
    blocks = papers.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PAPERS_PER_BLOCK))).scalar()
    dealt = papers.withColumn("block", (F.pmod(F.xxhash64(key), blocks) + 1).cast("int"))
    dealt.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{root}/papers")
    dealt = spark.read.schema(dealt.schema).parquet(f"{root}/papers")
    rows = _with_grams(dealt.select("block", F.col(text).alias("text")), mode).select("block", F.explode(F.concat("grams", F.array(F.lit(EVERY).cast("bigint")))).alias("gram")).distinct()
    # small rows are dealt and sorted; a partition then builds its bitmaps one after the other
    placed = rows.withColumn("bucket", F.bitmap_bucket_number("block")).repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket")
    bits = placed.groupBy("gram", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("block")).alias("bits"))
    bits.mapInArrow(_packed, bits.schema).write.mode("overwrite").parquet(f"{root}/grams")
    return open_index(spark, root, text, mode)


def open_index(spark: SparkSession, root: str, text: str, mode: str = "substring") -> TextIndex:
    return TextIndex(spark.read.parquet(f"{root}/papers"), spark.read.parquet(f"{root}/grams"), text, mode)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks whose bits are set: bit p of bucket b, both as Spark numbers them, is block ``(b - 1) * bits + p + 1``."""
    for batch in batches:
        for row in range(batch.num_rows):
            bits = np.unpackbits(np.frombuffer(batch.column("bits")[row].as_buffer(), np.uint8), bitorder="little")
            at = np.flatnonzero(bits) + (batch.column("bucket")[row].as_py() - 1) * len(bits) + 1
            n = len(at)
            columns = [pa.array([batch.column(c)[row].as_py()] * n, batch.schema.field(c).type) for c in ("query_id", "nth")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32))], names=["query_id", "nth", "block"])


def candidates(index: TextIndex, filters: DataFrame) -> DataFrame:
    """(query_id, block): the blocks whose papers may pass each filter."""
    asked = filters.select("query_id", "any", F.size("texts").alias("n_texts"), F.posexplode("texts").alias("nth", "text"))
    grams = _with_grams(asked, index.mode)
    grams = grams.withColumn("grams", F.when(F.size("grams") == 0, F.array(F.lit(EVERY).cast("bigint"))).otherwise(F.col("grams")))
    wanted = grams.select("query_id", "nth", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
    # written, so that the planner knows its size and does not shuffle the index for a few filters
    hit = stored(wanted, "wanted").join(index.grams, "gram")
    met = hit.mapInArrow(_unpacked, hit.schema).groupBy("query_id", "nth", "bucket").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"), F.first("n_grams").alias("n_grams")
    )
    whole = met.where("n = n_grams").select("query_id", "nth", "bucket", "bits")
    kind = filters.schema["query_id"].dataType.simpleString()
    held = whole.mapInArrow(_blocks, f"query_id {kind}, nth int, block int")
    counts = held.groupBy("query_id", "block").agg(F.count_distinct("nth").alias("n"))
    return counts.join(filters.select("query_id", "any", F.size("texts").alias("n_texts")), "query_id").where("any OR n = n_texts").select("query_id", "block")


def passes(text: Column, texts: Column, any_text: Column, mode: str) -> Column:
    """Whether a text passes a filter that is data."""
    own = words(text)
    holds = (lambda t: F.contains(text, t)) if mode == "substring" else (lambda t: F.size(F.array_except(words(t), own)) == 0)
    return F.when(any_text, F.exists(texts, holds)).otherwise(F.forall(texts, holds))


def search(index: TextIndex, filters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The papers that pass each filter (query_id and the table's columns), and (query_id, blocks_read, blocks)."""
    blocks = stored(candidates(index, filters), "blocks")
    asked = stored(blocks.join(filters.select("query_id", "texts", "any"), "query_id"), "asked")
    met = index.papers.join(asked, "block").where(passes(F.col(index.text), F.col("texts"), F.col("any"), index.mode))
    total = index.papers.agg(F.count_distinct("block").alias("n")).scalar()
    read = filters.select("query_id").join(blocks.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    report = read.select("query_id", F.coalesce("n", F.lit(0)).alias("blocks_read"), total.alias("blocks"))
    return met.drop("block", "texts", "any"), report
