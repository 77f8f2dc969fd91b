"""Benchmark items inside documents.

An item is found where a document holds at least 0.8 of its five-word shingles. Items go into size
classes and documents into windows as long as the class needs; MinHash values bring them together
and exact containment decides (see ``containment``). All of it is Spark expressions.

Defined results: null texts and items have no words and are never found; rows with a null id are
not reported and stay; items of one to four words are found as a run of their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.llm.containment import contained
from paperloom.llm.native import word_list


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) of each benchmark item in each document."""
    return contained(docs, word_list("text"), benchmark, word_list("text"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(found, docs["doc_id"] == found["__leak"], "left_anti")
