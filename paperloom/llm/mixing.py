"""Mixes sources to target shares by systematic sampling.

Within a source, documents stand in order of size; each takes up its expected number of copies
on a line, one after the other. With one random offset per source, a document is emitted once for
each whole number its piece of the line crosses. So a source's copies differ from its expectation
by less than one, and its words by about one document's words, as neighbours have like sizes.

Places in the order come from a range-partitioned sort: a row's place in its partition plus the
rows of its source in earlier partitions. No source's rows ever meet in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
repeated rows count each; an empty table stays empty; a source without words gets no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.llm.native import word_list
from paperloom.llm.tables import stored

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"


def n_words(text: str) -> Column:
    return F.size(word_list(text)).cast("long")


def placed(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``place``, the 0-based position within ``group`` by ``order``; nulls stand last."""
    by = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    rows = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33).alias("part")
    blocks = rows.groupBy(part, *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).toDF(
        "b_part", *[f"b_{c}" for c in group], "first", "n", "before"
    )
    blocks = stored(blocks, "blocks")
    match = F.col("b_part") == F.shiftright("at", 33)
    for c in group:
        match = match & F.col(f"b_{c}").eqNullSafe(F.col(c))
    return rows.join(blocks, match).select(*df.columns, (F.col("at") - F.col("first") + F.col("before")).alias("place"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    A level is a target per unit of weight. Sources whose limit lies below the level are held at
    it and the rest is shared anew, which lifts the level, until no further source is above.
    """
    cap = F.col("source_size") * LIMIT
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    table = stored(placed(sizes, [], ["source"], "sources").select("source", "source_size", weight.alias("weight"), cap.alias("cap")), "weights")
    level, last = 0.0, -1.0
    while level != last:
        held = F.col("cap") < F.lit(level) * F.col("weight")
        total, used, free = table.agg(
            F.sum("source_size"), F.sum(F.when(held, F.col("cap")).otherwise(0)), F.sum(F.when(held, 0).otherwise(F.col("weight")))
        ).first()
        last, level = level, (total - used) / free if free else level
    share = F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double"))
    return table.select("source", "source_size", share.alias("target"))


def planned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, size, source_size, target, copies), row a struct of the columns to keep."""
    sized = docs.select(
        F.struct(*keep).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size")
    )
    lined = placed(sized, ["source"], ["size", "doc_id"], "line")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    goals = stored(goals.withColumnRenamed("source", "g_source"), "targets")
    key = F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(SEED)))
    offset = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    end = F.floor(rate * (F.col("place") + 1) + offset) - F.floor(rate * F.col("place") + offset)
    return lined.join(goals, F.col("source").eqNullSafe(F.col("g_source"))).select("row", "size", "source_size", "target", end.cast("int").alias("copies"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, copies counted)."""
    return planned(docs, ["doc_id"]).select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document's row as often as it is taken."""
    out = planned(docs, docs.columns).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
