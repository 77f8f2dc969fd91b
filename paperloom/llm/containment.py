"""Finds short texts inside long ones: MinHash over windows, then exact shingle containment.

Everything is Spark expressions. Items (the short texts) fall into size classes: at most 16, 32,
64, ... shingles. For a class of at most U shingles a document is covered by windows of 1.5 U
shingles, one at every U / 2, so each run of U shingles lies whole in one of them; each window and
each item has ``hashes`` MinHash values, and an item meets a document where one value is equal
(bands of one row). An item of T shingles with 0.8 T of them in a window has a similarity of at
least 0.8 T / (1.5 U + 0.2 T) with it: over 0.25 from T = 10 on, so that with 20 values the chance to
meet is over 0.996 (exact runs: over 0.9996).
Items of up to ``FEW`` distinct shingles are met for certain: at 0.8 none of up to four may be
missing, and one of five to nine, so a document that holds the item holds one of any one or two of
its shingles. These are its values, met by windows of a single shingle. Values of a document count
once.

The low bits of a shingle's hash put it into one of ``BINS`` bins, and each bin has its own share
of the values, so a shingle enters only those. A value is the least of ``hash XOR constant``:
hashes are uniform, so each constant ranks them by nearness to itself and picks each shingle alike.
Minima of blocks give those of windows, and windows of one class those of the next.

Items of fewer words than a shingle are one run of their own length, met by equality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.rows import hold
from paperloom.llm.native import run_hashes, word_hashes
from paperloom.llm.tables import stored

SHINGLE = 5
CONTAINED = 0.8
FEW, SMALLEST = 9, 16
BINS = 4
# Item values that may be sent to every task: 24 bytes each, 24 MB at most. Beyond it both sides are shuffled.
BROADCAST_VALUES = 1_000_000


def _constants(hashes: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(hashes)), lambda i: F.xxhash64(i, F.lit("constant")))


def _bins(blocks: Column) -> Column:
    """Per bin, the shingles of each block that belong to it."""
    return F.transform(
        F.array(*[F.lit(b).cast("long") for b in range(BINS)]),
        lambda b: F.transform(blocks, lambda block: F.filter(block, lambda x: x.bitwiseAND(F.lit(BINS - 1).cast("long")) == b)),
    )


def _minima(bins: Column, constants: Column, shape: Callable[[Column], Column]) -> Column:
    """Per bin and constant, the minimum of each block, null for none."""
    least = lambda blocks, c: F.transform(blocks, lambda block: F.array_min(F.transform(block, lambda x: x.bitwiseXOR(c))))
    return F.flatten(F.transform(bins, lambda blocks: F.transform(constants, lambda c: shape(least(blocks, c)))))


def _size_class(n: Column, distinct: Column) -> Column:
    above = F.greatest(F.lit(SMALLEST), F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int"))
    return F.when(distinct <= FEW, 1).otherwise(above)


def item_table(items: DataFrame, words: Column, hashes: int) -> DataFrame:
    """(item_id, length, class, set, values): shingle length, size class, shingles, MinHash values."""
    listed = hold(items.select("item_id", words.alias("w")), h=word_hashes("w")).where("size(h) > 0")
    length = F.least(F.size("h"), F.lit(SHINGLE))
    own_runs = F.coalesce(*[F.when(length == n, run_hashes(n)) for n in range(1, SHINGLE + 1)])
    rows = hold(listed, length=length, sh=own_runs, set=F.array_distinct(own_runs))
    # one more than may be missing
    single = F.slice(F.array_sort("set"), 1, F.when(F.size("set") <= 4, 1).otherwise(2))
    values = F.array_compact(_minima(_bins(F.array("sh")), _constants(hashes // BINS), lambda m: m[0]))
    return stored(
        rows.select(
            "item_id",
            "length",
            _size_class(F.size("sh"), F.size("set")).alias("class"),
            "set",
            F.when(F.col("length") < SHINGLE, F.col("sh")).when(F.size("set") <= FEW, single).otherwise(values).alias("values"),
        ),
        "items",
    )


def _document_values(docs: DataFrame, words: Column, kinds: set[tuple[int, int]], hashes: int, singles: Column | None) -> DataFrame:
    """(doc_id, values): what the windows of the classes in use can meet.

    Windows of a single shingle give as many values as there are words; where the items' values of that
    kind are few, ``singles`` holds them, and only values among them go on.
    """
    met = lambda values: values if singles is None else F.array_intersect(values, singles)
    df = hold(docs.select("doc_id", words.alias("w")), h=word_hashes("w")).drop("w")

    lists = [run_hashes(length) for length, _ in sorted(kinds) if length < SHINGLE]
    classes = {u for length, u in kinds if length == SHINGLE}
    if not classes:
        return df.select("doc_id", met(F.flatten(F.array(*lists))).alias("values")) if lists else df.select("doc_id", F.array().cast("array<long>").alias("values"))
    df = hold(df, sh=run_hashes(SHINGLE), short=F.flatten(F.array(*lists)) if lists else F.array().cast("array<long>")).drop("h")
    out = []
    if lists or 1 in classes:
        df = hold(df, single=met(F.concat("short", "sh") if 1 in classes else F.col("short"))).drop("short")
        out.append(F.col("single"))
    wide = sorted(classes - {1})
    if wide:
        # blocks of half the smallest class; three make its window
        block = wide[0] // 2
        n_blocks = F.ceil(F.size("sh") / block).cast("int")
        blocks = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice("sh", b * block + 1, block))).otherwise(
            F.array().cast("array<array<long>>")
        )
        df = hold(df, bins=_bins(blocks), constants=_constants(hashes // BINS)).drop("sh")
        # level[k][i]: minimum k of the block at step i
        df = hold(df, level=_minima(F.col("bins"), F.col("constants"), lambda m: m)).drop("bins", "constants")
        triples = F.transform("level", lambda m: F.transform(m, lambda x, i: F.least(x, F.get(m, i + 1), F.get(m, i + 2))))
        size, df = wide[0], hold(df, **{f"at_{wide[0]}": triples}).drop("level")
        while size < wide[-1]:
            wider = F.transform(
                f"at_{size}",
                lambda m: F.when(
                    F.size(m) > 0,
                    F.transform(
                        F.sequence(F.lit(0), F.floor((F.size(m) - 1) / 2).cast("int")), lambda i: F.least(F.get(m, i * 2), F.get(m, i * 2 + 3))
                    ),
                ).otherwise(F.array().cast("array<long>")),
            )
            df = hold(df, **{f"at_{size * 2}": wider})
            if size not in classes:
                df = df.drop(f"at_{size}")
            size *= 2
        out += [F.flatten(f"at_{u}") for u in wide]
    # a null, the value of an empty bin, meets nothing
    return df.select("doc_id", F.array_distinct(F.concat(*out)).alias("values"))


def contained(docs: DataFrame, doc_words: Column, items: DataFrame, item_words: Column, hashes: int = 20) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) where a document holds 0.8 of an item's shingles.

    ``docs`` has doc_id and text, ``items`` item_id and text. Rows with a null id are left out, as
    are items without words; repeated ids count as one document or item, the best row standing.
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    table = item_table(items.select("item_id", "text").where("item_id IS NOT NULL"), item_words, hashes)
    kinds = {(r["length"], r["class"]) for r in table.select("length", "class").distinct().collect()}  # at most 4 + log2 of the longest item
    values, singles = table.select("item_id", F.explode("values").alias("value")).distinct(), None
    if table.agg(F.coalesce(F.sum(F.size("values")), F.lit(0))).first()[0] <= BROADCAST_VALUES:
        values = F.broadcast(values)
        one = table.where((F.col("length") < SHINGLE) | (F.col("class") == 1)).select(F.explode("values").alias("value"))
        singles = one.agg(F.collect_set("value")).scalar()
    met = _document_values(docs, doc_words, kinds, hashes, singles).select("doc_id", F.explode("values").alias("value"))
    pairs = stored(met.join(values, "value").select("doc_id", "item_id").distinct(), "met")
    lengths = sorted({length for length, _ in kinds}) or [SHINGLE]
    texts = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    found = hold(texts, h=word_hashes(doc_words)).drop("text")
    found = hold(found, **{f"runs_{n}": F.array_distinct(run_hashes(n)) for n in lengths}).drop("h")
    own = F.coalesce(*[F.when(F.col("length") == n, F.col(f"runs_{n}")) for n in lengths])
    shared = F.size(F.array_intersect("set", own))
    both = found.join(pairs, "doc_id").join(table.select("item_id", "length", "set"), "item_id")
    scored = both.select("doc_id", "item_id", shared.alias("shared"), F.size("set").alias("item_shingles"))
    return (
        scored.where(F.col("shared") >= F.lit(CONTAINED) * F.col("item_shingles"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("shared").cast("long").alias("shared"), F.max("item_shingles").cast("long").alias("item_shingles"))
    )
