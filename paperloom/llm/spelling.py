"""Spelling variants: words one code point apart, found in a dictionary of pairs of trie nodes.

The vocabulary is sorted twice, by the words and by the words read backwards. In a sorted list a
trie needs no pointers: a word keeps the nodes of its common prefix with the word before it and
opens a new node for every further code point. So each range partition numbers its part of the
trie in one pass, and what the passes cannot see - nodes that began in an earlier partition - is
mended from one row per partition (``_leads``). A word of length L then has L + 1 prefix nodes and
L + 1 suffix nodes, and each pair of integers (prefix node, suffix node) names a word with a gap:

* *skipped* at i: prefix of length i, suffix from i + 1. Two words with one skipped pair differ in
  exactly the code point at i.
* *inserted* at i: prefix of length i, suffix from i, which is the word itself. A skipped pair of
  another word that equals it is that word with the code point at i taken out. In a run of equal
  code points only the first is taken out, so that a pair of words meets once.

Words that share a skipped pair differ in one code point of the alphabet, so a pair's group holds
at most one word per letter (90) and the word without it, whatever the corpus. Within a group the
counts and the best partner come from the group's order; pairs of words are never rows.

A word's form is its near word of largest count, if that is at least twice its own. Counts at
least double along a chain of forms, so pointer jumping ends within seven rounds.

Defined results: a null text has no words; with a null doc_id no code point is deleted; rows with
one doc_id count as they stand; an empty vocabulary gives no rows; a run of any length is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.llm.tables import stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = 97
SHORTEST, LEAST, FACTOR = 5, 3, 2
# A node's number is its partition's number and a counter of so many bits; the root is 0.
_BITS = 40


def lowered(run: Column) -> Column:
    """A-Z in lower case, letters beyond ASCII as they are."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n): the words of at least ``shortest`` code points that occur ``least`` times.

    Counts are combined in the tasks that read the texts, so that what is shuffled is the
    vocabulary of each task, whatever a word's share of the corpus.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # a shorter run is too short with a code point deleted as well
    runs = runs.where(F.length("run") >= shortest).select("doc_id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % every == 0, cut).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the trie nodes of one sorted partition; ``nodes[d]`` is the node of the first d code points."""
    part = TaskContext.get().partitionId()
    used, before, path, place = part << _BITS, "", [0], 0
    for batch in batches:
        out = []
        for word in batch.column("key").to_pylist():
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            fresh = len(word) - same
            path = path[: same + 1] + list(range(used + 1, used + fresh + 1))
            used, before = used + fresh, word
            out.append(path)
        n = batch.num_rows
        spots = pa.array(range((part << _BITS) + place, (part << _BITS) + place + n), pa.int64())
        place += n
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("key"), pa.array([part] * n, pa.int32()), spots, pa.array(out, pa.list_(pa.int64()))],
            names=["word", "key", "part", "spot", "nodes"],
        )


def _shared(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _leads(ends: list) -> list[tuple[int, list[int]]]:
    """Per partition, the true numbers of the nodes its first word shares with the partition before.

    ``ends`` has one row per partition: its first and last word and the nodes of both.
    """
    leads, before = [], None
    for row in sorted(ends, key=lambda r: r["part"]):
        depth = _shared(before[0], row["first"]) if before else 0
        true = before[1][1 : depth + 1] if before else []
        leads.append((row["part"], true))
        # the last word's nodes, where they are among the first word's shared ones, are the true ones too
        own = [true[d - 1] if 0 < d <= depth and x == row["opened"][d] else x for d, x in enumerate(row["nodes"])]
        before = row["last"], own
    return leads


def numbered(words: DataFrame, key: Column, name: str, parts: int | None = None) -> DataFrame:
    """(word, spot, nodes): the trie nodes of each word's ``key``, and the word's place in the order of keys."""
    keyed = words.select("word", key.alias("key"))
    # a given number, as numbering costs more than the few bytes by which small partitions are merged
    parts = parts or int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, "key").sortWithinPartitions("key")
    local = stored(ranged.mapInArrow(_number, "word string, key string, part int, spot long, nodes array<long>"), name)
    # one row for each partition of the sort
    ends = local.groupBy("part").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.min_by("nodes", "spot").alias("opened"), F.max_by("nodes", "spot").alias("nodes")
    )
    leads = local.sparkSession.createDataFrame(_leads(ends.collect()), "part int, lead array<long>")
    base = F.shiftleft(F.col("part").cast("long"), _BITS)
    true = F.transform("nodes", lambda x, d: F.when((d > 0) & (d <= F.size("lead")) & (x == base + d), F.get("lead", d - 1)).otherwise(x))
    return local.join(F.broadcast(leads), "part").select("word", "spot", F.when(F.size("lead") > 0, true).otherwise(F.col("nodes")).alias("nodes"))


def pair_dictionary(words: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The words (word, n, id) in code-point order of ids, and the rows (id, n, prefix, suffix, skipped, first).

    ``first`` marks skipped positions that begin a run of equal code points.
    """
    forward = numbered(words, F.col("word"), "prefixes", parts)
    backward = numbered(words, F.reverse("word"), "suffixes", parts)
    both = forward.join(backward.select("word", F.reverse("nodes").alias("ends")), "word").join(words, "word")
    both = stored(both.select("word", "n", F.col("spot").alias("id"), "nodes", "ends"), "nodes")
    gaps = both.select("id", "n", "word", "nodes", "ends", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    here, last = F.col("i"), F.length("word")
    letter = lambda at: F.substring(F.col("word"), at, F.lit(1))
    inserted = F.struct(F.get("nodes", here).alias("prefix"), F.get("ends", here).alias("suffix"), F.lit(False).alias("skipped"), F.lit(False).alias("first"))
    skipped = F.struct(
        F.get("nodes", here).alias("prefix"),
        F.get("ends", here + 1).alias("suffix"),
        F.lit(True).alias("skipped"),
        ((here == 0) | (letter(here) != letter(here + 1))).alias("first"),
    )
    rows = gaps.select("id", "n", F.inline(F.when(here < last, F.array(inserted, skipped)).otherwise(F.array(inserted))))
    return both.select("word", "n", "id"), rows


def near_words(rows: DataFrame) -> DataFrame:
    """(id, n_near, best): how many near words each word with any has, and the one of largest count, ties to the first."""
    # larger counts and smaller ids sort first
    me = F.struct((-F.col("n")).alias("less"), "id", "first")
    # most pairs have one row; the others are gathered where the count has put them
    met = rows.withColumn("rows", F.count("*").over(Window.partitionBy("prefix", "suffix"))).where("rows > 1")
    groups = met.groupBy("prefix", "suffix").agg(
        F.sort_array(F.collect_list(F.when(F.col("skipped"), me))).alias("members"),
        F.max(F.when(~F.col("skipped"), F.struct("id", "n"))).alias("whole"),
    )
    best = lambda m: F.when(m.isNotNull(), F.struct(m["less"].alias("less"), m["id"].alias("id")))
    at = F.col("m")
    top = F.get("members", F.lit(0))
    other = F.when(top["id"] == at["id"], F.get("members", F.lit(1))).otherwise(top)
    shorter = F.when(at["first"], F.col("whole"))
    shorter = F.when(shorter.isNotNull(), F.struct((-shorter["n"]).alias("less"), shorter["id"].alias("id")))
    each = groups.select("members", "whole", F.explode("members").alias("m")).select(
        at["id"].alias("id"),
        (F.size("members") - 1 + shorter.isNotNull().cast("int")).cast("long").alias("k"),
        F.least(best(other), shorter).alias("best"),
    )
    longer = F.filter("members", lambda m: m["first"])
    whole = groups.where(F.col("whole").isNotNull()).select(
        F.col("whole.id").alias("id"), F.size(longer).cast("long").alias("k"), best(F.get(longer, F.lit(0))).alias("best")
    )
    met = each.unionByName(whole).where("k > 0")
    return met.groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(id, root): where the chain of forms (id, form) that starts at each id ends."""
    at = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = stored(at.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = step.select("id", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of ``docs``."""
    words = stored(vocabulary(docs), "words")
    named, rows = pair_dictionary(words, parts)
    near = near_words(rows)
    near = stored(
        near.join(named, "id").select("id", "n_near", F.when(-F.col("best.less") >= FACTOR * F.col("n"), F.col("best.id")).alias("form")), "near"
    )
    roots = followed(near.where("form IS NOT NULL"))
    forms = named.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = named.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    linked = near.select("id", "n_near", F.col("form").alias("form_id")).join(roots.select("id", F.col("root").alias("root_id")), "id", "left")
    out = named.join(linked, "id", "left").join(forms, "form_id", "left").join(ends, "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
