"""Repeated passages across documents, by a compacted De Bruijn graph of word windows.

A window of ``WINDOW`` consecutive words is an edge of the graph, from its first to its last
``WINDOW - 1`` words. Only edges that can repeat enter it:

1. One pass per document finds, for each window, the smallest hash among its short runs of
   ``SEED`` words. Equal windows have the same smallest run, so a window whose smallest run
   stands in one document only cannot repeat. About one run in 22 is some window's smallest;
   these seeds are all that is shuffled for the whole corpus.
2. Documents with a repeated seed give the 128-bit names of the windows under it. An aggregate
   that combines before the shuffle finds for each edge the smallest document and its place
   there: the source coordinate.
3. Edges join their source. An edge whose predecessor has the predecessor of its source goes on
   the same path; where it has not the graph branches. Joins of the edges with themselves, one
   place on and one place back, leave the first and the last edge of each path, which become one
   row (document, start, length, source, source start).
4. A path's words are compared with those at its source coordinates, by a digest of the whole span
   that has nothing to do with the names; a path whose words differ is dropped. Inside a document
   windows of both names equal to a path's are repeats of it.

Documents with equal words have equal edges; only the one with the smallest id enters the graph.

Defined results: a null text has no words; a document with a null id neither loses words nor is
a source; rows with one doc_id are treated as one document's texts, none the other's source;
texts under 50 words have no window and stay; extra columns pass through ``cut_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from paperloom.llm.tables import stored
from paperloom.llm.words import Piece, covered, hash_runs, hash_words, pieces, within

WINDOW = 50
SEED = 8
_KEY = ["doc_id", "th"]
_PIECE = 1 << 19  # bytes of text worked on at a time


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text); th tells texts under one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each ``n`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == n else np.minimum(x[: len(x) - (n - span)], x[n - span :])


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_PROFILE = "doc_id long, th long, n_words long, sha string, seeds array<long>, at array<int>, span array<int>"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column("text"), size=_PIECE):
            n = len(p.rows) - 1
            starts, bounds = within(p.of, WINDOW)
            runs = hash_runs(hash_words(p), SEED)
            least = np.zeros(0, np.uint64)
            if len(starts):
                least = _smallest(runs, WINDOW - SEED + 1)[starts]
            new = np.ones(len(starts), bool)
            new[1:] = least[1:] != least[:-1]
            new[bounds[:-1][bounds[:-1] < len(starts)]] = True
            first = np.flatnonzero(new)
            row_of = np.searchsorted(bounds, first, "right") - 1
            cuts = np.searchsorted(row_of, np.arange(n + 1)).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(v))
                for v in (
                    least[first].view(np.int64),
                    (first - bounds[row_of]).astype(np.int32),
                    np.diff(np.append(first, len(starts))).astype(np.int32),
                )
            ]
            raw = p.text.tobytes()
            shas = [_sha(raw[a:b].split()) for a, b in zip(p.rows[:-1].tolist(), p.rows[1:].tolist())]
            ids = [batch.column(c).slice(p.first, n) for c in _KEY]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(p.n_words.astype(np.int64)), pa.array(shas), *lists],
                names=["doc_id", "th", "n_words", "sha", "seeds", "at", "span"],
            )


_EDGE = "h long, g long, doc_id long, th long, pos int"


def _names(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of all windows, with their starts and the bounds of each row's windows."""
    starts, bounds = within(p.of, WINDOW)
    h, g = (hash_runs(hash_words(p, f), WINDOW, f) for f in (0, 1))
    return h[starts] if len(starts) else h[:0], g[starts] if len(starts) else g[:0], starts, bounds


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different windows, each at its first place, that a document's ranges name."""
    for batch in batches:
        ranges = batch.column("ranges")
        for p in pieces(batch.column("text"), size=_PIECE):
            h, g, _, bounds = _names(p)
            for row in range(len(p.rows) - 1):
                lo, hi = bounds[row], bounds[row + 1]
                steps = np.zeros(hi - lo + 1, np.int64)
                own = ranges[p.first + row].values
                at, span = (np.asarray(own.field(i)) for i in (0, 1))
                np.add.at(steps, at, 1)
                np.add.at(steps, at + span, -1)
                wanted = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
                _, first = np.unique(h[lo:hi][wanted], return_index=True)
                pos = np.sort(wanted[first])
                n = len(pos)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[lo:hi][pos].view(np.int64)),
                        pa.array(g[lo:hi][pos].view(np.int64)),
                        *(pa.array(np.full(n, batch.column(c)[p.first + row].as_py(), np.int64)) for c in _KEY),
                        pa.array(pos.astype(np.int32)),
                    ],
                    names=["h", "g", "doc_id", "th", "pos"],
                )


def profile(docs: DataFrame) -> DataFrame:
    """One row per document: word count, digest of its words, seeds with the windows they stand for."""
    return stored(keyed(docs).mapInArrow(_profile, _PROFILE), "profile")


def copies(profiles: DataFrame) -> DataFrame:
    """Documents with windows whose words are all those of a smaller doc_id, with that id."""
    rows = profiles.where(f"doc_id IS NOT NULL AND n_words >= {WINDOW}").select(*_KEY, "sha")
    groups = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    groups = stored(groups, "copy-groups")  # apart from the join, so that a hot group can be split there
    return rows.join(groups, "sha").where("doc_id > first").select(*_KEY, "first").distinct()


def candidates(docs: DataFrame, profiles: DataFrame, same: DataFrame) -> DataFrame:
    """First texts that share a seed with another document, with the window ranges of such seeds."""
    owners = profiles.where("doc_id IS NOT NULL").join(same.select(*_KEY), _KEY, "left_anti")
    seeds = owners.select(*_KEY, F.inline(F.arrays_zip("seeds", "at", "span")))
    shared = seeds.groupBy("seeds").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seeds")
    ranges = seeds.join(shared, "seeds", "left_semi").groupBy(*_KEY).agg(F.collect_list(F.struct("at", "span")).alias("ranges"))
    return stored(keyed(docs).join(ranges, _KEY).select(*_KEY, "text", "ranges"), "candidates")


_PATH = ["doc_id", "th", "source", "source_th", "lag"]


def paths(chosen: DataFrame) -> DataFrame:
    """Repeated unbranched paths: (doc_id, th, start, n, source, source_th, source_start), n in windows."""
    edges = chosen.mapInArrow(_edges, _EDGE)
    place = F.struct(F.col("doc_id").alias("source"), F.col("th").alias("source_th"), F.col("pos").alias("source_pos"))
    sources = edges.groupBy("h", "g").agg(F.min(place).alias("s"), F.max("doc_id").alias("last")).where("s.source < last").select("h", "g", "s.*")
    met = edges.join(sources, ["h", "g"]).where("doc_id > source")
    steps = stored(met.select("doc_id", "th", "source", "source_th", (F.col("pos") - F.col("source_pos")).alias("lag"), "pos"), "steps")
    ends = []
    for side, step in (("start", 1), ("last", -1)):
        # an edge one place before (or behind) on the same path
        beside = steps.withColumn("pos", F.col("pos") + step)
        order = F.row_number().over(Window.partitionBy(*_PATH).orderBy("pos"))
        ends.append(steps.join(beside, [*_PATH, "pos"], "left_anti").withColumn("nth", order).withColumnRenamed("pos", side))
    whole = ends[0].join(ends[1], [*_PATH, "nth"])
    return whole.select(
        *_KEY, "start", (F.col("last") - F.col("start") + 1).alias("n"), "source", "source_th", (F.col("start") - F.col("lag")).alias("source_start")
    )


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the words of each span that is asked for."""
    for batch in batches:
        out: list[tuple] = []
        for p in pieces(batch.column("text"), size=_PIECE):
            raw = p.text.tobytes()
            for row in range(len(p.rows) - 1):
                own = batch.column("asked")[p.first + row].values
                words = raw[p.rows[row] : p.rows[row + 1]].split()
                key = [batch.column(c)[p.first + row].as_py() for c in _KEY]
                for start, n in zip(own.field(0).to_pylist(), own.field(1).to_pylist()):
                    span = b" ".join(words[start : start + n + WINDOW - 1])
                    out.append((*key, start, n, hashlib.blake2b(span, digest_size=16).digest()))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*_KEY, "at", "n", "words"])


def verified(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """The paths whose words are those at their source coordinates."""
    found = stored(found, "paths")
    mine = found.select(*_KEY, F.col("start").alias("at"), "n")
    theirs = found.select(F.col("source").alias("doc_id"), F.col("source_th").alias("th"), F.col("source_start").alias("at"), "n")
    asked = mine.unionByName(theirs).distinct().groupBy(*_KEY).agg(F.collect_list(F.struct("at", "n")).alias("asked"))
    texts = chosen.select(*_KEY, "text").join(asked, _KEY)
    said = stored(texts.mapInArrow(_spans, "doc_id long, th long, at int, n int, words binary"), "spans").distinct()
    own = said.select(*_KEY, F.col("at").alias("start"), "n", "words")
    source = said.select(F.col("doc_id").alias("source"), F.col("th").alias("source_th"), F.col("at").alias("source_start"), "n", F.col("words").alias("meant"))
    both = found.join(own, [*_KEY, "start", "n"]).join(source, ["source", "source_th", "source_start", "n"])
    return both.where("words = meant").drop("words", "meant")


def _removed(p: Piece, spans: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For each row with spans, which of its words go; windows equal to one of a path's go wherever they stand."""
    h, g, _, bounds = _names(p)
    for row in range(len(p.rows) - 1):
        own = spans[p.first + row].values
        if own is None or not len(own):
            continue
        first, second = (x[bounds[row] : bounds[row + 1]] for x in (h, g))
        places = np.concatenate([np.arange(a, a + n) for a, n in zip(own.field(0).to_pylist(), own.field(1).to_pylist())])
        gone, at = np.unique(first[places], return_index=True)
        like = np.minimum(np.searchsorted(gone, first), len(gone) - 1)
        same = (gone[like] == first) & (second[places[at]][like] == second)
        yield row, covered(np.flatnonzero(same), WINDOW, int(p.n_words[row]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for p in pieces(batch.column("text"), size=_PIECE):
            raw = p.text.tobytes()
            for row, gone in _removed(p, batch.column("spans")):
                words = raw[p.rows[row] : p.rows[row + 1]].split()
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                out.append((*(batch.column(c)[p.first + row].as_py() for c in _KEY), int(gone.sum()), _sha(kept)))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("doc_id", "th", "lost", "kept"), x)) for x in out],
            pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("lost", pa.int64()), ("kept", pa.string())]),
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, state = batch.column("text").to_pylist(), np.zeros(batch.num_rows, np.int32)
        for p in pieces(batch.column("text"), size=_PIECE):
            raw = p.text.tobytes()
            for row, gone in _removed(p, batch.column("spans")):
                a, at = p.of[row], np.append(p.start[p.of[row] : p.of[row + 1]], p.rows[row + 1])
                kept = np.flatnonzero(~gone)
                texts[p.first + row] = b"".join(raw[at[i] : at[i + 1]] for i in kept.tolist()).decode().rstrip()
                state[p.first + row] = 1 if len(kept) else 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, pa.string()), pa.array(state)], names=["row", "text", "state"]
        )


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Profiles, whole copies, candidate texts, and spans by document (array of start and n)."""
    profiles = profile(docs)
    same = stored(copies(profiles), "copies")
    chosen = candidates(docs, profiles, same)
    spans = verified(paths(chosen), chosen).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return profiles, same, chosen, spans


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the words that stay."""
    profiles, same, chosen, spans = repeats(docs)
    part = (
        chosen.join(spans, _KEY)
        .mapInArrow(_digest, "doc_id long, th long, lost long, kept string")
        .groupBy(*_KEY)
        .agg(F.first("lost").alias("lost"), F.first("kept").alias("kept"))
    )
    whole = same.select(*_KEY, F.lit(True).alias("whole"))
    gone = F.coalesce("whole", F.lit(False))
    return (
        profiles.select(*_KEY, "n_words", "sha")
        .join(whole, _KEY, "left")
        .join(part, _KEY, "left")
        .select(
            "doc_id",
            "n_words",
            F.when(gone, F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )
    )


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated words; the blanks after a word go with it. A
    document that loses all its words is dropped; one that had none stays. ``n_chars``,
    where there is one, follows a changed text."""
    _, same, _, spans = repeats(docs)
    nothing = F.lit(None).cast("array<struct<start:int,n:int>>")
    marks = spans.withColumn("whole", F.lit(False)).unionByName(
        same.select(*_KEY, nothing.alias("spans"), F.lit(True).alias("whole"))
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    th = F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")
    packed = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), th, "text")
    left = packed.join(marks, _KEY, "left").where("whole IS NULL OR NOT whole").select("row", "text", "spans")
    schema = StructType([left.schema["row"], *StructType.fromDDL("text string, state int").fields])
    out = left.mapInArrow(_cut, schema).where("state < 2")

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("state") == 1, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
        return F.col("row").getField(c).alias(c)

    return out.select(*[column(c) for c in docs.columns])
