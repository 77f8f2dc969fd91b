"""The vector tables: one row per paper with all its vectors, one row per chunk.

A table is dealt into ``BUCKETS`` by a hash of the paper. A write makes folders for the buckets
it touches and then adds a line to the version list that names the folder of every bucket, so
readers see whole versions only, a failed write leaves the last one in place, and untouched
buckets are not rewritten. A version's line is a file that only one writer can create: who finds
it taken removes what it wrote and starts again from the version that came between, so that writers
at one time lose nothing. Folders that only versions before the last ``KEPT`` name are removed.
A batch that is written again finds its line and does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.operators.search import mean_vector, pack_vectors


def upsert(old: DataFrame, new: DataFrame, key: str = "paperId") -> DataFrame:
    """Old rows of all other papers, plus the new rows."""
    return delete(old, new.select(key)).unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, keys: DataFrame, key: str = "paperId") -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def update_payload(old: DataFrame, new: DataFrame, allowed: Sequence[str], key: str = "paperId") -> DataFrame:
    """Overwrites the allowed fields that ``new`` brings, on the rows of its papers."""
    fields = [c for c in new.columns if c in allowed and c in old.columns and c != key]
    fresh = new.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = old.join(fresh, key, "left")
    changed = {c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(changed).select(*old.columns)


def existing_keys(df: DataFrame, key: str = "paperId") -> DataFrame:
    return df.select(key).distinct()


def embedding_documents(chunks: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Per paper its vectors, payloads in chunk order, and mean vector."""
    packed = pack_vectors(chunks)
    mean = mean_vector(chunks).withColumnRenamed("embedding", "mean_embedding")
    out = packed.withColumnRenamed("vectors", "embeddings").join(mean, "paperId")
    if payload:
        rows = chunks.groupBy("paperId").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("chunk_idx", F.struct(*payload).alias("p")))), lambda s: s["p"]
            ).alias("payloads")
        )
        out = out.join(rows, "paperId")
    return out


def save_embedding_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("append").json(path)


BUCKETS = 32
KEPT = 3
ATTEMPTS = 20
_LINE = "version bigint, run string, batch bigint, folders array<string>"


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(_LINE).json(f"{root}/_versions")
    except AnalysisException:
        return None


def _latest(spark: SparkSession, root: str, count: int = 1) -> list:
    """The last version lines, the newest first."""
    lines = _versions(spark, root)
    return lines.orderBy(F.desc("version")).limit(count).collect() if lines is not None else []


def current_version(spark: SparkSession, root: str) -> int | None:
    return next((line["version"] for line in _latest(spark, root)), None)


def _read(spark: SparkSession, root: str, folders: Sequence[str | None]) -> DataFrame | None:
    paths = [f"{root}/{f}" for f in folders if f]
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    rows = next((_read(spark, root, line["folders"]) for line in _latest(spark, root)), None)
    return None if rows is None else rows.drop("_run")


def _bucket(key: str = "paperId"):
    return F.pmod(F.hash(key), F.lit(BUCKETS))


def _files(spark: SparkSession, root: str):
    """The file system of the table, and what makes a path of a name below it."""
    jvm = spark.sparkContext._jvm
    path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{root}/{name}" if name else root)
    return path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _publish(spark: SparkSession, root: str, line: dict) -> bool:
    """Creates the line of a version, or tells that another writer has."""
    files, path = _files(spark, root)
    target = path(f"_versions/{line['version']:012d}.json")
    try:
        out = files.create(target, False)
    except Py4JJavaError as e:
        if files.exists(target):
            return False
        raise e
    out.write(bytearray(json.dumps(line).encode()))
    out.close()
    return True


def _remove_old(spark: SparkSession, root: str) -> None:
    """Deletes the folders that older versions name and no kept one; what another writer is at work on has no name yet."""
    lines = _latest(spark, root, 2 * KEPT)
    named = lambda some: {f.split("/")[0] for line in some for f in line["folders"] if f}
    files, path = _files(spark, root)
    for name in named(lines[KEPT:]) - named(lines[:KEPT]):
        files.delete(path(name), True)


def sync(new: DataFrame, root: str, run: str = "", batch: int | None = None) -> int | None:
    """Upserts chunk rows (paperId, chunk_idx, ...) and publishes the next version.

    A paper's rows of earlier runs are replaced; within a run, rows replace those with the same
    chunk and stand next to the others. Returns the version, or None for a table still empty.
    Without a batch number each call is a run of its own.
    """
    for _ in range(ATTEMPTS):
        done, version = _try_sync(new, root, run, batch)
        if done:
            return version
    raise RuntimeError(f"{ATTEMPTS} versions of {root} were taken by other writers")


def _try_sync(new: DataFrame, root: str, run: str, batch: int | None) -> tuple[bool, int | None]:
    """Whether the next version could be published, and which is the current one then."""
    spark = new.sparkSession
    lines = _versions(spark, root)
    if batch is not None and lines is not None and not lines.where((F.col("run") == run) & (F.col("batch") == batch)).isEmpty():
        return True, current_version(spark, root)
    last = next(iter(_latest(spark, root)), None)
    version = last["version"] + 1 if last else 1
    run = run if batch is not None else f"{run}#{version}"
    touched = sorted(r["b"] for r in new.select(_bucket().alias("b")).distinct().collect())  # at most BUCKETS
    if not touched:
        return True, version - 1 or None
    folders = list(last["folders"]) if last else [None] * BUCKETS
    rows = new.withColumn("_run", F.lit(run))
    old = _read(spark, root, [folders[b] for b in touched])
    if old is not None:
        came = new.select("paperId", F.lit(True).alias("_came")).distinct()
        kept = old.join(new.select("paperId", "chunk_idx"), ["paperId", "chunk_idx"], "left_anti").join(came, "paperId", "left")
        rows = rows.unionByName(kept.where(F.col("_came").isNull() | (F.col("_run") == run)).drop("_came"), allowMissingColumns=True)
    dealt = rows.withColumn("_b", _bucket()).repartition(len(touched), "_b").sortWithinPartitions("_b", "paperId")
    own = f"v{version}-{uuid.uuid4().hex[:12]}"
    dealt.write.partitionBy("_b").parquet(f"{root}/{own}")
    for b in touched:
        folders[b] = f"{own}/_b={b}"
    if not _publish(spark, root, {"version": version, "run": run, "batch": batch, "folders": folders}):
        files, path = _files(spark, root)
        files.delete(path(own), True)
        return False, None
    _remove_old(spark, root)
    return True, version
