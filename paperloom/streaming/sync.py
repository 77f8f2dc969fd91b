"""Streams that keep tables up to date, and the streaming forms of watch and timeout operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.sources import vector_store


def new_only(stream: DataFrame, key: str = "paperId", time: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Each key once. With an event time the remembered keys are bounded by the watermark."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def sync_vectors(stream: DataFrame, root: str, checkpoint: str, run: str) -> StreamingQuery:
    """Upserts every waiting file into the vector table, then ends; the end of the run is the done signal.

    ``run`` names one arrival of papers: chunks of a paper that come in several batches of a run
    stand together and replace what earlier runs stored of it. A run that is started again after
    a failure keeps its name.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        vector_store.sync(batch, root, run, batch_id)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def complete_pairs(text: DataFrame, meta: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Papers whose text and metadata rows have both arrived; each side carries (batch_id, paperId, ts)."""
    t = text.withWatermark("ts", watermark).alias("t")
    m = meta.withWatermark("ts", watermark).alias("m")
    near = F.expr(f"m.ts BETWEEN t.ts - INTERVAL {watermark} AND t.ts + INTERVAL {watermark}")
    both = (F.col("t.batch_id") == F.col("m.batch_id")) & (F.col("t.paperId") == F.col("m.paperId")) & near
    keep = [F.col(f"m.{c}") for c in meta.columns if c not in ("batch_id", "paperId", "ts")]
    return t.join(m, both, "inner").select("t.*", *keep)


def stalled_items(starts: DataFrame, finishes: DataFrame, key: str, timeout: str, watermark: str = "10 minutes") -> DataFrame:
    """Items started but not finished in time, reported once the watermark has passed the timeout."""
    s = starts.withWatermark("ts", watermark).alias("s")
    f = finishes.withWatermark("ts", watermark).alias("f")
    on = F.expr(f"s.{key} = f.{key} AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL {timeout}")
    return s.join(f, on, "left_outer").where(F.col(f"f.{key}").isNull()).select("s.*")


def stream_durations(lines: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """First and last line of each token stream, per window; lines carry (stream_id, start_ts, ts)."""
    seconds = lambda c: (F.unix_micros(c) - F.unix_micros("start_ts")) / 1_000_000
    return (
        lines.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), "stream_id", "start_ts")
        .agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        .select("stream_id", seconds(F.col("a")).alias("first_token"), seconds(F.col("b")).alias("total"))
    )
