"""Service metrics from request events (ts, method, endpoint, http_status, latency)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.operators.running import running_total

# Upper bucket edges of the latency histogram, in seconds.
LATENCY_EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def request_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("method", "endpoint", "http_status").agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(events: DataFrame) -> DataFrame:
    """Cumulative counts per bucket edge plus +Inf, one row per (method, endpoint, le), with sum and count."""
    wide = events.groupBy("method", "endpoint").agg(
        *[F.count_if(F.col("latency") <= e).alias(f"b{i}") for i, e in enumerate(LATENCY_EDGES)],
        F.count("latency").alias("total"),
        F.sum("latency").alias("seconds"),
    )
    rows = [F.struct(F.lit(str(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(LATENCY_EDGES)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return wide.select("method", "endpoint", "seconds", "total", F.inline(F.array(*rows)))


def latency_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("method", "endpoint").agg(
        F.count("latency").alias("n"), F.sum("latency").alias("seconds"), F.avg("latency").alias("mean")
    )


def in_progress(events: DataFrame, keys: list[str], bin_seconds: int | None = 3600) -> DataFrame:
    """Open requests after every start and end. At one instant starts count before ends.

    Bins are spans of time; without ``bin_seconds`` they are ranges of like size, for keys that are hot in one span.
    """
    micros = F.unix_micros("ts")
    length = F.round(F.col("latency") * 1_000_000).cast("bigint")
    point = lambda at, delta: F.struct(at.alias("at"), F.lit(delta).alias("delta"))
    steps = events.select(
        *keys, "event_id", F.inline(F.array(point(micros, 1), point(micros + length, -1)))
    ).withColumn("last", F.col("delta") < 0)
    return running_total(
        steps,
        keys,
        ["at", "last", "event_id"],
        F.col("delta"),
        None if bin_seconds is None else F.floor(F.col("at") / (bin_seconds * 1_000_000)),
        "open_requests",
    ).drop("last")


def scrape_windows(events: DataFrame, interval: str = "30 seconds", watermark: str | None = None) -> DataFrame:
    """Requests and latency per scrape interval and endpoint; the same plan serves streams."""
    source = events.withWatermark("ts", watermark) if watermark else events
    return source.groupBy(F.window("ts", interval).alias("w"), "endpoint").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("latency").alias("seconds")
    ).select(F.col("w.start").alias("window_start"), "endpoint", "requests", "seconds")


def stream_times(lines: DataFrame, starts: DataFrame, key: str = "stream_id") -> DataFrame:
    """Seconds from request start to the first and to the last line of each stream."""
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1_000_000
    spans = lines.groupBy(key).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return starts.join(spans, key).select(
        key, seconds("_a", "start_ts").alias("first_token"), seconds("_b", "start_ts").alias("total")
    )


def stalled(starts: DataFrame, finishes: DataFrame, key: str, timeout_seconds: int) -> DataFrame:
    """Starts without a finish of the same key within the timeout.

    Finishes shrink to their first and last time per (key, slot), slots being one
    timeout wide. A start in slot b is answered when the last finish of b is not before
    it, or the first finish of b + 1 is in time: no start meets more than two rows.
    """
    micros = F.unix_micros("ts")
    width = timeout_seconds * 1_000_000
    slots = finishes.groupBy(F.col(key).alias("_k"), F.floor(micros / width).alias("_slot")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last")
    )
    same = slots.select(F.col("_k").alias(key), F.col("_slot").alias("_b"), "_last")
    following = slots.select(F.col("_k").alias(key), (F.col("_slot") - 1).alias("_b"), "_first")
    asked = starts.withColumn("_b", F.floor(micros / width)).join(same, [key, "_b"], "left").join(following, [key, "_b"], "left")
    answered = (F.col("_last") >= micros) | (F.col("_first") <= micros + width)
    return asked.where(~F.coalesce(answered, F.lit(False))).select(*starts.columns)


def think_segments(tokens: DataFrame, key: str = "stream_id", bin_tokens: int = 1024) -> DataFrame:
    """Tokens of a stream with ``inside`` (between think marks); the marks themselves drop out.

    A token is inside when the latest mark before it opens. The latest mark is the running
    maximum of (position, state), so a long stream is worked on bin by bin.
    """
    opens, closes = F.contains("token", F.lit("<think>")), F.contains("token", F.lit("</think>"))
    mark = F.when(opens, F.col("seq") * 2 + 1).when(closes, F.col("seq") * 2)
    latest = running_total(
        tokens, [key], ["seq"], mark.cast("bigint"), F.floor(F.col("seq") / bin_tokens), "_mark", how="max"
    )
    inside = F.coalesce(F.col("_mark") % 2 == 1, F.lit(False))
    return latest.where(~(opens | closes)).select(*tokens.columns, inside.alias("inside"))


def flush_groups(tokens: DataFrame, key: str = "stream_id", flush_chars: int = 100, bin_tokens: int = 1024) -> DataFrame:
    """Visible and hidden text of a stream in pieces of about ``flush_chars`` characters."""
    marked = think_segments(tokens, key, bin_tokens)
    sized = running_total(
        marked, [key, "inside"], ["seq"], F.length("token"), F.floor(F.col("seq") / bin_tokens), "_chars"
    )
    piece = F.floor((F.col("_chars") - F.length("token")) / flush_chars)
    return (
        sized.withColumn("piece", piece)
        .groupBy(key, "inside", "piece")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("seq", "token"))), lambda s: s["token"]), ""
            ).alias("text")
        )
    )
