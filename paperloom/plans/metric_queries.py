"""Metric queries over events, and token streams from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import ids as I
from paperloom.operators import metrics as R
from paperloom.plans import fixtures as X
from paperloom.plans.registry import query
from paperloom.session import read_table

_EV = X.with_ctes(X.API_EVENTS)


@query("request_counter", _EV + "SELECT method, endpoint, http_status, count(*) AS requests FROM ev GROUP BY ALL")
def request_counter(spark, sf):
    return R.request_counts(X.api_events(spark, sf))


@query("endpoint_groups", _EV + "SELECT method, regexp_replace(endpoint, '/notebook/[^/]+', '/notebook/:id') AS endpoint, count(*) AS requests FROM ev GROUP BY ALL")
def endpoint_groups(spark, sf):
    grouped = X.api_events(spark, sf).withColumn("endpoint", I.group_endpoint(F.col("endpoint")))
    return grouped.groupBy("method", "endpoint").agg(F.count(F.lit(1)).alias("requests"))


_GROUPED = "g AS (SELECT * REPLACE (regexp_replace(endpoint, '/notebook/[^/]+', '/notebook/:id') AS endpoint) FROM ev)"
_EDGES = ", ".join(str(e) for e in R.LATENCY_EDGES)
_NAMES = ", ".join(f"'{e}'" for e in R.LATENCY_EDGES)


def _grouped(spark, sf):
    return X.api_events(spark, sf).withColumn("endpoint", I.group_endpoint(F.col("endpoint")))


@query(
    "latency_histogram",
    X.with_ctes(X.API_EVENTS, _GROUPED) + f""", e AS (SELECT unnest([{_EDGES}, 1e300]) AS edge, unnest([{_NAMES}, '+Inf']) AS le),
t AS (SELECT method, endpoint, round(sum(latency), 6) AS seconds, count(latency) AS total FROM g GROUP BY ALL),
k AS (SELECT method, endpoint, le, count_if(latency <= edge) AS n FROM g, e GROUP BY ALL)
SELECT method, endpoint, seconds, total, le, n FROM t JOIN k USING (method, endpoint)""",
)
def latency_histogram(spark, sf):
    return R.latency_histogram(_grouped(spark, sf)).withColumn("seconds", F.round("seconds", 6))


@query(
    "latency_summary",
    X.with_ctes(X.API_EVENTS, _GROUPED) + "SELECT method, endpoint, count(latency) AS n, round(sum(latency), 6) AS seconds, round(avg(latency), 6) AS mean FROM g GROUP BY ALL",
)
def latency_summary(spark, sf):
    out = R.latency_summary(_grouped(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("seconds", "mean")})


_IN_PROGRESS = (
    X.with_ctes(X.API_EVENTS) + """, s AS (SELECT method, event_id, epoch_us(ts) AS at_us, 1 AS delta FROM ev
UNION ALL SELECT method, event_id, epoch_us(ts) + CAST(round(latency * 1000000) AS BIGINT), -1 FROM ev)
SELECT method, event_id, at_us AS "at", delta, CAST(sum(delta) OVER (PARTITION BY method ORDER BY at_us, delta DESC, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open_requests FROM s"""
)


@query("requests_in_progress", _IN_PROGRESS)
def requests_in_progress(spark, sf):
    return R.in_progress(X.api_events(spark, sf), ["method"])


@query("requests_in_progress_ranged", _IN_PROGRESS)
def requests_in_progress_ranged(spark, sf):
    """All requests of a method, in bins of like size wherever they lie in time."""
    return R.in_progress(X.api_events(spark, sf), ["method"], bin_seconds=None)


@query(
    "scrape_windows",
    X.with_ctes(X.API_EVENTS) + """SELECT epoch_us(time_bucket(INTERVAL 30 SECOND, ts)) // 1000000 AS window_start, endpoint, count(*) AS requests, round(sum(latency), 6) AS seconds FROM ev GROUP BY ALL""",
)
def scrape_windows(spark, sf):
    out = R.scrape_windows(X.api_events(spark, sf))
    return out.select(F.unix_seconds("window_start").alias("window_start"), "endpoint", "requests", F.round("seconds", 6).alias("seconds"))


_STALLED = X.with_ctes("""s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')""", "f AS (SELECT user_id, ts FROM events WHERE event_type = 'error')")


@query(
    "stalled_requests",
    _STALLED + """SELECT event_id, user_id FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = s.user_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 6 HOUR)""",
)
def stalled_requests(spark, sf):
    e = X.events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    starts = e.where(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    finishes = e.where(F.col("event_type") == "error").select("user_id", "ts")
    return R.stalled(starts, finishes, "user_id", 6 * 3600).select("event_id", "user_id")


@query(
    "stream_times",
    """WITH l AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type <> 'view' GROUP BY user_id),
s AS (SELECT user_id, min(ts) AS t FROM events GROUP BY user_id)
SELECT user_id AS stream_id, round((epoch_us(a) - epoch_us(t)) / 1000000, 6) AS first_token, round((epoch_us(b) - epoch_us(t)) / 1000000, 6) AS total FROM l JOIN s USING (user_id)""",
)
def stream_times(spark, sf):
    """Users as streams: their first event is the request, the rest are lines."""
    e = X.events(spark, sf).select(F.col("user_id").alias("stream_id"), "ts", "event_type")
    starts = e.groupBy("stream_id").agg(F.min("ts").alias("start_ts"))
    out = R.stream_times(e.where(F.col("event_type") != "view"), starts)
    return out.withColumns({c: F.round(c, 6) for c in ("first_token", "total")})


def _tokens(spark, sf):
    """Conversations as token streams; odd turns are thought."""
    c = read_table(spark, sf, "conversations")
    words = F.split("text", " ")
    odd = F.col("turn") % 2 == 1
    marked = F.when(odd, F.concat(F.array(F.lit("<think>")), words, F.array(F.lit("</think>")))).otherwise(words)
    rows = c.select(F.col("conv_id").alias("stream_id"), "turn", F.posexplode(marked).alias("i", "token"))
    return rows.select("stream_id", (F.col("turn") * 1_000_000 + F.col("i")).alias("seq"), "token")


_TOKENS = """t AS (SELECT conv_id AS stream_id, turn * 1000000 + i AS seq, token FROM (
  SELECT conv_id, turn, unnest(w) AS token, unnest(range(len(w))) AS i FROM (
    SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN ['<think>'] || string_split(text, ' ') || ['</think>'] ELSE string_split(text, ' ') END AS w FROM conversations))),
th AS (SELECT stream_id, seq, token, seq // 1000000 % 2 = 1 AS inside FROM t WHERE token NOT IN ('<think>', '</think>'))"""


@query("token_think_flags", X.with_ctes(_TOKENS) + "SELECT * FROM th")
def token_think_flags(spark, sf):
    return R.think_segments(_tokens(spark, sf))


@query(
    "token_flush_groups",
    X.with_ctes(_TOKENS) + """, c AS (SELECT *, sum(length(token)) OVER (PARTITION BY stream_id, inside ORDER BY seq) - length(token) AS before FROM th)
SELECT stream_id, inside, CAST(before // 100 AS BIGINT) AS piece, string_agg(token, '' ORDER BY seq) AS text FROM c GROUP BY ALL""",
)
def token_flush_groups(spark, sf):
    return R.flush_groups(_tokens(spark, sf))
