"""Streams run to their end over the given tables, and the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.operators import embed as E
from paperloom.operators import metrics as R
from paperloom.operators import search as S
from paperloom.operators.chunks import chunk_papers
from paperloom.plans import fixtures as X
from paperloom.plans import jobs
from paperloom.plans.catalog_queries import _pages
from paperloom.plans.registry import query
from paperloom.session import new_folder, read_table, spread
from paperloom.sources import requests as Q
from paperloom.sources import schemas, vector_store
from paperloom.streaming import search as RS
from paperloom.streaming import state, sync


def _stream(spark, sf, table: str) -> DataFrame:
    """A given table as a file stream, be it one file or a folder of part files.

    Streams take a plain path for a folder that partition columns start from, so the table is named as a pattern.
    """
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{table}}}.parquet")


def _run(spark, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all waiting input and returns what it wrote."""
    out = new_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").outputMode("append")
    writer.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _timed(events: DataFrame) -> DataFrame:
    since = F.col("ts").cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return events.withColumn("ts", F.expr("TIMESTAMP_LTZ '1970-01-01 00:00:00Z'") + since)


@query(
    "stream_scrape_windows",
    """WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 30 SECOND, ts)) // 1000000 AS window_start, event_type AS endpoint, count(*) AS requests FROM events GROUP BY ALL)
SELECT * FROM w WHERE (window_start + 30) * 1000000 <= (SELECT epoch_us(max(ts)) - 60000000 FROM events)""",
)
def stream_scrape_windows(spark, sf):
    """Closed scrape windows of the event stream, one minute allowed for late rows."""
    events = _timed(_stream(spark, sf, "events")).select("ts", F.col("event_type").alias("endpoint"), F.col("value").alias("latency"))
    closed = R.scrape_windows(events, watermark="1 minute")
    rows = _run(spark, closed, "scrape")
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "endpoint", "requests")


@query(
    "stream_stalled",
    """WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), f AS (SELECT user_id, ts FROM events WHERE event_type = 'error')
SELECT event_id, user_id FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = s.user_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 6 HOUR)
  AND epoch_us(ts) + 6 * 3600000000 < (SELECT least((SELECT epoch_us(max(ts)) FROM s), (SELECT epoch_us(max(ts)) FROM f)) - 600000000)""",
)
def stream_stalled(spark, sf):
    """Views without an error of the same user in six hours, as far as the watermark has come."""
    events = _timed(_stream(spark, sf, "events"))
    starts = events.where(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    finishes = events.where(F.col("event_type") == "error").select("user_id", "ts")
    return _run(spark, sync.stalled_items(starts, finishes, "user_id", "6 HOURS"), "stalled").select("event_id", "user_id")


@query(
    "stream_admission",
    """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS task_id, event_id::VARCHAR AS query_id, event_type AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('view', 'error', 'purchase')),
st AS (
  SELECT DISTINCT task_id, 0::BIGINT AS n, NULL::VARCHAR AS running, []::VARCHAR[] AS waiting, []::STRUCT(q VARCHAR, a VARCHAR)[] AS said FROM e
  UNION ALL
  SELECT st.task_id, e.n,
    CASE WHEN kind = 'view' THEN coalesce(running, query_id) WHEN running IS NOT NULL THEN waiting[1] END,
    CASE WHEN running IS NULL THEN waiting WHEN kind = 'view' THEN list_append(waiting, query_id) ELSE waiting[2:] END,
    CASE WHEN kind = 'view' THEN [{'q': query_id, 'a': CASE WHEN running IS NULL THEN 'start' ELSE 'wait' END}]
         WHEN running IS NULL THEN [{'q': query_id, 'a': 'ignored'}]
         ELSE list_concat([{'q': running, 'a': CASE kind WHEN 'error' THEN 'cancelled' ELSE 'done' END}],
                          CASE WHEN len(waiting) > 0 THEN [{'q': waiting[1], 'a': 'start'}] ELSE [] END) END
  FROM st JOIN e ON e.task_id = st.task_id AND e.n = st.n + 1)
SELECT task_id, x.q AS query_id, x.a AS action FROM (SELECT task_id, unnest(said) AS x FROM st)""",
)
def stream_admission(spark, sf):
    """Views as requests, errors as cancels and purchases as ends, one task per user."""
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "error", "cancel").when(
        F.col("event_type") == "purchase", "done"
    )
    events = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.col("event_id").cast("string").alias("query_id"),
    )
    return _run(spark, state.admit_requests(events.where(F.col("kind").isNotNull())), "admission")


@query(
    "stream_request_topics",
    """SELECT 'u/' || conv_id AS task_id, conv_id || '_' || turn AS query_id, CASE WHEN turn % 2 = 0 THEN 'request' ELSE 'cancel' END AS kind FROM conversations""",
)
def stream_request_topics(spark, sf):
    """Even turns as requests and odd ones as cancels, each in its topic, read back as one stream."""
    folder = new_folder(spark, "topics")
    conv = F.col("conv_id").cast("string")
    rows = read_table(spark, sf, "conversations").select(
        F.concat(F.lit("u/"), conv).alias("task_id"), F.concat_ws("_", conv, F.col("turn").cast("string")).alias("query_id"), "turn"
    )
    for kind, part in (("request", F.col("turn") % 2 == 0), ("cancel", F.col("turn") % 2 == 1)):
        Q.write_folder(rows.where(part).drop("turn"), f"{folder}/{kind}")
    requests, cancels = (Q.stream_folder(spark, f"{folder}/{k}", schemas.CANCEL_REQUEST) for k in ("request", "cancel"))
    return _run(spark, Q.request_events(requests, cancels), "request-events")


@query(
    "stream_token_pieces",
    """WITH RECURSIVE w AS (SELECT conv_id || '_' || turn AS stream_id,
    CASE WHEN turn % 2 = 1 THEN list_concat(['<think>'], string_split(text, ' '), ['</think>', 'done']) ELSE string_split(text, ' ') END AS t FROM conversations),
e AS MATERIALIZED (SELECT stream_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS n, len(t) AS last FROM w),
st AS (
  SELECT stream_id, 0::BIGINT AS n, false AS inside, '' AS c, '' AS h, NULL::STRUCT(c VARCHAR, h VARCHAR) AS piece FROM w
  UNION ALL
  SELECT stream_id, n, inside, CASE WHEN cut THEN '' ELSE c END, CASE WHEN cut THEN '' ELSE h END,
         CASE WHEN cut OR (last = n AND (c <> '' OR h <> '')) THEN {'c': c, 'h': h} END
  FROM (SELECT *, (NOT mark AND (length(c) > 100 OR length(h) > 100)) AS cut
        FROM (SELECT e.stream_id, e.n, e.last, contains(token, '<think>') OR contains(token, '</think>') AS mark,
                     CASE WHEN contains(token, '<think>') THEN true WHEN contains(token, '</think>') THEN false ELSE inside END AS inside,
                     CASE WHEN contains(token, '<think>') OR contains(token, '</think>') OR inside THEN c ELSE c || token END AS c,
                     CASE WHEN contains(token, '<think>') OR contains(token, '</think>') OR NOT inside THEN h ELSE h || token END AS h
              FROM st JOIN e ON e.stream_id = st.stream_id AND e.n = st.n + 1)))
SELECT stream_id, piece.c AS content, piece.h AS think FROM st WHERE piece IS NOT NULL""",
)
def stream_token_pieces(spark, sf):
    """Each conversation turn as a token stream; odd turns think first."""
    odd = F.col("turn") % 2 == 1
    words = F.split("text", " ")
    marked = F.when(odd, F.concat(F.array(F.lit("<think>")), words, F.array(F.lit("</think>"), F.lit("done")))).otherwise(words)
    tokens = F.concat(marked, F.array(F.lit(None).cast("string")))
    rows = _stream(spark, sf, "conversations").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream_id"),
        F.posexplode(tokens).alias("seq", "token"),
    )
    return _run(spark, state.flush_tokens(rows), "tokens")


@query(
    "stream_vector_sync",
    X.with_ctes(X.CHUNK_VECTORS) + 'SELECT "paperId", chunk_idx, label FROM v',
)
def stream_vector_sync(spark, sf):
    """The embeddings as arriving files, synced twice into a vector table; the second run replaces the same papers."""
    folder = new_folder(spark, "vectors")
    p = F.floor(F.col("vec_id") / 5)
    for run in ("a", "b"):
        stream = _stream(spark, sf, "embeddings").select(
            F.concat(F.lit("d"), p.cast("string")).alias("paperId"), (F.col("vec_id") % 5).alias("chunk_idx"), "label", "embedding"
        )
        sync.sync_vectors(stream, f"{folder}/table", f"{folder}/state-{run}", run).awaitTermination()
    return vector_store.read_current(spark, f"{folder}/table").select("paperId", "chunk_idx", "label")


@query(
    "stream_vector_sync_files",
    X.with_ctes(X.CHUNK_VECTORS) + """SELECT "paperId", chunk_idx, label, CASE WHEN hash3 THEN 'second' ELSE 'first' END AS run
FROM (SELECT *, CAST(substr("paperId", 2) AS BIGINT) % 3 = 0 AS hash3 FROM v) WHERE NOT (hash3 AND chunk_idx = 4)""",
)
def stream_vector_sync_files(spark, sf):
    """Embeddings in five files, one file in a micro-batch, each paper with a chunk in every file. A
    second run brings every third paper again with its last chunk gone; its first batch is run twice."""
    folder = new_folder(spark, "vector-files")
    p = F.floor(F.col("vec_id") / 5)
    rows = read_table(spark, sf, "embeddings").select(
        F.concat(F.lit("d"), p.cast("string")).alias("paperId"), (F.col("vec_id") % 5).alias("chunk_idx"), "label", "embedding", p.alias("p")
    )
    runs = {"first": rows, "second": rows.where((F.col("p") % 3 == 0) & (F.col("chunk_idx") < 4))}
    for run, wanted in runs.items():
        arrived = wanted.withColumn("run", F.lit(run)).drop("p")
        for k in range(5):
            arrived.where(F.col("chunk_idx") == k).coalesce(1).write.mode("append").parquet(f"{folder}/{run}")
        stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{run}")
        sync.sync_vectors(stream, f"{folder}/table", f"{folder}/state-{run}", run).awaitTermination()
    vector_store.sync(spark.read.parquet(f"{folder}/second").where("chunk_idx = 0"), f"{folder}/table", "second", 0)
    return vector_store.read_current(spark, f"{folder}/table").select("paperId", "chunk_idx", "label", "run")


@query("stream_distinct_keys", "SELECT DISTINCT 'd' || (vec_id // 5) AS \"paperId\" FROM embeddings")
def stream_distinct_keys(spark, sf):
    p = F.floor(F.col("vec_id") / 5)
    keys = _stream(spark, sf, "embeddings").select(F.concat(F.lit("d"), p.cast("string")).alias("paperId"))
    return _run(spark, sync.new_only(keys), "keys")


@query(
    "stream_pairs",
    """SELECT a.event_id, a.event_id || 't' AS txt, a.event_type AS meta FROM events a WHERE event_type <> 'error'""",
)
def stream_pairs(spark, sf):
    """Events as text rows, joined to their metadata rows; errors have none."""
    e = _timed(_stream(spark, sf, "events"))
    key = F.col("event_id").cast("string").alias("paperId")
    batch = (F.col("event_id") % 10).alias("batch_id")
    text = e.select(batch, key, "ts", "event_id", F.concat(F.col("event_id").cast("string"), F.lit("t")).alias("txt"))
    meta = e.where(F.col("event_type") != "error").select(batch, key, "ts", F.col("event_type").alias("meta"))
    return _run(spark, sync.complete_pairs(text, meta), "pairs").select("event_id", "txt", "meta")


@query(
    "request_topic_roundtrip",
    "SELECT CAST(item_id AS VARCHAR) AS query_id, 'u/' || item_id AS task_id, text, 3 AS \"topK\" FROM benchmark",
)
def request_topic_roundtrip(spark, sf):
    """Requests written to a topic folder as JSON and read back as a stream."""
    folder = new_folder(spark, "topic")
    Q.write_folder(_search_requests(spark, sf), folder)
    rows = _run(spark, Q.stream_folder(spark, folder, schemas.SEARCH_REQUEST), "requests")
    return rows.select("query_id", "task_id", F.col("query.queries")[0].alias("text"), F.col("topK"))


def _search_requests(spark, sf) -> DataFrame:
    """Every benchmark text as a search request; every third is limited to well-cited papers."""
    i = F.col("item_id")
    key = i.cast("string")
    none = F.lit(None).cast("string")
    query_ = F.struct(
        F.array("text").alias("queries"), none.alias("authorName"), none.alias("publicationDate_start"),
        none.alias("publicationDate_end"), F.lit(None).cast("array<string>").alias("search_paperIds"),
        F.lit(False).alias("peer_reviewed_only"), F.lit(False).alias("preprint_only"),
        F.lit(None).cast("array<string>").alias("venues"), F.when(i % 3 == 0, 50).alias("citationCount"),
    )
    return read_table(spark, sf, "benchmark").select(
        F.concat(F.lit("u/"), key).alias("task_id"), query_.alias("query"), F.lit("u").alias("user_id"),
        key.alias("query_id"), key.alias("notebook_id"), F.lit(3).alias("topK"), F.lit(False).alias("paperLock"),
    )


def _document_papers(spark, sf) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("main_text")))
    chunks = chunk_papers(docs).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paperId"), "chunk_idx", "text"
    )
    packed = S.pack_vectors(E.embed_texts(chunks, "text", E.hashed_words(), prefix="passage: "))
    return packed.join(X.papers_meta(spark, sf).drop("doc_id"), "paperId")


@query("stream_search")
def stream_search(spark, sf):
    """All requests of the topic folder answered over all documents, with a feedback table.

    The paper table is written once to the shared folder, as a service would keep it.
    """
    folder = new_folder(spark, "search")
    _document_papers(spark, sf).write.parquet(f"{folder}/papers")
    papers = spark.read.parquet(f"{folder}/papers")
    Q.write_folder(_search_requests(spark, sf), f"{folder}/topic")
    feedback = X.feedback(spark, sf).withColumn("task_id", F.lit("u/0"))
    stream = Q.stream_folder(spark, f"{folder}/topic", schemas.SEARCH_REQUEST)
    answer = lambda batch: RS.search_requests(batch, papers, E.hashed_words(), feedback)
    RS.answer_stream(stream, answer, f"{folder}/results", f"{folder}/state", once=True).awaitTermination()
    schema = "task_id string, query_id string, paperId string, retrieval_score double, rerank_score double, score double, rank int"
    return spark.read.schema(schema).json(f"{folder}/results")


@query(
    "requery_new_papers",
    X.with_ctes(X.CHUNK_VECTORS, X.LABEL_QUERIES) + """,
sc AS (SELECT query_id, "topK", "paperId", p, round(sum(s) / count(*), 6) AS retrieval_score FROM (
   SELECT query_id, "topK", qi, "paperId", p, max(list_cosine_similarity(qe, e)) AS s FROM q, v GROUP BY ALL) GROUP BY query_id, "topK", "paperId", p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS n FROM sc
      WHERE "paperId" NOT IN (SELECT "paperId" FROM v WHERE CAST(label AS VARCHAR) = query_id))
SELECT query_id, "paperId", retrieval_score, n AS retrieval_rank FROM r WHERE n <= "topK" """,
)
def requery_new_papers(spark, sf):
    """Each label's stored query again, papers holding a chunk of the label counting as returned before."""
    chunks = X.chunk_vectors(spark, sf)
    returned = chunks.select(F.col("label").cast("string").alias("query_id"), "paperId").distinct()
    return RS.requery_new_papers(S.pack_vectors(chunks), X.label_queries(spark, sf), returned)


@query(
    "stream_requery",
    X.with_ctes(X.CHUNK_VECTORS, X.LABEL_QUERIES) + """,
sc AS (SELECT query_id, "topK", "paperId", p, round(sum(s) / count(*), 6) AS retrieval_score FROM (
   SELECT query_id, "topK", qi, "paperId", p, max(list_cosine_similarity(qe, e)) AS s FROM q, v GROUP BY ALL) GROUP BY query_id, "topK", "paperId", p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, "paperId") AS n FROM sc
      WHERE "paperId" NOT IN (SELECT "paperId" FROM v WHERE CAST(label AS VARCHAR) = query_id))
SELECT query_id, "paperId", retrieval_score, n AS retrieval_rank FROM r WHERE n <= "topK" """,
)
def stream_requery(spark, sf):
    """Papers arriving in four files, one in a micro-batch, over each label's stored query; the stream is stopped and started again between."""
    folder = new_folder(spark, "standing")
    chunks = X.chunk_vectors(spark, sf)
    returned = chunks.select(F.col("label").cast("string").alias("query_id"), "paperId").distinct()
    queries = X.label_queries(spark, sf)
    papers = S.pack_vectors(chunks)
    for part in ((0, 1), (2, 3)):
        for k in part:
            arrived = papers.where(F.pmod(F.crc32("paperId"), F.lit(4)) == k)
            arrived.coalesce(1).write.mode("append").parquet(f"{folder}/new")
        stream = spark.readStream.schema(papers.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/new")
        RS.requery_stream(stream, queries, returned, f"{folder}/lists", f"{folder}/state", once=True).awaitTermination()
    return RS.standing_lists(spark, f"{folder}/lists").select("query_id", "paperId", "retrieval_score", "retrieval_rank")


_LETTERS = "abcdefghijklmnop"


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace({text}, '{c}', '')))::DOUBLE" for c in _LETTERS) + "]"


@query(
    "stream_questions",
    f"""WITH q AS (SELECT item_id % 7 AS t, text AS question, {_letters_sql("('query: ' || text)")} AS e FROM benchmark),
d AS (SELECT doc_id % 7 AS t, {_letters_sql("coalesce(text, '')")} AS e FROM documents)
SELECT 'u/' || t AS task_id, question, round(avg(CASE WHEN list_sum(d.e) > 0 AND list_sum(q.e) > 0 THEN list_cosine_similarity(q.e, d.e) ELSE 0 END), 6) AS score
FROM q JOIN d USING (t) GROUP BY t, question""",
)
def stream_questions(spark, sf):
    """Every benchmark text as a question request of one of seven notebooks, answered from a topic folder over the notebook's documents."""
    folder = new_folder(spark, "questions")
    task = lambda c: F.concat(F.lit("u/"), (c % 7).cast("string"))
    asked = _search_requests(spark, sf).withColumn("task_id", task(F.col("query_id").cast("int")))
    Q.write_folder(asked, f"{folder}/topic")
    encoder = E.letter_counts(_LETTERS)
    docs = read_table(spark, sf, "documents").select(task(F.col("doc_id")).alias("task_id"), "text")
    pooled = E.embed_texts(docs, "text", encoder).select("task_id", "embedding")
    stream = Q.stream_folder(spark, f"{folder}/topic", schemas.SEARCH_REQUEST)
    RS.answer_stream(stream, lambda batch: RS.score_questions(batch, pooled, encoder), f"{folder}/results", f"{folder}/state", once=True).awaitTermination()
    return spark.read.schema("task_id string, question string, score double").json(f"{folder}/results").select("task_id", "question", "score")


@query(
    "catalogue_refresh",
    """WITH d AS (SELECT doc_id, 'd' || doc_id AS pid, source, split_part(text, chr(10), 1) AS title, text, doc_id % 2 = 0 AS oa FROM documents),
k AS (SELECT title, min(pid) AS pid FROM d WHERE doc_id % 6 > 0 GROUP BY title),
a AS (SELECT d.* FROM d JOIN k USING (pid) WHERE length(source) > 3)
SELECT 'doi/' || pid AS doi, pid AS "paperId", source AS venue, doc_id % 5 AS "citationCount" FROM a
UNION ALL SELECT 'stored/' || doc_id, pid, 'old ' || source, 7 FROM d WHERE doc_id % 6 = 0""",
)
def catalogue_refresh(spark, sf):
    """Landed pages with enrichment merged over a stored table."""
    docs = read_table(spark, sf, "documents")
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    enrichment = docs.select(
        key.alias("paperId"), F.lit(None).cast("array<struct<paperId:string,title:string>>").alias("references"),
        F.lit(None).cast("struct<url:string>").alias("openAccessPdf"),
        F.struct(F.concat(F.lit("doi/"), key).alias("DOI"), none.alias("ArXiv"), F.col("doc_id").alias("CorpusId")).alias("externalIds"),
        F.lit(1).alias("influentialCitationCount"), F.lit(True).alias("isOpenAccess"),
    )
    stored = docs.where(F.col("doc_id") % 6 == 0).select(
        F.concat(F.lit("stored/"), F.col("doc_id").cast("string")).alias("doi"), key.alias("paperId"),
        F.concat(F.lit("old "), "source").alias("venue"), F.lit(7).alias("citationCount"),
    )
    meta, _ = jobs.refresh_catalogue(_pages(spark, sf), enrichment, stored_meta=stored)
    return meta.select("doi", "paperId", "venue", "citationCount")


@query(
    "vector_refresh",
    X.with_ctes(X.PAPERS_META, X.PAPERS_TEXT) + r""",
t AS (SELECT "paperId", CASE WHEN length(CASE WHEN main_text = 'None' THEN '' ELSE main_text END) < 500
        THEN coalesce(title, '') || ' ' || coalesce(abstract, '') ELSE main_text END AS t FROM pt WHERE status = 'None')
SELECT t."paperId", venue, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''))::BIGINT AS tokens, 0::BIGINT AS empty_vectors
FROM t JOIN pm USING ("paperId") WHERE length(t) >= 500""",
)
def vector_refresh(spark, sf):
    """Chunk vectors of every paper still to do: the tokens of its text that chunks hold, and vectors of length zero."""
    meta = X.papers_meta(spark, sf).drop("doc_id")
    text = X.papers_text(spark, sf).select("paperId", "title", "abstract", "main_text", "status")
    vectors, _ = jobs.refresh_vectors(meta, spread(text), E.hashed_words(), chunk_size=60)
    return vectors.groupBy("paperId", "venue").agg(
        F.sum(F.col("core_end") - F.col("core_start")).alias("tokens"), F.count_if(F.array_max("embedding") == 0).alias("empty_vectors")
    )


@query(
    "status_after_refresh",
    X.with_ctes(X.PAPERS_TEXT) + """SELECT "paperId", CASE WHEN status = 'None' THEN 'abstract_pushed' WHEN status = 'extracted' THEN 'pdf_pushed' ELSE status END AS status FROM pt""",
)
def status_after_refresh(spark, sf):
    meta = X.papers_meta(spark, sf).drop("doc_id")
    text = X.papers_text(spark, sf).select("paperId", "title", "abstract", "main_text", "status")
    _, advanced = jobs.refresh_vectors(meta, text, E.hashed_words(), only_new=False)
    return advanced.select("paperId", "status")
