"""Catalogue, vector and notebook tables derived from the given tables.

Each table has a DataFrame form and the same rule as a SQL common table
expression, so a query and its SQL check start from equal rows. Only integer and
string arithmetic is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.operators.search import mean_vector
from paperloom.session import read_table, spread


def row_count(df: DataFrame):
    """The number of rows as a scalar subquery column."""
    return df.agg(F.count(F.lit(1))).scalar()


def _doc(k) -> F.Column:
    return F.concat(F.lit("d"), k.cast("string"))


def papers_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    i = F.col("doc_id")
    lines = F.split("text", "\n")
    return docs.withColumn("n", row_count(docs)).select(
        i,
        _doc(i).alias("paperId"),
        F.concat(F.lit("10.1/"), (i % F.floor(F.col("n") * 9 / 10)).cast("string")).alias("doi"),
        lines[0].alias("title"),
        F.element_at(lines, -1).alias("abstract"),
        F.when(i % 3 > 0, F.col("text")).otherwise("None").alias("main_text"),
        (i % 2 == 0).alias("isOpenAccess"),
        F.element_at(
            F.array(F.lit("None"), F.lit("extracted"), F.lit("pdf_pushed"), F.lit("abstract_pushed")),
            (i % 4 + 1).cast("int"),
        ).alias("status"),
    )


PAPERS_TEXT = """pt AS (
  SELECT doc_id, 'd' || doc_id AS "paperId",
         '10.1/' || (doc_id % ((SELECT count(*) FROM documents) * 9 // 10)) AS doi,
         split_part(text, chr(10), 1) AS title,
         list_extract(string_split(text, chr(10)), -1) AS abstract,
         CASE WHEN doc_id % 3 > 0 THEN text ELSE 'None' END AS main_text,
         doc_id % 2 = 0 AS "isOpenAccess",
         list_extract(['None', 'extracted', 'pdf_pushed', 'abstract_pushed'], doc_id % 4 + 1) AS status
  FROM documents)"""


def papers_meta(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    i, n = F.col("doc_id"), F.col("n")
    published = F.date_add(F.lit("2015-01-01").cast("date"), (i * 13 % 3650).cast("int"))
    return docs.withColumn("n", row_count(docs)).select(
        i,
        _doc(i).alias("paperId"),
        F.concat(F.lit("10.1/"), (i % F.floor(n * 9 / 10)).cast("string")).alias("doi"),
        F.when(i % 5 == 0, "arXiv.org").otherwise(F.col("source")).alias("venue"),
        F.lower(F.when(i % 5 == 0, "arXiv.org").otherwise(F.col("source"))).alias("venue_lower"),
        (i * 7 % 101).alias("citationCount"),
        (i % 7).alias("influentialCitationCount"),
        F.date_format(published, "yyyy-MM-dd").alias("publicationDate"),
        F.year(published).alias("publicationYear"),
        F.concat_ws(";", _doc(i * 3 % n), _doc(i * 5 % n), _doc(i + n)).alias("referenceIds"),
        F.concat_ws(",", "lang", "source").alias("fieldsOfStudy"),
        F.concat(F.lit("Ann "), F.col("source"), F.lit(",Bo "), F.col("lang")).alias("authorName"),
        F.when(
            i % 4 == 0,
            F.concat(F.lit("gs://papers/pdf/2101/2101."), i.cast("string"), F.lit("v"), (i % 6 + 1).cast("string"), F.lit(".pdf")),
        )
        .otherwise(F.concat(F.lit("http://host.example/pdf/"), _doc(i)))
        .alias("openAccessPdf"),
        (i % 2 == 0).alias("isOpenAccess"),
    )


PAPERS_META = """pm AS (
  SELECT doc_id, 'd' || doc_id AS "paperId", '10.1/' || (doc_id % (n * 9 // 10)) AS doi,
         CASE WHEN doc_id % 5 = 0 THEN 'arXiv.org' ELSE source END AS venue,
         lower(CASE WHEN doc_id % 5 = 0 THEN 'arXiv.org' ELSE source END) AS venue_lower,
         doc_id * 7 % 101 AS "citationCount", doc_id % 7 AS "influentialCitationCount",
         strftime(DATE '2015-01-01' + CAST(doc_id * 13 % 3650 AS INT), '%Y-%m-%d') AS "publicationDate",
         year(DATE '2015-01-01' + CAST(doc_id * 13 % 3650 AS INT)) AS "publicationYear",
         'd' || (doc_id * 3 % n) || ';d' || (doc_id * 5 % n) || ';d' || (doc_id + n) AS "referenceIds",
         lang || ',' || source AS "fieldsOfStudy",
         'Ann ' || source || ',Bo ' || lang AS "authorName",
         CASE WHEN doc_id % 4 = 0 THEN 'gs://papers/pdf/2101/2101.' || doc_id || 'v' || (doc_id % 6 + 1) || '.pdf'
              ELSE 'http://host.example/pdf/d' || doc_id END AS "openAccessPdf",
         doc_id % 2 = 0 AS "isOpenAccess"
  FROM (SELECT doc_id, lang, source, (SELECT count(*) FROM documents) AS n FROM documents))"""


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = read_table(spark, sf, "embeddings")
    p = F.floor(F.col("vec_id") / 5)
    return v.select(
        p.alias("p"),
        _doc(p).alias("paperId"),
        (F.col("vec_id") % 5).alias("chunk_idx"),
        "label",
        "embedding",
        (F.lit(2015) + p % 10).alias("publicationYear"),
        (p * 7 % 101).alias("citationCount"),
    )


CHUNK_VECTORS = """v AS (
  SELECT vec_id // 5 AS p, 'd' || (vec_id // 5) AS "paperId", vec_id % 5 AS chunk_idx, label,
         CAST(embedding AS DOUBLE[]) AS e,
         2015 + (vec_id // 5) % 10 AS "publicationYear", (vec_id // 5) * 7 % 101 AS "citationCount"
  FROM embeddings)"""


def label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: its sub-queries are the mean vectors of the label's chunks at each chunk position."""
    v = chunk_vectors(spark, sf).withColumn("query_id", F.col("label").cast("string")).withColumnRenamed("chunk_idx", "qi")
    means = mean_vector(v, ("query_id", "qi"))
    return means.withColumn("topK", (F.lit(3) + F.col("query_id").cast("int") % 3).cast("int"))


LABEL_QUERIES = """q AS (
  SELECT label, CAST(label AS VARCHAR) AS query_id, chunk_idx AS qi, 3 + label % 3 AS "topK", list(m ORDER BY pos) AS qe
  FROM (SELECT label, chunk_idx, pos, avg(x) AS m
        FROM (SELECT label, chunk_idx, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v)
        GROUP BY label, chunk_idx, pos)
  GROUP BY label, chunk_idx)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    n = row_count(read_table(spark, sf, "documents").select("doc_id"))
    conv, turn = F.col("conv_id"), F.col("turn")
    paper = lambda k: F.struct(
        _doc((conv + turn * k) % F.col("n")).alias("paperId"), ((conv + k) % 3 - 1).alias("user_score")
    )
    return c.withColumn("n", n).select(
        conv,
        turn,
        turn.alias("seq"),
        F.concat(F.lit("u"), (conv % 7).cast("string"), F.lit("/"), conv.cast("string")).alias("task_id"),
        (conv * 1000 + turn).alias("timestamp"),
        F.concat_ws("_", conv.cast("string"), F.floor(turn / 2).cast("string")).alias("query_id"),
        "role",
        F.col("text").alias("content"),
        F.when(F.col("role") == "system", "assistant").otherwise("all").alias("access"),
        F.when(turn % 5 == 0, "search-worker").otherwise("m").alias("model"),
        F.element_at(F.array(F.lit("reply"), F.lit("expand"), F.lit("update")), (turn % 3 + 1).cast("int")).alias("mode"),
        F.concat(F.lit("notebook "), conv.cast("string"), F.lit(" "), turn.cast("string")).alias("notebook_title"),
        F.array(paper(1), paper(2), paper(3)).alias("papers"),
    )


MESSAGES = """m AS (
  SELECT conv_id, turn, 'u' || (conv_id % 7) || '/' || conv_id AS task_id, conv_id * 1000 + turn AS "timestamp",
         conv_id || '_' || (turn // 2) AS query_id, role, text AS content,
         CASE WHEN role = 'system' THEN 'assistant' ELSE 'all' END AS access,
         CASE WHEN turn % 5 = 0 THEN 'search-worker' ELSE 'm' END AS model,
         list_extract(['reply', 'expand', 'update'], turn % 3 + 1) AS mode,
         'notebook ' || conv_id || ' ' || turn AS notebook_title,
         [{'paperId': 'd' || ((conv_id + turn) % n), 'user_score': (conv_id + 1) % 3 - 1},
          {'paperId': 'd' || ((conv_id + turn * 2) % n), 'user_score': (conv_id + 2) % 3 - 1},
          {'paperId': 'd' || ((conv_id + turn * 3) % n), 'user_score': (conv_id + 3) % 3 - 1}] AS papers
  FROM conversations, (SELECT count(*) AS n FROM documents))"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "labels").select(
        _doc(F.col("doc_id")).alias("paperId"),
        F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality")).alias("user_score"),
    )


FEEDBACK = """fb AS (SELECT 'd' || doc_id AS "paperId", CASE WHEN toxic = 1 THEN -1 ELSE quality END AS user_score FROM labels)"""


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(read_table(spark, sf, "pages").select("page_id", "html"))
    parts = pages.select("page_id", F.posexplode(F.split("html", "<p")).alias("block_idx", "part"))
    k = F.col("page_id") + F.col("block_idx")
    side = lambda m: F.col("block_idx") * m % 100 / F.lit(100.0)
    content = F.regexp_replace(F.concat(F.lit("<p"), F.col("part")), "<[^>]*>", " ")
    return parts.select(
        "page_id",
        F.col("block_idx").cast("bigint").alias("block_idx"),
        (F.lit(8) + k % 3).cast("double").alias("fontsize"),
        F.floor(F.col("block_idx") / 4).cast("double").alias("page"),
        side(37).alias("bottom"),
        side(41).alias("top"),
        side(43).alias("left"),
        side(47).alias("right"),
        content.alias("content"),
    )


PAGE_BLOCKS = """b AS (
  SELECT page_id, block_idx, CAST(8 + (page_id + block_idx) % 3 AS DOUBLE) AS fontsize,
         CAST(block_idx // 4 AS DOUBLE) AS page,
         block_idx * 37 % 100 / 100.0 AS bottom, block_idx * 41 % 100 / 100.0 AS top,
         block_idx * 43 % 100 / 100.0 AS "left", block_idx * 47 % 100 / 100.0 AS "right",
         regexp_replace('<p' || part, '<[^>]*>', ' ', 'g') AS content
  FROM (SELECT page_id, unnest(string_split(html, '<p')) AS part,
               generate_subscripts(string_split(html, '<p'), 1) - 1 AS block_idx FROM pages))"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with ``ts`` as an instant: the files hold UTC times without a zone, whatever the session's zone is."""
    since_epoch = F.col("ts").cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    instant = F.expr("TIMESTAMP_LTZ '1970-01-01 00:00:00Z'") + since_epoch
    return read_table(spark, sf, "events").withColumn("ts", instant)


def api_events(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/notebook/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"),
        (F.abs("value") / 10).alias("latency"),
    )


API_EVENTS = """ev AS (
  SELECT event_id, ts, user_id, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
         '/notebook/' || user_id || '/' || event_type AS endpoint,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status, abs(value) / 10 AS latency
  FROM events)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
