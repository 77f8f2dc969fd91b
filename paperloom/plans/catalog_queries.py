"""Catalogue queries over documents, labels and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import ids as I
from paperloom.functions import text as T
from paperloom.operators import catalog as C
from paperloom.operators import filters as P
from paperloom.operators import learn as L
from paperloom.operators import text_index
from paperloom.plans import fixtures as X
from paperloom.plans import jobs
from paperloom.plans.registry import query
from paperloom.session import new_folder, read_table
from paperloom.sources import feeds, parquet, vector_store

_META = X.with_ctes(X.PAPERS_META)
_TEXT = X.with_ctes(X.PAPERS_TEXT)
_BOTH = X.with_ctes(X.PAPERS_TEXT, X.PAPERS_META)


@query(
    "scan_filter_list",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
    "WHERE l_quantity > 30 AND l_returnflag IN ('A', 'R') AND l_linestatus != 'F' AND l_linenumber NOT IN (2, 3) AND l_discount <= 0.05",
)
def scan_filter_list(spark, sf):
    wanted = [
        ("l_quantity", ">", 30), ("l_returnflag", "in", ["A", "R"]), ("l_linestatus", "!=", "F"),
        ("l_linenumber", "not in", [2, 3]), ("l_discount", "<=", 0.05),
    ]
    return parquet.scan(spark, f"{sf}/lineitem.parquet", wanted).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "load_years",
    "SELECT year(o_orderdate) AS order_year, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders "
    "WHERE year(o_orderdate) IN (1996, 1998) GROUP BY 1",
)
def load_years(spark, sf):
    """Orders saved by year and loaded again, two years of them and one table of all."""
    folder = new_folder(spark, "orders-by-year")
    parquet.save_by_year(read_table(spark, sf, "orders").withColumn("publicationYear", F.year("o_orderdate")), folder)
    kept = parquet.load_years(spark, folder, [1996, 1998])
    return kept.groupBy(F.col("publicationYear").alias("order_year")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total")
    )


@query(
    "fallback_rows",
    _TEXT + """SELECT "paperId", status, main_text FROM pt WHERE status <> 'None'
UNION ALL SELECT "paperId", 'pristine', NULL FROM pt WHERE status = 'None'""",
)
def fallback_rows(spark, sf):
    """Papers without a worked-on text row come from the pristine table."""
    text = X.papers_text(spark, sf).select("paperId", "status", "main_text")
    pristine = text.select("paperId", F.lit("pristine").alias("status"))
    return parquet.with_fallback(text.where(F.col("status") != "None"), pristine)


@query("length_check", _BOTH + """SELECT (SELECT count(*) FROM pm) - (SELECT count(*) FROM pt WHERE status <> 'None') AS difference""")
def length_check(spark, sf):
    text = X.papers_text(spark, sf).where(F.col("status") != "None")
    return parquet.row_count_mismatch(X.papers_meta(spark, sf), text)


@query(
    "dedupe_by_title",
    """SELECT text AS title, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text""",
)
def dedupe_by_title(spark, sf):
    docs = read_table(spark, sf, "documents").select(F.col("text").alias("title"), "doc_id", "source")
    return C.keep_one(docs, ["title"], F.col("doc_id"))


_MERGE = """,
n AS (SELECT doi, arg_min("paperId", doc_id) AS "paperId", arg_min(struct_pack(a := abstract), doc_id).a AS abstract
      FROM (SELECT doc_id, doi, "paperId", CASE WHEN doc_id % 2 = 0 THEN abstract END AS abstract FROM pt WHERE doc_id % 3 > 0) GROUP BY doi),
o AS (SELECT doi, arg_min(venue, doc_id) AS venue, arg_min(struct_pack(a := a0), doc_id).a AS abstract
      FROM (SELECT doc_id, doi, venue, venue || ' stored' AS a0 FROM pm WHERE doc_id % 4 > 0) GROUP BY doi)
SELECT coalesce(n.doi, o.doi) AS doi, n."paperId", coalesce(n.abstract, o.abstract) AS abstract, o.venue
FROM n FULL OUTER JOIN o ON n.doi = o.doi"""


@query("merge_full_outer", _BOTH + _MERGE)
def merge_full_outer(spark, sf):
    """New rows over stored rows by doi; both sides overlap in part and hold nulls."""
    i = F.col("doc_id")
    text, meta = X.papers_text(spark, sf), X.papers_meta(spark, sf)
    new = text.where(i % 3 > 0).select("doc_id", "doi", "paperId", F.when(i % 2 == 0, F.col("abstract")).alias("abstract"))
    old = meta.where(i % 4 > 0).select("doc_id", "doi", "venue", F.concat("venue", F.lit(" stored")).alias("abstract"))
    return C.combine_first(
        C.keep_one(new, ["doi"], i).drop("doc_id"), C.keep_one(old, ["doi"], i).drop("doc_id"), "doi"
    )


@query(
    "merge_missing_keys",
    """WITH d AS (SELECT doc_id, 'd' || doc_id AS pid, source, 'old ' || source AS old,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'None' ELSE 'doi/' || (doc_id // 14) END AS doi FROM documents),
n AS (SELECT doi, min(pid) AS pid, arg_min(source, pid) AS venue FROM d WHERE doc_id % 2 = 0 AND doc_id % 7 > 2 GROUP BY doi),
o AS (SELECT doi, min(pid) AS pid, arg_min(old, pid) AS venue FROM d WHERE doc_id % 2 = 1 AND doc_id % 7 > 2 GROUP BY doi)
SELECT doi, coalesce(n.pid, o.pid) AS "paperId", coalesce(n.venue, o.venue) AS venue FROM n FULL JOIN o USING (doi)
UNION ALL SELECT coalesce(doi, 'None'), pid, CASE WHEN doc_id % 2 = 0 THEN source ELSE old END FROM d WHERE doc_id % 7 <= 2""",
)
def merge_missing_keys(spark, sf):
    """Papers whose doi is null, empty or 'None', on both sides of a merge, next to repeated dois."""
    i = F.col("doc_id")
    kind = i % 7
    doi = F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, "None").otherwise(F.concat(F.lit("doi/"), F.floor(i / 14).cast("string")))
    docs = read_table(spark, sf, "documents").select(
        "doc_id", doi.alias("doi"), F.concat(F.lit("d"), i.cast("string")).alias("paperId"), F.col("source").alias("venue")
    )
    new = C.keep_keyed(docs.where(i % 2 == 0).drop("doc_id"), "doi", F.col("paperId"))
    old = docs.where(i % 2 == 1).withColumn("venue", F.concat(F.lit("old "), "venue")).drop("doc_id")
    return jobs.merge_table(new, old).select("doi", "paperId", "venue")


@query(
    "merge_extracted_text",
    _BOTH + """,
x AS (SELECT doi, arg_min("paperId", doc_id) AS "paperId", arg_min(main_text, doc_id) AS main_text FROM pt WHERE main_text <> 'None' GROUP BY doi),
t AS (SELECT doi, arg_min("paperId", doc_id) AS "paperId", arg_min(title, doc_id) AS title FROM pt GROUP BY doi),
j AS (SELECT coalesce(x.doi, t.doi) AS doi, coalesce(x."paperId", t."paperId") AS "paperId", x.main_text, t.title
      FROM x FULL OUTER JOIN t ON x.doi = t.doi)
SELECT pm."paperId", j.doi, j.main_text, j.title FROM pm LEFT JOIN j ON pm."paperId" = j."paperId" """,
)
def merge_extracted_text(spark, sf):
    text = X.papers_text(spark, sf)
    extracted = text.where(F.col("main_text") != "None").select("doc_id", "doi", "paperId", "main_text")
    stored = text.select("doc_id", "doi", "paperId", "title")
    return C.merge_extracted(extracted, stored, X.papers_meta(spark, sf), "doc_id").drop("doc_id")


@query(
    "enrichment_left_join",
    _BOTH + """SELECT pt."paperId", pt.title, coalesce(pm."citationCount", 0) AS "citationCount",
       coalesce(pm."openAccessPdf", 'None') AS "openAccessPdf"
FROM pt LEFT JOIN (SELECT * FROM pm WHERE "isOpenAccess") pm ON pt."paperId" = pm."paperId" """,
)
def enrichment_left_join(spark, sf):
    specs = X.papers_meta(spark, sf).where("isOpenAccess").select("paperId", "citationCount", "openAccessPdf")
    papers = X.papers_text(spark, sf).select("paperId", "title")
    return C.enrich(papers, specs, ["citationCount"], ["openAccessPdf"])


@query(
    "text_fallback",
    _TEXT + """,
f AS (SELECT "paperId", CASE WHEN main_text = 'None' THEN '' ELSE main_text END AS m, coalesce(title, '') || ' ' || coalesce(abstract, '') AS ta FROM pt),
g AS (SELECT "paperId", CASE WHEN length(m) < 500 THEN ta ELSE m END AS main_text, ta AS ref_text,
             length(regexp_replace(m, '^\\s+|\\s+$', '', 'g')) > 500 AS pdf_extracted FROM f)
SELECT * FROM g WHERE length(main_text) >= 500""",
)
def text_fallback(spark, sf):
    return C.sufficient_text(X.papers_text(spark, sf)).drop("title", "abstract")


@query(
    "payload_join",
    _BOTH + """,
f AS (SELECT "paperId", CASE WHEN main_text = 'None' THEN '' ELSE main_text END AS m, coalesce(title, '') || ' ' || coalesce(abstract, '') AS ta FROM pt),
g AS (SELECT "paperId", CASE WHEN length(m) < 500 THEN ta ELSE m END AS main_text FROM f)
SELECT pm."paperId", pm.venue, pm."publicationYear", length(g.main_text) AS chars
FROM pm JOIN g ON pm."paperId" = g."paperId" WHERE length(g.main_text) >= 500""",
)
def payload_join(spark, sf):
    both = C.payload_and_text(X.papers_meta(spark, sf), X.papers_text(spark, sf))
    return both.select("paperId", "venue", "publicationYear", F.length("main_text").alias("chars"))


@query(
    "discarded_papers",
    _TEXT + """,
f AS (SELECT CASE WHEN main_text = 'None' THEN '' ELSE main_text END AS m, coalesce(title, '') || ' ' || coalesce(abstract, '') AS ta FROM pt)
SELECT count(*) AS discarded FROM f WHERE length(CASE WHEN length(m) < 500 THEN ta ELSE m END) < 500""",
)
def discarded_papers(spark, sf):
    return C.discarded_count(X.papers_meta(spark, sf), X.papers_text(spark, sf))


@query(
    "status_remap",
    _TEXT + """SELECT "paperId", CASE status WHEN 'extracted' THEN 'pdf_pushed' WHEN 'None' THEN 'abstract_pushed' ELSE status END AS status FROM pt""",
)
def status_remap(spark, sf):
    text = X.papers_text(spark, sf).select("paperId", "status")
    return C.remap_status(text, {"extracted": "pdf_pushed", "None": "abstract_pushed"})


@query(
    "status_set_for_listed",
    X.with_ctes(X.PAPERS_TEXT, X.FEEDBACK) + """SELECT "paperId", CASE WHEN "paperId" IN (SELECT "paperId" FROM fb) THEN 'extracted' ELSE status END AS status FROM pt""",
)
def status_set_for_listed(spark, sf):
    text = X.papers_text(spark, sf).select("paperId", "status")
    return C.set_status(text, "extracted", X.feedback(spark, sf))


@query("worklist_open_access", _TEXT + """SELECT "paperId", status FROM pt WHERE status <> 'pdf_pushed' AND "isOpenAccess" """)
def worklist_open_access(spark, sf):
    text = X.papers_text(spark, sf)
    return text.where(P.compile_filters(P.work_list(only_new=False, open_access=True))).select("paperId", "status")


@query("worklist_new", _TEXT + """SELECT "paperId" FROM pt WHERE status = 'None'""")
def worklist_new(spark, sf):
    return X.papers_text(spark, sf).where(P.compile_filters(P.work_list(only_new=True))).select("paperId")


@query(
    "worklist_join",
    _BOTH + """SELECT pm."paperId", pt.status, pm."openAccessPdf" FROM pt JOIN pm ON pt."paperId" = pm."paperId" AND pt.doi = pm.doi WHERE pt.status <> 'pdf_pushed'""",
)
def worklist_join(spark, sf):
    text = X.papers_text(spark, sf).where(P.compile_filters(P.work_list(only_new=False))).select("paperId", "doi", "status")
    return X.papers_meta(spark, sf).join(text, ["paperId", "doi"], "inner").select("paperId", "status", "openAccessPdf")


@query(
    "payload_filter_fields",
    _BOTH + """SELECT pm."paperId", venue, "publicationYear", "citationCount" FROM pm JOIN pt USING ("paperId")
WHERE venue IN ('src1', 'src2', 'arXiv.org') AND venue_lower NOT IN ('src2') AND "citationCount" >= 20 AND "influentialCitationCount" < 6
  AND "publicationDate" >= '2016-03-01' AND "publicationDate" < '2023-01-01' AND (contains(title, 'e') OR contains(title, 'zzz'))
  AND contains("authorName", 'Ann') AND contains("authorName", 'Bo')""",
)
def payload_filter_fields(spark, sf):
    both = X.papers_meta(spark, sf).join(X.papers_text(spark, sf).select("paperId", "title"), "paperId")
    wanted = P.payload_filter(
        [
            ["venue", "==", ["src1", "src2", "arXiv.org"]],
            ["venue_lower", "!=", "src2"],
            ["citationCount", "gte", 20],
            ["influentialCitationCount", "lt", 6],
            ["publicationDate", "gte", "2016-03-01"],
            ["publicationDate", "lt", "2023-01-01"],
            ["title", "any", ["e", "zzz"]],
            ["authorName", "==", ["Ann", "Bo"]],
        ]
    )
    return both.where(wanted).select("paperId", "venue", "publicationYear", "citationCount")


@query("fulltext_any", "SELECT doc_id FROM documents WHERE contains(text, 'ing the') OR contains(text, 'tion') OR contains(text, 'und')")
def fulltext_any(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.where(P.text_match(F.col("text"), ["ing the", "tion", "und"], any_text=True)).select("doc_id")


@query(
    "fulltext_all_tokens",
    r"""SELECT doc_id FROM documents
WHERE list_has_all(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['the', 'of']) AND list_has_all(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['and'])""",
)
def fulltext_all_tokens(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.where(P.text_match(F.col("text"), ["The of", "and"], any_text=False, mode="token")).select("doc_id")


def _indexed_filter(spark, sf, texts, any_text, mode):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    index = text_index.build(docs, new_folder(spark, "texts"), "text", "doc_id", mode)
    filters = spark.createDataFrame([(1, texts, any_text)], "query_id int, texts array<string>, any boolean")
    return text_index.search(index, filters)[0].select("doc_id")


@query("fulltext_any_indexed", "SELECT doc_id FROM documents WHERE contains(text, 'ing the') OR contains(text, 'tion') OR contains(text, 'und')")
def fulltext_any_indexed(spark, sf):
    """The filter through a stored index of trigrams."""
    return _indexed_filter(spark, sf, ["ing the", "tion", "und"], True, "substring")


@query(
    "fulltext_all_tokens_indexed",
    r"""SELECT doc_id FROM documents
WHERE list_has_all(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['the', 'of']) AND list_has_all(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['and'])""",
)
def fulltext_all_tokens_indexed(spark, sf):
    """The filter through a stored index of words."""
    return _indexed_filter(spark, sf, ["The of", "and"], False, "token")


@query(
    "request_filters",
    _META + """SELECT "paperId", venue FROM pm WHERE contains("authorName", 'Ann') AND "publicationDate" >= '2016-01-01'
AND "publicationDate" <= '2022-12-31' AND venue_lower NOT IN ('arxiv.org', 'biorxiv') AND venue_lower IN ('src1', 'src3') AND "citationCount" >= 5""",
)
def request_filters(spark, sf):
    parsed = {
        "authorName": "Ann", "publicationDate_start": "2016-01-01", "publicationDate_end": "2022-12-31",
        "peer_reviewed_only": True, "venues": ["SRC1", "src3"], "citationCount": 5,
    }
    return X.papers_meta(spark, sf).where(P.request_condition(parsed)).select("paperId", "venue")


@query(
    "paper_lock",
    X.with_ctes(X.PAPERS_META, X.FEEDBACK) + """SELECT "paperId", venue FROM pm WHERE "paperId" IN (SELECT "paperId" FROM fb WHERE user_score >= 0)""",
)
def paper_lock(spark, sf):
    meta = X.papers_meta(spark, sf).select("paperId", "venue")
    return P.lock_to_notebook(meta, X.feedback(spark, sf), ["paperId"])


@query(
    "trash_filter",
    X.with_ctes(X.PAPERS_META, X.FEEDBACK) + """SELECT "paperId", venue FROM pm WHERE "paperId" NOT IN (SELECT "paperId" FROM fb WHERE user_score < 0)""",
)
def trash_filter(spark, sf):
    return P.drop_trashed(X.papers_meta(spark, sf).select("paperId", "venue"), X.feedback(spark, sf), ["paperId"])


@query("allowed_fields", 'SELECT doc_id, lang FROM documents')
def allowed_fields(spark, sf):
    return P.select_allowed(read_table(spark, sf, "documents"), ["doc_id", "lang", "secret"], ["doc_id", "lang", "source"])


@query(
    "citation_threshold",
    _META + """SELECT "paperId", "publicationYear", "citationCount" FROM pm
WHERE "citationCount" >= greatest(0, least(20, 3 * (2026 - 2 - "publicationYear")))""",
)
def citation_threshold(spark, sf):
    meta = X.papers_meta(spark, sf)
    floor = P.citation_floor(F.col("publicationYear"), 3, 2026)
    return meta.where(F.col("citationCount") >= floor).select("paperId", "publicationYear", "citationCount")


@query(
    "readable_papers",
    _TEXT + """SELECT "paperId" FROM pt WHERE "isOpenAccess" OR (doc_id % 3 = 0 AND abstract <> '')""",
)
def readable_papers(spark, sf):
    """Abstracts are null for a third of the papers and empty for another."""
    kind = F.col("doc_id") % 3
    text = X.papers_text(spark, sf).withColumn("abstract", F.when(kind == 0, F.col("abstract")).when(kind == 1, ""))
    return C.readable(text).select("paperId")


@query(
    "plausible_venues",
    _META + """SELECT "paperId", v AS venue FROM (SELECT "paperId", CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(venue, 1, 3) ELSE venue END AS v FROM pm)
WHERE length(v) > 3""",
)
def plausible_venues(spark, sf):
    """Venues are missing for a quarter of the papers and cut to three letters for another."""
    kind = F.col("doc_id") % 4
    venue = F.when(kind == 0, F.lit(None)).when(kind == 1, F.substring("venue", 1, 3)).otherwise(F.col("venue"))
    return C.plausible_venue(X.papers_meta(spark, sf).withColumn("venue", venue)).select("paperId", "venue")


@query(
    "missing_markers",
    _TEXT + """SELECT "paperId", nullif(status, 'None') AS decoded, coalesce(nullif(status, 'None'), 'None') AS encoded,
       CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 7 END AS counts FROM pt""",
)
def missing_markers(spark, sf):
    text = X.papers_text(spark, sf)
    decoded = C.decode_missing(text.select("doc_id", "paperId", "status")).withColumn("decoded", F.col("status"))
    counts = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7).alias("counts")
    kept = decoded.select("paperId", "decoded", "status", counts)
    encoded = C.encode_missing(kept.select("paperId", "status", "counts"), ["counts"]).withColumnRenamed("status", "encoded")
    return kept.select("paperId", "decoded").join(encoded, "paperId")


@query(
    "article_split",
    _BOTH + """SELECT 'metadata' AS part, 'doi,openAccessPdf,paperId,venue' AS columns, count(*) AS n FROM pm
UNION ALL SELECT 'text', 'abstract,doi,openAccessPdf,paperId,status,title', count(*) FROM pt""",
)
def article_split(spark, sf):
    text = X.papers_text(spark, sf).select("paperId", "title", "abstract", "status")
    meta = X.papers_meta(spark, sf).select("paperId", "doi", "venue", "openAccessPdf")
    parts = C.split_article(meta.join(text, "paperId"))
    shape = lambda name, df: df.agg(
        F.lit(name).alias("part"), F.lit(",".join(sorted(df.columns))).alias("columns"), F.count(F.lit(1)).alias("n")
    )
    return shape("metadata", parts[0]).unionByName(shape("text", parts[1]))


@query(
    "field_overlap",
    _META + """SELECT "paperId", "fieldsOfStudy" FROM pm WHERE list_has_any(string_split("fieldsOfStudy", ','),
  (SELECT list(DISTINCT split_part("fieldsOfStudy", ',', 1)) FROM pm WHERE "fieldsOfStudy" LIKE 'de%' OR "fieldsOfStudy" LIKE 'fr%'))""",
)
def field_overlap(spark, sf):
    meta = X.papers_meta(spark, sf)
    fields = C.first_fields(meta.where(F.col("fieldsOfStudy").rlike("^(de|fr)")))
    return C.overlaps_fields(meta, fields).select("paperId", "fieldsOfStudy")


@query("first_fields", _META + """SELECT DISTINCT split_part("fieldsOfStudy", ',', 1) AS field FROM pm""")
def first_fields(spark, sf):
    return C.first_fields(X.papers_meta(spark, sf))


@query("papers_of_year", _META + """SELECT "paperId" FROM pm WHERE "publicationYear" = 2019""")
def papers_of_year(spark, sf):
    return C.of_year(X.papers_meta(spark, sf), 2019).select("paperId")


@query(
    "link_replacement",
    _META + """,
snap AS (SELECT 'd' || o_orderkey AS "paperId", 'gs://snapshot/' || o_orderkey AS link FROM orders WHERE o_orderstatus = 'F')
SELECT pm."paperId", coalesce(s.link, "openAccessPdf") AS "openAccessPdf" FROM pm
LEFT JOIN snap s ON list_extract(string_split("openAccessPdf", '/'), -1) = s."paperId" """,
)
def link_replacement(spark, sf):
    orders = read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    key = F.col("o_orderkey").cast("string")
    snapshot = orders.select(F.concat(F.lit("d"), key).alias("paperId"), F.concat(F.lit("gs://snapshot/"), key).alias("openAccessPdf"))
    return C.replace_links(X.papers_meta(spark, sf).select("paperId", "openAccessPdf"), snapshot)


@query(
    "chained_semi_join",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)",
)
def chained_semi_join(spark, sf):
    wanted = [("o_orderpriority", "==", "1-URGENT"), ("o_totalprice", ">", 300000)]
    orders = parquet.scan(spark, f"{sf}/orders.parquet", wanted).withColumnRenamed("o_orderkey", "l_orderkey")
    return C.chained_semi(read_table(spark, sf, "lineitem"), orders, "l_orderkey").select("l_orderkey", "l_linenumber")


@query(
    "drop_stored_titles",
    "SELECT p_partkey, upper(p_name) AS title FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size > 49)",
)
def drop_stored_titles(spark, sf):
    part = read_table(spark, sf, "part")
    snapshot = part.select("p_partkey", F.upper("p_name").alias("title"))
    stored = part.where(F.col("p_size") > 49).select(F.col("p_name").alias("title"))
    return C.drop_stored(snapshot, stored)


@query(
    "not_yet_processed",
    X.with_ctes(X.PAPERS_META, X.CHUNK_VECTORS, X.FEEDBACK) + """SELECT "paperId" FROM pm
WHERE "paperId" NOT IN (SELECT "paperId" FROM v) AND "paperId" NOT IN (SELECT "paperId" FROM fb)""",
)
def not_yet_processed(spark, sf):
    done = [X.chunk_vectors(spark, sf), X.feedback(spark, sf)]
    return C.not_processed(X.papers_meta(spark, sf).select("paperId"), done)


@query(
    "citation_edges",
    _META + """SELECT DISTINCT "paperId", r AS "refId" FROM (SELECT "paperId", unnest(string_split("referenceIds", ';')) AS r FROM pm)
WHERE r <> '' AND r IN (SELECT "paperId" FROM pm)""",
)
def citation_edges(spark, sf):
    return L.citation_edges(X.papers_meta(spark, sf))


@query(
    "concat_subsets",
    _META + """SELECT "paperId", venue, CASE WHEN "publicationYear" = 2018 THEN NULL ELSE "citationCount" END AS "citationCount"
FROM pm WHERE "publicationYear" IN (2016, 2018)""",
)
def concat_subsets(spark, sf):
    """Two year subsets, one without the count column."""
    meta = X.papers_meta(spark, sf)
    a = C.of_year(meta, 2016).select("paperId", "venue", "citationCount")
    return parquet.concat_subsets([a, C.of_year(meta, 2018).select("paperId", "venue")])


@query(
    "conditional_counts",
    _BOTH + """SELECT "publicationYear", count(*) AS papers, count(DISTINCT pm.doi) AS distinct_dois,
       count_if("isOpenAccess" AND status = 'extracted') AS open_extracted, count_if("citationCount" > 50) AS well_cited
FROM pm JOIN (SELECT "paperId", status FROM pt) t USING ("paperId") GROUP BY "publicationYear" """,
)
def conditional_counts(spark, sf):
    both = X.papers_meta(spark, sf).join(X.papers_text(spark, sf).select("paperId", "status"), "paperId")
    return both.groupBy("publicationYear").agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_distinct("doi").alias("distinct_dois"),
        F.count_if(F.col("isOpenAccess") & (F.col("status") == "extracted")).alias("open_extracted"),
        F.count_if(F.col("citationCount") > 50).alias("well_cited"),
    )


@query(
    "length_profile",
    "SELECT source, max(octet_length(encode(text))) AS longest, count_if(octet_length(encode(text)) >= 2000) AS over_limit FROM documents GROUP BY source",
)
def length_profile(spark, sf):
    size = F.octet_length("text")
    return read_table(spark, sf, "documents").groupBy("source").agg(
        F.max(size).alias("longest"), F.count_if(size >= 2000).alias("over_limit")
    )


@query("id_intersect", _META + """SELECT DISTINCT r AS id FROM (SELECT unnest(string_split("referenceIds", ';')) AS r FROM pm) WHERE r IN (SELECT "paperId" FROM pm)""")
def id_intersect(spark, sf):
    meta = X.papers_meta(spark, sf)
    refs = meta.select(F.explode(F.split("referenceIds", ";")).alias("id"))
    return refs.intersect(meta.select(F.col("paperId").alias("id")))


@query("id_subtract", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_subtract(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id").subtract(read_table(spark, sf, "labels").select("doc_id"))


@query("id_union", "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def id_union(spark, sf):
    a = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return a.union(read_table(spark, sf, "customer").select("c_custkey")).distinct()


@query(
    "vector_upsert",
    X.with_ctes(X.CHUNK_VECTORS) + """SELECT "paperId", chunk_idx, 'new' AS origin FROM v WHERE label >= 8 AND chunk_idx < 3
UNION ALL SELECT "paperId", chunk_idx, 'old' FROM v WHERE "paperId" NOT IN (SELECT "paperId" FROM v WHERE label >= 8 AND chunk_idx < 3)""",
)
def vector_upsert(spark, sf):
    v = X.chunk_vectors(spark, sf)
    new = v.where((F.col("label") >= 8) & (F.col("chunk_idx") < 3)).select("paperId", "chunk_idx", F.lit("new").alias("origin"))
    return vector_store.upsert(v.select("paperId", "chunk_idx", F.lit("old").alias("origin")), new)


@query(
    "vector_delete",
    X.with_ctes(X.CHUNK_VECTORS, X.FEEDBACK) + """SELECT "paperId", chunk_idx FROM v WHERE "paperId" NOT IN (SELECT "paperId" FROM fb WHERE user_score < 1)""",
)
def vector_delete(spark, sf):
    keys = X.feedback(spark, sf).where(F.col("user_score") < 1)
    return vector_store.delete(X.chunk_vectors(spark, sf).select("paperId", "chunk_idx"), keys)


@query(
    "vector_payload_update",
    X.with_ctes(X.CHUNK_VECTORS, X.PAPERS_META) + """SELECT v."paperId", chunk_idx, v.label,
  CASE WHEN m."paperId" IS NOT NULL THEN m."citationCount" ELSE v."citationCount" END AS "citationCount",
  CASE WHEN m."paperId" IS NOT NULL THEN m."publicationYear" ELSE v."publicationYear" END AS "publicationYear"
FROM v LEFT JOIN (SELECT * FROM pm WHERE "isOpenAccess") m ON v."paperId" = m."paperId" """,
)
def vector_payload_update(spark, sf):
    from paperloom.sources.schemas import CHUNK_PAYLOAD

    new = X.papers_meta(spark, sf).where("isOpenAccess").select(
        "paperId", "citationCount", "publicationYear", F.lit(-1).alias("label")
    )
    old = X.chunk_vectors(spark, sf).select("paperId", "chunk_idx", "label", "citationCount", "publicationYear")
    return vector_store.update_payload(old, new, CHUNK_PAYLOAD)


@query("vector_existing_keys", X.with_ctes(X.CHUNK_VECTORS) + 'SELECT DISTINCT "paperId" FROM v')
def vector_existing_keys(spark, sf):
    return vector_store.existing_keys(X.chunk_vectors(spark, sf))


@query(
    "embedding_documents",
    X.with_ctes(X.CHUNK_VECTORS) + """,
d AS (SELECT "paperId", count(*) AS chunks, string_agg(label, ',' ORDER BY chunk_idx) AS labels FROM v GROUP BY "paperId"),
m AS (SELECT "paperId", round(avg(x), 6) AS m1 FROM (SELECT "paperId", e[1] AS x FROM v) GROUP BY "paperId")
SELECT "paperId", chunks, labels, m1 AS mean_1 FROM d JOIN m USING ("paperId")""",
)
def embedding_documents(spark, sf):
    docs = vector_store.embedding_documents(X.chunk_vectors(spark, sf), ["label"])
    return docs.select(
        "paperId",
        F.size("embeddings").cast("bigint").alias("chunks"),
        F.array_join(F.transform("payloads", lambda p: p["label"].cast("string")), ",").alias("labels"),
        F.round(F.col("mean_embedding")[0], 6).alias("mean_1"),
    )


@query(
    "sample_rows",
    "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100",
)
def sample_rows(spark, sf):
    return parquet.sample_rows(read_table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")


@query(
    "api_pages_flatten",
    """WITH d AS (SELECT doc_id, text, lang, source, split_part(text, chr(10), 1) AS title FROM documents),
k AS (SELECT title, min('d' || doc_id) AS pid FROM d WHERE doc_id % 6 > 0 GROUP BY title)
SELECT k.pid AS "paperId", d.source AS venue, lower(d.source) AS venue_lower, doc_id % 5 AS "citationCount",
  lang || ',' || source AS "fieldsOfStudy", 'a' || doc_id AS "authorId", CASE WHEN doc_id % 6 = 1 THEN 'Ann' ELSE 'Ann,Bo' END AS "authorName"
FROM k JOIN d ON k.pid = 'd' || d.doc_id WHERE length(source) > 3""",
)
def api_pages_flatten(spark, sf):
    """Documents as landed API pages, one page per language, some papers without authors."""
    flat = feeds.flatten_pages(_pages(spark, sf))
    return flat.select("paperId", "venue", "venue_lower", "citationCount", "fieldsOfStudy", "authorId", "authorName")


def _pages(spark, sf):
    docs = read_table(spark, sf, "documents")
    i = F.col("doc_id")
    author = lambda id_, name: F.struct(id_.alias("authorId"), name.alias("name"))
    one = author(F.concat(F.lit("a"), i.cast("string")), F.lit("Ann"))
    authors = (
        F.when(i % 6 == 0, F.lit(None))
        .when(i % 6 == 1, F.array(one))
        .otherwise(F.array(one, author(F.lit(None).cast("string"), F.lit("Bo")), author(F.lit(""), F.lit(None).cast("string"))))
    )
    paper = F.struct(
        F.concat(F.lit("d"), i.cast("string")).alias("paperId"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("abstract"),
        F.col("source").alias("venue"),
        F.when(i % 5 > 0, (i % 5).cast("int")).alias("citationCount"),
        F.lit("2020-01-01").alias("publicationDate"),
        F.array("lang", F.lit(""), "source").alias("fieldsOfStudy"),
        authors.alias("authors"),
    )
    # One document per landed page, so no page grows with the table.
    return docs.select(
        X.row_count(docs).alias("total"), F.when(i > 0, F.lit("next")).alias("token"), F.array(paper).alias("data")
    )


@query(
    "api_pages_incomplete",
    "SELECT source, count(*) AS seen, (SELECT count(*) FROM documents) AS total, count_if(doc_id = 0) AS last_pages FROM documents GROUP BY source",
)
def api_pages_incomplete(spark, sf):
    """Every source alone is an incomplete set of pages."""
    pages = _pages(spark, sf).withColumn("source", F.col("data")[0]["venue"])
    return feeds.incomplete_pages(pages, ["source"])


@query(
    "enrichment_flatten",
    _META + """SELECT "paperId", CASE WHEN doc_id % 2 = 0 THEN "openAccessPdf" END AS "openAccessPdf",
  CASE WHEN doc_id % 4 = 3 THEN 'None' WHEN doc_id % 4 = 0 THEN doi WHEN doc_id % 4 = 1 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS doi,
  split_part("referenceIds", ';', 1) || ';' || split_part("referenceIds", ';', 3) AS "referenceIds",
  'on ' || venue || ', part' AS "referenceTitles" FROM pm WHERE doc_id % 9 > 0""",
)
def enrichment_flatten(spark, sf):
    i, s = F.col("doc_id"), F.lit(None).cast("string")
    ref = lambda pid, title: F.struct(pid.alias("paperId"), title.alias("title"))
    part = lambda k: F.split_part("referenceIds", F.lit(";"), F.lit(k))
    ids = F.when(
        i % 4 < 3,
        F.struct(
            F.when(i % 4 == 0, F.col("doi")).alias("DOI"),
            F.when(i % 4 == 1, F.concat(F.lit("x"), i.cast("string"))).alias("ArXiv"),
            i.alias("CorpusId"),
        ),
    )
    docs = X.papers_meta(spark, sf).select(
        F.when(i % 9 > 0, F.col("paperId")).alias("paperId"),
        F.array(ref(part(1), F.concat(F.lit("on "), "venue", F.lit("; part"))), ref(s, s), ref(part(3), s)).alias("references"),
        F.when(i % 2 == 0, F.struct(F.col("openAccessPdf").alias("url"))).alias("openAccessPdf"),
        ids.alias("externalIds"),
        "influentialCitationCount",
        "isOpenAccess",
    )
    return feeds.flatten_enrichment(docs).select("paperId", "openAccessPdf", "doi", "referenceIds", "referenceTitles")


@query(
    "snapshot_normalise",
    """WITH s AS (SELECT *, 'd' || doc_id AS id, DATE '2007-04-02' + CAST(doc_id % 5000 AS INT) AS day FROM documents)
SELECT id AS "paperId", 'Ann, Bo, ' || source AS "authorName",
  CASE doc_id % 4 WHEN 0 THEN 'Computer Science,Mathematics' WHEN 1 THEN 'Geology' WHEN 2 THEN 'Biology,Other' ELSE 'Physics' END AS "fieldsOfStudy",
  'gs://arxiv-dataset/arxiv/arxiv/pdf/' || id || '/' || id || 'v2.pdf' AS "openAccessPdf",
  strftime(day, '%Y-%m-%d') AS "publicationDate", year(day) AS "publicationYear",
  CASE WHEN doc_id % 3 = 0 THEN '10.48550/arXiv.' || id ELSE '10.1/' || doc_id END AS doi FROM s""",
)
def snapshot_normalise(spark, sf):
    """Documents as raw snapshot records."""
    wanted = ["paperId", "authorName", "fieldsOfStudy", "openAccessPdf", "publicationDate", "publicationYear", "doi"]
    return feeds.normalise_snapshot(_snapshot(spark, sf)).select(*wanted)


def _snapshot(spark, sf):
    i = F.col("doc_id")
    day = F.date_add(F.lit("2007-04-02").cast("date"), (i % 5000).cast("int"))
    created = F.concat(F.date_format(day, "E, d MMM yyyy"), F.lit(" 10:00:00 GMT"))
    version = lambda v, c: F.struct(F.lit(v).alias("version"), c.alias("created"))
    codes = F.array(F.lit("cs.AI stat.ML"), F.lit("physics.geo-ph"), F.lit("q-bio.GN made-up"), F.lit("hep-th cond-mat.str-el"))
    none = F.lit(None).cast("string")
    return read_table(spark, sf, "documents").select(
        F.concat(F.lit("d"), i.cast("string")).alias("id"),
        F.col("text").alias("title"), F.col("text").alias("abstract"), none.alias("submitter"), none.alias("comments"),
        none.alias("journal-ref"), none.alias("report-no"), none.alias("license"),
        F.concat(F.lit("Ann and Bo  and "), "source").alias("authors"),
        F.element_at(codes, (i % 4 + 1).cast("int")).alias("categories"),
        F.when(i % 3 > 0, F.concat(F.lit("10.1/"), i.cast("string"))).alias("doi"),
        F.array(version("v1", created), version("v2", F.lit("Mon, 1 Jan 2024 00:00:00 GMT"))).alias("versions"),
    )


@query(
    "snapshot_merge",
    """WITH s AS (SELECT 'd' || doc_id AS pid, text AS title, doc_id % 4 AS k, CASE WHEN doc_id % 3 = 0 THEN '10.48550/arXiv.d' || doc_id ELSE '10.1/' || doc_id END AS doi,
  year(DATE '2007-04-02' + CAST(doc_id % 5000 AS INT)) AS y, 'gs://arxiv-dataset/arxiv/arxiv/pdf/d' || doc_id || '/d' || doc_id || 'v2.pdf' AS link FROM documents),
n AS (SELECT doi, s.pid, 'arXiv.org' AS venue, link FROM s JOIN (SELECT title, min(pid) AS pid FROM s WHERE k IN (1, 3) AND y = 2008 GROUP BY title) f ON s.pid = f.pid),
o AS (SELECT '10.1/' || doc_id AS doi, 's' || doc_id AS pid, 'stored' AS venue, 'http://h/d' || doc_id AS link FROM documents WHERE doc_id % 2 = 1),
j AS (SELECT coalesce(n.doi, o.doi) AS doi, coalesce(n.pid, o.pid) AS pid, coalesce(n.venue, o.venue) AS venue, coalesce(n.link, o.link) AS link FROM n FULL OUTER JOIN o ON n.doi = o.doi)
SELECT j.doi, j.pid AS "paperId", j.venue, coalesce(s.link, j.link) AS "openAccessPdf" FROM j LEFT JOIN s ON list_extract(string_split(j.link, '/'), -1) = s.pid""",
)
def snapshot_merge(spark, sf):
    """One year of snapshot papers, in the fields the stored table covers, merged over it."""
    from paperloom.plans import jobs

    i = F.col("doc_id")
    key = i.cast("string")
    stored = read_table(spark, sf, "documents").where(i % 2 == 1).select(
        F.concat(F.lit("10.1/"), key).alias("doi"),
        F.concat(F.lit("s"), key).alias("paperId"),
        F.lit("stored").alias("venue"),
        F.when(i % 4 == 1, "Geology,x").otherwise("Physics,x").alias("fieldsOfStudy"),
        F.concat(F.lit("http://h/d"), key).alias("openAccessPdf"),
        F.lit("t").alias("title"),
    )
    snapshot = feeds.normalise_snapshot(_snapshot(spark, sf))
    meta, _ = jobs.merge_snapshot(snapshot, stored.drop("title"), stored.drop("venue", "fieldsOfStudy"), 2008)
    return meta.select("doi", "paperId", "venue", "openAccessPdf")


@query(
    "clean_columns",
    """SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, lower(source) AS source_lower,
  CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END AS flag, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS BIGINT) AS counted FROM documents""",
)
def clean_columns(spark, sf):
    i = F.col("doc_id")
    docs = read_table(spark, sf, "documents").withColumn(
        "flag", F.when(i % 3 == 0, " True ").when(i % 3 == 1, "FALSE").otherwise("unknown")
    )
    clean = T.clean_strings(docs)
    return clean.select(
        "doc_id", "text", F.lower("source").alias("source_lower"), T.parse_bool(F.col("flag")).alias("flag"),
        T.count_or_zero(F.when(i % 4 > 0, F.col("n_chars"))).cast("bigint").alias("counted"),
    )


@query(
    "link_functions",
    _META + r"""SELECT "paperId",
  CASE WHEN "openAccessPdf" LIKE 'http%' THEN 'http' WHEN "openAccessPdf" LIKE 'gs%' THEN 'gs' END AS route,
  list_extract(string_split("openAccessPdf", '/'), -1) AS segment,
  regexp_replace("openAccessPdf", '^http://', 'https://') AS secure,
  CASE WHEN "openAccessPdf" LIKE 'gs://%' THEN 'https://arxiv.org/pdf/' || regexp_replace(regexp_extract("openAccessPdf", '([^/]+)\.pdf$', 1), 'v\d+$', '')
       ELSE "openAccessPdf" END AS public,
  CASE WHEN regexp_extract("openAccessPdf", 'v(\d+)\.pdf$', 1) = '' THEN "openAccessPdf" ELSE
    array_to_string(list_transform(range(0, least(4, doc_id % 6 + 1)), lambda k: regexp_replace("openAccessPdf", 'v\d+\.pdf$', 'v' || (doc_id % 6 + 1 - k) || '.pdf')), ' ') END AS fallbacks
FROM pm""",
)
def link_functions(spark, sf):
    link = F.col("openAccessPdf")
    return X.papers_meta(spark, sf).select(
        "paperId",
        C.route_by_scheme(link).alias("route"),
        T.last_segment(link).alias("segment"),
        T.force_https(link).alias("secure"),
        T.public_link(link).alias("public"),
        F.array_join(T.version_fallbacks(link, tries=4), " ").alias("fallbacks"),
    )


@query(
    "date_functions",
    _META + """SELECT "paperId", strftime(CAST("publicationDate" AS DATE) - INTERVAL 3 MONTH, '%Y-%m-%d') AS earlier,
  array_to_string(range(2014, "publicationYear" + 1), ',') AS years FROM pm""",
)
def date_functions(spark, sf):
    earlier = T.months_before(F.to_date("publicationDate"), 3)
    years = T.year_range(F.lit(2014), F.col("publicationYear"))
    return X.papers_meta(spark, sf).select(
        "paperId",
        F.date_format(earlier, "yyyy-MM-dd").alias("earlier"),
        F.array_join(years.cast("array<string>"), ",").alias("years"),
    )


@query(
    "hash_ids",
    """SELECT doc_id, substr(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 20) AS short_id,
  sha256(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS query_hash, source || '/' || doc_id AS task_id, '3_' || doc_id AS sub_query FROM documents""",
)
def hash_ids(spark, sf):
    key = F.col("doc_id").cast("string")
    return read_table(spark, sf, "documents").select(
        "doc_id",
        I.hash_id(F.col("text")).alias("short_id"),
        I.query_hash(F.col("text")).alias("query_hash"),
        I.task_id(F.col("source"), key).alias("task_id"),
        I.sub_query_id(F.lit(3), key).alias("sub_query"),
    )


@query(
    "point_ids",
    X.with_ctes(X.CHUNK_VECTORS) + """,
h AS (SELECT "paperId", chunk_idx, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8' || hex(encode("paperId")))) AS a,
             sha1(unhex('6ba7b8109dad11d180b400c04fd430c8' || hex(encode("paperId" || '_' || chunk_idx)))) AS b FROM v)
SELECT "paperId", chunk_idx,
  substr(a,1,8)||'-'||substr(a,9,4)||'-5'||substr(a,14,3)||'-'||substr('89ab', (instr('0123456789abcdef', substr(a,17,1)) - 1) % 4 + 1, 1)||substr(a,18,3)||'-'||substr(a,21,12) AS paper_point,
  substr(b,1,8)||'-'||substr(b,9,4)||'-5'||substr(b,14,3)||'-'||substr('89ab', (instr('0123456789abcdef', substr(b,17,1)) - 1) % 4 + 1, 1)||substr(b,18,3)||'-'||substr(b,21,12) AS chunk_point
FROM h""",
)
def point_ids(spark, sf):
    return X.chunk_vectors(spark, sf).select(
        "paperId",
        "chunk_idx",
        I.point_id(F.col("paperId")).alias("paper_point"),
        I.chunk_point_id(F.col("paperId"), F.col("chunk_idx")).alias("chunk_point"),
    )


@query(
    "blocked_pages",
    r"""SELECT page_id, CASE WHEN contains(lower(html), 'lang="fr"') OR contains(lower(html), 'captcha') OR contains(url, 'ref=x')
  OR contains(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), 'the ') THEN url END AS status FROM pages""",
)
def blocked_pages(spark, sf):
    status = C.blocked_status(F.col("url"), F.col("html"), ['lang="FR"', "captcha"], ["ref=x"], ["the "])
    return read_table(spark, sf, "pages").select("page_id", status.alias("status"))
