"""Text, block, chunk, answer and card queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import answers as A
from paperloom.functions import text as T
from paperloom.functions.rows import hold
from paperloom.operators import blocks as B
from paperloom.operators import chunks as K
from paperloom.operators.links import linkify_texts
from paperloom.plans import fixtures as X
from paperloom.plans.registry import query
from paperloom.session import read_table, spread

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_SENTENCES = rf"""s AS (
  SELECT doc_id, list_filter(list_transform(
           string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
           lambda x: {_strip('x')}), lambda x: x <> '') AS ss
  FROM documents)"""


def _docs(spark, sf):
    return spread(read_table(spark, sf, "documents").select("doc_id", "text", "source"))


@query(
    "sentence_split",
    X.with_ctes(_SENTENCES) + "SELECT doc_id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence FROM s",
)
def sentence_split(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(K.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


# Chunks of 60 tokens less a prefix of 3, at most 4 of them plus one.
_CHUNKS = rf"""
tk AS (SELECT doc_id, flatten(list_transform(list_transform(ss, lambda x: list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')),
         lambda t: CASE WHEN len(t) > 52 THEN list_transform(range(0, CAST((len(t) + 51) // 52 AS BIGINT)), lambda i: t[i * 52 + 1 : i * 52 + 52]) ELSE [t] END)) AS tl FROM s),
kp AS (SELECT doc_id, list_filter(tl, lambda t: len(t) >= 3) AS tl FROM tk),
fold AS (SELECT doc_id, flatten(tl) AS tokens,
   list_reduce(list_transform(tl, lambda t: {{'ends': []::BIGINT[], 'cur': CAST(len(t) AS BIGINT), 'pos': CAST(len(t) AS BIGINT)}}),
     lambda a, x: CASE WHEN len(a.ends) > 6 THEN a
       WHEN a.cur + x.cur < 57 THEN {{'ends': a.ends, 'cur': a.cur + x.cur, 'pos': a.pos + x.cur}}
       ELSE {{'ends': CASE WHEN a.cur = 0 THEN a.ends ELSE list_append(a.ends, a.pos) END, 'cur': x.cur, 'pos': a.pos + x.cur}} END,
     {{'ends': []::BIGINT[], 'cur': 0::BIGINT, 'pos': 0::BIGINT}}) AS f FROM kp WHERE len(tl) > 0),
en AS (SELECT doc_id, tokens, CASE WHEN len(f.ends) < 6 AND f.cur > 0 THEN list_append(f.ends, f.pos) ELSE f.ends END AS ends FROM fold),
ix AS (SELECT doc_id, tokens, [0] || ends AS b, len(ends) AS n, unnest(range(0, least(len(ends), 5))) AS i FROM en),
wn AS (SELECT doc_id, i, n, tokens, b,
   CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN b[greatest(i - 2, 0) + 1] ELSE b[i] END AS lo,
   CASE WHEN i = 0 THEN b[least(2, n - 1) + 2] WHEN i = n - 1 THEN b[i + 2] ELSE b[i + 3] END AS hi FROM ix)
SELECT doc_id, i AS chunk_idx, array_to_string(tokens[lo + 1 : hi], ' ') AS text, b[i + 1] - lo + 3 AS core_start, b[i + 2] - lo + 3 AS core_end
FROM wn WHERE n > 1"""


@query("chunk_context", X.with_ctes(_SENTENCES) + "," + _CHUNKS)
def chunk_context(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.col("text").alias("main_text"))
    rows = K.chunk_papers(docs, chunk_size=60, max_chunks=4, prefix_len=3, drop_single=True, min_sentence_tokens=3)
    return rows.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("chunk_idx", "core_start", "core_end")], "text")


@query("embed_prefix", "SELECT doc_id, 'passage: ' || text AS document, 'query: ' || text AS query, ' ' || text AS other FROM documents")
def embed_prefix(spark, sf):
    t = F.col("text")
    return read_table(spark, sf, "documents").select(
        "doc_id",
        K.with_role_prefix(t, "multilingual-e5", "document").alias("document"),
        K.with_role_prefix(t, "multilingual-e5", "query").alias("query"),
        K.with_role_prefix(t, "other", "query").alias("other"),
    )


@query(
    "line_cleanup",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, line, list_filter(string_split_regex(lower(line), '\s+'), lambda x: x <> '') AS ws FROM l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE len(ws) > 3 AND NOT list_has_any(ws, ['the', 'received', 'und'])), '') AS body
FROM w GROUP BY doc_id""",
)
def line_cleanup(spark, sf):
    kept = T.clean_lines(F.col("text"), ["the", "Received", "und"])
    return _docs(spark, sf).select("doc_id", F.array_join(kept, "\n").alias("body"))


@query(
    "number_lines_and_glyphs",
    rf"""WITH m AS (SELECT doc_id, replace(replace(text, ' the ', chr(10) || '42' || chr(10)), ' of ', ' (cid:12) ') AS t FROM documents)
SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda l:
  CASE WHEN regexp_matches({_strip('l')}, '^[0-9]+$') THEN '' ELSE {_strip('l')} END), chr(10)), '\(cid:[^)]+\)', '', 'g') AS cleaned FROM m""",
)
def number_lines_and_glyphs(spark, sf):
    t = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("\n42\n")), F.lit(" of "), F.lit(" (cid:12) "))
    return _docs(spark, sf).select("doc_id", T.drop_glyph_marks(T.blank_number_lines(t)).alias("cleaned"))


@query(
    "word_class_counts",
    rf"""SELECT doc_id, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 5 AS enough,
  len(list_filter(string_split({_strip('text')}, ' '), lambda w: NOT regexp_matches(w, '[\p{{Nd}}\p{{Lu}}]'))) AS normal FROM documents""",
)
def word_class_counts(spark, sf):
    t = F.col("text")
    return read_table(spark, sf, "documents").select(
        "doc_id",
        T.letter_count(t).cast("bigint").alias("letters"),
        T.enough_letters(t).alias("enough"),
        T.normal_words(t).cast("bigint").alias("normal"),
    )


@query(
    "section_find",
    """WITH p AS (SELECT page_id, html, instr(lower(html), '<body>') AS pos FROM pages),
t AS (SELECT page_id, pos, substr(html, pos + 6) AS tail FROM p),
e AS (SELECT page_id, pos, tail, least(nullif(instr(lower(tail), '</nav>'), 0), nullif(instr(lower(tail), '<p'), 0), nullif(instr(lower(tail), 'div'), 0)) AS stop FROM t)
SELECT page_id, CASE WHEN pos > 0 THEN substr(tail, 1, least(coalesce(stop - 1, length(tail)), 5000)) ELSE '' END AS section FROM e""",
)
def section_find(spark, sf):
    found = T.find_section(F.col("html"), "<body>", ["</nav>", "<p", "div"], 5000)
    return read_table(spark, sf, "pages").select("page_id", found.alias("section"))


_RAW = rf"""
rb AS (SELECT * REPLACE (regexp_replace({_strip(f"array_to_string(list_transform(string_split(content, chr(10)), lambda l: CASE WHEN regexp_matches({_strip('l')}, '^[0-9]+$') THEN '' ELSE {_strip('l')} END), chr(10))")}, '\(cid:[^)]+\)', '', 'g') AS content) FROM b),
r AS (SELECT *, len(string_split(content, ' ')) AS nwords FROM rb WHERE length(regexp_replace(content, '[^\p{{L}}]', '', 'g')) > 5)"""
_LIMITS = """,
lim AS (SELECT page_id, quantile_cont(bottom, 0.02) AS bl, quantile_cont(top, 0.02) AS tl, quantile_cont("left", 0.02) AS ll,
               quantile_cont("right", 0.02) AS rl
        FROM (SELECT page_id, bottom, top, "left", "right", unnest(range(nwords)) FROM r) GROUP BY page_id)"""


@query(
    "block_margin_limits",
    X.with_ctes(X.PAGE_BLOCKS) + "," + _RAW + _LIMITS + """
SELECT page_id, round(bl, 9) AS bottom_limit, round(tl, 9) AS top_limit, round(ll, 9) AS left_limit, round(rl, 9) AS right_limit FROM lim""",
)
def block_margin_limits(spark, sf):
    limits = B.margin_limits(B.raw_blocks(X.page_blocks(spark, sf)), "page_id")
    return limits.select("page_id", *[F.round(f"{m}_limit", 9).alias(f"{m}_limit") for m in B.MARGINS])


@query(
    "block_margin_filter",
    X.with_ctes(X.PAGE_BLOCKS) + "," + _RAW + _LIMITS + """
SELECT r.page_id, block_idx, nwords, content FROM r JOIN lim USING (page_id)
WHERE (bottom > bl AND top > tl AND "left" > ll AND "right" > rl) OR nwords > 10""",
)
def block_margin_filter(spark, sf):
    kept = B.inside_margins(B.raw_blocks(X.page_blocks(spark, sf)), "page_id")
    return kept.select("page_id", "block_idx", F.col("nwords").cast("bigint").alias("nwords"), "content")


_NORMAL = r"len(list_filter(string_split({0}, ' '), lambda w: NOT regexp_matches(w, '[\p{{Nd}}\p{{Lu}}]')))"
_PARSED = ",\n" + rf"""
px AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_idx) - 1 AS pos, fontsize, page,
              chr(10) || content || CASE WHEN lead(block_idx) OVER (PARTITION BY page_id ORDER BY block_idx) IS NULL THEN '' ELSE chr(10) END AS content
       FROM r),
pb AS (SELECT *, {_NORMAL.format(_strip('content'))} AS nwords FROM px)"""


def _full_text(spark, sf):
    return B.serialise(B.raw_blocks(X.page_blocks(spark, sf)), "page_id")


@query(
    "block_parse",
    X.with_ctes(X.PAGE_BLOCKS) + "," + _RAW + _PARSED + "SELECT page_id, pos, fontsize, page, nwords, content FROM pb",
)
def block_parse(spark, sf):
    """Blocks serialised to one text per page and parsed back."""
    rows = _full_text(spark, sf).select("page_id", F.posexplode(B.parse_blocks(F.col("full_text"))).alias("pos", "b"))
    return rows.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "b.fontsize", "b.page", F.col("b.nwords").cast("bigint").alias("nwords"), "b.content"
    )


_FONT = """,
fl AS (SELECT page_id, max(page) AS last FROM pb WHERE nwords > 0 GROUP BY page_id),
fc AS (SELECT pb.page_id, fontsize, sum(nwords) AS n, min(pos) AS first FROM pb JOIN fl USING (page_id)
       WHERE nwords > 0 AND page <= floor(last / 2) GROUP BY pb.page_id, fontsize),
fm AS (SELECT page_id, fontsize AS fs FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS k FROM fc) WHERE k = 1),
bf AS (SELECT d.page_id, coalesce(fs, 0.0) AS body_font FROM (SELECT DISTINCT page_id FROM pb) d LEFT JOIN fm USING (page_id))"""


@query(
    "body_font_mode",
    X.with_ctes(X.PAGE_BLOCKS) + "," + _RAW + _PARSED + _FONT + "SELECT page_id, CAST(body_font AS DOUBLE) AS body_font FROM bf",
)
def body_font_mode(spark, sf):
    """The body font from the block table, one row per block."""
    rows = _full_text(spark, sf).select("page_id", F.posexplode(B.parse_blocks(F.col("full_text"))).alias("block_idx", "b"))
    return B.font_modes(rows.select("page_id", "block_idx", "b.fontsize", "b.page", "b.nwords"), "page_id")


@query(
    "body_text_assembly",
    X.with_ctes(X.PAGE_BLOCKS) + "," + _RAW + _PARSED + _FONT + r""",
tx AS (SELECT page_id, coalesce(string_agg(content, ' ' ORDER BY pos) FILTER (WHERE fontsize >= 0.95 * body_font AND nwords > 0), '') AS t
       FROM pb JOIN bf USING (page_id) GROUP BY page_id)
SELECT page_id, regexp_replace(regexp_replace(t, '\n$', ''), '\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', ' ', 'g') AS main_text FROM tx""",
)
def body_text_assembly(spark, sf):
    """Body text per page, from the serialised form, all inside the page's row."""
    return B.clean_full_text(_full_text(spark, sf), with_references=False, as_of_year=2026, min_chars=100).select("page_id", "main_text")


def _reference_docs(spark, sf):
    """Page blocks turned into papers with a reference list after the sixth block; every other page has a heading."""
    raw = B.raw_blocks(X.page_blocks(spark, sf))
    i = F.col("block_idx")
    entry = F.concat(
        i.cast("string"), F.lit(". Smith, A. "), "content", F.lit(" ("), (F.lit(1990) + i % 30).cast("string"), F.lit("), vol.")
    )
    content = F.when((i == 6) & (F.col("page_id") % 2 == 0), "closing words\nReferences").when(i > 6, entry).otherwise(F.col("content"))
    return B.serialise(raw.withColumn("content", content), "page_id")


_REF = rf"""
rr AS (SELECT * REPLACE (CASE WHEN block_idx = 6 AND page_id % 2 = 0 THEN 'closing words' || chr(10) || 'References'
         WHEN block_idx > 6 THEN block_idx || '. Smith, A. ' || content || ' (' || (1990 + block_idx % 30) || '), vol.' ELSE content END AS content) FROM r),
px AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_idx) - 1 AS pos, fontsize, page,
              chr(10) || content || CASE WHEN lead(block_idx) OVER (PARTITION BY page_id ORDER BY block_idx) IS NULL THEN '' ELSE chr(10) END AS content
       FROM rr),
pb AS (SELECT *, {_NORMAL.format(_strip('content'))} AS nwords FROM px)"""
_YEARS = "|".join(str(y) for y in range(1950, 2026))
_REF_INDEX = rf""",
ft AS (SELECT page_id, coalesce(e.fs, a.fs, 0.0) AS body FROM (SELECT DISTINCT page_id FROM pb) d LEFT JOIN fm e USING (page_id)
       LEFT JOIN (SELECT page_id, fontsize AS fs FROM (
           SELECT page_id, fontsize, row_number() OVER (PARTITION BY page_id ORDER BY sum(nwords) DESC, min(pos)) AS k
           FROM pb WHERE nwords > 0 GROUP BY page_id, fontsize HAVING (SELECT sum(nwords) FROM pb p2 WHERE p2.page_id = pb.page_id) > 5) WHERE k = 1) a USING (page_id)),
fl2 AS (SELECT pb.*, body, count(*) OVER (PARTITION BY page_id) AS n,
   CASE WHEN fontsize < body THEN 1 ELSE 0 END AS sm,
   CASE WHEN regexp_matches(substr(replace(content, chr(10), ''), 1, 3), '\p{{Nd}}') THEN 1 ELSE 0 END AS dg,
   CASE WHEN regexp_matches(content, '{_YEARS}') THEN 1 ELSE 0 END AS yr,
   CASE WHEN contains(content, '.') AND contains(content, ',') THEN 1 ELSE 0 END AS pu,
   regexp_replace(content, '\n$', '') AS c0
   FROM pb JOIN ft USING (page_id)),
fw AS (SELECT *, least(20, n - pos) AS m, split_part(c0, chr(10), 1) AS l1, list_extract(string_split(c0, chr(10)), -1) AS l2,
   coalesce(min(sm) OVER nx, 1) AS sm_n, coalesce(sum(dg) OVER nx, 0) AS dg_n, sum(yr) OVER hr AS yr_h,
   min(sm) OVER hr AS sm_h, sum(dg) OVER hr AS dg_h, sum(pu) OVER hr AS pu_h
   FROM fl2 WINDOW nx AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING),
                   hr AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
fh AS (SELECT *, regexp_matches(array_to_string(string_split(l1, ' ')[1:2], ' '), 'references|References|REFERENCES|Literature Cited') AS ht,
                 regexp_matches(array_to_string(string_split(l2, ' ')[1:2], ' '), 'references|References|REFERENCES|Literature Cited') AS hb FROM fw),
h1 AS (SELECT page_id, arg_min(CASE WHEN ht THEN pos ELSE pos + 1 END, pos) AS st, arg_min(sm_n, pos) AS small FROM fh
       WHERE (ht OR hb) AND (sm_n = 1 OR dg_n > m // 2 OR yr_h > m // 3) GROUP BY page_id),
h2 AS (SELECT page_id, min(pos) AS st, arg_min(sm_h, pos) AS small FROM fh
       WHERE (sm_h = 1 OR dg_h > m // 2) AND yr_h > m // 3 AND pu_h > m // 2 GROUP BY page_id),
rs AS (SELECT d.page_id, d.n, d.body, CASE WHEN h1.st IS NOT NULL THEN h1.st ELSE h2.st END AS st, CASE WHEN h1.st IS NOT NULL THEN h1.small ELSE h2.small END AS small
       FROM (SELECT DISTINCT page_id, n, body FROM fh) d LEFT JOIN h1 USING (page_id) LEFT JOIN h2 USING (page_id)),
re AS (SELECT rs.page_id, rs.n, rs.st, rs.small, rs.body,
   CASE WHEN rs.small = 1 THEN coalesce((SELECT min(pos) FROM pb WHERE pb.page_id = rs.page_id AND pos >= rs.st AND pos < rs.n - 1 AND fontsize >= rs.body AND nwords >= 5), rs.n) ELSE rs.n END AS en FROM rs)"""


@query(
    "reference_section",
    X.with_ctes(X.PAGE_BLOCKS) + "," + _RAW + "," + _REF + _FONT + _REF_INDEX + """
SELECT page_id, CAST(body AS DOUBLE) AS body, CAST(st AS BIGINT) AS ref_start, CASE WHEN st IS NOT NULL THEN CAST(en AS BIGINT) END AS ref_end FROM re""",
)
def reference_section(spark, sf):
    d = hold(_reference_docs(spark, sf), b=B.parse_blocks(F.col("full_text")))
    found = B.find_references(d, F.col("b"), 2026)
    return found.select(
        "page_id",
        F.col("_g").alias("body"),
        F.col("_s").cast("bigint").alias("ref_start"),
        F.col("_e").cast("bigint").alias("ref_end"),
    )


@query(
    "reference_text",
    X.with_ctes(X.PAGE_BLOCKS) + "," + _RAW + "," + _REF + _FONT + _REF_INDEX + r""",
sec AS (SELECT pb.*, st, en, en - st AS k, pos - st AS off FROM pb JOIN re USING (page_id) WHERE st > 0 AND pos >= st AND pos < en),
rf AS (SELECT page_id, fontsize AS ref_fs FROM (SELECT page_id, fontsize, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(pos)) AS z
       FROM sec WHERE k > 5 AND off < k // 2 GROUP BY page_id, fontsize) WHERE z = 1),
rt AS (SELECT page_id, string_agg(content, ' ' ORDER BY pos) AS t FROM sec JOIN rf USING (page_id) WHERE fontsize = ref_fs GROUP BY page_id),
ln AS (SELECT page_id, regexp_replace(regexp_replace(t, '\n$', ''), '\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', ' ', 'g') AS t FROM rt)
SELECT page_id, replace(regexp_replace(regexp_replace(replace(replace(replace(replace(t, 'references', ''), 'References', ''), 'REFERENCES', ''), 'Literature Cited', ''),
  '\.([A-Z])', '.' || chr(1) || '\1', 'g'), '(^|[^\p{L}\p{N}_])([A-Z][a-z]*)\.', '\1\2', 'g'), chr(1), '') AS ref_text FROM ln""",
)
def reference_text(spark, sf):
    cleaned = B.clean_full_text(_reference_docs(spark, sf), with_references=True, as_of_year=2026, min_chars=100)
    return cleaned.where(F.col("ref_text").isNotNull() & (F.col("ref_text") != "")).select("page_id", "ref_text")


_TITLE_JSON = r"""replace(replace(replace(split_part(text, chr(10), 1), '\', ''), '"', ''), '}', '')"""
_WORDS = r"""replace(replace(replace(split_part(text, ' ', 1), '\', ''), '"', ''), chr(10), '')"""


def _answers(spark, sf):
    """Model answers built from documents: a think part, then a loose JSON object."""
    plain = lambda c: F.translate(c, '\\"}', "")
    title = plain(F.split("text", "\n")[0])
    word = F.translate(F.split("text", " ")[0], '\\"\n', "")
    answer = F.concat(
        F.lit("<think> "), title, F.lit('</think> Here: {"sub_queries": ["'), word, F.lit('", "None of '), word,
        F.lit('"], "Is_Ethical": True, "cite": None, "scientific": False, "paperIds": "d'), F.col("doc_id").cast("string"),
        F.lit('", } done'),
    )
    return read_table(spark, sf, "documents").select("doc_id", answer.alias("answer"), word.alias("word"), title.alias("t"))


@query(
    "think_split",
    f"""SELECT doc_id, {_strip(_TITLE_JSON)} AS think, starts_with(c, 'Here: {{') AND ends_with(c, 'done') AS clean FROM (
  SELECT doc_id, text, 'Here: {{ done' AS c FROM documents)""",
)
def think_split(spark, sf):
    content = A.content_part(F.col("answer"))
    return _answers(spark, sf).select(
        "doc_id",
        A.think_part(F.col("answer")).alias("think"),
        (F.startswith(content, F.lit("Here: {")) & F.endswith(content, F.lit("done"))).alias("clean"),
    )


@query(
    "loose_json_fields",
    f"""SELECT doc_id, {_WORDS} || '|null of ' || replace(replace(replace({_WORDS}, 'None', 'null'), 'True', 'true'), 'False', 'false') AS queries, true AS ethical, false AS scientific,
  CAST(NULL AS BOOLEAN) AS cite_only, CAST(NULL AS BOOLEAN) AS details, 'd' || doc_id AS search_ids FROM documents""",
)
def loose_json_fields(spark, sf):
    parsed = _answers(spark, sf).select("doc_id", A.parse_answer(F.col("answer"), "expand").alias("p"))
    return parsed.select(
        "doc_id",
        F.array_join("p.queries", "|").alias("queries"),
        "p.ethical",
        "p.scientific",
        "p.cite_only",
        "p.details",
        F.array_join("p.search_paperIds", "|").alias("search_ids"),
    )


@query(
    "fuzzy_event_keys",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def fuzzy_event_keys(spark, sf):
    """The first key of the event's JSON that contains 'K', whatever its case."""
    value = A.first_matching(A.json_record(F.col("props")), ["K"])
    return read_table(spark, sf, "events").select("event_id", value.cast("bigint").alias("k"))


@query(
    "plan_parse",
    """SELECT doc_id, 'about ' || source AS abstract, unnest([0, 1, 2]) AS section, unnest(['TLDR', 'methods', 'Introduction']) AS title,
  unnest(['d1,d' || doc_id || ',d2', 'd' || doc_id || ',d2', 'd1,d' || doc_id || ',d2']) AS ids FROM documents""",
)
def plan_parse(spark, sf):
    key = F.col("doc_id").cast("string")
    answer = F.concat(
        F.lit('{"abstract": "about '), "source",
        F.lit('", "sections": [{"Topic": "TLDR", "scope": "x", "papers": ["d1"]}, {"title": "methods", "content": "y", "references": ["d'),
        key, F.lit('", "d2"]}, {"title": "Introduction", "paper_list": []}]}'),
    )
    plans = read_table(spark, sf, "documents").select("doc_id", A.parse_plan(answer).alias("p"))
    rows = plans.select("doc_id", "p.abstract", F.posexplode("p.sections").alias("section", "s"))
    return rows.select("doc_id", "abstract", "section", "s.title", F.array_join("s.paperIds", ",").alias("ids"))


@query(
    "parsed_dates",
    """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, event_id % 4 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('month', d), '%Y-%m-%d') WHEN 2 THEN strftime(date_trunc('year', d), '%Y-%m-%d') END || ',2030-05-01' AS dates FROM e WHERE k < 3
UNION ALL SELECT event_id, '2030-05-01' FROM e WHERE k = 3""",
)
def parsed_dates(spark, sf):
    """Event dates written in four ways, one of them unreadable, next to a fixed later date."""
    k = F.col("event_id") % 4
    day = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(k == 1, F.lower(F.date_format("ts", "MMM yyyy")))
        .when(k == 2, F.date_format("ts", "yyyy"))
        .otherwise("some day")
    )
    none = F.lit(None).cast("string")
    record = F.create_map(F.lit("end_date"), F.lit("may 2030"), F.lit("date_from"), day, F.lit("date_x"), none, F.lit("name"), F.lit("2001"))
    return read_table(spark, sf, "events").select("event_id", F.array_join(A.normal_dates(record), ",").alias("dates"))


@query(
    "query_plan_merge",
    f"""WITH x AS (SELECT doc_id, doc_id % 3 = 0 AS details, doc_id % 2 = 0 AS sci FROM documents)
SELECT doc_id, CASE WHEN details THEN 'd' || doc_id ELSE '' END AS ids, CASE WHEN sci THEN 'Physics' END AS field,
       CASE WHEN sci AND NOT details THEN 'Ann' END AS author, sci AS searched FROM x""",
)
def query_plan_merge(spark, sf):
    i = F.col("doc_id")
    word = lambda c: F.when(c, "true").otherwise("false")
    expand = F.concat(
        F.lit('{"queries": ["q"], "scientific": '), word(i % 2 == 0), F.lit(', "ethical": true, "details": '), word(i % 3 == 0),
        F.lit(', "paperIds": ["d'), i.cast("string"), F.lit('"]}'),
    )
    d = read_table(spark, sf, "documents").select("doc_id", A.parse_answer(expand, "expand").alias("e"))
    d = d.withColumn("k", A.parse_answer(F.lit('{"research_field": ["Physics"]}'), "keywords"))
    d = d.withColumn("q", A.parse_answer(F.lit('{"author": "Ann"}'), "parse"))
    m = d.select("doc_id", A.merge_query_plan(F.col("e"), F.col("k"), F.col("q")).alias("m"))
    from paperloom.operators.filters import query_gate

    return m.select(
        "doc_id",
        F.array_join("m.search_paperIds", ",").alias("ids"),
        F.array_join("m.research_field", ",").alias("field"),
        F.col("m.authorName").alias("author"),
        query_gate(F.col("m.queries"), F.col("m.ethical"), F.col("m.scientific")).alias("searched"),
    )


@query(
    "prompt_build",
    """SELECT doc_id, 'Fields:' || chr(10) || '- title: A title' || chr(10) || '- scope: No description' || chr(10) || 'Query: ' || text || ' in ' || source AS prompt FROM documents""",
)
def prompt_build(spark, sf):
    template = F.lit("Fields:\n<FIELDS>\nQuery: <QUERY> in <TITLE>")
    fields = F.lit(A.field_list({"title": "A title", "scope": ""}))
    prompt = A.build_prompt(template, {"FIELDS": fields, "QUERY": F.col("text"), "TITLE": F.col("source")})
    return read_table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"))


_CARD = """'--- Article ---' || chr(10) || 'Article ID: [' || "paperId" || ']' || chr(10) || 'Title: ' || title || chr(10) || 'Authors: ' || split_part("authorName", ',', 1)
  || ' et al.' || chr(10) || 'Date: ' || "publicationDate" || chr(10) || 'Abstract:' || chr(10) || abstract || chr(10) || 'Excerpt:' || chr(10) || '''' || main_text || '''' || chr(10) || chr(10)"""


def _cards(spark, sf):
    both = X.papers_meta(spark, sf).join(X.papers_text(spark, sf).select("paperId", "title", "abstract", "main_text"), "paperId")
    names = ("paperId", "title", "authorName", "publicationDate", "abstract")
    paper = {n: F.col(n) for n in names} | {"best_chunks": F.array("main_text")}
    return both.withColumn("card", A.article_card(paper, include_abstract=True))


@query(
    "article_cards",
    X.with_ctes(X.PAPERS_TEXT, X.PAPERS_META)
    + f"""SELECT "paperId", {_CARD} AS card FROM pm JOIN (SELECT "paperId", title, abstract, main_text FROM pt) t USING ("paperId")""",
)
def article_cards(spark, sf):
    return _cards(spark, sf).select("paperId", "card")


@query(
    "model_message_list",
    X.with_ctes(X.PAPERS_TEXT, X.PAPERS_META)
    + f""", c AS (SELECT "paperId", title, CASE WHEN doc_id % 2 = 0 THEN 'No article relevant to the query were found in the database' ELSE {_CARD} END AS card
  FROM pm JOIN (SELECT "paperId", title, abstract, main_text FROM pt) t USING ("paperId"))
SELECT "paperId", unnest([0, 1, 2]) AS pos, unnest(['assistant', 'user', 'user']) AS role, unnest(['earlier', card, 'Ask ' || title]) AS content FROM c""",
)
def model_message_list(spark, sf):
    d = _cards(spark, sf).withColumn("list", F.when(F.col("doc_id") % 2 == 1, F.array("card")))
    context = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("earlier").alias("content")))
    prompt = A.build_prompt(F.lit("Ask <TITLE>"), {"TITLE": F.col("title")})
    rows = d.select("paperId", F.posexplode(A.model_messages(context, A.article_cards(F.col("list")), prompt)).alias("pos", "m"))
    return rows.select("paperId", "pos", "m.role", "m.content")


@query(
    "citation_labels",
    X.with_ctes(X.PAPERS_META) + """SELECT "paperId", list_extract(string_split(trim(split_part("authorName", ',', 1)), ' '), -1) || ' et al., ' || year(CAST("publicationDate" AS DATE)) AS label FROM pm""",
)
def citation_labels(spark, sf):
    meta = X.papers_meta(spark, sf)
    return meta.select("paperId", A.citation_label(F.col("authorName"), F.col("publicationDate")).alias("label"))


@query(
    "citation_linkify",
    X.with_ctes(X.PAPERS_META) + r""", l AS (SELECT "paperId", 'p' || (100000 + doc_id) || 'x' AS a, 'p' || (100000 + doc_id) || 'xy' AS b FROM pm)
SELECT "paperId", 'See [Long et al., 2001](#' || b || '), then [Short et al., 2002](#' || a || ').' AS linked FROM l""",
)
def citation_linkify(spark, sf):
    """Two ids, one a prefix of the other, one repeated in the text."""
    stem = F.concat(F.lit("p"), (F.lit(100000) + F.col("doc_id")).cast("string"), F.lit("x"))
    long = F.concat(stem, F.lit("y"))
    paper = lambda i, label: F.struct(i.alias("paperId"), F.lit(label).alias("label"))
    d = X.papers_meta(spark, sf).select("paperId", stem.alias("a"), long.alias("b"))
    text = F.concat(F.lit("See "), "b", F.lit(" "), "b", F.lit(", then "), "a", F.lit("."))
    papers = F.array(paper(F.col("a"), "Short et al., 2002"), paper(F.col("b"), "Long et al., 2001"))
    # The shorter id also occurs inside the longer one and inside its link.
    return linkify_texts(d, text, papers).select("paperId", "linked")


@query(
    "citation_linkify_many",
    X.with_ctes(X.CHUNK_VECTORS) + r""", p AS (SELECT DISTINCT label, "paperId" FROM v),
l AS (SELECT label, list("paperId" ORDER BY "paperId") AS ids FROM p GROUP BY label)
SELECT CAST(label AS VARCHAR) AS answer, list_sum(list_transform(ids, lambda i: length(i) * 2 + 12))::BIGINT AS chars, len(ids)::BIGINT AS links,
       sha256(array_to_string(list_transform(ids, lambda i: 'see [L ' || i || '](#' || i || ').'), ' ')) AS digest FROM l""",
)
def citation_linkify_many(spark, sf):
    """One answer per label that cites all papers of the label, hundreds of them, ids within ids among them."""
    v = X.chunk_vectors(spark, sf).select("label", "paperId").distinct()
    own = F.sort_array(F.collect_list("paperId"))
    answers = v.groupBy("label").agg(own.alias("ids"))
    text = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("see "), i, F.lit(" "), i, F.lit("."))), " ")
    papers = F.transform("ids", lambda i: F.struct(i.alias("paperId"), F.concat(F.lit("L "), i).alias("label")))
    linked = linkify_texts(answers, text, papers)
    links = F.size(F.split("linked", r"\]\(#")) - 1
    return linked.select(
        F.col("label").cast("string").alias("answer"),
        (F.length("linked") - F.size("ids") + 1).cast("long").alias("chars"),
        links.cast("long").alias("links"),
        F.sha2("linked", 256).alias("digest"),
    )


@query(
    "fabricated_citations",
    X.with_ctes(X.MESSAGES) + """, c AS (SELECT task_id, query_id, unnest(list_concat(list_transform(papers, lambda p: p."paperId"), ['d' || turn || 'x', 'd0'])) AS "paperId" FROM m WHERE role = 'assistant')
SELECT DISTINCT task_id, query_id, "paperId" FROM c WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT task_id AS t, query_id AS q, unnest(list_transform(papers, lambda p: p."paperId")) AS id FROM m) a
  WHERE a.t = c.task_id AND a.q = c.query_id AND a.id = c."paperId")""",
)
def fabricated_citations(spark, sf):
    """Answers that cite their papers, an invented id and d0."""
    m = X.messages(spark, sf)
    ids = F.array_join(F.transform("papers", lambda p: p["paperId"]), "], [")
    content = F.concat("content", F.lit(" ["), ids, F.lit("] [unsupported] [d"), F.col("turn").cast("string"), F.lit("x, d0]"))
    answers = m.where(F.col("role") == "assistant").select("task_id", "query_id", content.alias("content"))
    allowed = m.select("task_id", "query_id", F.explode("papers").alias("p")).select("task_id", "query_id", "p.paperId")
    return A.fabricated_citations(answers, allowed, ["task_id", "query_id"])


@query("title_underscores", r"""SELECT doc_id, regexp_replace(text, '\s+', '_', 'g') AS name FROM documents""")
def title_underscores(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.underscore_spaces(F.col("text")).alias("name"))
