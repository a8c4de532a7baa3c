"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry import model, workers
from docketry.operators import chunking, chunks, citations, cite, classify, enrich, folds, index, lines, postprocess, report, retrieve, search, state
from docketry.sources import loadfile, tables, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LINES = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(s) + 1))::INTEGER AS line_no, unnest(s) AS line FROM split),
paged AS (SELECT *, ((line_no - 1) // 25 + 1)::INTEGER AS page FROM lines)
"""
QUERY_TEXT = "of the antion thening onre that"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(_LINES + "SELECT doc_id, line_no, line FROM lines")
def line_explode(spark, d):
    return lines.lines(table(spark, d, "documents"))


@query(_LINES + "SELECT doc_id, line_no, page, 'DOC_SYN_' || lpad((doc_id * 1000 + page)::VARCHAR, greatest(8, length((doc_id * 1000 + page)::VARCHAR))::INTEGER, '0') AS bates FROM paged")
def page_map(spark, d):
    return lines.paged(lines.lines(table(spark, d, "documents"))).select("doc_id", "line_no", "page", "bates")


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[ -]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS stem FROM part")
def stem_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_stem(F.col("p_name")).alias("stem"))


@query("WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents) SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS first_id FROM h")
def dedup_sha256(spark, d):
    return state.content_duplicates(table(spark, d, "documents"))


@query(_LINES + ", m AS (SELECT *, CASE WHEN line_no % 3 = 0 THEN line_no END AS own_id FROM lines) SELECT doc_id, line_no, line, coalesce(last_value(own_id IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)::INTEGER AS text_id FROM m")
def text_marker_ffill(spark, d):
    """Every third line is an element's first: marks stand before them, and are carried on."""
    rows = chunks.marked_lines(_marked(table(spark, d, "documents"), 3))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.select("doc_id", number.alias("line_no"), "line", F.coalesce(F.col("text_id").cast("int"), F.lit(-1)).alias("text_id"))


def _marked(docs: DataFrame, every: int) -> DataFrame:
    """doc_id, md: texts with a mark before every few lines."""
    marked = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + 1) % every == 0, F.array(F.format_string("[TEXT:%d]", i + 1), x)).otherwise(F.array(x)))
    return docs.select("doc_id", F.array_join(F.flatten(marked), "\n").alias("md"))


@query(_LINES + "SELECT doc_id, line_no, sum(CASE WHEN length(line) <= 40 AND NOT contains(line, ',') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS section_id FROM lines")
def section_ids(spark, d):
    return lines.sections(lines.lines(table(spark, d, "documents"))).select("doc_id", "line_no", "section_id")


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, unnest(range(1, len(s) + 1))::INTEGER AS para_no, unnest(s) AS paragraph FROM p""")
def paragraph_split(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return lines.paragraphs(docs)


@query("""SELECT conv_id, (turn + 1)::INTEGER AS line_start, CASE role WHEN 'user' THEN 'Q' ELSE 'A' END AS mark,
lpad((turn + 1)::VARCHAR, 2, ' ') || ' ' || CASE role WHEN 'user' THEN 'Q' ELSE 'A' END || ' ' || trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS line
FROM conversations WHERE role IN ('user', 'assistant')""")
def transcript_lines(spark, d):
    return lines.transcript(table(spark, d, "conversations"))


@query("""WITH x AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, (len(string_split(text, chr(10))) - 1) // 25 + 1 AS pages FROM documents),
s AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN pages WHEN 1 THEN 1 ELSE n END AS segments FROM x),
r AS (SELECT *, CASE WHEN pages = 1 THEN 'single' WHEN segments = pages THEN 'vendor-ff' WHEN segments > 1 THEN 'unpaged-mismatch' ELSE 'unpaged-no-ocr' END AS route FROM s)
SELECT doc_id, pages::INTEGER AS n_pages, route, starts_with(route, 'unpaged') AS flagged, CASE WHEN route = 'vendor-ff' THEN pages ELSE 1 END::INTEGER AS kept FROM r""")
def pagination_route(spark, d):
    """A third of the texts has a form feed behind each page of lines, a third behind each line, a third none."""
    text = F.split("text", "\n", -1)
    mark = lambda x, i: F.concat(F.when(i == 0, "").when(F.col("doc_id") % 3 == 2, "\f").when((F.col("doc_id") % 3 == 0) & (i % 25 == 0), "\f").otherwise("\n"), F.lit("x"), x)
    docs = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(text, mark), "").alias("content"), (F.floor((F.size(text) - 1) / 25) + 1).cast("int").alias("n_pages"), F.lit(0).alias("n_images"))
    return loadfile.paginate(docs).select("doc_id", "n_pages", "route", "flagged", F.size(F.split("text", "\f", -1)).alias("kept"))


_FOLD = """
WITH RECURSIVE w AS (SELECT doc_id, {lines} AS s FROM documents), n AS (SELECT doc_id, s, list_transform(s, lambda x: length(x)) AS n FROM w),
"""
_CUT = """,
c AS (SELECT doc_id, a, b FROM r WHERE b >= a AND b > 0 UNION ALL SELECT doc_id, start, len(n) FROM r JOIN n USING (doc_id) WHERE i = len(n) AND start <= len(n))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1)::INTEGER AS chunk_idx, a::INTEGER AS line_start, b::INTEGER AS line_end, array_to_string(s[a:b], chr(10)) AS core_text FROM c JOIN n USING (doc_id)
"""


@query(_FOLD.format(lines="string_split(text, chr(10))") + """r AS (
  SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS start, -1::BIGINT AS size, 0::BIGINT AS a, 0::BIGINT AS b FROM n UNION ALL
  SELECT doc_id, i + 1, CASE WHEN f THEN CASE WHEN i + 2 - start > 5 THEN i - 3 ELSE i + 2 END ELSE start END,
    CASE WHEN f THEN CASE WHEN i + 2 - start > 5 THEN (list_sum(n[i - 3 : i + 1]) + 4)::BIGINT ELSE -1 END ELSE size + 1 + n[i + 1] END,
    CASE WHEN f THEN start ELSE 0 END, CASE WHEN f THEN i + 1 ELSE 0 END
  FROM (SELECT r.*, n.n, (size + 1 + n[i + 1]) // 4 >= 800 AS f FROM r JOIN n USING (doc_id) WHERE i < len(n)))""" + _CUT)
def chunk_generic(spark, d):
    return chunking.generic_chunks(table(spark, d, "documents"))


_OPENED = "list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 4 = 1 THEN i || '. The ' || x ELSE x END)"


@query(_FOLD.format(lines=_OPENED) + """r AS (
  SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS start, -1::BIGINT AS size, 0::BIGINT AS a, 0::BIGINT AS b FROM n UNION ALL
  SELECT doc_id, i + 1, CASE WHEN f THEN i + 1 ELSE start END, CASE WHEN f THEN n[i + 1] ELSE size + 1 + n[i + 1] END, CASE WHEN f THEN start ELSE 0 END, CASE WHEN f THEN i ELSE 0 END
  FROM (SELECT r.*, n.n, i + 1 > start AND trim(s[i + 1], ' ') <> '' AND (greatest(size, 0) // 4 >= 300 OR (greatest(size, 0) // 4 >= 200 AND (i + 1) % 4 = 1)) AS f FROM r JOIN n USING (doc_id) WHERE i < len(n)))""" + _CUT)
def chunk_paragraph(spark, d):
    """Every fourth line opens a numbered paragraph."""
    opened = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 0, F.concat((i + 1).cast("string"), F.lit(". The "), x)).otherwise(x))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(opened, "\n").alias("text"))
    return chunking.cut_lines(docs, "paragraph", target=200, most=300)


@query(_LINES + """, f AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 <> 0 THEN page END AS page FROM paged),
c AS (SELECT *, CASE WHEN page IS DISTINCT FROM lag(page) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS chg FROM f),
r AS (SELECT *, sum(chg) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c)
SELECT doc_id, page, min(line_no) AS line_start, max(line_no) AS line_end FROM r WHERE page IS NOT NULL GROUP BY doc_id, run, page""")
def page_spans(spark, d):
    pages = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + 1) % 7 != 0, F.floor(i / 25) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", pages.alias("page_map"))
    return rows.select("doc_id", F.inline(chunks.page_spans(F.col("page_map"))))


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber + l_partkey % 3 AS page FROM lineitem),
i AS (SELECT *, page - row_number() OVER (PARTITION BY l_orderkey ORDER BY page) AS island FROM p),
r AS (SELECT l_orderkey, min(page) AS a, max(page) AS b FROM i GROUP BY l_orderkey, island)
SELECT l_orderkey, CASE WHEN max(b) = min(a) THEN 'p. ' ELSE 'pp. ' END || string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY l_orderkey""")
def page_ranges(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int").alias("page"))
    return rows.groupBy("l_orderkey").agg(F.collect_list("page").alias("p")).select("l_orderkey", T.page_ranges(F.col("p")).alias("pages"))


@query("""SELECT o_orderkey, 'ABC' || lpad((o_custkey + i)::VARCHAR, greatest(6, length((o_custkey + i)::VARCHAR))::INTEGER, '0') AS bates, i::INTEGER AS page_idx
FROM (SELECT o_orderkey, o_custkey, unnest(range(0, o_orderkey % 4 + 1)) AS i FROM orders)""")
def page_bates_list(spark, d):
    rows = table(spark, d, "orders").withColumn("n", (F.col("o_orderkey") % 4 + 1).cast("int")).select(
        "o_orderkey", "n", F.concat(F.lit("ABC"), T.pad_number(F.col("o_custkey"), F.lit(6))).alias("beg"), F.concat(F.lit("ABC"), T.pad_number(F.col("o_custkey") + F.col("n") - 1, F.lit(6))).alias("fin"),
    )
    return rows.select("o_orderkey", F.posexplode(loadfile.page_stamps("beg", "fin", "n")).alias("page_idx", "bates"))


_TOKENS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: NOT list_contains([""" + ", ".join(f"'{s}'" for s in search.STOP_WORDS) + r"""], x)) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term)
"""


def _index(spark: SparkSession, d: str, again: bool = False) -> str:
    """The path of this session's index of the documents in d, built if need be."""
    path = f"{workers.shared_folder(spark)}/index-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()[:12]}"
    if again or not index.available(spark, path):
        index.build(table(spark, d, "documents").select("doc_id", "text"), path)
    return path


def _keyword(spark, d, k: int = 10) -> DataFrame:
    return index.KeywordIndex(spark, _index(spark, d)).search(QUERY_TEXT, k)


@query(_TOKENS + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY term")
def tfidf_terms(spark, d):
    """Builds the index that the searches read."""
    return tables.read(spark, f"{_index(spark, d, again=True)}/terms").filter("block = 0").select("term", "df", "occurrences")


_Q = "['" + "', '".join(w for w in QUERY_TEXT.split() if w not in search.STOP_WORDS) + "']"
_SEARCH = _TOKENS + f"""
, n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf, n GROUP BY term, n),
q AS (SELECT term, count(*) AS q_tf FROM (SELECT unnest(list_concat({_Q}, list_transform(range(1, len({_Q})), lambda i: {_Q}[i] || ' ' || {_Q}[i + 1]))) AS term) GROUP BY term),
wt AS (SELECT doc_id, tf.term, (1 + ln(tf)) * idf AS w, idf FROM tf JOIN idf USING (term)),
sc AS (SELECT doc_id, sum(w * w) AS norm2, sum(CASE WHEN q_tf IS NOT NULL THEN w * (1 + ln(q_tf)) * idf END) AS dot FROM wt LEFT JOIN q USING (term) GROUP BY doc_id),
qn AS (SELECT sqrt(sum(((1 + ln(q_tf)) * idf) ** 2)) AS q_norm FROM q JOIN idf USING (term)),
cs AS (SELECT doc_id, round(dot / sqrt(norm2) / q_norm, 6) AS score FROM sc, qn WHERE dot > 0),
best AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM cs)
"""


@query(_SEARCH + "SELECT doc_id, score, rank FROM best WHERE rank <= 10")
def tfidf_search(spark, d):
    return _keyword(spark, d)


@query(_SEARCH + ", k AS (SELECT * FROM best WHERE rank <= 10) SELECT doc_id, rank, CASE WHEN (SELECT max(score) FROM k) = (SELECT min(score) FROM k) THEN 1.0::DOUBLE ELSE round((score - (SELECT min(score) FROM k)) / ((SELECT max(score) FROM k) - (SELECT min(score) FROM k)), 6) END AS normal FROM k")
def minmax_scores(spark, d):
    return search.min_max(_keyword(spark, d)).select("doc_id", "rank", "normal")


_NEAR = """q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7),
vs AS (SELECT vec_id, round(1 / (1 + list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - e[i]::DOUBLE) * (embedding[i]::DOUBLE - e[i]::DOUBLE)))), 6) AS score FROM embeddings, q),
near AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM vs)"""


@query("WITH " + _NEAR + " SELECT vec_id, score, rank FROM near WHERE rank <= 10")
def vector_search(spark, d):
    vectors = table(spark, d, "embeddings")
    return search.vector_search(vectors, vectors.filter("vec_id = 7"))


@query(_SEARCH + ", " + _NEAR.replace("q AS", "qv AS").replace(", q)", ", qv)") + """
, u AS (SELECT doc_id, rank AS k, NULL::INTEGER AS s FROM best WHERE rank <= 10 UNION ALL SELECT vec_id, NULL, rank FROM near WHERE rank <= 10),
m AS (SELECT doc_id, min(k) AS k, min(s) AS s FROM u GROUP BY doc_id),
f AS (SELECT *, round(coalesce(1 / (60 + k)::DOUBLE, 0) + coalesce(1 / (60 + s)::DOUBLE, 0), 6) AS score FROM m)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, k NULLS LAST, s NULLS LAST, doc_id)::INTEGER AS rank FROM f""")
def rrf_hybrid(spark, d):
    vectors = table(spark, d, "embeddings")
    semantic = search.vector_search(vectors, vectors.filter("vec_id = 7")).withColumnRenamed("vec_id", "doc_id")
    return search.fuse(_keyword(spark, d), semantic, "doc_id")


@query(_SEARCH + ", " + _NEAR.replace("q AS", "qv AS").replace(", q)", ", qv)") + """
, u AS (SELECT doc_id, rank AS k, NULL::INTEGER AS s FROM best WHERE rank <= 100 UNION ALL SELECT vec_id, NULL, rank FROM near WHERE rank <= 100),
m AS (SELECT doc_id, min(k) AS k, min(s) AS s FROM u GROUP BY doc_id),
f AS (SELECT *, round(coalesce(1 / (60 + k)::DOUBLE, 0) + coalesce(1 / (60 + s)::DOUBLE, 0), 6) AS score FROM m),
r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, k NULLS LAST, s NULLS LAST, doc_id)::INTEGER AS rank FROM f)
SELECT * FROM r WHERE rank <= 10""")
def rrf_hybrid_deep(spark, d):
    vectors = table(spark, d, "embeddings")
    depth = search.fetch_k(QUERY_TEXT, 10) * search.LIST_FETCH
    semantic = search.vector_search(vectors, vectors.filter("vec_id = 7"), depth).withColumnRenamed("vec_id", "doc_id")
    return search.fuse(_keyword(spark, d, depth), semantic, "doc_id").filter(F.col("rank") <= 10)


def _with_text(spark, d, found: DataFrame) -> DataFrame:
    """A bounded list of hits with their texts; the hits are sent to the texts, not the texts to the hits."""
    return table(spark, d, "documents").select("doc_id", "text").join(F.broadcast(found), "doc_id")


@query(_SEARCH + """, b AS (SELECT doc_id, rank, CASE WHEN contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'the anea. eriner thanea.') THEN score * 5 ELSE score END AS score FROM best JOIN documents USING (doc_id) WHERE rank <= 10)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, rank)::INTEGER AS rank FROM b""")
def phrase_boost(spark, d):
    found = _with_text(spark, d, _keyword(spark, d))
    return search.phrase_boost(found, "the anea. Eriner thanea.").select("doc_id", "score", "rank")


@query(_SEARCH + """, b AS (SELECT doc_id, rank, CASE WHEN contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'the anea. eriner thanea.') THEN score * 5 ELSE score END AS score FROM best JOIN documents USING (doc_id) WHERE rank <= 50),
r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, rank)::INTEGER AS rank FROM b)
SELECT * FROM r WHERE rank <= 10""")
def phrase_boost_deep(spark, d):
    found = _with_text(spark, d, _keyword(spark, d, search.fetch_k(QUERY_TEXT, 10)))
    return search.phrase_boost(found, "the anea. Eriner thanea.").filter(F.col("rank") <= 10).select("doc_id", "score", "rank")


_BOXES = """
WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, (l_partkey % 40 + 1)::INTEGER AS page, l_discount * 4000 AS l, 700.0::DOUBLE - l_quantity * 12 AS t,
  l_discount * 4000 + 60 + l_tax * 2500 AS r, 700.0::DOUBLE - l_quantity * 12 - 10 AS b, l_suppkey AS stamp FROM lineitem),
x AS (SELECT *, greatest(1, least(25, floor((655.0::DOUBLE - t) / ((655.0::DOUBLE - 87.5) / 25)) + 1))::INTEGER AS line_start FROM e),
c AS (SELECT *, greatest(line_start, least(25, floor((655.0::DOUBLE - b) / ((655.0::DOUBLE - 87.5) / 25))))::INTEGER AS line_end FROM x)
"""


def _cited(spark, d):
    return citations.line_ranges(citations.elements(table(spark, d, "lineitem")))


@query(_BOXES + "SELECT doc_id, ord, page, line_start, line_end FROM c")
def bbox_lines(spark, d):
    return _cited(spark, d).select("doc_id", "ord", "page", "line_start", "line_end")


@query(_BOXES + ", p AS (SELECT stamp, page, max(t) AS top, min(b) AS bottom FROM e GROUP BY stamp, page HAVING count(*) >= 8) SELECT stamp, quantile_cont(top, 0.5) AS top, quantile_cont(bottom, 0.5) AS bottom FROM p GROUP BY stamp")
def content_area_median(spark, d):
    return citations.content_area(citations.elements(table(spark, d, "lineitem")), "stamp")


@query(_BOXES + """SELECT doc_id, ord, CASE WHEN r - l > 0.65 * 612.0::DOUBLE THEN 'full_width' WHEN r < 306 AND l < 0.38 * 612.0::DOUBLE THEN 'left' WHEN l > 306 * 0.85::DOUBLE AND l >= 0.38 * 612.0::DOUBLE THEN 'right' WHEN (l + r) / 2 < 306 THEN 'left' ELSE 'right' END AS side FROM e""")
def patent_columns(spark, d):
    return citations.column_of(citations.elements(table(spark, d, "lineitem"))).select("doc_id", "ord", "side")


@query(_BOXES + "SELECT doc_id, count(*) AS total, round(100.0::DOUBLE * count(CASE WHEN ord % 5 <> 0 THEN line_start END) / count(*), 4) AS coverage_pct, true AS has_pages, true AS has_stamps FROM c GROUP BY doc_id")
def coverage_metrics(spark, d):
    return citations.coverage(_cited(spark, d).withColumn("line_start", F.when(F.col("ord") % 5 != 0, F.col("line_start"))), "doc_id")


@query(_BOXES + ", s AS (SELECT DISTINCT stamp, page, line_start FROM c), n AS (SELECT *, lead(line_start) OVER (PARTITION BY stamp, page ORDER BY line_start) AS next_line FROM s) SELECT * FROM n WHERE next_line - line_start > 5")
def line_gaps(spark, d):
    return citations.line_gaps(_cited(spark, d), "stamp")


@query("""WITH s AS (SELECT o_custkey, (o_orderkey % 50)::INTEGER AS page, o_orderkey AS stamp FROM orders),
n AS (SELECT *, lead(stamp) OVER (PARTITION BY o_custkey ORDER BY page, stamp) AS next_stamp, lead(page) OVER (PARTITION BY o_custkey ORDER BY page, stamp) AS next_page FROM s)
SELECT * FROM n WHERE next_stamp - stamp > next_page - page + 5""")
def bates_gaps(spark, d):
    stamps = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 50).cast("int").alias("page"), F.col("o_orderkey").alias("stamp"))
    return citations.stamp_gaps(stamps, "o_custkey")


@query(_BOXES + "SELECT doc_id, page, count(DISTINCT stamp) AS n_stamps, min(stamp) AS first_stamp FROM e GROUP BY doc_id, page HAVING count(DISTINCT stamp) > 1")
def bates_duplicates(spark, d):
    return citations.stamp_duplicates(citations.elements(table(spark, d, "lineitem")), "doc_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def type_distribution(spark, d):
    return report.distribution(table(spark, d, "events"), "event_type")


#: Stand-ins for legal documents: names and pieces of text, dealt to customers by their numbers.
_NAMES = (
    "Deposition of A.pdf", "condensed transcript 3.txt", "Hearing Transcript.pdf", "rebuttal-report.pdf", "Declaration of B.pdf", "Motion to Compel.pdf", "Opposition.pdf", "US Patent 7.pdf", "office action.pdf",
    "License.pdf", "10-K 2020.pdf", "IEEE draft.pdf", "Affidavit.pdf", "Resp to 2nd Set of Rogs.pdf", "First set of RFPs.pdf", "abc_def_0001234.pdf", "notes.txt",
)
_PIECES = (
    "DEPOSITION OF A WITNESS, COURT REPORTER", " 5  Q.  Where were you", "12   and so it went", "12. The expert is of the OPINION", "1.2.3 Scope: it SHALL hold", "From: a", "To: b", "Subject: c", "ITEM 1 of FORM 10-Q",
    "see ¶ 12 UNDER PENALTY OF PERJURY", "INTERROGATORY NO. 4 PROPOUNDS THE FOLLOWING", "RESPONSE TO INTERROGATORY NO. 4, GENERAL OBJECTIONS", "WHEREAS the EFFECTIVE DATE, NOW THEREFORE", "UNITED STATES PATENT, CLAIMS, ABSTRACT",
    "plain words of a letter", "MOTION TO, IN SUPPORT OF ARGUMENT", "YOUR HONOR, THE COURT, HEARING", "OFFICE ACTION, CLAIMS REJECTED, AMENDMENT", "REFERENCES, CONCLUSION, UNIVERSITY", "AFFIDAVIT, SWORN, NOTARIZED",
)


def _filed(spark, d) -> DataFrame:
    """doc_id, file_name, text, n_pages."""
    c, names, pieces = F.col("c_custkey"), F.array(*map(F.lit, _NAMES)), F.array(*map(F.lit, _PIECES))
    part = lambda at, times: F.repeat(F.concat(F.element_at(pieces, (at % len(_PIECES) + 1).cast("int")), F.lit("\n")), times.cast("int"))
    text = F.concat(part(c, c % 37 + 1), part(F.floor(c / 7), c % 5 + 1), part(F.floor(c / 11), c % 3 + 1))
    return table(spark, d, "customer").select(c.alias("doc_id"), F.element_at(names, (F.floor(c / 3) % len(_NAMES) + 1).cast("int")).alias("file_name"), text.alias("text"), (c % 5 + 1).cast("int").alias("n_pages"))


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_FILED = f"""WITH k AS (SELECT {_quoted(_NAMES)} AS names, {_quoted(_PIECES)} AS pieces),
filed AS (SELECT c_custkey AS doc_id, names[c_custkey // 3 % {len(_NAMES)} + 1] AS file_name, (c_custkey % 5 + 1)::INTEGER AS n_pages,
  repeat(pieces[c_custkey % {len(_PIECES)} + 1] || chr(10), c_custkey % 37 + 1) || repeat(pieces[c_custkey // 7 % {len(_PIECES)} + 1] || chr(10), c_custkey % 5 + 1) || repeat(pieces[c_custkey // 11 % {len(_PIECES)} + 1] || chr(10), c_custkey % 3 + 1) AS text
  FROM customer, k)"""
_BY_NAME = "(SELECT doc_id, doc_type, 1.0::DOUBLE AS score FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS doc_type, lower(file_name) AS f FROM filed WHERE regexp_matches(lower(file_name), '{form}')" for t, form in classify.FILE_NAMES.items()) + f""") x
WHERE doc_type <> 'discovery_request' OR NOT regexp_matches(f, '{classify.FILE_NAMES["discovery_response"]}') UNION ALL SELECT doc_id, 'exhibit', 0.15::DOUBLE FROM filed WHERE regexp_matches(lower(file_name), '{classify.STAMPED_NAME}'))"""
_BY_WORDS = "(SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS doc_type, least(1.0::DOUBLE, (" + " + ".join(f"contains(upper(text), '{w}')::INTEGER" for w in words) + f") / {max(3.0, 0.4 * len(words))}::DOUBLE) AS score FROM filed" for t, words in classify.KEYWORDS.items()
) + ") x WHERE score > 0)"
_COUNTED = "(SELECT doc_id, greatest(n_pages, 1) AS pages, " + " OR ".join(f"contains(upper(text), '{a}')" for a in classify.ANSWERS) + " AS answers, " + ", ".join(
    f"len(list_filter({'list_slice(string_split(text, chr(10)), 1, 30)' if n == 'mail_headers' else 'string_split(text, chr(10))'}, lambda x: regexp_matches(x, '{p}'))) AS {n}" for n, p in classify.LINE_SHAPES.items()
) + " FROM filed)"
_BY_LINES = "(WITH c AS " + _COUNTED + """, s AS (
SELECT doc_id, 'deposition' AS doc_type, greatest(CASE WHEN turns > 10 THEN least(1.0::DOUBLE, turns / 30.0::DOUBLE) END, CASE WHEN margin_numbers > 20 THEN 0.7::DOUBLE END) AS score FROM c
UNION ALL SELECT doc_id, 'hearing_transcript', CASE WHEN turns > 10 THEN least(0.5::DOUBLE, turns / 60.0::DOUBLE) END FROM c
UNION ALL SELECT doc_id, 'expert_report', greatest(CASE WHEN numbered_paragraphs > 5 THEN least(1.0::DOUBLE, numbered_paragraphs / pages::DOUBLE / 3) END, CASE WHEN paragraph_signs > 3 THEN 0.5::DOUBLE END) FROM c
UNION ALL SELECT doc_id, 'declaration', CASE WHEN numbered_paragraphs > 5 THEN least(0.6::DOUBLE, numbered_paragraphs / pages::DOUBLE / 5) END FROM c
UNION ALL SELECT doc_id, 'technical_standard', CASE WHEN section_numbers > 5 THEN least(1.0::DOUBLE, section_numbers / 15.0::DOUBLE) END FROM c
UNION ALL SELECT doc_id, 'agreement', CASE WHEN section_numbers > 5 THEN least(0.5::DOUBLE, section_numbers / 20.0::DOUBLE) END FROM c
UNION ALL SELECT doc_id, 'correspondence', CASE WHEN mail_headers >= 3 THEN 1.0::DOUBLE END FROM c
UNION ALL SELECT doc_id, 'sec_filing', CASE WHEN items >= 2 THEN least(1.0::DOUBLE, items / 4.0::DOUBLE) END FROM c
UNION ALL SELECT doc_id, 'discovery_response', CASE WHEN answers AND requests >= 1 THEN least(1.0::DOUBLE, requests / 3.0::DOUBLE) END FROM c
UNION ALL SELECT doc_id, 'discovery_request', CASE WHEN NOT answers AND requests >= 1 THEN least(1.0::DOUBLE, requests / 3.0::DOUBLE) END FROM c)
SELECT * FROM s WHERE score > 0)"""


@query(_FILED + " SELECT doc_id, doc_type, score FROM " + _BY_NAME)
def signal_filename(spark, d):
    return classify.filename_signal(_filed(spark, d))


@query(_FILED + " SELECT doc_id, doc_type, round(score, 6) AS score FROM " + _BY_WORDS)
def signal_content(spark, d):
    return classify.content_signal(_filed(spark, d)).withColumn("score", F.round("score", 6))


@query(_FILED + " SELECT doc_id, doc_type, round(score, 6) AS score FROM " + _BY_LINES)
def signal_structural(spark, d):
    return classify.structural_signal(_filed(spark, d)).withColumn("score", F.round("score", 6))


@query(_FILED + f""", w AS (SELECT *, 0.2::DOUBLE AS w, true AS says FROM {_BY_NAME} UNION ALL SELECT *, 0.3::DOUBLE, true FROM {_BY_WORDS} UNION ALL SELECT *, 0.3::DOUBLE, false FROM {_BY_LINES}),
a AS (SELECT doc_id, doc_type, sum(w * score) / 0.95::DOUBLE AS score, max(CASE WHEN says THEN score END) AS told FROM w GROUP BY doc_id, doc_type),
r AS (SELECT *, row_number() OVER o AS n, lead(score) OVER o AS nxt FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY round(score, 9) DESC, doc_type)),
b AS (SELECT * FROM r WHERE n = 1)
SELECT doc_id, CASE WHEN b.doc_type IS NULL OR (b.doc_type = 'deposition' AND told IS NULL) THEN 'unknown' ELSE b.doc_type END AS doc_type, coalesce(round(score, 3), 0) AS confidence, coalesce(round(score - coalesce(nxt, 0), 6), 0) + 0.0::DOUBLE AS margin,
  coalesce(round(score, 9) < 0.12::DOUBLE OR round(score - coalesce(nxt, 0), 9) < 0.04::DOUBLE, true) AS needs_input FROM filed LEFT JOIN b USING (doc_id)""")
def classify_argmax(spark, d):
    return classify.classify(_filed(spark, d)).drop("top_types")


@query("""WITH f AS (SELECT lang, unnest(['n_chars', 'doc_id']) AS feature, unnest([n_chars, doc_id])::DOUBLE AS value FROM documents)
SELECT lang, feature, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(value), 4) AS m2 FROM f GROUP BY lang, feature""")
def profile_welford(spark, d):
    return classify.profiles(table(spark, d, "documents"), "lang", ["n_chars", "doc_id"])


def _labelled(spark, d):
    """The state of an earlier run: the labelled documents, those marked toxic with a stale hash."""
    return table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("stale"), F.max("quality").alias("quality"))


_STATE = "WITH k AS (SELECT doc_id, max(toxic) AS stale, max(quality) AS quality FROM labels GROUP BY doc_id)"


@query(_STATE + " SELECT doc_id, sha256(text) AS content_hash FROM documents LEFT JOIN k USING (doc_id) WHERE stale IS NULL OR stale = 1")
def index_diff(spark, d):
    now = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    known = now.join(_labelled(spark, d), "doc_id").select("doc_id", F.when(F.col("stale") == 1, "stale").otherwise(F.col("content_hash")).alias("content_hash"))
    return state.changes(now, known, "doc_id")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def index_prune(spark, d):
    return state.vanished(table(spark, d, "labels").select(F.col("doc_id").alias("user_id")), table(spark, d, "events").select("user_id").distinct(), "user_id")


@query(_STATE + """, cur AS (SELECT doc_id FROM documents), ch AS (SELECT doc_id FROM k WHERE stale = 1), ex AS (SELECT doc_id FROM k UNION SELECT user_id FROM events)
SELECT doc_id, 'delete' AS action FROM ex WHERE doc_id NOT IN (SELECT doc_id FROM cur) UNION ALL SELECT doc_id, 'delete' FROM ex WHERE doc_id IN (SELECT doc_id FROM ch)
UNION ALL SELECT doc_id, 'add' FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM ex) UNION ALL SELECT doc_id, 'add' FROM cur WHERE doc_id IN (SELECT doc_id FROM ex) AND doc_id IN (SELECT doc_id FROM ch)""")
def vector_update_plan(spark, d):
    known = _labelled(spark, d)
    existing = known.select("doc_id").union(table(spark, d, "events").select("user_id")).distinct()
    return state.update_plan(table(spark, d, "documents").select("doc_id"), existing, known.filter("stale = 1").select("doc_id"), "doc_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, max(CASE WHEN rn = 1 THEN event_type END) AS status, count(CASE WHEN event_type = 'error' THEN 1 END) AS retry_count, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS stages, count(*) AS n_events FROM r GROUP BY user_id")
def pipeline_state_fold(spark, d):
    return state.fold(table(spark, d, "events"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), f AS (SELECT user_id, max(CASE WHEN rn = 1 THEN event_type END) AS status, count(CASE WHEN event_type = 'error' THEN 1 END) AS retry_count FROM r GROUP BY user_id) SELECT user_id, CASE WHEN status = 'purchase' THEN 'completed' WHEN retry_count >= 3 THEN 'failed' ELSE 'run' END AS decision FROM f")
def retry_gate(spark, d):
    return state.gate(state.fold(table(spark, d, "events"))).select("user_id", "decision")


@query("WITH s AS (SELECT p_partkey, regexp_replace(lower(p_name), '[ -]+', '_', 'g') AS stem FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS n FROM s) SELECT p_partkey, CASE WHEN n = 1 THEN stem ELSE stem || '_' || n END AS unique_stem FROM n")
def stem_disambiguate(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[ -]+", "_").alias("stem"))
    return state.disambiguate(names, "p_partkey", "stem").select("p_partkey", "unique_stem")


@query(_LINES + """, q AS (SELECT l.doc_id, l.line AS quote FROM lines l WHERE l.line_no <= 3 UNION ALL SELECT doc_id, 'never said' FROM documents)
, t AS (SELECT q.doc_id, trim(quote, ' ' || chr(9) || chr(10) || chr(13)) AS quote, text FROM q JOIN documents USING (doc_id))
SELECT d.doc_id AS chunk_id, count(DISTINCT CASE WHEN quote <> '' AND contains(t.text, quote) THEN quote END) AS n_quotes, CASE WHEN any_value(d.lang) = 'en' THEN 'witness_statement' ELSE 'unclassified' END AS category,
CASE WHEN d.doc_id % 2 = 0 THEN 'high' ELSE 'medium' END AS relevance, CASE WHEN d.doc_id BETWEEN 1 AND 99 AND d.doc_id <> 7 THEN 2 ELSE 1 END AS n_claims FROM documents d JOIN t USING (doc_id) GROUP BY d.doc_id""")
def enrich_validate(spark, d):
    docs = table(spark, d, "documents")
    said = docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("core_text"), F.array_append(F.slice(F.split("text", "\n"), 1, 3), F.lit(" never said ")).alias("key_quotes"),
        F.when(F.col("lang") == "en", " Witness_Statement").otherwise(F.col("lang")).alias("category"), F.when(F.col("doc_id") % 2 == 0, "high").otherwise("none").alias("relevance"),
        F.array(F.col("doc_id").cast("string"), F.lit("7"), F.lit("7654321"), F.lit("x")).alias("claims"),
    )
    good = enrich.validate(said)
    return good.select("chunk_id", F.size("key_quotes").cast("long").alias("n_quotes"), "category", "relevance", F.size("claims").alias("n_claims"))


_RESULTS = "WITH r AS (SELECT doc_id, len(string_split(text, chr(10))) - 1 AS citations_count, (doc_id % 101)::DOUBLE AS coverage_pct, n_chars // 3200 AS chunks_count FROM documents)"


@query(_RESULTS + " SELECT doc_id, 'zero_citations' AS warning FROM r WHERE citations_count = 0 UNION ALL SELECT doc_id, 'low_coverage' FROM r WHERE citations_count > 0 AND coverage_pct < 50 UNION ALL SELECT doc_id, 'zero_chunks' FROM r WHERE chunks_count = 0")
def report_warnings(spark, d):
    rows = table(spark, d, "documents").select(
        "doc_id", (F.size(F.split("text", "\n")) - 1).alias("citations_count"), (F.col("doc_id") % 101).cast("double").alias("coverage_pct"), F.floor(F.col("n_chars") / 3200).alias("chunks_count"),
    )
    return report.warnings(rows)


@query("""WITH v AS (SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, n, mean, v[n // 2 + 1] AS p50, v[floor(n * 0.95::DOUBLE)::INTEGER + 1] AS p95, v[n] AS most FROM v""")
def latency_summary(spark, d):
    return report.latency(table(spark, d, "events").filter("value IS NOT NULL"), "event_type", "value")


@query("""WITH f AS (SELECT user_id, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank, event_type FROM events)
SELECT user_id, round(count(CASE WHEN event_type = 'click' THEN 1 END) / 5.0::DOUBLE, 6) AS precision, count(CASE WHEN event_type = 'click' THEN 1 END) > 0 AS any_hit FROM f WHERE rank <= 5 GROUP BY user_id""")
def precision_at_k(spark, d):
    events = table(spark, d, "events").withColumnRenamed("event_id", "item")
    ranked = events.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc_nulls_last(), "item"))).select("user_id", "item", "rank")
    return report.precision_at_k(ranked, events.filter("event_type = 'click'"), "user_id", "item", 5)


@query("SELECT doc_id, count(*) AS chunks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY doc_id")
def doc_stats(spark, d):
    return report.distribution(lines.lines(table(spark, d, "documents")), "doc_id").withColumnRenamed("n", "chunks")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 1 THEN 1 ELSE 0 END AS y FROM lineitem),
g AS (SELECT *, sum(y) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doc FROM s)
SELECT l_orderkey, doc::BIGINT AS doc, count(*) AS n_images FROM g WHERE doc > 0 GROUP BY l_orderkey, doc""")
def opt_group(spark, d):
    pages = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("production"), (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")).alias("line_no"),
        F.col("l_partkey").cast("string").alias("bates"), F.col("l_suppkey").cast("string").alias("path"), F.when(F.col("l_linenumber") % 3 == 1, "Y").otherwise("").alias("doc_break"),
    )
    return loadfile.group_pages(pages).select(F.col("production").alias("l_orderkey"), "doc", F.size("images").cast("long").alias("n_images"))


@query(_LINES + ", f AS (SELECT doc_id, line_no, CASE WHEN line LIKE '%.' THEN page END AS own FROM paged) SELECT doc_id, line_no, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)::INTEGER AS page FROM f")
def page_ffill(spark, d):
    rows = lines.paged(lines.lines(table(spark, d, "documents"))).withColumn("own", F.when(F.col("line").endswith("."), F.col("page"))).drop("page")
    return lines.carry(rows, ["doc_id"], "line_no", "own", "page").select("doc_id", "line_no", F.coalesce("page", F.lit(-1)).alias("page"))


@query(_LINES + """, m AS (SELECT doc_id, line_no, line, page, page IS DISTINCT FROM lag(page) OVER (PARTITION BY doc_id ORDER BY line_no) AS turned FROM paged),
e AS (SELECT doc_id, line_no, 0 AS part, page, CASE WHEN turned THEN '[PAGE:' || page || CASE WHEN page % 2 = 0 THEN ' | S' || page ELSE '' END || ']' ELSE line END AS line FROM m UNION ALL SELECT doc_id, line_no, 1, page, line FROM m WHERE turned)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1)::INTEGER AS pos, page, line FROM e""")
def page_markers(spark, d):
    """Pages of 25 lines, every other one with a stamp."""
    text = F.split("text", "\n", -1)
    pages = F.transform(text, lambda x, i: (F.floor(i / 25) + 1).cast("int"))
    stamps = F.transform(text, lambda x, i: F.when(F.floor(i / 25) % 2 == 1, F.concat(F.lit("S"), (F.floor(i / 25) + 1).cast("string"))))
    rows = table(spark, d, "documents").select("doc_id", F.lit("generic").alias("family"), text.alias("text_lines"), pages.alias("page_map"), stamps.alias("bates_map"))
    return chunks.with_page_marks(rows).select("doc_id", F.posexplode(F.arrays_zip("page_map", "text_lines")).alias("pos", "x")).select("doc_id", "pos", F.col("x.page_map").alias("page"), F.col("x.text_lines").alias("line"))


@query("""SELECT doc_id, concat_ws(chr(10), '# D' || doc_id, '', '**Bates range:** D' || doc_id || ' – D' || n_chars, CASE WHEN source <> '' THEN '**Original filename:** ' || source END, CASE WHEN doc_id % 2 = 0 THEN '**Custodian:** ' || lang END,
  CASE WHEN doc_id % 5 <> 0 THEN '**Date:** ' || CASE WHEN doc_id % 3 = 0 THEN 'sent' WHEN doc_id % 3 = 1 THEN 'made' ELSE 'changed' END END, CASE WHEN doc_id % 7 = 0 THEN '**Cc:** all' END) AS header FROM documents""")
def header_block(spark, d):
    """Documents as records of a load file."""
    i, blank = F.col("doc_id"), F.lit("")
    dated = lambda n, word: F.when((i % 5 != 0) & (i % 3 == n), word).otherwise(blank)
    have = {
        "beg_bates": F.concat(F.lit("D"), i.cast("string")), "end_bates": F.concat(F.lit("D"), F.col("n_chars").cast("string")), "file_name": F.coalesce("source", blank), "custodian": F.when(i % 2 == 0, F.col("lang")).otherwise(blank),
        "date_sent": dated(0, "sent"), "date_created": dated(1, "made"), "date_last_mod": dated(2, "changed"), "cc": F.when(i % 7 == 0, "all").otherwise(blank),
    }
    rows = table(spark, d, "documents").select("doc_id", *[have.get(c, blank).alias(c) for c in loadfile.ALIASES])
    return rows.select("doc_id", loadfile.heading().alias("header"))


@query("""WITH b AS (SELECT l_orderkey, 'L' || lpad(l_suppkey::VARCHAR, 6, '0') AS s, l_linenumber FROM lineitem)
SELECT l_orderkey, 'Order ' || l_orderkey || CASE WHEN l_orderkey % 2 = 0 THEN ' at ' || min(s) || CASE WHEN min(s) <> max(s) THEN '-' || max(s) ELSE '' END ELSE ', p. 5' END AS citation FROM b GROUP BY l_orderkey""")
def citation_string(spark, d):
    """Orders cited by the stamps of their items, every other one by a page."""
    stamp = F.concat(F.lit("L"), T.pad_number(F.col("l_suppkey"), F.lit(6)))
    even = F.col("l_orderkey") % 2 == 0
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(stamp).alias("s")).select(
        "l_orderkey", F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("stem"), F.lit("generic").alias("family"), F.when(even, F.col("s")).otherwise(F.array().cast("array<string>")).alias("stamps"), F.array(F.lit(5)).alias("pages"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("ranges", "array<struct<page:int,first:int,last:int>>"), ("paragraphs", "array<bigint>"), ("request_kind", "string"), ("request_number", "bigint"), ("part", "int"), ("part_total", "int"))],
    )
    return rows.select("l_orderkey", chunks.citation_string().alias("citation"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS page FROM lineitem), n AS (SELECT l_orderkey, max(page) AS last FROM p GROUP BY l_orderkey)
SELECT l_orderkey, page::INTEGER AS page, 'ABC' || lpad((l_orderkey + page - 1)::VARCHAR, greatest(9, length((l_orderkey + page - 1)::VARCHAR))::INTEGER, '0') AS bates FROM p JOIN n USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey WHERE last >= 1""")
def bates_derive(spark, d):
    pages = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("page"), F.lit(None).cast("string").alias("bates"))
    number = lambda c: T.pad_number(c, F.lit(9))
    last = pages.groupBy("l_orderkey").agg(F.max("page").alias("n"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    names = last.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("Abc"), number(F.col("l_orderkey")), F.lit("-abc"), number(F.col("l_orderkey") + F.col("n") - 1), F.lit(" x.pdf")).alias("file_name"))
    derived = chunks.derive_stamps(pages.distinct().withColumnRenamed("l_orderkey", "doc_id"), names)
    return derived.filter("bates IS NOT NULL").withColumnRenamed("doc_id", "l_orderkey")


@query(_LINES + """, s AS (SELECT doc_id, line_no, CASE WHEN contains(lower(line), 'the anea.') THEN 1000000 ELSE len(list_intersect(list_distinct(regexp_split_to_array(lower(line), '\\s+')), ['the', 'anea.'])) END AS score FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS n FROM s)
SELECT doc_id, CASE WHEN score > 0 THEN line_no ELSE -1 END::INTEGER AS line_no FROM r WHERE n = 1""")
def query_page(spark, d):
    empty = F.struct(F.lit(None).cast("array<int>").alias("page_map"), F.lit(None).cast("array<string>").alias("bates_map"))
    hits = table(spark, d, "documents").select("doc_id", F.col("text").alias("core_text"), empty.alias("citation"))
    return retrieve.hit_places(hits, "the anea.").select("doc_id", F.coalesce("hit_line", F.lit(-1)).alias("line_no"))


@query(_SEARCH + r""", shared AS (SELECT doc_id, rank, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\s+')), string_split('""" + QUERY_TEXT + r"""', ' ')))::DOUBLE AS score FROM best JOIN documents USING (doc_id) WHERE rank <= 10)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, rank)::INTEGER AS rank FROM shared QUALIFY row_number() OVER (ORDER BY score DESC, rank) <= 5""")
def rerank_lexical(spark, d):
    found = _with_text(spark, d, _keyword(spark, d))
    return retrieve.reranked(found, retrieve.shared_words(QUERY_TEXT, F.col("text")), 5).select("doc_id", "score", "rank")


@query(_SEARCH + r""", shared AS (SELECT doc_id, rank, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\s+')), string_split('""" + QUERY_TEXT + r"""', ' ')))::DOUBLE AS score FROM best JOIN documents USING (doc_id) WHERE rank <= 50)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, rank)::INTEGER AS rank FROM shared QUALIFY row_number() OVER (ORDER BY score DESC, rank) <= 5""")
def rerank_lexical_deep(spark, d):
    found = _with_text(spark, d, _keyword(spark, d, search.fetch_k(QUERY_TEXT, 10, rerank=True)))
    return retrieve.reranked(found, retrieve.shared_words(QUERY_TEXT, F.col("text")), 5).select("doc_id", "score", "rank")


@query("""WITH p AS (SELECT lang, count(n_chars) AS n, round(avg(n_chars::DOUBLE), 6) AS mean, round(var_pop(n_chars::DOUBLE) * count(n_chars), 4) AS m2 FROM documents GROUP BY lang)
SELECT doc_id, p.lang, round(1 / (1 + sqrt(((n_chars - mean) / greatest(sqrt(CASE WHEN n > 1 THEN m2 / n ELSE 0.01::DOUBLE END), 0.01::DOUBLE)) ** 2)), 6) AS score FROM documents, p""")
def profile_score(spark, d):
    docs = table(spark, d, "documents")
    return classify.profile_scores(docs.drop("lang"), "doc_id", ["n_chars"], classify.profiles(docs, "lang", ["n_chars"]), "lang")


@query("SELECT conv_id, list_aggregate(list_sort(list_distinct(list(role) || list('quote'))), 'string_agg', ',') AS quotes FROM conversations GROUP BY conv_id")
def enrich_merge_quotes(spark, d):
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"), F.collect_list(F.lit("quote")).alias("more"))
    return said.select("conv_id", F.array_join(F.array_sort(enrich.merge_quotes(F.col("roles"), F.col("more"))), ",").alias("quotes"))


@query("""SELECT CASE WHEN quality = 1 THEN 'completed' WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS status, count(*) AS documents, sum(n_chars)::BIGINT AS citations, sum(n_chars // 3200)::BIGINT AS chunks, round(avg(length(text)), 4) AS coverage
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY ROLLUP (status)""")
def pipeline_report(spark, d):
    joined = table(spark, d, "documents").join(_labelled(spark, d), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return report.run_report(joined.select(status.alias("status"), F.col("n_chars").alias("citations_count"), F.floor(F.col("n_chars") / 3200).alias("chunks_count"), F.length("text").alias("coverage_pct")))


@query("SELECT o_orderpriority AS production, o_orderkey + 1 AS line_no, 'A' || o_orderkey AS beg_bates, 'A' || o_custkey AS end_bates, o_orderstatus AS custodian FROM orders")
def dat_parse(spark, d):
    def row(*cells):
        return F.concat_ws(loadfile.FIELD, *[F.concat(F.lit(loadfile.QUALIFIER), c, F.lit(loadfile.QUALIFIER)) for c in cells])

    orders = table(spark, d, "orders")
    body = orders.select(F.col("o_orderpriority").alias("production"), (F.col("o_orderkey") + 1).alias("line_no"), row(F.concat(F.lit("A"), "o_orderkey"), F.concat(F.lit("A"), "o_custkey"), F.col("o_orderstatus")).alias("line"))
    head = body.select("production").distinct().select("production", F.lit(0).cast("long").alias("line_no"), row(F.lit("BegBates"), F.lit("EndBates"), F.lit("Custodian")).alias("line"))
    return loadfile.parse_records(head.unionByName(body)).select("production", "line_no", "beg_bates", "end_bates", "custodian")


def _said(spark, d) -> tuple[DataFrame, DataFrame]:
    """Conversations as transcripts (doc_id, md) of ten lines a page, and their citations."""
    said = table(spark, d, "conversations").filter("role IN ('user', 'assistant')").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    line = lambda x, i: F.concat(F.lpad((i % 10 + 1).cast("string"), 2, " "), F.when(x["role"] == "user", "  Q.  ").otherwise("  A.  "), F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"\s+", " "))
    page = lambda i: F.concat(F.repeat(F.lit(" "), F.lit(40)), (F.floor(i / 10) + 1).cast("string"))
    rows = F.flatten(F.transform("t", lambda x, i: F.when(i % 10 == 0, F.array(page(i), line(x, i))).otherwise(F.array(line(x, i)))))
    return transcripts.from_text(said.select("doc_id", F.array_join(rows, "\n").alias("content")))


@query("""WITH t AS (SELECT conv_id, role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id AS doc_id, i // 10 + 1 AS page, i % 10 + 1 AS line_start, 'line_P' || (i // 10 + 1) || '_L' || (i % 10 + 1) AS ref FROM t""")
def transcript_citations(spark, d):
    return _said(spark, d)[1].select("doc_id", F.col("page").cast("long").alias("page"), F.col("line_start").cast("long").alias("line_start"), "ref")


def _corpus(md: DataFrame, kind: str) -> DataFrame:
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return md.select("doc_id", stem.alias("stem"), "md", F.lit(kind).alias("doc_type"), stem.alias("file_name"), F.lit("").alias("source_path"))


@query("""WITH t AS (SELECT conv_id, role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id AS doc_id, (i % 10 + 1)::INTEGER AS number, CASE role WHEN 'user' THEN 'Q' ELSE 'A' END AS mark, said FROM t WHERE said <> ''""")
def qa_markers(spark, d):
    md = _said(spark, d)[0]
    return lines.qa_markers(lines.lines(md.select("doc_id", F.col("md").alias("text")))).select("doc_id", "number", "mark", F.trim("said").alias("said"))


@query()
def chunk_transcript(spark, d):
    md, cited = _said(spark, d)
    return chunks.chunk(_corpus(md, "deposition"), cited, target=200).select("chunk_id", "core_text", "citation_string", "tokens", "pages")


@query()
def chunk_discovery(spark, d):
    """Every tenth line of a document is a request, every tenth but five a response to it."""
    head = lambda x, i: F.when(i % 10 == 0, F.concat(F.lit("INTERROGATORY NO. "), (F.floor(i / 10) + 1).cast("string"))).when(i % 10 == 5, F.concat(F.lit("RESPONSE TO INTERROGATORY NO. "), (F.floor(i / 10) + 1).cast("string"))).otherwise(x)
    docs = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), head), "\n").alias("text"))
    cited = _by_page(docs)
    return chunks.chunk(_corpus(_marked(docs, 1), "discovery_response"), cited, target=200, most=300).select("chunk_id", "core_text", "citation_string", "tokens", "pages")


def _by_page(docs: DataFrame) -> DataFrame:
    """A citation of each line by its page of 25."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    have = {"doc_id": F.col("doc_id"), "ord": F.col("ord"), "ref": F.format_string("#/texts/%d", F.col("ord") + 1), "page": F.floor(F.col("ord") / 25) + 1, "type": F.lit("page_only")}
    return rows.select(*[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in model.CITATIONS.split(", "))])


@query(r"""WITH x AS (SELECT l_suppkey AS doc_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord, l_partkey, l_quantity::INTEGER AS q FROM lineitem),
v AS (SELECT doc_id, ord, CASE WHEN l_partkey % 19 = 0 THEN q END AS sign, CASE WHEN l_partkey % 19 <> 0 AND l_partkey % 3 = 0 THEN q * 6 - 5 END AS plain FROM x),
e AS (SELECT *, count(coalesce(sign, plain)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM v),
o AS (SELECT *, coalesce(sign, CASE WHEN earlier = 0 THEN plain END) AS opens FROM e),
s AS (SELECT *, count(opens) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stretch FROM o)
SELECT doc_id, ord, coalesce(CASE WHEN stretch > 0 THEN max(coalesce(opens, CASE WHEN plain BETWEEN 1 AND 200 THEN plain END)) OVER (PARTITION BY doc_id, stretch ORDER BY ord ROWS UNBOUNDED PRECEDING) END, -1)::BIGINT AS paragraph FROM s""")
def paragraph_carry(spark, d):
    q = F.col("l_quantity").cast("int")
    text = F.when(F.col("l_partkey") % 19 == 0, F.concat(F.lit("see ¶ "), q.cast("string"), F.lit(" there"))).when(F.col("l_partkey") % 3 == 0, F.concat((q * 6 - 5).cast("string"), F.lit(". The item"))).otherwise("an item")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("ord"), text.alias("text"))
    return cite.paragraph_numbers(rows).select("doc_id", "ord", F.coalesce("paragraph", F.lit(-1)).alias("paragraph"))


@query(_LINES + """, x AS (SELECT doc_id, line_no, CASE WHEN line_no % 10 = 1 THEN line_no // 10 + 1 END AS n FROM lines)
SELECT doc_id, line_no - 1 AS ord, last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS request, 'rfp' AS kind FROM x""")
def request_carry(spark, d):
    """Every tenth line of a document is a request for production; each line belongs to the last one."""
    rows = lines.lines(table(spark, d, "documents")).withColumn("text", F.when(F.col("line_no") % 10 == 1, F.concat(F.lit("REQUEST FOR PRODUCTION NO. "), (F.floor(F.col("line_no") / 10) + 1).cast("string"))).otherwise(F.concat(F.lit("x"), "line")))
    elements = rows.select("doc_id", (F.col("line_no") - 1).alias("ord"), F.lit(None).cast("string").alias("self_ref"), F.lit("text").alias("label"), "text", F.lit(1).alias("page_no"), *[F.lit(None).cast("double").alias(c) for c in "ltrb"])
    return cite.discovery_citations(cite.prepared(elements)).select("doc_id", "ord", F.col("discovery_request_number").alias("request"), F.col("discovery_request_kind").alias("kind"))


@query(r"""WITH x AS (SELECT l_suppkey AS doc_id, (l_partkey % 40 + 1)::INTEGER AS page, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord, 'ABC' || lpad((l_partkey % 900)::VARCHAR, 6, '0') AS s FROM lineitem WHERE l_partkey % 5 = 0)
SELECT doc_id, page AS page_no, arg_max(s, ord) AS bates FROM x GROUP BY doc_id, page""")
def bates_by_page(spark, d):
    """A fifth of the items are page footers with a stamp."""
    stamp = F.concat(F.lit("Page of ABC"), T.pad_number(F.col("l_partkey") % 900, F.lit(6)), F.lit(" x"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("ord"), F.when(F.col("l_partkey") % 5 == 0, "page_footer").otherwise("text").alias("label"), stamp.alias("text"), (F.col("l_partkey") % 40 + 1).cast("int").alias("page_no"),
    )
    return cite.footer_stamps(rows)


_PAGED = r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS n, unnest(s) AS line FROM s), p AS (SELECT *, CASE WHEN n % 20 = 1 THEN 'Page ' || (n // 20 + 1) WHEN n % 7 = 0 THEN '¶ ' || n || ' ' || line ELSE 'x' || replace(line, '.', '') END AS t, n // 20 + (CASE WHEN n % 20 = 0 THEN 0 ELSE 1 END) AS page FROM l)"""


@query(_PAGED + " SELECT doc_id, n - 1 AS ord, page::INTEGER AS page, n::BIGINT AS paragraph_number FROM p WHERE n % 7 = 0 AND n % 20 <> 1")
def citation_marks(spark, d):
    """Every twentieth line names a page, every seventh other one a paragraph: citations of the marked text."""
    line = lambda x, i: F.when((i + 1) % 20 == 1, F.concat(F.lit("Page "), (F.floor((i + 1) / 20) + 1).cast("string"))).when((i + 1) % 7 == 0, F.concat(F.lit("¶ "), (i + 1).cast("string"), F.lit(" "), F.regexp_replace(x, r"(?i)(?:page|p\.)\s+\d+", ""))).otherwise(F.concat(F.lit("x"), F.translate(x, ".", "")))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("md"), F.lit("brief").alias("doc_type"))
    return postprocess.mark_citations(docs)[1].select("doc_id", "ord", "page", "paragraph_number")


@query()
def align_pages(spark, d):
    """Documents without page breaks against their own pages of lines."""
    docs = table(spark, d, "documents")
    pages = lines.paged(lines.lines(docs)).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    texts = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.array_join("rows.line", "\n").alias("t")))).alias("p"))
    return folds.align_pages(docs.select("doc_id", "text").join(texts, "doc_id").select("doc_id", "text", F.col("p.t").alias("pages")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks to ranked hits with pages: marked texts are chunked with citations, and a phrase is searched in them."""
    docs = table(spark, sf_dir, "documents")
    path = f"{workers.shared_folder(spark)}/flagship-{spark.sparkContext.applicationId}"
    tables.write(chunks.chunk(_corpus(_marked(docs, 1), "unknown"), _by_page(docs)), f"{path}/chunks")
    made = tables.read(spark, f"{path}/chunks")
    index.build(made.select("chunk_id", F.col("core_text").alias("text")), f"{path}/keyword", "chunk_id")
    hits = retrieve.Retriever(spark, path, made).search(QUERY_TEXT, 10, "bm25")
    return retrieve.display(hits, QUERY_TEXT)
