"""Court reporters' transcripts: from plain text, and from the text spans of pages.

Both give marked text (doc_id, md) with '[PAGE:n]' lines and numbered lines, and citations (model.CITATIONS)
with the keys line_P{page}_L{line} that the chunker looks up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import model
from docketry.functions import text as T

#: Margin numbers, page numbers at the right, and the dot after Q or A; fixed patterns.
MARGIN, PAGE_NUMBER, ANSWER_DOT = r"^\s?(\d{1,2})\s{2,}", r"^\s{30,}(\d+)\s*$", r"^(\s*[QA])\.\s+"
HEAD_LINES, LINES = 80, 25
#: Places on a page, in points from its upper left; fixed values.
MARGIN_X, MARKER_X, MARKER_Y, HEADER_Y, FOOTER_Y, SAME_LINE = 100, 400, 95, 70, 730, 3
_COLUMNS = dict(c.split() for c in model.CITATIONS.split(", "))


def _lines(content: Column) -> Column:
    return F.split(F.regexp_replace(content, r"\r\n?", "\n"), "\n", -1)


def is_transcript(texts: DataFrame) -> DataFrame:
    """doc_id, is_transcript: whether the first lines of a text (doc_id, content) have a margin number and a page number."""
    head = F.slice(_lines(F.coalesce("content", F.lit(""))), 1, HEAD_LINES)
    return texts.select("doc_id", (F.exists(head, lambda x: F.concat(x, F.lit("\n")).rlike(MARGIN)) & F.exists(head, lambda x: x.rlike(PAGE_NUMBER))).alias("is_transcript"))


def _citations(rows: DataFrame, page: str, transcript_page: str) -> DataFrame:
    """A citation for each numbered line; of lines with one key one remains, where the first was."""
    once = rows.groupBy("doc_id", transcript_page, "line").agg(F.min("ord").alias("ord"), F.max_by(page, "ord").alias("_page"))
    have = {
        "doc_id": F.col("doc_id"), "ord": F.col("ord"), "ref": F.format_string("line_P%d_L%d", transcript_page, "line"), "page": F.col("_page"), "line_start": F.col("line"), "line_end": F.col("line"),
        "type": F.lit("transcript_line"), "transcript_page": F.col(transcript_page),
    }
    return once.select(*[have.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _COLUMNS.items()])


def _marked_text(rows: DataFrame) -> DataFrame:
    """doc_id, md from (doc_id, ord, out), in order."""
    listed = rows.filter("out IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "out"))).alias("o"))
    return listed.select("doc_id", F.array_join("o.out", "\n").alias("md"))


def from_text(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marked texts, citations) of plain transcripts (doc_id, content).

    A page begins at a line with its number at the right; what stands before the first page, lines
    without a margin number of 1 to LINES, and empty ones are left out. Null content has neither.
    """
    rows = texts.select("doc_id", F.posexplode(_lines(F.col("content"))).alias("pos", "line_text")).withColumn("ord", F.col("pos").cast("long"))
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = F.nullif(F.regexp_extract("line_text", PAGE_NUMBER, 1), F.lit("")).cast("int")
    rows = rows.withColumn("own", own).withColumn("page", F.last("own", ignorenulls=True).over(so_far))
    margin = F.when(F.col("own").isNull() & F.col("page").isNotNull(), F.nullif(F.regexp_extract("line_text", MARGIN, 1), F.lit("")).cast("int"))
    said = F.regexp_replace(F.regexp_replace("line_text", MARGIN, ""), ANSWER_DOT, "$1  ")
    rows = rows.withColumn("line", F.when(margin.between(1, LINES) & (T.strip(said) != ""), margin)).withColumn("said", said)
    out = F.when(F.col("own").isNotNull(), F.format_string("\n[PAGE:%d]", "own")).when(F.col("line").isNotNull(), F.concat(F.lpad(F.col("line").cast("string"), 2, " "), F.lit("  "), "said"))
    return _marked_text(rows.withColumn("out", out)), _citations(rows.filter("line IS NOT NULL"), "page", "page")


def page_lines(spans: DataFrame) -> DataFrame:
    """doc_id, page_no, y, line, said, transcript_page: visual lines of pages from text spans (doc_id, page_no, ord, text, x0, y0, x1, y1).

    Spans belong to one line if their middle is within SAME_LINE of the line's first. Footers,
    confidentiality headers and page markers are no content; a number at the left margin is the
    line's. Pages are folded one by one, in the JVM.
    """
    rows = spans.filter(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    listed = rows.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("y", "ord", "x0", "text"))).alias("s"))
    anchors = F.aggregate(
        F.col("s"), F.expr("CAST(array() AS array<double>)"),
        lambda acc, x: F.when((F.size(acc) == 0) | (F.abs(x["y"] - F.element_at(acc, -1)) > SAME_LINE), F.array_append(acc, x["y"])).otherwise(acc),
    )
    groups = listed.withColumn("y", F.explode(anchors)).withColumn("next", F.lead("y").over(Window.partitionBy("doc_id", "page_no").orderBy("y")))
    groups = groups.withColumn("g", F.filter("s", lambda x: (x["y"] >= F.col("y")) & (F.col("next").isNull() | (x["y"] < F.col("next")))))
    full = F.array_join(F.col("g.text"), " ")
    shown = F.regexp_extract(T.strip(full), r"^Page\s+(\d+)$", 1)
    conducted = F.regexp_extract(full, r"Conducted on.*,\s*\d{4}\s+(\d{1,3})\s*$", 1)
    placed = (F.array_min("g.x0") > MARKER_X) & (F.col("y") < MARKER_Y)
    marker = F.when((shown != "") & placed, shown).when((shown == "") & (conducted != ""), conducted).cast("int")
    kept = groups.filter((F.col("y") <= FOOTER_Y) & ~((F.col("y") < HEADER_Y) & F.upper(full).contains("CONFIDENTIAL"))).withColumn("marker", marker)
    by_x = F.array_sort(F.transform("g", lambda x: F.struct(x["x0"].alias("x0"), x["y"].alias("y"), x["ord"].alias("ord"), x["text"].alias("text"))))
    number = lambda x: F.when((x["x0"] < MARGIN_X) & x["text"].rlike(r"^\s*\d{1,2}\s*$"), T.strip(x["text"]).cast("int"))
    margins = F.filter(F.transform(by_x, number), lambda n: n.between(1, LINES))
    content = F.filter(by_x, lambda x: ~F.coalesce(number(x).between(1, LINES), F.lit(False)))
    page = F.last("marker", ignorenulls=True).over(Window.partitionBy("doc_id", "page_no").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    said = F.regexp_replace(F.array_join(F.transform(content, lambda x: x["text"]), " "), "  +", "  ")
    return kept.withColumn("transcript_page", page).select("doc_id", "page_no", "y", "marker", F.get(margins, F.lit(0)).alias("line"), F.when(F.size(content) > 0, said).alias("said"), "transcript_page")


def from_spans(spans: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marked texts, citations) of the pages (doc_id, page_no) of documents with text spans; pages without a number have their own."""
    rows = page_lines(spans)
    numbers = rows.groupBy("doc_id", "page_no").agg(F.max("transcript_page").alias("transcript_page"))
    numbered = pages.select("doc_id", "page_no").distinct().join(numbers, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("transcript_page", "page_no").alias("shown"))
    content = rows.filter("marker IS NULL AND said IS NOT NULL").filter(T.strip(F.col("said")) != "").join(numbered, ["doc_id", "page_no"])
    marks = numbered.select("doc_id", "page_no", F.lit(-1e300).alias("y"), F.format_string("\n[PAGE:%d]", "shown").alias("out"), F.lit(None).cast("int").alias("line"), "shown")
    text = F.when(F.col("line").isNotNull(), F.concat(F.lpad(F.col("line").cast("string"), 2, " "), F.lit("  "), "said")).otherwise(F.col("said"))
    every = marks.unionByName(content.select("doc_id", "page_no", "y", text.alias("out"), "line", "shown"))
    every = every.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "y")).cast("long"))
    return _marked_text(every), _citations(every.filter("line IS NOT NULL"), "page_no", "shown")
