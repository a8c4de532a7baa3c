"""Citations rebuilt from layout elements: lines of transcripts, columns of patents, paragraphs, requests, pages.

Elements are (doc_id, ord, self_ref, label, text, page_no, l, t, r, b), origin at the bottom left; ord is
their order. What carries over from element to element is a window over a document in that order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import model
from docketry.functions import text as T

#: Layout where a document has no page with enough elements, and of a patent column; fixed values.
TOP, BOTTOM, LINES, LEAST_ELEMENTS = 655.0, 87.5, 25, 8
COLUMN_LINES = 65
PAGE_WIDTH = 612.0
#: A text page of a patent has more characters than this, and more on average to an element.
SPEC_CHARACTERS, SPEC_AVERAGE = 300, 30
MOST_PARAGRAPH = 200
#: Forms of a stamp in a page footer, the first that is found counts; fixed patterns.
FOOTER_STAMPS = (r"INTEL_PROX_\d{5,11}", r"PROX_INTEL[-_]\d{5,11}", r"[A-Z]{2,}[-_][A-Z]{2,}[-_]\d{5,}", r"\b[A-Z]{2,10}\d{6,10}\b")
#: Where a request or a response to one begins; fixed pattern.
REQUEST = r"(?i)^\s*(?:#+\s*)?(?:\*+\s*)?(?:RESPONSE\s+TO\s+|SUPPLEMENTAL\s+RESPONSE\s+TO\s+|FURTHER\s+RESPONSE\s+TO\s+)?(INTERROGATORY|REQUEST\s+FOR\s+PRODUCTION|REQUEST\s+FOR\s+ADMISSION)\s+NO\.\s*(\d+)"
GAP_LINES = GAP_STAMPS = 5
_COLUMNS = [c.split()[0] for c in model.CITATIONS.split(", ")]
_TYPES = dict(c.split() for c in model.CITATIONS.split(", "))


def number(text: Column, pattern: str, group: int = 1) -> Column:
    """The number that a group of the first match holds; null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("bigint")


def page_marker(text: Column, left: Column, top: Column) -> Column:
    """The page that a marker 'Page 12' at the upper right names; null for testimony that says so."""
    placed = left.isNull() | (left > 400) | (top > 700)
    return F.when(placed, number(T.strip(text), r"^Page\s+(\d+)$")).cast("int")


def header(label: Column, text: Column) -> Column:
    return F.coalesce(label == "section_header", F.lit(False)) | F.startswith(F.upper(T.strip(text)), F.lit("CONFIDENTIAL"))


def skippable(text: Column, top: Column, bottom: Column) -> Column:
    """Blank, or a box of less than three points."""
    return (T.strip(text) == "") | F.coalesce(F.abs(top - bottom) < 3, F.lit(False))


def code_lines(text: Column) -> Column:
    """(first, last) of the line numbers 1 to 25 that stand before words in a block of code; null without any."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|\s)(\d{1,2})\s+[A-Za-z]"), F.lit(1)), lambda x: x.cast("int"))
    known = F.filter(found, lambda n: (n >= 1) & (n <= LINES))
    return F.when(F.size(known) > 0, F.struct(F.array_min(known).alias("first"), F.array_max(known).alias("last")))


def line_range(t: Column, b: Column, top: Column, bottom: Column, lines: Column) -> Column:
    """(first, last) line of a box in a content area; both within it, the last not before the first."""
    height = (top - bottom) / lines
    first = F.greatest(F.lit(1), F.least(lines, F.floor((top - t) / height) + 1))
    last = F.greatest(first, F.least(lines, F.floor((top - b) / height)))
    return F.when(height > 0, F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))).otherwise(F.struct(F.lit(1).alias("first"), F.lit(1).alias("last")))


def footer_stamps(elements: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """doc_id, page_no, bates: the stamp in the last page footer that has one; a row of sidecar takes its place."""
    stamp = F.coalesce(*[F.nullif(F.regexp_extract(T.strip(F.col("text")), p, 0), F.lit("")) for p in FOOTER_STAMPS])
    found = (
        elements.filter((F.col("label") == "page_footer") & F.col("page_no").isNotNull()).withColumn("bates", stamp).filter("bates IS NOT NULL")
        .groupBy("doc_id", "page_no").agg(F.max_by("bates", "ord").alias("bates"))
    )
    if sidecar is None:
        return found
    named = sidecar.select("doc_id", "page_no", F.col("bates").alias("named"))
    return found.join(named, ["doc_id", "page_no"], "full").select("doc_id", "page_no", F.coalesce("named", "bates").alias("bates"))


def prepared(elements: DataFrame) -> DataFrame:
    """Elements with a text, a reference, and what the handlers ask of each."""
    rows = elements.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("ref", F.coalesce("self_ref", F.concat(F.lit("#/texts/"), F.col("ord").cast("string"))))
    return rows.select(
        "*", page_marker(F.col("text"), F.col("l"), F.col("t")).alias("marker"), header(F.col("label"), F.col("text")).alias("is_header"),
        skippable(F.col("text"), F.col("t"), F.col("b")).alias("skip"), (F.col("t").isNotNull() & F.col("b").isNotNull() & F.col("page_no").isNotNull()).alias("placed"),
    )


def content_area(rows: DataFrame) -> DataFrame:
    """doc_id, top, bottom: medians over pages with LEAST_ELEMENTS content elements of the highest and lowest edge."""
    content = rows.filter(~F.col("is_header") & F.col("marker").isNull() & ~F.col("skip") & F.col("placed"))
    pages = content.groupBy("doc_id", "page_no").agg(F.max("t").alias("top"), F.min("b").alias("bottom"), F.count(F.lit(1)).alias("n"))
    return pages.filter(F.col("n") >= LEAST_ELEMENTS).groupBy("doc_id").agg(F.percentile("top", F.lit(0.5)).alias("top"), F.percentile("bottom", F.lit(0.5)).alias("bottom"))


def _so_far(*by: str) -> Window:
    return Window.partitionBy("doc_id", *by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)


def _cited(rows: DataFrame, kind: Column | str, **columns: Column) -> DataFrame:
    have = {"doc_id": F.col("doc_id"), "ord": F.col("ord"), "ref": F.col("ref"), "page": F.col("page_no"), "type": F.lit(kind) if isinstance(kind, str) else kind} | columns
    return rows.select(*[have.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in _COLUMNS])


def transcript_citations(rows: DataFrame, lines_per_page: int = LINES) -> DataFrame:
    """Page, lines and transcript page of each element; markers set the page of what follows and are left out."""
    lines = F.lit(lines_per_page)
    paged = rows.withColumn("carried", F.last("marker", ignorenulls=True).over(_so_far()))
    kept = paged.filter(F.col("marker").isNull() & ~F.col("is_header") & ~F.col("skip") & F.col("placed")).join(content_area(rows), "doc_id", "left")
    box = line_range(F.col("t"), F.col("b"), F.coalesce("top", F.lit(TOP)), F.coalesce("bottom", F.lit(BOTTOM)), lines)
    kept = kept.withColumn("range", F.coalesce(F.when(F.col("label") == "code", code_lines(F.col("text"))), box))
    page = F.when(F.col("carried") != 0, F.col("carried")).otherwise(F.col("page_no"))
    return _cited(kept, "transcript_line", line_start=F.col("range.first"), line_end=F.col("range.last"), transcript_page=page)


def patent_layout(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, width, middle, top, bottom, first_spec of each document, and its text pages as an array."""
    width = sizes.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("page_no") == 1, F.col("width"))), F.min_by("width", "page_no")).alias("width"))
    pages = rows.filter("page_no IS NOT NULL").groupBy("doc_id", "page_no").agg(
        F.sum(F.length("text")).alias("n"), F.avg(F.length("text")).alias("mean"), F.max("t").alias("top"), F.min("b").alias("bottom"),
    )
    spec = pages.filter((F.col("n") > SPEC_CHARACTERS) & (F.col("mean") > SPEC_AVERAGE)).groupBy("doc_id").agg(
        F.collect_set("page_no").alias("spec_pages"), F.min("page_no").alias("first_spec"), F.max("top").alias("top"), F.min("bottom").alias("bottom"),
    )
    boxes = rows.join(width, "doc_id", "left").withColumn("width", F.coalesce("width", F.lit(PAGE_WIDTH)))
    centre = (F.col("l") + F.col("r")) / 2
    narrow = boxes.filter((F.length("text") >= 20) & (F.col("r") - F.col("l") <= F.col("width") * 0.55))
    sides = narrow.groupBy("doc_id").agg(
        F.percentile(F.when(centre < F.col("width") * 0.4, F.col("r")), F.lit(0.5)).alias("left"), F.percentile(F.when(centre > F.col("width") * 0.6, F.col("l")), F.lit(0.5)).alias("right"),
    )
    known = rows.select("doc_id").distinct().join(width, "doc_id", "left").join(sides, "doc_id", "left").join(spec, "doc_id", "left").withColumn("width", F.coalesce("width", F.lit(PAGE_WIDTH)))
    return known.select("doc_id", "width", F.coalesce((F.col("left") + F.col("right")) / 2, F.col("width") / 2).alias("middle"), "spec_pages", F.coalesce("first_spec", F.lit(1)).alias("first_spec"), F.coalesce("top", F.lit(700.0)).alias("top"), F.coalesce("bottom", F.lit(80.0)).alias("bottom"))


def column_side(left: Column, right: Column, width: Column, middle: Column) -> Column:
    """full_width, left or right; where edges do not tell, the centre does."""
    return (
        F.when(right - left > width * 0.65, "full_width").when((right < middle) & (left < width * 0.38), "left")
        .when((left > middle * 0.85) & (left >= width * 0.38), "right").when((left + right) / 2 < middle, "left").otherwise("right")
    )


def patent_citations(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Column and lines on text pages, columns counted on from the first of them; pages alone for figures and full-width boxes."""
    kept = rows.filter(~F.col("skip") & F.col("placed")).join(patent_layout(rows, sizes), "doc_id")
    text_page = F.coalesce(F.array_contains("spec_pages", F.col("page_no")), F.lit(False))
    side = column_side(F.col("l"), F.col("r"), F.col("width"), F.col("middle"))
    kind = F.when(~text_page, "patent_figure").when(side == "full_width", "cross_column_merge").otherwise("patent_column")
    kept = kept.withColumn("kind", kind).withColumn("side", side).withColumn("range", line_range(F.col("t"), F.col("b"), F.col("top"), F.col("bottom"), F.lit(COLUMN_LINES)))
    inside = F.col("kind") == "patent_column"
    column = (F.col("page_no") - F.col("first_spec")) * 2 + F.when(F.col("side") == "left", 1).otherwise(2)
    return _cited(kept, F.col("kind"), column=F.when(inside, column), line_start=F.when(inside, F.col("range.first")), line_end=F.when(inside, F.col("range.last")))


def paragraph_numbers(rows: DataFrame) -> DataFrame:
    """rows (doc_id, ord, text) with ``paragraph``: the number of the paragraph that each stands in.

    A sign or the word, anywhere after white space, opens its number. A plain '12. Text' opens one if
    none is open, or if it is within 1 and MOST_PARAGRAPH and does not go back. What is accepted
    after an opening that always counts is the running maximum, so no fold is needed: openings part
    a document into stretches, and a window over each gives the number.
    """
    text = F.col("text")
    sign = F.coalesce(number(text, r"(?:^|\s)[¶§]\s*(\d+)"), number(text, r"(?:^|\s)[Pp]aragraph\s+(\d+)"))
    seen = rows.withColumn("_sign", sign).withColumn("_plain", F.when(F.col("_sign").isNull(), number(text, r"^(\d+)\.\s+[A-Z]")))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(F.coalesce("_sign", "_plain").isNotNull()).over(before), F.lit(False))
    opens = F.coalesce("_sign", F.when(~earlier, F.col("_plain")))
    parted = seen.withColumn("_open", opens).withColumn("_stretch", F.count("_open").over(_so_far()))
    value = F.coalesce("_open", F.when(F.col("_plain").between(1, MOST_PARAGRAPH), F.col("_plain")))
    return parted.withColumn("paragraph", F.when(F.col("_stretch") > 0, F.max(value).over(_so_far("_stretch")))).drop("_sign", "_plain", "_open", "_stretch")


def paragraph_citations(rows: DataFrame) -> DataFrame:
    kept = paragraph_numbers(rows.filter(~F.col("skip") & F.col("page_no").isNotNull()))
    known = F.coalesce(F.col("paragraph") != 0, F.lit(False))
    return _cited(kept, F.when(known, "paragraph").otherwise("page_only"), paragraph_number=F.col("paragraph"))


def discovery_citations(rows: DataFrame) -> DataFrame:
    """Every element has the kind and number of the last numbered request or response before it."""
    kept = rows.filter(~F.col("skip") & F.col("page_no").isNotNull())
    label, n = F.regexp_extract("text", REQUEST, 1), number(F.col("text"), REQUEST, 2)
    kept = kept.withColumn("own", F.when(label != "", F.struct(T.request_kind(label).alias("kind"), n.alias("n")))).withColumn("now", F.last("own", ignorenulls=True).over(_so_far()))
    kind = F.when(F.col("now.n").isNotNull(), "discovery_request").otherwise("page_only")
    return _cited(kept, kind, discovery_request_kind=F.col("now.kind"), discovery_request_number=F.col("now.n"))


def page_citations(rows: DataFrame) -> DataFrame:
    return _cited(rows.filter(~F.col("skip") & F.col("page_no").isNotNull()), "page_only")


def reconstruct(elements: DataFrame, types: DataFrame, sizes: DataFrame, sidecar: DataFrame | None = None, lines_per_page: int = LINES) -> DataFrame:
    """The citations of all elements, by the family of each document's type (doc_id, doc_type); unknown without one.

    A reference that is repeated in a document counts where it is last. Stamps are those of
    footer_stamps(). Elements without a page are not cited.
    """
    family = reduce(lambda acc, x: acc.when(F.col("doc_type").isin(*x[1]), x[0]), model.FAMILIES.items(), F.when(F.lit(False), "")).otherwise("generic")
    rows = prepared(elements).join(types.select("doc_id", "doc_type"), "doc_id", "left").withColumn("family", F.coalesce(family, F.lit("generic"))).drop("doc_type")
    one = lambda name: rows.filter(F.col("family") == name)
    cited = [transcript_citations(one("transcript"), lines_per_page), patent_citations(one("patent"), sizes), paragraph_citations(one("paragraph")), discovery_citations(one("discovery")), page_citations(one("generic"))]
    every = reduce(DataFrame.unionByName, cited).drop("bates")
    latest = F.row_number().over(Window.partitionBy("doc_id", "ref").orderBy(F.col("ord").desc()))
    every = every.withColumn("_n", latest).filter("_n = 1").drop("_n")
    stamps = footer_stamps(elements, sidecar).select("doc_id", F.col("page_no").alias("page"), "bates")
    return every.join(stamps, ["doc_id", "page"], "left").select(*_COLUMNS)


def line_gaps(citations: DataFrame) -> DataFrame:
    """doc_id, page, line, next_line: jumps of more than GAP_LINES between distinct lines of a transcript page."""
    starts = citations.filter("transcript_page IS NOT NULL AND line_start IS NOT NULL").select("doc_id", F.col("transcript_page").alias("page"), F.col("line_start").alias("line")).distinct()
    after = F.lead("line").over(Window.partitionBy("doc_id", "page").orderBy("line"))
    return starts.withColumn("next_line", after).filter(F.col("next_line") - F.col("line") > GAP_LINES)


def page_stamps(citations: DataFrame) -> DataFrame:
    """doc_id, page, bates, others: the first stamp of each page, and how many citations have another one."""
    stamped = citations.filter("coalesce(page, 0) <> 0 AND coalesce(bates, '') <> ''")
    first = stamped.groupBy("doc_id", "page").agg(F.min_by("bates", "ord").alias("first"))
    return stamped.join(first, ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.first("first").alias("bates"), F.count_if(F.col("bates") != F.col("first")).alias("others"))


def stamp_gaps(citations: DataFrame) -> DataFrame:
    """doc_id, page, next_page, stamp, next_stamp: where stamps advance by more than pages do, plus GAP_STAMPS."""
    numbered = page_stamps(citations).withColumn("stamp", number(F.col("bates"), r"(\d{5,})$")).filter("stamp IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy("page")
    moved = numbered.select("doc_id", "page", F.lead("page").over(w).alias("next_page"), "stamp", F.lead("stamp").over(w).alias("next_stamp"))
    return moved.filter(F.col("next_stamp") - F.col("stamp") > F.col("next_page") - F.col("page") + GAP_STAMPS)


def _notes(rows: DataFrame, order: list[str], note: Column, name: str) -> DataFrame:
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, note.alias("note")))).alias("notes"))
    return listed.select("doc_id", F.col("notes.note").alias(name))


def validate(citations: DataFrame) -> DataFrame:
    """A row per document: total_items, coverage_pct, has_*, type_distribution, line_gaps, bates_gaps, bates_duplicates."""
    placed = F.coalesce("line_start", "paragraph_number", "column").isNotNull()
    totals = citations.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_items"), (F.count_if(placed) / F.count(F.lit(1)) * 100).alias("coverage_pct"), F.bool_or(F.col("line_start").isNotNull()).alias("has_line_numbers"),
        F.bool_or(F.col("column").isNotNull()).alias("has_column_numbers"), F.bool_or(F.coalesce("bates", F.lit("")) != "").alias("has_bates"),
    )
    kinds = citations.groupBy("doc_id", "type").count().groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count")))).alias("type_distribution"))
    lines = _notes(line_gaps(citations), ["page", "line"], F.format_string("Page %d: gap %d->%d", "page", "line", "next_line"), "line_gaps")
    jump = F.col("next_stamp") - F.col("stamp") - F.col("next_page") + F.col("page")
    stamps = _notes(stamp_gaps(citations), ["page"], F.format_string("Pages %d-%d: Bates %d->%d (gap: %d)", "page", "next_page", "stamp", "next_stamp", jump), "bates_gaps")
    twice = page_stamps(citations).filter("others > 0").select("doc_id", "page", F.explode(F.sequence(F.lit(1), F.col("others").cast("int"))).alias("n"))
    repeated = _notes(twice, ["page", "n"], F.format_string("Page %d: multiple Bates stamps", "page"), "bates_duplicates")
    none = F.array().cast("array<string>")
    joined = reduce(lambda a, b: a.join(b, "doc_id", "left"), [totals, kinds, lines, stamps, repeated])
    return joined.select("doc_id", "total_items", "coverage_pct", "has_line_numbers", "has_column_numbers", "has_bates", "type_distribution", *[F.coalesce(c, none).alias(c) for c in ("line_gaps", "bates_gaps", "bates_duplicates")])


def infer_type(citations: DataFrame) -> DataFrame:
    """doc_id, doc_type by what kinds of citations a document has."""
    has = lambda kind: F.count_if(F.col("type") == kind)
    return citations.groupBy("doc_id").agg(
        F.when(has("transcript_line") > 0, "deposition").when(has("patent_column") > 0, "patent").when(has("discovery_request") > 0, "discovery_response")
        .when(has("paragraph") > 3, "expert_report").otherwise("unknown").alias("doc_type")
    )
