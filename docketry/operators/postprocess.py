"""Cleaning of converted text, marks of elements and footnotes in it, and citation marks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import model, workers
from docketry.functions import text as T

# Fixed patterns of lines.
CONTENTS = r"(?i)^(table\s+of\s+contents|contents)"
AFTER_CONTENTS = r"^\d{1,2}\s+[QA]\s+|^[¶§]\s*\d+|^(?i:CLAIM \d+)"
RULE, WIDE = r"^[_\.\s]{10,}$", r"\s{3,}"
PAGE, COLUMN, SIGN, TURN = r"(?i)(?:Page|p\.)\s+(\d+)", r"(?i)col(?:umn)?\.?\s*(\d+)", r"^[¶§]\s*(\d+)", r"^\s*(\d{1,2})\s+([QA])\s+(.*)$"
STAMPS = (r"INTEL_PROX_\d{5,11}", r"PROX_INTEL-\d{5,11}", r"[A-Z]{2,}[-_][A-Z]{2,}[-_]\d{5,}")
#: An alphabetical list of words begins with a letter: so many lines are looked at, so many must be words in order.
LIST_LINES, LIST_WORDS = 10, 5
PREFIX, SHORT_PREFIX, NOTE_HEAD = 50, 20, 30


def clean(docs: DataFrame) -> DataFrame:
    """doc_id, md of docs (doc_id, md) without word lists, contents, repeated blank lines and ruled lines.

    What follows a word list is gone to the end of the text; contents end at testimony, a numbered
    paragraph or a claim. Where a line stands decides, so it is windows over a document's lines.
    """
    listed = docs.select("doc_id", F.split("md", "\n", -1).alias("lines"))
    words = F.transform(F.slice("lines", F.col("pos") + 1, LIST_LINES), T.strip)
    rows = listed.select("doc_id", F.size("lines").alias("n"), "lines", F.posexplode("lines").alias("pos", "line"))
    run = F.coalesce(F.array_position(F.transform(words, lambda w: w.rlike("^[A-Za-z]+$")), F.lit(False)).cast("int"), F.lit(0))
    leading = F.transform(F.when(run > 0, F.slice(words, 1, run - 1)).otherwise(words), F.lower)
    listing = F.when(F.col("line").rlike(r"^[A-Z]\s*$") & (F.col("pos") + LIST_LINES < F.col("n")), (F.size(leading) >= LIST_WORDS) & (leading == F.array_sort(leading)))
    rows = rows.select("doc_id", "pos", "line", F.coalesce(listing, F.lit(False)).alias("listing"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("line").rlike(CONTENTS), True).when(F.col("line").rlike(AFTER_CONTENTS), False)
    rows = rows.withColumn("contents", F.coalesce(F.last(turn, ignorenulls=True).over(upto), F.lit(False)))
    rows = rows.withColumn("blank", T.strip(F.col("line")) == "").withColumn("stays", ~F.col("contents") & ~F.col("line").rlike(RULE))
    before = F.last(F.when(F.col("stays"), F.col("blank")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("kept", F.col("stays") & ~(F.col("blank") & F.coalesce(before, F.lit(True))))
    some = F.coalesce(F.max("kept").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("ends", F.col("listing") & some).withColumn("over", F.max("ends").over(upto))
    left = rows.filter("kept AND NOT over").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("line", WIDE, "  ").alias("line")))).alias("l"))
    return docs.select("doc_id").join(left.select("doc_id", F.array_join("l.line", "\n").alias("md")), "doc_id", "left").select("doc_id", F.coalesce("md", F.lit("")).alias("md"))


def footnotes(elements: DataFrame) -> DataFrame:
    """doc_id, ord, number, content of footnote elements that begin with their number."""
    text, form = T.strip(F.col("text")), r"(?s)^(\d+)\s+(.+)$"
    notes = elements.filter("label = 'footnote'").select("doc_id", "ord", F.regexp_extract(text, form, 1).alias("number"), T.strip(F.regexp_extract(text, form, 2)).alias("content"))
    return notes.filter("number <> ''")


def text_elements(elements: DataFrame) -> DataFrame:
    """doc_id, ord, text_id, text of the elements that a text's lines can be of: those with text that are no footnote."""
    named = F.regexp_extract(F.coalesce("self_ref", F.lit("")), r"/texts/(\d+)", 1)
    rows = elements.filter("coalesce(label, '') <> 'footnote'").withColumn("text", T.strip(F.col("text"))).filter("text <> ''")
    return rows.select("doc_id", "ord", F.coalesce(F.nullif(named, F.lit("")), F.col("ord").cast("string")).alias("text_id"), "text")


def mark_elements(lines: list[str], elements: list[tuple[str, str]]) -> list[str]:
    """lines with '[TEXT:n]' before each that holds the beginning of an element: of those left, the first in order.

    An element's first SHORT_PREFIX letters decide. Elements wait under these, and a line's own pieces
    of the lengths that occur are looked up, so the cost is by the line's length, not by elements.
    """
    waiting: dict[str, list[int]] = defaultdict(list)
    for i in range(len(elements) - 1, -1, -1):
        prefix = elements[i][1][:PREFIX].strip()[:SHORT_PREFIX]
        if prefix:
            waiting[prefix].append(i)
    lengths = sorted({len(p) for p in waiting})
    out = []
    for line in lines:
        flat = line.strip()
        if flat and not flat.startswith("#"):
            seen = {flat[a : a + n] for n in lengths for a in range(len(flat) - n + 1)}
            found = min((waiting[p][-1] for p in seen if waiting.get(p)), default=None)
            if found is not None:
                out.append(f"[TEXT:{elements[found][0]}]")
                waiting[elements[found][1][:PREFIX].strip()[:SHORT_PREFIX]].pop()
        out.append(line)
    return out


_NUMBERED, _CAPITALS, _RULED = re.compile(r"^(\d+)\s+"), re.compile(r"^[A-Z_]+"), re.compile(r"^[\|\-\s]+$")


def inline_footnotes(lines: list[str], notes: dict[str, str]) -> list[str]:
    """lines with footnotes (number, content) moved behind the last text before them, as '[FOOTNOTE n: ...]'.

    A line is a footnote if its number is one's and what follows looks like a reference.
    """
    out: list[str] = []
    held: list[str] = []
    for line in lines:
        flat = line.strip()
        m = _NUMBERED.match(flat)
        if m and m[1] in notes:
            rest = flat[m.end():].strip()
            if rest.startswith(("Id", "See")) or _CAPITALS.match(rest) or "at" in rest[:NOTE_HEAD]:
                held.append(f"[FOOTNOTE {m[1]}: {notes[m[1]]}]")
                continue
        if held and out and flat and not flat.startswith("#") and not _RULED.match(flat):
            at = len(out)
            while at and not out[at - 1].strip():
                at -= 1
            out[at:at] = held
            held = []
        out.append(line)
    return out + held


def _by_document(docs: DataFrame, more: DataFrame, fields: list[str], change: Callable[[list[str], list[dict]], list[str]]) -> DataFrame:
    """doc_id, md with the lines of each text changed by what more (doc_id, ord, fields) has for it; others stay as they are."""
    listed = more.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for md, rows in zip(batch.column("md"), batch.column("more"), strict=True):
                md, rows = md.as_py(), rows.as_py()
                texts.append(md if md is None or not rows else "\n".join(change(md.split("\n"), rows)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "md"])

    workers.ship(docs.sparkSession)
    return docs.select("doc_id", "md").join(listed, "doc_id", "left").mapInArrow(run, "doc_id long, md string")


def insert_text_marks(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, md with a mark before each line of an element; a document is one task's work, as what is used up decides."""
    return _by_document(docs, text_elements(elements), ["text_id", "text"], lambda lines, rows: mark_elements(lines, [(r["text_id"], r["text"]) for r in rows]))


def insert_footnotes(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, md with footnotes inside the text; of several with one number the last counts."""
    return _by_document(docs, footnotes(elements), ["number", "content"], lambda lines, rows: inline_footnotes(lines, {r["number"]: r["content"] for r in rows}))


def _stamp(line: Column, stamps: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 0), F.lit("")) for p in stamps])


def mark_citations(docs: DataFrame, stamps: tuple[str, ...] = STAMPS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, md with marks of pages, stamps, lines, columns and paragraphs; their citations) of docs (doc_id, md, doc_type).

    A page and a stamp hold until the next one; a line that names a page names no stamp. Citations
    are of testimony lines and of paragraph signs, with the key line_{number of the line, from 0}.
    """
    rows = docs.select("doc_id", "doc_type", F.posexplode(F.split("md", "\n", -1)).alias("pos", "line"))
    group = lambda p, i=1: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    own_page = group(PAGE).try_cast("int")
    paged = F.col("line").rlike(PAGE)
    rows = rows.withColumn("own_page", own_page).withColumn("own_stamp", F.when(~paged, _stamp(F.col("line"), stamps)))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("page", F.last("own_page", ignorenulls=True).over(upto)).withColumn("bates", F.last("own_stamp", ignorenulls=True).over(upto))
    turn = F.when(~paged & F.col("doc_type").isin(*model.TRANSCRIPTS), group(TURN).cast("int"))
    sign = F.when(~paged & turn.isNull(), group(SIGN).try_cast("bigint"))
    column = F.when(~paged & F.col("doc_type").isin(*model.PATENTS), group(COLUMN))
    rows = rows.withColumns({"turn": turn, "sign": sign, "column_mark": column})
    said = F.concat(F.col("turn").cast("string"), F.lit("  "), F.regexp_extract("line", TURN, 2), F.lit("  "), F.regexp_extract("line", TURN, 3))
    mark = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"[{name}:"), value.cast("string"), F.lit("]")))
    out = F.array_compact(F.array(mark("PAGE", F.col("own_page")), mark("BATES", F.col("own_stamp")), mark("LINE", F.col("turn")), mark("COLUMN", F.col("column_mark")), mark("PARA", F.col("sign")), F.coalesce(said, "line")))
    marked = rows.withColumn("out", out).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("o")).select("doc_id", F.array_join(F.flatten("o.out"), "\n").alias("md"))
    cited = rows.filter("turn IS NOT NULL OR sign IS NOT NULL")
    have = {
        "doc_id": F.col("doc_id"), "ord": F.col("pos"), "ref": F.format_string("line_%d", "pos"), "page": F.col("page"), "line_start": F.col("turn"), "line_end": F.col("turn"), "bates": F.col("bates"),
        "paragraph_number": F.col("sign"), "type": F.when(F.col("turn").isNotNull(), "transcript_line").otherwise("paragraph"),
    }
    kinds = dict(c.split() for c in model.CITATIONS.split(", "))
    return marked, cited.select(*[have.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def process(docs: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, md, doc_type) cleaned, marked with elements, footnotes and citations; and those citations."""
    cleaned = insert_footnotes(insert_text_marks(clean(docs), elements), elements)
    return mark_citations(cleaned.join(docs.select("doc_id", "doc_type"), "doc_id"))


def found_citations(texts: DataFrame) -> DataFrame:
    """What a converted text (doc_id, md) says of its citations: pages, stamps, lines, columns, paragraphs, kind, and whether they must be rebuilt."""
    every = lambda p, i=1: F.regexp_extract_all("md", F.lit(p), F.lit(i))
    numbers = lambda p: F.transform(every(p), lambda x: x.try_cast("bigint"))
    stamps = F.array_distinct(F.flatten(F.array(*[every(p, 0) for p in STAMPS])))
    rows = texts.select(
        "doc_id", numbers(r"(?i)(?:Page|p\.)\s+(\d+)").alias("pages"), stamps.alias("bates_stamps"), numbers(r"(?m)^\s*(\d{1,2})\s+[QA]\s").alias("line_markers"),
        numbers(r"(?i)col(?:umn)?\.?\s*(\d+)").alias("column_markers"), numbers(r"[¶§]\s*(\d+)").alias("paragraph_numbers"),
    )
    has = lambda c: F.size(c) > 0
    kind = F.when(has("line_markers"), "deposition").when(has("column_markers"), "patent").when(has("paragraph_numbers"), "expert_report").otherwise("unknown")
    typed = F.when(F.col("doc_type") == "deposition", has("line_markers")).when(F.col("doc_type") == "patent", has("column_markers")).when(F.col("doc_type") == "expert_report", has("paragraph_numbers")).otherwise(True)
    return rows.withColumn("doc_type", kind).withColumn("needs_reconstruction", ~has("pages") | ~typed)
