"""Chunks with citations: marked text and its citations to cited pieces of about a budget of tokens.

Texts are marked: a line '[TEXT:n]' says that the lines after it are of element n, whose citation has
the reference '#/texts/n'. Lines, their elements and citations are joined once and kept as one array a
document; only line lengths and kinds go to Python, where a budget is counted; all else is arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import model, workers
from docketry.functions import text as T
from docketry.operators import cite

TARGET_TOKENS, MOST_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 800, 1200, 100, 4
OVERLAP_LINES, OVERLAP_TURNS = 5, 3
CONTINUED = "  (cont’d)"
#: Openings of a paragraph, and where a response to a request begins; fixed patterns.
PARAGRAPH = r"^(?:¶\s*\d+|§\s*\d+|Paragraph\s+\d+|\d+\.\s+[A-Z])"
RESPONSE = r"(?i)^\s*(?:#+\s*)?(?:\*+\s*)?(?:RESPONSE\s+TO|SUPPLEMENTAL\s+RESPONSE\s+TO|FURTHER\s+RESPONSE\s+TO)\b"
#: A file name that begins with a range of stamps; fixed pattern.
STAMP_RANGE = r"^([A-Za-z]{2,10})[ _-]?(\d{5,10})\s*[-_– ]\s*(?:[A-Za-z]{2,10}[ _-]?)?(\d{5,10})(?!\d)"
BLANK, OPENS = 1, 2

_DETAILS = ("page", "bates", "line_start", "line_end", "transcript_page", "paragraph_number", "column")
_PIECE = (
    "text_lines array<string>, page_map array<int>, bates_map array<string>, pages array<int>, stamps array<string>, ranges array<struct<page:int,first:int,last:int>>, "
    "transcript_pages array<int>, paragraphs array<bigint>, columns array<int>, request_kind string, request_number bigint, part int, part_total int"
)


def derive_stamps(citations: DataFrame, names: DataFrame) -> DataFrame:
    """citations with a stamp for each page, from a file name (doc_id, file_name) that begins with their range.

    Only where no citation of the document has a stamp and the range has as many stamps as the last
    page. The prefix is written in capitals, numbers as wide as the first.
    """
    base = F.regexp_extract("file_name", r"([^/]*)$", 1)
    parts = names.select("doc_id", *[F.regexp_extract(base, STAMP_RANGE, i).alias(c) for i, c in ((1, "prefix"), (2, "first"), (3, "last"))]).filter("prefix <> ''")
    totals = citations.groupBy("doc_id").agg(F.max("page").alias("pages"), F.bool_or(F.coalesce("bates", F.lit("")) != "").alias("stamped")).filter("NOT stamped AND pages >= 1")
    fits = parts.join(totals, "doc_id").filter(F.col("last").cast("bigint") - F.col("first").cast("bigint") + 1 == F.col("pages")).select("doc_id", "prefix", "first")
    stamp = F.concat(F.upper("prefix"), T.pad_number(F.col("first").cast("bigint") + F.col("page") - 1, F.length("first")))
    return citations.join(fits, "doc_id", "left").withColumn("bates", F.coalesce(F.when(F.col("page").isNotNull(), stamp), "bates")).drop("prefix", "first")


def marked_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, text_id: lines of docs (doc_id, md) without element marks, and the element each is of."""
    rows = docs.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("pos", "line"))
    mark = F.nullif(F.regexp_extract("line", r"^\[TEXT:(\d+)\]", 1), F.lit(""))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("text_id", F.last(mark, ignorenulls=True).over(so_far)).filter(~F.startswith("line", F.lit("[TEXT:")))


def cited_lines(docs: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, entries: an array of a document's lines, each with its element's citation.

    known_page and known_bates are the last ones so far, page_at and bates_at the lines they are of:
    what a chunk that begins later must not take over is told by that.
    """
    cited = citations.filter(F.startswith("ref", F.lit("#/texts/"))).select("doc_id", F.substring("ref", 9, 99).alias("text_id"), *_DETAILS)
    rows = marked_lines(docs).join(cited, ["doc_id", "text_id"], "left")
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("i", F.row_number().over(w) - 1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    for c in ("page", "bates"):
        rows = rows.withColumn(f"known_{c}", F.last(c, ignorenulls=True).over(upto)).withColumn(f"{c}_at", F.last(F.when(F.col(c).isNotNull(), F.col("i")), ignorenulls=True).over(upto))
    entry = F.struct("i", "line", "text_id", *_DETAILS, "known_page", "page_at", "known_bates", "bates_at")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


# Budgets. Cuts are (first, end, whether the heading is repeated, group heading, part, parts) of a document's lines.


def generic_cuts(lengths: list[int], target: int) -> list[tuple]:
    """A chunk is closed when its joined lines reach the target; the next begins with its last lines, if it had more."""
    out, first, size = [], 0, -1
    for i, n in enumerate(lengths):
        size += 1 + n
        if size // CHARS_PER_TOKEN >= target:
            out.append((first, i + 1))
            first, size = (i + 1 - OVERLAP_LINES, sum(lengths[i + 1 - OVERLAP_LINES : i + 1]) + OVERLAP_LINES - 1) if i + 1 - first > OVERLAP_LINES else (i + 1, -1)
    return [*out, (first, len(lengths))] if first < len(lengths) else out


def paragraph_cuts(lengths: list[int], kinds: list[int], target: int, most: int) -> list[tuple]:
    """A chunk ends before a paragraph once it has reached the target, and before any line with text at most."""
    out, first, size = [], 0, -1
    for i, (n, kind) in enumerate(zip(lengths, kinds, strict=True)):
        tokens = max(size, 0) // CHARS_PER_TOKEN
        if i > first and not kind & BLANK and (tokens >= most or (kind & OPENS and tokens >= target)):
            out.append((first, i))
            first, size = i, -1
        size += 1 + n
    return [*out, (first, len(lengths))] if first < len(lengths) else out


def request_cuts(lengths: list[int], kinds: list[int], target: int, most: int, overlap: int) -> list[tuple]:
    """One chunk for each request with its responses; what stands before the first is one too, unless it is blank.

    A larger one is cut at the target; its later parts repeat the heading and about ``overlap`` tokens.
    """
    heads = [i for i, kind in enumerate(kinds) if kind & OPENS]
    out = []
    for head, a, b in zip([-1, *heads], [0, *heads], [*heads, len(lengths)], strict=True):
        if a == b or (head < 0 and all(k & BLANK for k in kinds[a:b])):
            continue
        if (sum(lengths[a:b]) + b - a - 1) // CHARS_PER_TOKEN <= most:
            out.append((a, b, False, head, None, None))
            continue
        parts, first, size, repeated = [], a, 0, False
        heading = lengths[head] + len(CONTINUED) + 1 if head >= 0 else 0
        for i in range(a, b):
            size += lengths[i] + 1
            if size >= target * CHARS_PER_TOKEN:
                parts.append((first, i + 1, repeated))
                first, tail = i + 1, 0
                while first > parts[-1][0] and tail < overlap * CHARS_PER_TOKEN:
                    first -= 1
                    tail += lengths[first] + 1
                size, repeated = heading + tail, head >= 0
        if any(j != head for j in range(first, b)) or not parts:
            parts.append((first, b, repeated))
        out += [(x, y, again, head, n, len(parts)) for n, (x, y, again) in enumerate(parts, 1)]
    return out


def cuts(target: int, most: int, overlap: int) -> Column:
    """A column function of (family, lengths, kinds): the cuts of each document. Only numbers go to Python."""
    workers.ship()

    @F.pandas_udf("array<struct<a:int,b:int,repeated:boolean,head:int,part:int,part_total:int>>")
    def run(family: pd.Series, lengths: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for name, n, kind in zip(family, lengths, kinds, strict=True):
            n, kind = n.tolist(), kind.tolist()
            if name == "discovery":
                found = request_cuts(n, kind, target, most, overlap)
            else:
                found = [(a, b, False, -1, None, None) for a, b in (paragraph_cuts(n, kind, target, most) if name == "paragraph" else generic_cuts(n, target))]
            out.append([dict(zip(("a", "b", "repeated", "head", "part", "part_total"), x, strict=True)) for x in found])
        return pd.Series(out)

    return run


def _pieces(rows: DataFrame, target: int, most: int, overlap: int) -> DataFrame:
    """Chunks of documents (doc_id, stem, doc_type, family, source_path, entries) before they are written out."""
    line = lambda e: e["line"]
    stripped = lambda e: T.strip(e["line"])
    request = lambda e: stripped(e).rlike(cite.REQUEST) & ~stripped(e).rlike(RESPONSE)
    opens = lambda e: F.when(F.col("family") == "discovery", request(e)).otherwise(e["line"].rlike(PARAGRAPH))
    kinds = F.transform("entries", lambda e: F.when(stripped(e) == "", BLANK).when(opens(e), OPENS).otherwise(0))
    found = rows.withColumn("cuts", cuts(target, most, overlap)(F.col("family"), F.transform("entries", lambda e: F.length(line(e))), kinds))
    # lines are dealt to chunks before these become rows: no row holds a whole document beside its chunk
    dealt = F.transform("cuts", lambda c: F.struct(c.alias("cut"), F.slice(F.col("entries"), c["a"] + 1, c["b"] - c["a"]).alias("own"), F.get(F.col("entries"), c["head"])["line"].alias("heading")))
    cut = found.select("doc_id", "stem", "doc_type", "family", "source_path", F.posexplode(dealt).alias("chunk_idx", "x")).select("*", "x.*")
    a, repeated, heading = F.col("cut.a"), F.col("cut.repeated"), F.col("heading")
    lead = lambda value, kind: F.when(repeated, F.array(value.cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
    pages = F.concat(lead(F.lit(None), "int"), F.transform("own", lambda e: F.when(e["page_at"] >= a, e["known_page"]).cast("int")))
    stamps = F.concat(lead(F.lit(None), "string"), F.transform("own", lambda e: F.when(e["bates_at"] >= a, e["known_bates"])))
    texts = F.concat(lead(F.concat(heading, F.lit(CONTINUED)), "string"), F.transform("own", line))
    some = lambda c: F.array_distinct(F.filter(F.transform("own", lambda e: e[c]), lambda x: F.coalesce(x.cast("string"), F.lit("")).isin("", "0") == F.lit(False)))
    timed = F.filter("own", lambda e: (F.coalesce(e["transcript_page"], F.lit(0)) != 0) & (F.coalesce(e["line_start"], F.lit(0)) != 0))
    end = lambda e: F.coalesce(F.nullif(e["line_end"], F.lit(0)), e["line_start"])
    ranges = F.transform(F.array_distinct(F.transform(timed, lambda e: e["transcript_page"])), lambda p: F.struct(
        p.alias("page"), F.array_min(F.transform(F.filter(timed, lambda e: e["transcript_page"] == p), lambda e: e["line_start"])).alias("first"),
        F.array_max(F.transform(F.filter(timed, lambda e: e["transcript_page"] == p), end)).alias("last"),
    ))
    made = {
        "text_lines": texts, "page_map": pages, "bates_map": stamps, "pages": some("page"), "stamps": some("bates"), "ranges": ranges, "transcript_pages": some("transcript_page"),
        "paragraphs": some("paragraph_number"), "columns": some("column"), "request_kind": F.when(heading.isNotNull(), T.request_kind(F.regexp_extract(T.strip(heading), cite.REQUEST, 1))),
        "request_number": cite.number(T.strip(heading), cite.REQUEST, 2), "part": F.col("cut.part"), "part_total": F.col("cut.part_total"),
    }
    types = dict(c.strip().split(" ") for c in _PIECE.split(", "))
    return cut.select("doc_id", "stem", "doc_type", "family", "source_path", "chunk_idx", *[c.cast(types[n]).alias(n) for n, c in made.items()])


# Transcripts. Which page a line is on depends on where the last chunk ended, so a document is one fold.

_RULE, _PAGE = re.compile(r"^\s*\|[\s\-]+\|"), re.compile(r"^\[PAGE:(\d+)\]")
_TURN, _CELL = re.compile(r"^\s*(\d{1,2})\s+([QA])\.?\s+(.+)$"), re.compile(r"\|\s*([QA])\.?\s+(.+?)\s*\|")
_CLOCK, _DASHES = re.compile(r"^\d{2}:\d{2}:\d{2}"), re.compile(r"^-+$")


class Finder:
    """Citations of one transcript by reference, by key, and by page and line; of several the first."""

    def __init__(self, citations: list[dict]) -> None:
        self.by_ref, self.by_place = {}, {}
        for c in citations:  # in their order
            self.by_ref[c["ref"]] = c
            if c["line_start"] is not None:
                self.by_place.setdefault((c["transcript_page"], c["line_start"]), c)
                if c["type"] == "transcript_line":
                    self.by_place.setdefault((c["page"], c["line_start"]), c)

    def element(self, text_id: str | None) -> dict | None:
        return self.by_ref.get(f"#/texts/{text_id}") if text_id is not None else None

    def line(self, page: int, line: int) -> dict | None:
        return self.by_ref.get(f"line_P{page}_L{line}") or self.by_place.get((page, line))


class _Piece:
    def __init__(self) -> None:
        self.lines: list[str] = []
        self.size = -1
        self.places: list[tuple[int | None, str | None]] = []
        self.pages: dict[int, None] = {}
        self.stamps: dict[str, None] = {}
        self.ranges: dict[int, tuple[int, int]] = {}
        self.transcript_pages: dict[int, None] = {}

    def add(self, line: str, place: tuple[int | None, str | None]) -> None:
        self.lines.append(line)
        self.places.append(place)
        self.size += 1 + len(line)

    def row(self) -> dict:
        return {
            "text_lines": self.lines, "page_map": [p for p, _ in self.places], "bates_map": [b for _, b in self.places], "pages": list(self.pages), "stamps": list(self.stamps),
            "ranges": [{"page": p, "first": a, "last": b} for p, (a, b) in self.ranges.items()], "transcript_pages": list(self.transcript_pages),
        }


def turn_of(line: str, text_id: str | None, finder: Finder) -> tuple[int, str, str] | None:
    """(line number, Q or A, text) of a line of testimony, from its margin or, in a table, from its citation."""
    m = _TURN.match(line)
    if m:
        return int(m[1]), m[2], m[3]
    cell, cited = _CELL.search(line), finder.element(text_id)
    return (cited["line_start"], cell[1], cell[2]) if cell and cited and cited["line_start"] else None


def transcript_pieces(entries: list[tuple[str, str | None]], citations: list[dict], target: int) -> Iterator[dict]:
    """Chunks of testimony: closed after an answer that reaches the target, so never between a question and its answer.

    The next one begins with the last OVERLAP_TURNS lines, their pages and stamps, and the line ranges
    that the closed one had on those pages.
    """
    finder, piece = Finder(citations), _Piece()
    for line, text_id in entries:
        if _RULE.match(line):
            continue
        if line.startswith("[PAGE:"):
            m = _PAGE.match(line)
            if m:
                piece.transcript_pages.setdefault(int(m[1]))
            continue
        cells = [p for p in (x.strip() for x in line.split("|")) if p and not _CLOCK.match(p)] if "|" in line else None
        turn = turn_of(line, text_id, finder)
        if not turn:
            if cells is not None:
                cells = [c for c in cells if not _DASHES.match(c)]
                if not cells:
                    continue
                line = " ".join(cells)
            piece.add(line, piece.places[-1] if piece.places else (None, None))
            continue
        number, mark, text = turn
        page = next(reversed(piece.transcript_pages), 1)
        place = page, None
        cited = finder.element(text_id) or finder.line(page, number)
        if cited:
            place = (cited["page"] if cited["page"] is not None else page), cited["bates"]
            piece.pages.setdefault(place[0])
            a, b = piece.ranges.get(place[0], (number, number))
            piece.ranges[place[0]] = min(a, number), max(b, number)
            if place[1]:
                piece.stamps.setdefault(place[1])
        piece.add(f"{number} {mark} {text}" if cells else line, place)
        if mark == "A" and piece.size // CHARS_PER_TOKEN >= target:
            yield piece.row()
            done, piece = piece, _Piece()
            for old, at in list(zip(done.lines, done.places, strict=True))[-OVERLAP_TURNS:]:
                piece.add(old, at)
            pages = sorted({p for p, _ in piece.places if p})
            piece.pages, piece.transcript_pages = dict.fromkeys(pages), dict.fromkeys(pages)
            piece.stamps = dict.fromkeys(b for _, b in piece.places if b)
            piece.ranges = {p: r for p, r in done.ranges.items() if p in pages}
    if piece.lines:
        yield piece.row()


def _transcripts(rows: DataFrame, docs: DataFrame, citations: DataFrame, target: int) -> DataFrame:
    listed = marked_lines(docs.join(rows.select("doc_id"), "doc_id", "left_semi")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "text_id"))).alias("entries"))
    fields = ["ref", "page", "line_start", "bates", "transcript_page", "type"]
    cited = citations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("citations"))
    schema = f"doc_id long, stem string, doc_type string, family string, source_path string, chunk_idx int, {_PIECE}"
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = transcript_pieces([(e["line"], e["text_id"]) for e in row["entries"]], row["citations"], target)
                made = [{n: row.get(n) for n in names[:5]} | {"chunk_idx": i} | piece for i, piece in enumerate(found)]
                if made:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in made], schema=arrow)

    joined = rows.join(listed, "doc_id").join(cited, "doc_id").select("doc_id", "stem", "doc_type", "family", "source_path", "entries", "citations")
    from pyspark.sql.pandas.types import to_arrow_schema

    workers.ship(rows.sparkSession)
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return joined.mapInArrow(run, schema)


def page_spans(page_map: Column) -> Column:
    """Runs of one page as structs of page, line_start and line_end; lines without a page part runs."""
    begins = lambda p, i: p.isNotNull() & ~p.eqNullSafe(F.get(page_map, i - 1))
    ends = lambda p, i: p.isNotNull() & ~p.eqNullSafe(F.get(page_map, i + 1))
    at = lambda which: F.filter(F.transform(page_map, lambda p, i: F.when(which(p, i), F.struct(p.alias("page"), (i + 1).alias("line")))), lambda x: x.isNotNull())
    return F.zip_with(at(begins), at(ends), lambda x, y: F.struct(x["page"].cast("int").alias("page"), x["line"].cast("int").alias("line_start"), y["line"].cast("int").alias("line_end")))


def with_page_marks(rows: DataFrame) -> DataFrame:
    """A '[PAGE:n]' or '[PAGE:n | stamp]' line before each line whose page is not that of the line before; maps grow with it.

    Lines and maps that are not equally long are left as they are.
    """
    fits = F.size("text_lines") == F.size("page_map")
    page = lambda i: F.get("page_map", i)
    stamp = lambda i: F.get("bates_map", i)
    # Maps are carried forward, so an unknown page stands only before the first known one.
    turned = lambda p, i: p.isNotNull() & ~p.eqNullSafe(page(i - 1))
    mark = lambda p, i: F.when(F.coalesce(stamp(i), F.lit("")) != "", F.format_string("[PAGE:%d | %s]", p, stamp(i))).otherwise(F.format_string("[PAGE:%d]", p))
    twice = lambda first, second: F.flatten(F.transform("page_map", lambda p, i: F.when(turned(p, i), F.array(first(p, i), second(i))).otherwise(F.array(second(i)))))
    grown = {"text_lines": twice(mark, lambda i: F.get("text_lines", i)), "page_map": twice(lambda p, i: p, page), "bates_map": twice(lambda p, i: stamp(i), stamp)}
    return rows.withColumns({n: F.when(fits & (F.col("family") != "transcript"), c).otherwise(F.col(n)) for n, c in grown.items()})


def title(stem: Column) -> Column:
    """Words of a stem with capitals: every letter that does not follow a letter."""
    letters = F.split(F.lower(F.translate(stem, "_", " ")), "")
    return F.array_join(F.transform(letters, lambda c, i: F.when(~F.coalesce(F.get(letters, i - 1), F.lit(" ")).rlike(r"^\p{L}"), F.upper(c)).otherwise(c)), "")


def citation_string() -> Column:
    """How a chunk is cited: page and lines, paragraphs, request, or stamps and else pages."""
    name = title(F.col("stem"))
    spans = F.transform(F.array_sort("ranges"), lambda r: F.concat(r["page"].cast("string"), F.lit(":"), r["first"].cast("string"), F.when(r["first"] != r["last"], F.concat(F.lit("-"), r["last"].cast("string"))).otherwise("")))
    transcript = F.concat_ws(" ", name, F.lit("Dep."), F.when(F.size("ranges") > 0, F.array_join(spans, ", ")))
    low, high = F.array_min("paragraphs"), F.array_max("paragraphs")
    paragraph = F.concat_ws(" ", name, F.when(F.size("paragraphs") == 1, F.concat(F.lit("¶"), low.cast("string"))).when(F.size("paragraphs") > 1, F.concat(F.lit("¶¶"), low.cast("string"), F.lit("-"), high.cast("string"))))
    pages = T.page_ranges(F.col("pages"))
    kind = F.when(F.col("request_kind") == "rog", "ROG").when(F.col("request_kind") == "rfp", "RFP").when(F.col("request_kind") == "rfa", "RFA").otherwise("Req.")
    part = F.when(F.col("part_total") > 1, F.format_string(" (Pt. %d/%d)", "part", "part_total")).otherwise("")
    request = F.when(F.col("request_number").isNotNull(), F.concat(name, F.lit(" "), kind, F.format_string(" No. %d", "request_number"), part)).otherwise(F.concat_ws(", ", F.concat(name, F.lit(" (preamble)")), F.nullif(pages, F.lit(""))))
    first, last = F.array_min("stamps"), F.array_max("stamps")
    stamped = F.concat(name, F.lit(" at "), first, F.when(first != last, F.concat(F.lit("-"), last)).otherwise(""))
    generic = F.when(F.size("stamps") > 0, stamped).otherwise(F.concat_ws(", ", name, F.nullif(pages, F.lit(""))))
    return F.when(F.col("family") == "transcript", transcript).when(F.col("family") == "paragraph", paragraph).when(F.col("family") == "discovery", request).otherwise(generic)


def _written(pieces: DataFrame) -> DataFrame:
    """Pieces as chunk rows: marks, sets of pages and stamps that agree with the maps, the citation, its string."""
    sorted_set = lambda c: F.array_sort(F.array_distinct(c))
    marked = with_page_marks(pieces)
    mapped = F.filter("page_map", lambda p: p.isNotNull())
    stamped = F.array_distinct(F.filter("bates_map", lambda b: F.coalesce(b, F.lit("")) != ""))
    agreed = marked.withColumns({"pages": sorted_set(F.when(F.size(mapped) > 0, mapped).otherwise(F.col("pages"))), "stamps": F.when(F.size(stamped) > 0, stamped).otherwise(F.col("stamps"))})
    spans = page_spans(F.col("page_map"))
    lines = F.map_from_entries(F.transform("ranges", lambda r: F.struct(r["page"].cast("string"), F.array(r["first"], r["last"]))))
    timed = F.size("ranges") > 0
    citation = F.struct(
        F.col("pages").alias("pdf_pages"), F.col("stamps").alias("bates_range"), F.when(F.size("page_map") > 0, F.col("page_map")).alias("page_map"), F.when(F.size(spans) > 0, spans).alias("page_spans"),
        F.when(F.exists("bates_map", lambda b: b.isNotNull()), F.col("bates_map")).alias("bates_map"), F.when(timed, lines).alias("transcript_lines"),
        F.when(timed, sorted_set(F.col("transcript_pages"))).alias("transcript_pages"), F.when(F.size("paragraphs") > 0, sorted_set(F.col("paragraphs"))).alias("paragraph_numbers"),
        F.when(F.size("columns") > 0, F.struct(sorted_set(F.col("columns")).alias("columns"))).alias("column_lines"),
        F.col("request_kind").alias("discovery_request_kind"), F.col("request_number").alias("discovery_request_number"), F.col("part").alias("discovery_part"), F.col("part_total").alias("discovery_part_total"),
    )
    text = F.array_join("text_lines", "\n")
    kind = F.when(F.col("family") == "transcript", "deposition").when(F.col("family") == "paragraph", "expert_report").when(F.col("family") == "discovery", F.col("doc_type")).otherwise("unknown")
    have = {
        "doc_id": F.col("doc_id"), "stem": F.col("stem"), "chunk_idx": F.col("chunk_idx"), "chunk_id": F.concat(F.col("stem"), F.lit("_chunk_"), T.pad_number(F.col("chunk_idx"), F.lit(4))), "core_text": text,
        "pages": F.col("pages"), "citation": citation, "citation_string": citation_string(), "key_quotes": F.array(), "tokens": F.floor(F.length(text) / CHARS_PER_TOKEN), "doc_type": kind,
        "source_path": F.nullif("source_path", F.lit("")),
    }
    schema = pieces.sparkSession.createDataFrame([], model.CHUNKS).schema
    return agreed.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def chunk(docs: DataFrame, citations: DataFrame, target: int = TARGET_TOKENS, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks (model.CHUNKS) of documents (doc_id, stem, md, doc_type, file_name, source_path) by the family of their type.

    A document without a citation or without text has no chunks; one without a type, or of type
    unknown, is of the type that its citations tell. Stamps are derived from file names where none is known.
    """
    cited = derive_stamps(citations, docs.select("doc_id", F.coalesce(F.nullif("file_name", F.lit("")), "stem").alias("file_name")))
    told = cite.infer_type(citations).withColumnRenamed("doc_type", "told")
    rows = docs.filter("coalesce(md, '') <> ''").join(told, "doc_id").withColumn("doc_type", F.coalesce(F.nullif("doc_type", F.lit("unknown")), "told")).drop("told")
    family = F.lit("generic")
    for name, types in model.FAMILIES.items():
        family = F.when(F.col("doc_type").isin(*types), name).otherwise(family)
    rows = rows.withColumn("family", family)
    kept = rows.select("doc_id", "stem", "doc_type", "family", "source_path")
    others = kept.filter("family <> 'transcript'")
    entries = cited_lines(rows.filter("family <> 'transcript'").select("doc_id", "md"), cited)
    pieces = _pieces(others.join(entries, "doc_id"), target, most, overlap)
    testimony = _transcripts(kept.filter("family = 'transcript'"), rows.select("doc_id", "md"), cited, target)
    return _written(pieces.unionByName(testimony))
