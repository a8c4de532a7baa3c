"""Files below a folder, and connectors that turn them into text."""

from __future__ import annotations

import email
from collections.abc import Callable, Iterator
from email import policy

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry import workers
from docketry.functions import text as T

#: Extensions that a run takes up; fixed values.
INPUTS = ("pdf", "txt", "docx")
#: The parser of each extension; any other goes to the fallback.
PARSERS = {"xlsx": "sheets", "xls": "sheets", "eml": "mail", "msg": "mail", "pptx": "slides", "ppt": "slides", "txt": "plain", "md": "plain"}
TEXT_FORMATS = ("plain", "mail")


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = INPUTS, content: bool = True) -> DataFrame:
    """path, name, stem, ext, length, modified, content_hash and content of files below root, by path.

    A folder without such files is an error for who asked: FileNotFoundError.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no folder {root}") from e
        raise
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    rows = files.select(plain_path(F.col("path")).alias("path"), name.alias("name"), T.normalize_stem(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"), ext.alias("ext"), "length", F.col("modificationTime").alias("modified"), "content")
    rows = rows.filter(F.col("ext").isin(*extensions))
    if not rows.select("path").take(1):
        raise FileNotFoundError(f"no {', '.join(extensions)} below {root}")
    rows = rows.withColumn("content_hash", F.sha2("content", 256))
    return rows if content else rows.drop("content")


def plain_path(path: Column) -> Column:
    """A local path without its scheme; others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def by_stem(files: DataFrame) -> DataFrame:
    """One file for each stem: of several the last by path."""
    last = F.row_number().over(Window.partitionBy("stem").orderBy(F.col("path").desc()))
    return files.withColumn("_n", last).filter("_n = 1").drop("_n")


def parser_of(ext: Column) -> Column:
    chosen = F.lit("fallback")
    for e, p in PARSERS.items():
        chosen = F.when(F.lower(ext) == e, p).otherwise(chosen)
    return chosen


def parse_mail(raw: bytes) -> str:
    """A message as text: heading lines, the plain body before the HTML one, names of what is attached."""
    message = email.message_from_bytes(raw, policy=policy.default)
    subject = message.get("Subject", "(No Subject)")
    lines = [f"# Email: {subject}\n", *(f"**{h}:** {message.get(h, 'Unknown')}" for h in ("From", "To", "Date")), f"**Subject:** {subject}", "\n---\n"]
    body = message.get_body(preferencelist=("plain", "html"))
    if body:
        lines.append(body.get_content())
    attached = [part.get_filename() for part in message.iter_attachments() if part.get_filename()]
    if attached:
        lines += ["\n**Attachments:**", *(f"- {name}" for name in attached)]
    return "\n".join(lines)


def sheet_text(stem: str, sheets: list[tuple[str, list[list]]]) -> str:
    """Sheets (name, rows) as text: a heading for each, a line for each row that is not empty."""
    lines = [f"# {stem}\n"]
    for name, rows in sheets:
        lines.append(f"\n## Sheet: {name}\n")
        lines += ["| " + " | ".join("" if c is None else str(c) for c in row) + " |" for row in rows if any(c is not None for c in row)]
    return "\n".join(lines)


def slide_text(stem: str, slides: list[list[str]]) -> str:
    """Slides (texts of their shapes) as text, a heading for each."""
    lines = [f"# {stem}\n"]
    for n, texts in enumerate(slides, 1):
        lines += [f"\n## Slide {n}\n", *[t for t in texts if t]]
    return "\n".join(lines)


#: A connector takes a file's name and bytes and gives its text; what it raises is told in the row.
Connector = Callable[[str, bytes], str]
_CONVERTED = "path string, md string, parser string, doc_type string, needs_reconstruction boolean, error string"


def convert(files: DataFrame, connectors: dict[str, Connector] | None = None) -> DataFrame:
    """path, md, parser, doc_type, needs_reconstruction, error of files (path, name, ext, content) by their formats.

    Text and mail are read here. connectors has those of other parsers: sheets, slides, fallback; a
    file without one, or that fails, has an error instead of a text.
    """
    known: dict[str, Connector] = {"plain": lambda name, raw: raw.decode("utf-8"), "mail": lambda name, raw: parse_mail(raw)} | (connectors or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CONVERTED.split(", ")]
        types = [pa.string()] * 4 + [pa.bool_(), pa.string()]
        for batch in batches:
            rows = []
            for path, name, parser, content in zip(*(batch.column(c) for c in ("path", "name", "parser", "content")), strict=True):
                parser, md, error = parser.as_py(), None, None
                if parser == "mail" and name.as_py().lower().endswith(".msg") and parser not in (connectors or {}):
                    error = "no connector for msg files"
                elif parser not in known:
                    error = f"no connector for {parser}"
                else:
                    try:
                        md = known[parser](name.as_py(), content.as_py())
                    except Exception as e:  # noqa: BLE001 - a connector may raise anything; the row says what
                        error = f"{type(e).__name__}: {e}"
                kind = "unknown" if parser in ("plain", "fallback") or md is None else "exhibit"
                rows.append((path.as_py(), md, parser, kind, md is None or parser == "fallback", error))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    workers.ship(files.sparkSession)
    return files.select("path", "name", parser_of(F.col("ext")).alias("parser"), "content").mapInArrow(run, _CONVERTED)


def recognised(images: DataFrame, known: DataFrame, recognise: Connector) -> DataFrame:
    """doc_id, page_no, path, text of page images (doc_id, page_no, path, content), those in known (path, text) not done again; what fails has no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    texts.append(recognise(path.as_py(), content.as_py()))
                except Exception:  # noqa: BLE001 - a page that fails is an empty page
                    texts.append("")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "page_no", "path")), pa.array(texts, pa.string())], ["doc_id", "page_no", "path", "text"])

    workers.ship(images.sparkSession)
    done = images.join(known.select("path", "text"), "path").select("doc_id", "page_no", "path", "text")
    todo = images.join(known.select("path"), "path", "left_anti").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "path", "content")
    return done.unionByName(todo.mapInArrow(run, "doc_id long, page_no int, path string, text string"))


def clean_metadata(value: Column) -> Column:
    return F.nullif(T.strip(value), F.lit(""))


def document_date(value: Column) -> Column:
    """'D:YYYYMMDDHHmmSS...' as 'YYYY-MM-DDTHH:mm:SS'; without a valid day and time null. What is missing of the time is zero; offsets are dropped."""
    digits = F.regexp_replace(value, "^D:", "")
    part = lambda at, n: F.when(F.length(digits) >= at + n - 1, F.substring(digits, at, n)).otherwise(F.lit("0" * n))
    iso = F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2))
    valid = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    return F.when((F.length(digits) >= 8) & valid, iso)
