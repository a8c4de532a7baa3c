"""Documents as lines: explosion, pages, markers carried forward, sections, paragraphs, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T

LINES_PER_PAGE = 25


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def paged(rows: DataFrame) -> DataFrame:
    """Lines with the page and the stamp they stand on."""
    page = (F.floor((F.col("line_no") - 1) / LINES_PER_PAGE) + 1).cast("int")
    stamp = F.concat(F.lit("DOC_SYN_"), T.pad_number(F.col("doc_id") * 1000 + F.col("page"), F.lit(8)))
    return rows.withColumn("page", page).withColumn("bates", stamp)


def carry(rows: DataFrame, by: list[str], order: str, column: str, out: str) -> DataFrame:
    """The last value known so far; nulls before the first stay null."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(column, ignorenulls=True).over(w))


def sections(rows: DataFrame) -> DataFrame:
    """Running section number: a line without a comma or full stop inside and at most 40 characters opens one."""
    header = (F.length("line") <= 40) & ~F.col("line").contains(",")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section_id", F.sum(header.cast("int")).over(w))


def marked(rows: DataFrame, every: int = 3) -> DataFrame:
    """Text-id markers on every few lines of the source, taken out and carried to the lines after them."""
    rows = rows.withColumn("own_id", F.when(F.col("line_no") % every == 0, F.col("line_no").cast("int")))
    return carry(rows, ["doc_id"], "line_no", "own_id", "text_id")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para_no (from 1), paragraph: stripped, none empty; blank lines part them."""
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", r"(\r?\n){2,}", "\n\n"), "\n\n"), T.strip), lambda x: x != "")
    split = docs.select("doc_id", F.posexplode(parts).alias("pos", "paragraph"))
    return split.select("doc_id", (F.col("pos") + 1).alias("para_no"), "paragraph")


def transcript(turns: DataFrame) -> DataFrame:
    """Question and answer lines of conversations: user turns are Q, assistant turns A."""
    mark = F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A")
    return turns.withColumn("mark", mark).filter(F.col("mark").isNotNull()).select(
        "conv_id", (F.col("turn") + 1).cast("int").alias("line_start"), "mark",
        F.concat_ws(" ", F.lpad((F.col("turn") + 1).cast("string"), 2, " "), "mark", T.strip(F.coalesce("text", F.lit("")))).alias("line"),
    )


def qa_markers(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, number, mark, said of lines of testimony: a margin number, Q or A, and what is said."""
    form = r"^\s*(\d{1,2})\s+([QA])\.?\s+(.+)$"
    found = rows.filter(F.col("line").rlike(form))
    return found.select("doc_id", "line_no", F.regexp_extract("line", form, 1).cast("int").alias("number"), F.regexp_extract("line", form, 2).alias("mark"), F.regexp_extract("line", form, 3).alias("said"))
