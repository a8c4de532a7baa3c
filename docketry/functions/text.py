"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\r\x0B\f]+"


def normalize_stem(name: Column) -> Column:
    """Lower case; spaces and hyphens to single underscores; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), " -", "__"), "_+", "_"), "^_|_$", "")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, "^" + WHITE, ""), WHITE + "$", "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def page_ranges(pages: Column) -> Column:
    """Distinct sorted pages as text: 'p. 4', 'pp. 1, 6, 8-10'; empty for none."""
    known = F.array_sort(F.array_distinct(F.array_compact(pages)))
    step = F.aggregate(
        known,
        F.expr("struct('' AS out, CAST(NULL AS INT) AS first, CAST(NULL AS INT) AS last)"),
        lambda acc, p: F.when(acc["last"].isNull(), F.struct(acc["out"].alias("out"), p.cast("int").alias("first"), p.cast("int").alias("last")))
        .when(p == acc["last"] + 1, F.struct(acc["out"].alias("out"), acc["first"].alias("first"), p.cast("int").alias("last")))
        .otherwise(F.struct(F.concat(acc["out"], _run(acc), F.lit(", ")).alias("out"), p.cast("int").alias("first"), p.cast("int").alias("last"))),
        lambda acc: F.when(acc["last"].isNull(), F.lit("")).otherwise(F.concat(acc["out"], _run(acc))),
    )
    return F.when(F.size(known) == 0, "").when(F.size(known) == 1, F.concat(F.lit("p. "), step)).otherwise(F.concat(F.lit("pp. "), step))


def _run(acc: Column) -> Column:
    return F.when(acc["first"] == acc["last"], acc["first"].cast("string")).otherwise(F.concat_ws("-", acc["first"].cast("string"), acc["last"].cast("string")))


def bates_parts(stamp: Column) -> Column:
    """(prefix, number, width) of a stamp, null without a final number."""
    digits = F.regexp_extract(stamp, r"(\d+)$", 1)
    return F.when(digits != "", F.struct(F.regexp_extract(stamp, r"^(.*?)(\d+)$", 1).alias("prefix"), digits.cast("long").alias("number"), F.length(digits).alias("width")))


def pad_number(number: Column, width: Column) -> Column:
    """Zero-padded to width, never cut."""
    text = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(text), F.lit(0))), text)


def duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 60, F.concat(F.format_number(seconds, 1), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("s")))
        .otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), F.lpad(F.floor(whole % 3600 / 60).cast("string"), 2, "0"), F.lit("m")))
    )


def request_kind(label: Column) -> Column:
    """rfp, rfa or rog by what a heading asks for."""
    upper = F.upper(label)
    return F.when(upper.contains("PRODUCTION"), "rfp").when(upper.contains("ADMISSION"), "rfa").otherwise("rog")


def chunk_document_name(chunk_id: Column) -> Column:
    """The id without its last two parts; empty where there are fewer."""
    return F.when(F.size(F.split(chunk_id, "_")) > 2, F.regexp_replace(chunk_id, "_[^_]*_[^_]*$", "")).otherwise("")


def line_of_char(text: Column, position: Column) -> Column:
    """Zero-based line of a zero-based character position."""
    return F.size(F.split(F.substring(text, F.lit(1), position), "\n")) - 1


def bbox_line(edge: Column, top: Column, bottom: Column, lines: Column) -> Column:
    """One-based line of a height on a page, held within 1 and lines."""
    height = F.when(lines > 0, (top - bottom) / lines).otherwise(1.0)
    return F.greatest(F.lit(1), F.least(lines, F.floor((top - edge) / height) + 1)).cast("int")
