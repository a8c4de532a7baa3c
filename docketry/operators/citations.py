"""Measures of citations on the elements of the test tables; cite.py has the handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import cite

TOP, BOTTOM, LINES = 655.0, 87.5, 25
LEAST_ELEMENTS = 8
GAP_LINES = GAP_STAMPS = 5
#: Stamps that a task looks through for pages with several.
TASK_ROWS = 500_000


def elements(lineitem: DataFrame) -> DataFrame:
    """Layout elements that stand in for a converter's: box edges from an item's numbers."""
    top = F.lit(700.0) - F.col("l_quantity") * 12
    left = F.col("l_discount") * 4000
    return lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 40 + 1).cast("int").alias("page"),
        left.alias("l"), top.alias("t"), (left + 60 + F.col("l_tax") * 2500).alias("r"), (top - 10).alias("b"), F.col("l_suppkey").alias("stamp"),
    )


def line_ranges(boxes: DataFrame) -> DataFrame:
    """First and last line of each box; the last is never before the first."""
    height = (TOP - BOTTOM) / LINES
    last = F.greatest(F.col("line_start"), F.least(F.lit(LINES), F.floor((F.lit(TOP) - F.col("b")) / height)))
    return boxes.withColumn("line_start", T.bbox_line(F.col("t"), F.lit(TOP), F.lit(BOTTOM), F.lit(LINES))).withColumn("line_end", last.cast("int"))


def content_area(boxes: DataFrame, by: str) -> DataFrame:
    """Median over pages of the highest and the lowest edge, of pages with LEAST_ELEMENTS boxes."""
    pages = boxes.groupBy(by, "page").agg(F.max("t").alias("top"), F.min("b").alias("bottom"), F.count(F.lit(1)).alias("n"))
    area = pages.filter(F.col("n") >= LEAST_ELEMENTS).groupBy(by).agg(F.expr("percentile(top, 0.5)").alias("top"), F.expr("percentile(bottom, 0.5)").alias("bottom"))
    return area


def column_of(boxes: DataFrame, width: float = cite.PAGE_WIDTH) -> DataFrame:
    """side of each box: full_width, left or right, by the thresholds of a patent page whose middle is that of the page."""
    return boxes.withColumn("side", cite.column_side(F.col("l"), F.col("r"), F.lit(width), F.lit(width / 2)))


def coverage(cited: DataFrame, by: str) -> DataFrame:
    """Count, share with a line, and whether pages and stamps are known."""
    return cited.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.round(100.0 * F.count("line_start") / F.count(F.lit(1)), 4).alias("coverage_pct"),
        F.bool_or(F.col("page").isNotNull()).alias("has_pages"), F.bool_or(F.col("stamp").isNotNull()).alias("has_stamps"),
    )


def line_gaps(cited: DataFrame, by: str) -> DataFrame:
    """Jumps of more than GAP_LINES between distinct sorted lines of a page."""
    starts = cited.select(by, "page", "line_start").distinct()
    w = Window.partitionBy(by, "page").orderBy("line_start")
    return starts.withColumn("next_line", F.lead("line_start").over(w)).filter(F.col("next_line") - F.col("line_start") > GAP_LINES)


def stamp_gaps(stamps: DataFrame, by: str) -> DataFrame:
    """Stamps that advance by more than pages do, plus GAP_STAMPS."""
    w = Window.partitionBy(by).orderBy("page", "stamp")
    moved = stamps.withColumn("next_stamp", F.lead("stamp").over(w)).withColumn("next_page", F.lead("page").over(w))
    return moved.filter(F.col("next_stamp") - F.col("stamp") > F.col("next_page") - F.col("page") + GAP_STAMPS)


def stamp_duplicates(stamps: DataFrame, by: str) -> DataFrame:
    """Pages with more than one stamp."""
    # dealt first: sums of a task's own rows would be as many as the rows, and a task may read tens of millions
    dealt = stamps.select(by, "page", "stamp").repartition(1 + stamps.count() // TASK_ROWS, by, "page")
    seen = dealt.groupBy(by, "page").agg(F.countDistinct("stamp").alias("n_stamps"), F.min("stamp").alias("first_stamp"))
    return seen.filter("n_stamps > 1")
