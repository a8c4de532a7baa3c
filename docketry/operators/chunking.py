"""Cutting lines into chunks by a token budget, without citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import chunks


def cut_lines(docs: DataFrame, family: str = "generic", opens: str = chunks.PARAGRAPH, target: int = chunks.TARGET_TOKENS, most: int = chunks.MOST_TOKENS, overlap: int = chunks.OVERLAP_TOKENS) -> DataFrame:
    """doc_id, chunk_idx, line_start, line_end, core_text of docs (doc_id, text) by the budget of a family.

    Only the lengths of lines and whether they are blank or open a part go to Python.
    """
    split = docs.filter("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    kinds = F.transform("lines", lambda x: F.when(F.trim(x) == "", chunks.BLANK).when(x.rlike(opens), chunks.OPENS).otherwise(0))
    found = split.withColumn("cuts", chunks.cuts(target, most, overlap)(F.lit(family), F.transform("lines", F.length), kinds))
    dealt = F.transform("cuts", lambda c: F.struct((c["a"] + 1).alias("line_start"), c["b"].alias("line_end"), F.array_join(F.slice(F.col("lines"), c["a"] + 1, c["b"] - c["a"]), "\n").alias("core_text")))
    return found.select("doc_id", F.posexplode(dealt).alias("chunk_idx", "x")).select("doc_id", "chunk_idx", "x.*")


def generic_chunks(docs: DataFrame, target: int = chunks.TARGET_TOKENS) -> DataFrame:
    """A chunk is closed when its joined lines reach the target; the next one begins with its last lines, if it had more."""
    return cut_lines(docs, target=target)
