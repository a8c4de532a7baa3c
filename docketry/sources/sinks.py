"""Tables as JSON files for other programs: nulls are left out, a folder for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a citation that are written even where they are null, and those that are not.
ALWAYS = ("page", "line_start", "line_end", "bates", "column", "paragraph_number", "type")
WHERE_KNOWN = ("transcript_page", "discovery_request_kind", "discovery_request_number")


def chunks(df: DataFrame, path: str) -> None:
    """A chunk a line below stem=..., in their order; keys of the citation that are null are left out."""
    kept = df.repartition("stem").sortWithinPartitions("stem", "chunk_idx").drop("doc_id", "chunk_idx")
    kept.write.mode("overwrite").option("ignoreNullFields", True).partitionBy("stem").json(path)


def citations(df: DataFrame, path: str) -> None:
    """A document a line: stem and its citations by reference, in their order, as JSON text."""
    always = F.struct(*ALWAYS)
    more = F.struct(*WHERE_KNOWN)
    # two objects in one: the first keeps its nulls
    first, second = F.to_json(always, {"ignoreNullFields": "false"}), F.to_json(more, {"ignoreNullFields": "true"})
    joined = F.when(second == "{}", first).otherwise(F.concat(F.expr("substring(a, 1, length(a) - 1)"), F.lit(","), F.expr("substring(b, 2, length(b))")))
    rows = df.withColumns({"a": first, "b": second}).select("stem", "ord", F.concat(F.to_json(F.array("ref")), F.lit(":"), joined).alias("entry"))
    pair = F.regexp_replace("entry", r'^\[(.*?)\]:', "$1:")
    listed = rows.withColumn("entry", pair).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("ord", "entry"))).alias("e"))
    listed.select("stem", F.concat(F.lit("{"), F.array_join("e.entry", ","), F.lit("}")).alias("value")).write.mode("overwrite").partitionBy("stem").text(path)


def rows(df: DataFrame, path: str) -> None:
    """A row a line: manifests, flagged and failed documents, statistics, reports."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
