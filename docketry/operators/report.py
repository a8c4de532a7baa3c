"""Reports: distributions, warnings, a run's summary, retrieval and latency figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T

LOW_COVERAGE, LOW_CONFIDENCE = 50, 0.15
WARNINGS = ("zero_citations", "low_coverage", "zero_chunks", "citation_degraded", "no_json", "low_confidence")


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def ranked_distribution(rows: DataFrame, column: str) -> DataFrame:
    """column, n, pct: most frequent first, ties by value."""
    n = F.count(F.lit(1))
    counted = rows.groupBy(column).agg(n.alias("n"))
    return counted.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.col("n").desc(), column)


def warning_tests() -> dict[str, Column]:
    """What each warning asks of a result that is OK."""
    cited = F.coalesce("citations_count", F.lit(0))
    return {
        "zero_citations": cited == 0, "low_coverage": (cited > 0) & (F.coalesce("coverage_pct", F.lit(0)) < LOW_COVERAGE), "zero_chunks": F.coalesce("chunks_count", F.lit(0)) == 0,
        "citation_degraded": F.coalesce("citation_degraded", F.lit(False)), "no_json": ~F.coalesce("had_json", F.lit(True)), "low_confidence": F.coalesce(F.col("classification_confidence") < LOW_CONFIDENCE, F.lit(False)),
    }


def warnings(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, warning: a row for each warning that applies; columns that results lacks warn of nothing."""
    for c, t in (("citation_degraded", "boolean"), ("had_json", "boolean"), ("classification_confidence", "double")):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast(t))
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in warning_tests().items()]), lambda x: x.isNotNull())
    return results.select(key, F.explode(found).alias("warning"))


def totals(results: DataFrame) -> DataFrame:
    """One row over results (status OK, FAILED or SKIPPED): counts by status; of OK ones chunks, citations, and averages."""
    ok = F.col("status") == "OK"
    of = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit(0)))
    count = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        F.count(F.lit(1)).alias("total"), count("OK").alias("ok"), count("FAILED").alias("failed"), count("SKIPPED").alias("skipped"), F.coalesce(F.sum(of("chunks_count")), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum(of("citations_count")), F.lit(0)).alias("citations"), F.avg(of("chunks_count")).alias("avg_chunks"), F.avg(of("citations_count")).alias("avg_citations"), F.avg(of("coverage_pct")).alias("avg_coverage"),
        F.avg(F.when(ok & (F.col("elapsed_seconds") > 0), F.col("elapsed_seconds"))).alias("avg_seconds"),
    )


def run_report(results: DataFrame) -> DataFrame:
    """status, documents, citations, chunks, coverage: totals by status and over all (null)."""
    return results.rollup("status").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("citations_count").alias("citations"), F.sum("chunks_count").alias("chunks"), F.round(F.avg("coverage_pct"), 4).alias("coverage"),
    )


_TITLES = ("SUMMARY", "CLASSIFICATION DISTRIBUTION", "EXTRACTION METHODS", "ERRORS", "WARNINGS", "INFO")


def lines(results: DataFrame, seconds: float = 0.0, condensed: DataFrame | None = None) -> DataFrame:
    """section, title, ord, line: a run's report, in that order. Sections without a line are left out.

    results: model.RESULTS; condensed: names (file) of transcripts that are not supported. Lines that
    are of single documents stay a table, however many there are.
    """
    spark = results.sparkSession
    ok = results.filter("status = 'OK'")
    t = totals(results)
    n_condensed = condensed.count() if condensed is not None else 0
    number = lambda c, p=1: F.format_number(F.coalesce(c, F.lit(0.0)), p)
    told = [
        F.format_string("Documents:  %d total | %d OK | %d failed | %d skipped | %d condensed", "total", "ok", "failed", "skipped", F.lit(n_condensed)),
        F.when(F.col("ok") > 0, F.concat(F.lit("Chunks:     "), number(F.col("chunks"), 0), F.lit(" across "), F.col("ok").cast("string"), F.lit(" documents (avg "), number(F.col("avg_chunks")), F.lit("/doc)"))),
        F.when(F.col("ok") > 0, F.concat(F.lit("Citations:  "), number(F.col("citations"), 0), F.lit(" total (avg "), number(F.col("avg_citations")), F.lit("/doc)"))),
        F.when(F.col("ok") > 0, F.concat(F.lit("Coverage:   "), number(F.col("avg_coverage")), F.lit("% avg"))),
        F.concat(F.lit("Time:       "), T.duration(F.lit(float(seconds))), F.when(F.col("ok") > 0, F.concat(F.lit(" ("), T.duration(F.coalesce("avg_seconds", F.lit(0.0))), F.lit(" avg/doc)"))).otherwise("")),
    ]
    summary = t.select(F.posexplode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("n", "line")).select(F.lit(0).alias("section"), F.format_string("%09d", "n").alias("ord"), "line")

    def shares(column: str, section: int) -> DataFrame:
        d = ranked_distribution(ok.withColumn(column, F.coalesce(column, F.lit("unknown"))), column)
        return d.select(F.lit(section).alias("section"), F.concat(F.format_string("%019d", F.lit(2**62) - F.col("n")), column).alias("ord"), F.concat(F.rpad(column, 24, " "), F.lit(" "), F.lpad(F.col("n").cast("string"), 4, " "), F.lit("  ("), F.format_number("pct", 1), F.lit("%)")).alias("line"))

    failed = results.filter("status = 'FAILED'").select(F.lit(3).alias("section"), F.col("file").alias("ord"), F.concat(F.lit("FAIL  "), "file", F.lit(": "), F.coalesce("error", F.lit("Unknown error"))).alias("line"))
    why = {
        "zero_citations": F.lit("no citations"), "low_coverage": F.concat(F.lit("coverage "), F.format_number(F.coalesce("coverage_pct", F.lit(0.0)), 1), F.lit("%")), "zero_chunks": F.lit("no chunks"),
        "citation_degraded": F.lit("citation tracking degraded"), "no_json": F.lit("no layout for citation tracking"), "low_confidence": F.concat(F.lit("confidence "), F.format_number(F.coalesce("classification_confidence", F.lit(0.0)), 2)),
    }
    tests = warning_tests()
    warned = ok.select(F.inline(F.filter(F.array(*[F.when(tests[w], F.struct(F.lit(i).alias("w"), F.col("file").alias("file"), F.concat(F.col("file"), F.lit(" (type: "), F.coalesce("doc_type", F.lit("unknown")), F.lit("): "), why[w]).alias("line"))) for i, w in enumerate(WARNINGS)]), lambda x: x.isNotNull())))
    warned = warned.select(F.lit(4).alias("section"), F.concat(F.col("w").cast("string"), "file").alias("ord"), "line")
    skipped = t.filter("skipped > 0").select(F.lit(5).alias("section"), F.lit("0").alias("ord"), F.format_string("Skipped: %d", "skipped").alias("line"))
    parts = [summary, shares("doc_type", 1), shares("extraction_method", 2), failed, warned, skipped]
    if condensed is not None:
        parts.append(condensed.select(F.lit(5).alias("section"), F.concat(F.lit("1"), "file").alias("ord"), F.concat(F.lit("Condensed transcript, not supported: "), "file").alias("line")))
    titles = spark.createDataFrame(list(enumerate(_TITLES)), "section int, title string")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(titles), "section").select("section", "title", "ord", "line").orderBy("section", "ord")


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, sorted[n // 2], sorted[int(0.95 n)] and the largest of each group.

    Values are counted first and their counts added up in order, so a group is as many rows as it has
    different values, not one row of all of them.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(by)
    placed = counted.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(everything))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    return placed.groupBy(by).agg(
        F.max("n").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 4).alias("mean"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 0.95)).alias("p95"), F.max(value).alias("most"),
    )


def precision_at_k(found: DataFrame, expected: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Hits over k, whatever was returned, and whether there was one."""
    hits = found.filter(F.col("rank") <= k).join(expected.select(query, item).distinct().withColumn("hit", F.lit(1)), [query, item], "left")
    return hits.groupBy(query).agg(F.round(F.coalesce(F.sum("hit"), F.lit(0)) / k, 6).alias("precision"), (F.coalesce(F.sum("hit"), F.lit(0)) > 0).alias("any_hit"))


def evaluate(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, mode, precision, hit: of hits (query, mode, rank, chunk_id), how many of the first k begin as a query's expected prefixes (query, prefixes).

    A query without hits has precision 0 in every mode that there is.
    """
    modes = hits.select("mode").distinct()
    met = hits.filter(F.col("rank") <= k).join(queries, "query").withColumn("good", F.exists("prefixes", lambda p: F.startswith(F.col("chunk_id"), p)).cast("int"))
    counted = met.groupBy("query", "mode").agg(F.sum("good").alias("good"))
    every = queries.select("query").join(F.broadcast(modes))  # as many rows as modes for each query
    good = F.coalesce("good", F.lit(0))
    return every.join(counted, ["query", "mode"], "left").select("query", "mode", (good / k).alias("precision"), (good > 0).alias("hit"))


def mode_summary(evaluated: DataFrame, latencies: DataFrame) -> DataFrame:
    """mode, queries, mean, least and highest precision, hit rate, and latencies (query, mode, latency_ms)."""
    quality = evaluated.groupBy("mode").agg(
        F.count(F.lit(1)).alias("queries"), F.avg("precision").alias("mean_precision"), F.min("precision").alias("min_precision"), F.max("precision").alias("max_precision"), F.avg(F.col("hit").cast("int")).alias("hit_rate"),
    )
    speed = latency(latencies, "mode", "latency_ms").select("mode", F.col("mean").alias("mean_latency_ms"), F.col("p50").alias("p50_latency_ms"), F.col("p95").alias("p95_latency_ms"), F.col("most").alias("max_latency_ms"))
    return quality.join(speed, "mode", "left")


def mode_deltas(evaluated: DataFrame, base: str, other: str) -> DataFrame:
    """query, delta of precision from one mode to another."""
    one = lambda m, name: evaluated.filter(F.col("mode") == m).select("query", F.col("precision").alias(name))
    return one(base, "before").join(one(other, "after"), "query").withColumn("delta", F.col("after") - F.col("before"))
