"""Ranked retrieval over stored indexes: modes, candidates, fusion, phrase boost, reranking, pages of hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators import index, search
from docketry.sources import tables

MODES = ("bm25", "semantic", "hybrid")
PREVIEW = 400


def normalised(results: DataFrame) -> DataFrame:
    """Scores of a list to 0..1 over what it holds; all equal become 1."""
    w = Window.partitionBy()
    low, high = F.min("score").over(w), F.max("score").over(w)
    return results.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def reranked(results: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best of a bounded list by another score, ties as they stood; the new score takes the old one's place."""
    order = Window.orderBy(F.col("reranker_score").desc(), F.col("was"))
    again = results.withColumn("reranker_score", score.cast("double")).withColumnRenamed("rank", "was").withColumn("rank", F.row_number().over(order))
    return again.filter(F.col("rank") <= k).withColumn("score", F.col("reranker_score")).drop("was")


def boosted(results: DataFrame, query: str) -> DataFrame:
    """Scores of texts that hold the query as it is, but for case and white space, times PHRASE_FACTOR; ranks anew if any does."""
    wanted = " ".join(query.lower().split())
    if len(wanted.split()) < search.PHRASE_WORDS:
        return results
    hit = F.instr(F.regexp_replace(F.lower("core_text"), r"\s+", " "), wanted) > 0
    held = results.withColumn("_hit", hit)
    for c in ("score", "bm25_score"):
        held = held.withColumn(c, F.when(F.col("_hit"), F.col(c) * search.PHRASE_FACTOR).otherwise(F.col(c)))
    order = Window.orderBy(F.col("score").desc(), F.col("was"))
    some = F.max("_hit").over(Window.partitionBy())
    return held.withColumnRenamed("rank", "was").withColumn("rank", F.when(some, F.row_number().over(order)).otherwise(F.col("was"))).drop("_hit", "was")


class Retriever:
    """Searches the indexes at a path (keyword/, vectors/) over chunks (model.CHUNKS).

    embed: text to a vector, for semantic search; without it, or without a vector table, semantic and
    hybrid search fall back to keywords. rerank: a function of (query, text column) to a score column;
    without it reranking keeps the order and trims. The keyword index must be there.
    """

    def __init__(self, spark: SparkSession, path: str, chunks: DataFrame, embed: Callable[[str], list[float]] | None = None, rerank: Callable[[str, Column], Column] | None = None) -> None:
        self.spark, self.path, self.chunks, self.embed, self.rerank = spark, path, chunks, embed, rerank
        self.keyword = index.KeywordIndex(spark, f"{path}/keyword")
        self.vectors = tables.read(spark, f"{path}/vectors")

    @property
    def semantic_available(self) -> bool:
        return self.embed is not None and self.vectors is not None

    def _keyword(self, query: str, k: int) -> DataFrame:
        found = normalised(self.keyword.search(query, k))
        return found.select(F.col(self.keyword.key).alias("chunk_id"), "score", F.col("score").alias("bm25_score"), F.lit(None).cast("double").alias("semantic_score"), "rank")

    def _semantic(self, query: str, k: int) -> DataFrame:
        if not self.semantic_available:
            return self._keyword(query, k)
        found = normalised(index.search_vectors(self.vectors, self.embed(query), k))
        return found.select("chunk_id", "score", F.lit(None).cast("double").alias("bm25_score"), F.col("score").alias("semantic_score"), "rank")

    def _hybrid(self, query: str, k: int) -> DataFrame:
        """Both lists twice as long, fused by reciprocal ranks; scores of either stay beside the fused one."""
        if not self.semantic_available:
            return self._keyword(query, k)
        both = self._keyword(query, k * search.LIST_FETCH), self._semantic(query, k * search.LIST_FETCH)
        return fuse(*both).filter(F.col("rank") <= k)

    def search(self, query: str, top_k: int = 10, mode: str = "hybrid", rerank: bool = False, rerank_top_k: int | None = None) -> DataFrame:
        """Hits: chunk columns, score, bm25_score, semantic_score, reranker_score, rank. A blank query has none.

        Candidates are fetched as deep as boost and reranking need, and trimmed last. Candidates
        without a chunk are left out; the ranks of the others stay as they are.
        """
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} is none of {MODES}")
        k = search.fetch_k(query, top_k, rerank)
        way = {"bm25": self._keyword, "semantic": self._semantic, "hybrid": self._hybrid}[mode]
        found = way(query, k) if query.strip() else self._keyword("", k)
        hits = found.join(self.chunks, "chunk_id").withColumn("reranker_score", F.lit(None).cast("double"))
        hits = boosted(hits, query)
        if not rerank:
            return _trimmed(hits, top_k)
        final = top_k if rerank_top_k is None else rerank_top_k
        return _trimmed(hits, final) if self.rerank is None else reranked(hits, self.rerank(query, F.col("core_text")), final)

    def stats(self) -> tuple[DataFrame, dict]:
        """(stem, chunks) and totals: chunks, documents, which indexes there are."""
        by = self.chunks.groupBy("stem").agg(F.count(F.lit(1)).alias("chunks")).orderBy("stem")
        n = self.chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("stem").alias("documents")).first()
        return by, {"total_chunks": n.chunks, "num_documents": n.documents, "bm25_available": True, "semantic_available": self.semantic_available}


def _trimmed(hits: DataFrame, k: int) -> DataFrame:
    """The k best; ranks may have gaps where a candidate has no chunk, so what is left is counted."""
    return hits.orderBy("rank").limit(k)


def fuse(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two lists (chunk_id, bm25_score, semantic_score, rank); ties in the keyword list's order, then the other's."""
    each = [df.select("chunk_id", "bm25_score", "semantic_score", F.col("rank").alias("k") if first else F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("s") if first else F.col("rank").alias("s")) for df, first in ((keyword, True), (semantic, False))]
    summed = each[0].unionByName(each[1]).groupBy("chunk_id").agg(F.max("bm25_score").alias("bm25_score"), F.max("semantic_score").alias("semantic_score"), F.min("k").alias("k"), F.min("s").alias("s"))
    part = lambda c: F.coalesce(1 / (search.RRF_K + F.col(c)), F.lit(0.0))
    order = Window.orderBy(F.col("score").desc(), F.col("k").asc_nulls_last(), F.col("s").asc_nulls_last(), "chunk_id")
    return summed.withColumn("score", part("k") + part("s")).withColumn("rank", F.row_number().over(order)).select("chunk_id", "score", "bm25_score", "semantic_score", "rank")


def hit_places(hits: DataFrame, query: str) -> DataFrame:
    """hits with hit_line, hit_page, hit_bates: the first line that holds the query, or has most of its words.

    A line of the chunk's text is looked up in its page map; beyond its end the last place counts.
    Without a map, or without a word in common, there is no page.
    """
    wanted = " ".join(query.lower().split())
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(wanted.split())]).cast("array<string>")
    at = F.instr(F.lower("core_text"), query.lower().strip())
    exact = F.size(F.split(F.substring("core_text", F.lit(1), at - 1), "\n", -1)) - 1
    lines = F.transform(F.split(F.lower("core_text"), "\n", -1), lambda x, i: F.struct((-F.size(F.array_intersect(F.split(F.trim(x), r"\s+"), asked))).alias("less"), i.alias("i")))
    best = F.array_min(lines)
    line = F.when(F.lit(wanted == ""), None).when(at > 0, exact).when(best["less"] < 0, best["i"])
    pages, stamps = F.col("citation.page_map"), F.col("citation.bates_map")
    place = lambda m: F.when((F.size(m) > 0) & line.isNotNull(), F.get(m, F.least(line, F.size(m) - 1)))
    return hits.withColumns({"hit_line": line + 1, "hit_page": place(pages), "hit_bates": place(stamps)})


def display(hits: DataFrame, query: str) -> DataFrame:
    """What a reader is shown of each hit: rank, score, citation, document, place, a preview in one line."""
    flat = F.trim(F.regexp_replace("core_text", r"\s+", " "))
    preview = F.when(F.length(flat) > PREVIEW, F.concat(F.substring(flat, 1, PREVIEW), F.lit("..."))).otherwise(flat)
    return hit_places(hits, query).select(
        "rank", F.round("score", 4).alias("score"), "citation_string", "chunk_id", "stem", "doc_type", F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ").alias("pages"),
        "hit_page", "hit_bates", "source_path", "summary", preview.alias("preview"),
    ).orderBy("rank")


def shared_words(query: str, text: Column) -> Column:
    """How many distinct words of the query the text has: a reranker that needs no model."""
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())]).cast("array<string>")
    return F.size(F.array_intersect(F.split(F.lower(text), r"\s+"), asked))
