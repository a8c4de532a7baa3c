"""What searches share: words, depths of candidate lists, vector search, fusion, boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Function words of English that are no terms. One list for index and queries.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does "
    "down during each few for from further had has have he her here hers him his how i if in into is it its just me more most my no nor not now "
    "of off on once only or other our out over own same she should so some such than that the their them then there these they this those through "
    "to too under until up very was we were what when where which while who whom why will with would you your"
).split()
RRF_K = 60
PHRASE_WORDS, PHRASE_FACTOR = 4, 5
#: Candidates fetched for a phrase at least, times k for reranking, and times that for each list of a fusion.
PHRASE_FETCH, RERANK_FETCH, LIST_FETCH = 50, 3, 2


def vector_search(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """vec_id, score = 1 / (1 + squared distance) of the k nearest to the one query row."""
    one = query.select(F.col("embedding").cast("array<double>").alias("q")).limit(1)
    gap = F.zip_with(F.col("embedding").cast("array<double>"), "q", lambda a, b: (a - b) * (a - b))
    distance = F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x)
    scored = vectors.join(F.broadcast(one)).select("vec_id", F.round(1 / (1 + distance), 6).alias("score"))
    best = scored.orderBy(F.col("score").desc(), "vec_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "vec_id")))


def min_max(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Scores over the rows returned to 0..1; all equal become 1."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return results.withColumn("normal", F.when(high == low, 1.0).otherwise(F.round((F.col("score") - low) / (high - low), 6)))


def fuse(keyword: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """Reciprocal rank fusion; ties in the keyword list's order, then the other's."""
    both = keyword.select(key, F.col("rank").alias("k"), F.lit(None).cast("int").alias("s")).unionByName(semantic.select(key, F.lit(None).cast("int").alias("k"), F.col("rank").alias("s")))
    summed = both.groupBy(key).agg(F.min("k").alias("k"), F.min("s").alias("s"))
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    order = Window.orderBy(F.col("score").desc(), F.col("k").asc_nulls_last(), F.col("s").asc_nulls_last(), key)
    return summed.select(key, "k", "s", F.round(part("k") + part("s"), 6).alias("score")).withColumn("rank", F.row_number().over(order)).select(key, "score", "rank")


def phrase_boost(results: DataFrame, phrase: str) -> DataFrame:
    """Scores of texts that hold the phrase times PHRASE_FACTOR; ranks anew if any does."""
    def flat(c):
        return F.lower(F.regexp_replace(c, r"\s+", " "))

    wanted = " ".join(phrase.lower().split())
    hit = F.lit(len(wanted.split()) >= PHRASE_WORDS) & (F.instr(flat(F.col("text")), wanted) > 0)
    boosted = results.withColumn("score", F.when(hit, F.col("score") * PHRASE_FACTOR).otherwise(F.col("score")))
    return boosted.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("rank"))))


def fetch_k(query: str, k: int, rerank: bool = False) -> int:
    """Candidates to fetch for k results, so that boosts and reranking can lift what stands below k."""
    wanted = k * RERANK_FETCH if rerank else k
    return max(wanted, PHRASE_FETCH) if len(query.split()) >= PHRASE_WORDS else wanted
