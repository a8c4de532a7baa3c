"""Stored indexes: terms, postings and vectors as tables, searched without the texts.

A term's postings hold how often each text has the term; the lengths of the texts' vectors are a table
of their own. A query reads its own terms' postings, adds up and divides. Terms are sorted in parts, told
by a hash of their words, so that pages of a file without them are passed over.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docketry import workers
from docketry.operators import inverted, search
from docketry.sources import tables

#: Letters of the texts for each part of the index (about a million postings), and most parts.
PART_LETTERS, MOST_PARTS = 8_000_000, 4096
#: How terms are stored: neighbours share their beginnings, and numbers of texts take few bits.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def _found(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(search.TOKEN), F.lit(0))


def _idf(df: Column, n: int) -> Column:
    return F.log((1.0 + n) / (1 + df)) + 1


def words(text: Column, stop_words: Sequence[str] = search.STOP_WORDS) -> Column:
    """Lower-case words of two letters or more, without stop words."""
    found = _found(text)
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def terms(words: Column) -> Column:
    """Words, and neighbours joined by a space."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def build(texts: DataFrame, path: str, key: str = "doc_id", max_features: int | None = None, stop_words: Sequence[str] = search.STOP_WORDS) -> None:
    """Write the keyword index of texts (key, text) at path: terms with their postings, texts (number, key, norm), meta.

    A row of terms is (part, term, block, df, occurrences, texts, tfs): numbers of texts that have the
    term and how often; what goes beyond a block has rows of its own. Rows without a term hold keys.
    Weights are (1 + ln tf) * idf with idf = ln((1 + n) / (1 + df)) + 1; norm is the length of a text's
    vector. max_features keeps the terms that occur most, ties to the smaller term. Texts that have no
    term are not among texts. Without texts there is nothing to index: ValueError.
    """
    spark = texts.sparkSession
    n, letters = texts.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    if not n:
        raise ValueError("cannot build an index of no texts")
    cores = spark.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # a small file: more cores than it has splits
        texts = texts.select(key, "text").repartition(cores)
    workers.ship(spark)
    parts = min(MOST_PARTS, 1 + (letters or 0) // PART_LETTERS)
    packed = texts.select(key, _found(F.col("text")).alias("w")).mapInArrow(inverted.pieces(parts, list(stop_words)), inverted.PIECES)
    kind = texts.schema[key].dataType
    rows = f"part int, term string, block int, df long, occurrences long, texts array<long>, tfs array<int>, keys array<{kind.simpleString()}>"
    whole = packed.repartitionById(parts, F.col("part")).mapInArrow(inverted.merged(to_arrow_type(kind)), rows)
    held = f"{path}/terms" if max_features is None else f"{path}/whole"
    sent = {f"spark.sql.execution.arrow.{name}": value for name, value in inverted.SENT.items()}
    before = {name: spark.conf.get(name) for name in sent}
    try:
        for name, value in sent.items():
            spark.conf.set(name, value)
        tables.write(whole, held, options=PACKED)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    whole = tables.read(spark, held)
    known = whole.filter("term IS NOT NULL").drop("keys")
    if max_features is not None:
        most = known.filter("block = 0").orderBy(F.col("occurrences").desc(), "term").limit(max_features).select("term")
        tables.write(known.join(most, "term", "left_semi").sortWithinPartitions("part", "term", "block"), f"{path}/terms", options=PACKED)
        known = tables.read(spark, f"{path}/terms")
    # few tasks, so that a text's sum passes the shuffle few times
    each = known.coalesce(2 * cores).select(_idf(F.col("df"), n).alias("idf"), F.inline(F.arrays_zip(F.col("texts").alias("number"), F.col("tfs").alias("tf"))))
    w = (1 + F.log("tf")) * F.col("idf")
    norms = each.groupBy("number").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    keys = whole.filter("keys IS NOT NULL").select(F.inline(F.arrays_zip(F.col("texts").alias("number"), F.col("keys").alias(key))))
    tables.write(keys.join(norms, "number"), f"{path}/texts")
    meta = spark.range(1).select(F.lit(n).alias("n"), F.lit(parts).alias("parts"), F.lit(key).alias("key"), F.array(*map(F.lit, stop_words)).cast("array<string>").alias("stop_words"), F.current_timestamp().alias("built_at"))
    tables.write(meta, f"{path}/meta")
    if max_features is not None:
        tables.drop(spark, held)


def available(spark: SparkSession, path: str) -> bool:
    """Whether a complete index is stored at path."""
    return all(tables.exists(spark, f"{path}/{name}") for name in ("terms", "texts", "meta"))


class KeywordIndex:
    """An index at a path, opened: what it is of is read once, postings for each query."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        if not available(spark, path):
            raise FileNotFoundError(f"no index at {path}")
        self.spark = spark
        meta = tables.read(spark, f"{path}/meta").first()
        self.n, self.parts, self.key, self.stop_words = meta.n, meta.parts, meta.key, list(meta.stop_words)
        self.terms, self.texts = tables.read(spark, f"{path}/terms").filter("term IS NOT NULL"), tables.read(spark, f"{path}/texts")

    def _of(self, terms: Sequence[str]) -> DataFrame:
        return self.terms.filter(F.col("part").isin(*{inverted.part_of(t, self.parts) for t in terms}) & F.col("term").isin(*terms))

    def weights(self, query: str) -> dict[str, tuple[float, float]]:
        """(weight, idf) by term of the query's terms that the index knows; weights as a vector of length 1."""
        asked = self.spark.range(1).select(F.explode(terms(words(F.lit(query), self.stop_words))).alias("term"))
        tf = Counter(r.term for r in asked.collect())
        if not tf:
            return {}
        idf = {r.term: r.idf for r in self._of(list(tf)).filter("block = 0").select("term", _idf(F.col("df"), self.n).alias("idf")).collect()}
        known = {term: (1 + math.log(tf[term])) * idf[term] for term in tf if term in idf}
        length = math.sqrt(sum(w * w for w in known.values()))
        return {term: (w / length, idf[term]) for term, w in known.items()}

    def search(self, query: str, k: int = 10) -> DataFrame:
        """key, score, rank of the k best by cosine; blank queries and those of unknown terms have none; ties to the smaller key."""
        asked = self.weights(query)
        if not asked:
            return self.texts.filter(F.lit(False)).select(self.key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        weight = F.lit(0.0)
        for term, (w, idf) in asked.items():
            weight = F.when(F.col("term") == term, w * idf).otherwise(weight)
        hits = self._of(list(asked)).select(weight.alias("w"), F.inline(F.arrays_zip(F.col("texts").alias("number"), F.col("tfs").alias("tf"))))
        summed = hits.groupBy("number").agg(F.sum((1 + F.log("tf")) * F.col("w")).alias("dot"))
        scored = summed.join(self.texts, "number").select(self.key, F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter("score > 0")
        best = scored.orderBy(F.col("score").desc(), self.key).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), self.key)))


# Vectors


def existing(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, stem of what the vector table at path holds; none where there is no table."""
    held = tables.read(spark, path)
    return held.select("chunk_id", "stem") if held is not None else spark.createDataFrame([], "chunk_id string, stem string")


def update_vectors(chunks: DataFrame, path: str, embed, incremental: bool | None = None, changed: DataFrame | None = None) -> dict[str, int]:
    """Bring the vector table at path up to date with chunks (chunk_id, stem, text, ...): how many were added and deleted.

    What is gone, or whose stem is in changed (stem), is deleted; what is new or changed is embedded
    and added. incremental None: if there is a table. embed is a DataFrame function that adds
    ``embedding``; rows where it is null are left out, and so are tried again next time.
    """
    spark = chunks.sparkSession
    held = tables.read(spark, path)
    incremental = held is not None if incremental is None else incremental and held is not None
    if not incremental:
        made = embed(chunks).filter("embedding IS NOT NULL")
        before = held.count() if held is not None else 0
        tables.write(made, path)
        return {"added": tables.read(spark, path).count(), "deleted": before}
    changed = changed.select("stem").distinct() if changed is not None else spark.createDataFrame([], "stem string")
    kept = held.join(chunks.select("chunk_id"), "chunk_id", "left_semi").join(changed, "stem", "left_anti")
    fresh = chunks.join(kept.select("chunk_id"), "chunk_id", "left_anti")
    if not fresh.take(1) and held.count() == kept.count():
        return {"added": 0, "deleted": 0}
    before, stays = held.count(), kept.count()
    tables.write(kept.unionByName(embed(fresh).filter("embedding IS NOT NULL"), allowMissingColumns=True), path)
    return {"added": tables.read(spark, path).count() - stays, "deleted": before - stays}


def search_vectors(vectors: DataFrame, query: list[float], k: int = 10, key: str = "chunk_id") -> DataFrame:
    """key, score = 1 / (1 + squared distance), rank of the k nearest vectors; ties to the smaller key."""
    one = F.array(*[F.lit(float(x)) for x in query])
    gap = F.zip_with(F.col("embedding").cast("array<double>"), one, lambda a, b: (a - b) * (a - b))
    scored = vectors.select(key, F.round(1 / (1 + F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x)), 6).alias("score"))
    best = scored.filter("score IS NOT NULL").orderBy(F.col("score").desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def remove(spark: SparkSession, path: str, stem: str, key: str = "chunk_id") -> int:
    """Take a document's chunks out of the vector table and the index's texts at path; how many it had.

    Terms keep their postings and document frequencies until the next build.
    """
    gone = F.regexp_replace(F.col(key), "_[^_]*_[^_]*$", "") == stem
    removed = 0
    vectors = tables.read(spark, f"{path}/vectors")
    if vectors is not None:
        removed = vectors.filter(F.col("stem") == stem).count()
        if removed:
            tables.write(vectors.filter(F.col("stem") != stem), f"{path}/vectors")
    texts = tables.read(spark, f"{path}/keyword/texts")
    if texts is not None:
        own = texts.filter(gone).count()
        if own:
            tables.write(texts.filter(~gone), f"{path}/keyword/texts")
        removed = max(removed, own)
    return removed
