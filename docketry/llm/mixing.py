"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights by the rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: A source, and so a document, gives at most so many times its size.
MAX_PASSES = 3
#: Least cells of virtual time up to 1; queues fill them evenly. The cell in which the budget ends is sorted row by row.
CELLS = 4096


def word_count(text) -> "F.Column":
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: src_no (by code point, null last), source_size, target.

    All sources together share the sum of all sizes by weight. A target stops at MAX_PASSES times
    its source's size and the excess is dealt again by weight: with sources in order of
    cap / weight, the level of each position is what is left per weight unit after capping all
    before it, and the first source whose cap reaches that level fixes it for all.
    The windows here see one row per source, not documents.
    """
    n = len(WEIGHTS)
    ranked = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("src_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("src_no") - 1) % n + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(MAX_PASSES)))
    )
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("src_no"))
    everything = Window.partitionBy()
    levelled = (
        ranked.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("rest"))
        .withColumn("pos", F.row_number().over(order))
    )
    free = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("pos"))
    return (
        levelled.withColumn("at", F.min_by("level", free).over(everything))
        .select("source", "src_no", "source_size", F.least(F.col("cap"), F.col("at") * F.col("weight")).alias("target"))
    )


def _sized(docs: DataFrame, *more: "F.Column") -> DataFrame:
    """rid, _id, size, source, h of every row, and more; written, so that rids and hashes stay."""
    sized = docs.select(F.col("doc_id").alias("_id"), word_count(F.col("text")).alias("size"), "source", *more)
    return common.stash(sized.withColumn("h", common.shuffle_hash(F.col("_id"))).withColumn("rid", F.monotonically_increasing_id()), "mix-rows")


def _allot(sized: DataFrame) -> DataFrame:
    """sized with source_size, target and taken. Texts are not among its columns, and nothing here sends any."""
    n, budget = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = common.small(common.stash(source_targets(sized), "mix-targets"))
    queued = (
        sized.join(targets.withColumnRenamed("source", "_source"), sized.source.eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("bucket", F.shiftright("h", 32 - common.bucket_bits(n)).cast("int"))
    )
    queued = common.stash(common.before(queued, ["src_no"], "bucket", ["h", "_id", "size"], "size", "ahead"), "mix-queues")
    begin = F.col("turn") * F.col("source_size") + F.col("ahead")
    cells = CELLS << max(0, common.bucket_bits(n) - common.LEAST_BUCKET_BITS)
    passes = (
        queued.filter((F.col("size") > 0) & (F.col("target") > 0))
        .select("rid", "src_no", "h", "_id", "size", "target", "source_size", "ahead", F.explode(F.array(*[F.lit(p) for p in range(MAX_PASSES)])).alias("turn"))
        .filter(begin < F.col("target"))
        .withColumn("part", F.least(F.col("size"), F.floor(F.col("target") - begin)))
        .withColumn("finish", F.least(F.lit(1.0), (begin + F.col("size")) / F.col("target")))
        .withColumn("cell", F.floor(F.col("finish") * cells).cast("int"))
    )
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = passes.groupBy("cell").agg(F.sum("part").alias("words")).withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    # The one cell in which the budget ends, and whether the budget ends at all.
    end = sums.filter((F.col("start") < budget) & (F.col("start") + F.col("words") > budget)).select("cell", "start").first()
    last, start = (end.cell, end.start) if end else (cells + 1, 0)
    inside = Window.partitionBy("cell").orderBy("finish", "src_no", "h", "_id", "size", "turn").rowsBetween(Window.unboundedPreceding, -1)
    left = budget - start - F.coalesce(F.sum("part").over(inside), F.lit(0))
    cut = passes.filter(F.col("cell") == last).select("rid", F.greatest(F.lit(0), F.least(F.col("part"), left)).cast("long").alias("part"))
    taken = passes.filter(F.col("cell") < last).select("rid", "part").unionByName(cut).groupBy("rid").agg(F.sum("part").alias("taken"))
    return queued.join(taken, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The mix: every row of docs with its size, its source's target and the words taken of it.

    Each source is a queue of its documents in shuffled order, repeated up to MAX_PASSES times. A
    document's virtual finish time is its queue's running words over the source's target, so every
    queue is served at its target's rate and reaches its target at time 1; the document that is
    being served then is cut there and finishes with time 1. Rows are ranged by finish time into
    cells, cells are summed in order, and the mix is truncated where the sum of all sizes is reached.
    Cells and queue buckets grow in number with the rows, so that each stays small.

    Null text counts as empty (size 0, nothing taken). A null source is a source of its own, ranked
    last. Null or repeated doc_ids are separate rows that share a shuffle position; ties fall to
    doc_id, then size. An empty table gives an empty result. Columns of docs named in keep are
    carried along; others, whatever their names, are not read. Reruns give equal results.
    """
    sized = _sized(docs, *[F.col(k).alias(f"_keep_{k}") for k in keep if k != "source"])
    return _allot(sized).select(
        F.col("_id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"), "taken",
        *[F.col("source" if k == "source" else f"_keep_{k}").alias(k) for k in keep],
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, a row as often as the mix takes it (a cut one whole).

    Nulls, ties, empty tables and clashing names are as for mix(). Texts are sent once: to meet
    what was taken of them.
    """
    rows = _sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = _allot(rows.drop("row")).filter("taken > 0").select("rid", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("turns"))
    taken = taken.hint("merge")  # as many rows as documents: never broadcast, however small the table looks
    return rows.select("rid", "row").join(taken, "rid").select("row", F.explode(F.sequence(F.lit(1), F.col("turns"))).alias("turn")).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src_no FROM sized GROUP BY source),
ranked AS (
  SELECT *, ((src_no - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM src),
levelled AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, src_no) AS pos,
    ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, src_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, src_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
lvl AS (SELECT level AS full_level FROM levelled WHERE cap / weight >= level ORDER BY pos LIMIT 1),
targets AS (SELECT source, src_no, source_size, least(cap, full_level * weight) AS target FROM levelled, lvl),
queued AS (
  SELECT s.doc_id, s.size, s.h, t.src_no, t.source_size, t.target, row_number() OVER () AS rid,
    coalesce(sum(size) OVER (PARTITION BY t.src_no ORDER BY h, s.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, least(size, floor(target - (turn * source_size + ahead)))::BIGINT AS part, least(1.0::DOUBLE, (turn * source_size + ahead + size)::DOUBLE / target) AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS turn) x WHERE size > 0 AND target > 0 AND turn * source_size + ahead < target),
run AS (
  SELECT rid, part, coalesce(sum(part) OVER (ORDER BY finish, src_no, h, doc_id, size, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM passes),
took AS (
  SELECT rid, sum(greatest(0, least(part, (SELECT sum(size) FROM sized) - ahead)))::BIGINT AS taken FROM run GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN took USING (rid)
"""
