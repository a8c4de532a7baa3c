"""Toxicity by non-negative positive-unlabelled learning over hashed words and word beginnings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import Remembered

#: Rows with this remainder of crc32(doc_id) are held out.
FOLDS = 5
#: Bounds of the samples that the classifier is fitted on: toxic rows, and rows whose labels, if any, it does
#: not see; and of the word slots that either may have, so that long texts are bounded too.
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 14_000
MAX_POSITIVE_SLOTS, MAX_UNLABELLED_SLOTS = 4_000_000, 9_000_000
HASH_BITS = 18
#: Learning: steps that choose words, steps that weigh the chosen ones, how many standard errors of
#: its slope at zero a word must beat to be chosen, and the ridge on chosen words.
CHOOSE_STEPS, WEIGH_STEPS, SPARSE, RIDGE = 150, 500, 7.0, 3e-5
#: A word in fewer toxic rows of the sample is not learned from.
LEAST_ROWS = 3
#: Letters that a word's beginning has; longer words share a slot by it.
BEGINNING = 4

#: Words of a generation of the cache of a task; it keeps two, about 10 MB each.
CACHE_WORDS = 100_000

_word = re.compile(r"\w+")


def slots_of(word: str) -> tuple[int, ...]:
    """Hash slots of a word and, if it is longer, of its beginning."""
    names = (word, f"{word[:BEGINNING]}-") if len(word) > BEGINNING else (word,)
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1) for n in names)


def word_slots(text: str | None) -> list[int]:
    """Hash slots of the distinct lower-case words of a whole text, and of their beginnings."""
    return sorted({slot for w in set(_word.findall((text or "").lower())) for slot in slots_of(w)})


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [word_slots(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("place"), pa.array(slots, pa.list_(pa.int32()))], ["positive", "place", "slots"])


class _Rows:
    """Sparse 0/1 rows over the slots in use, from all rows' slots on end and their lengths."""

    def __init__(self, slots: np.ndarray, lengths: np.ndarray, used: np.ndarray) -> None:
        at = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        at[used] = np.arange(len(used), dtype=np.int32)
        slot = at[slots]
        kept = slot >= 0
        self.slot = slot[kept]
        self.owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[kept]
        self.n, self.width = len(lengths), len(used)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.slot], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, g[self.owner], self.width)


def _descend(rows: _Rows, n_pos: int, prior: float, steps: int, sparse: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal descent on the non-negative risk with logistic loss.

    Risk = prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)). Where
    the second part would be negative the step undoes it instead, as published for this estimator.
    """
    n_unl = rows.n - n_pos
    share = np.r_[np.full(n_pos, prior / n_pos), np.full(n_unl, 1 / n_unl)]
    probe = np.ones(rows.width + 1)
    for _ in range(12):
        probe /= np.linalg.norm(probe)
        seen = share * (rows.times(probe[:-1]) + probe[-1])
        probe = np.r_[rows.back(seen), seen.sum()]
    rate = 1 / (0.25 * np.linalg.norm(probe) + ridge + 1e-12)
    now = np.r_[np.zeros(rows.width), -np.log((1 - prior) / prior)]
    ahead, pace = now.copy(), 1.0
    for _ in range(steps):
        out = rows.times(ahead[:-1]) + ahead[-1]
        prob = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
        loss0 = np.logaddexp(0, out)
        if loss0[n_pos:].mean() - prior * loss0[:n_pos].mean() >= 0:
            g = np.r_[np.full(n_pos, -prior / n_pos), prob[n_pos:] / n_unl]
        else:
            g = np.r_[prior * prob[:n_pos] / n_pos, -prob[n_pos:] / n_unl]
        step = ahead - rate * (np.r_[rows.back(g), g.sum()] + ridge * np.r_[ahead[:-1], 0])
        step[:-1] = np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - rate * sparse, 0)
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, now, pace = step + (pace - 1) / quicker * (step - now), step, quicker
    return now[:-1], float(now[-1])


def fit(slots: np.ndarray, lengths: np.ndarray, n_pos: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights by slot and the bias: words are chosen under an L1 penalty, then weighed without it.

    slots holds the slots of all rows on end, the n_pos positive rows first.
    """
    common_slots = np.bincount(slots[: int(lengths[:n_pos].sum())], minlength=1 << HASH_BITS)
    used = np.flatnonzero(common_slots >= min(LEAST_ROWS, n_pos))
    out = np.zeros(1 << HASH_BITS)
    pooled = np.bincount(slots, minlength=1 << HASH_BITS)[used] / len(lengths)
    error = 0.5 * prior * np.sqrt(pooled / n_pos)
    w, bias = _descend(_Rows(slots, lengths, used), n_pos, prior, CHOOSE_STEPS, SPARSE * error, 0.0)
    used = used[w != 0]
    w, bias = _descend(_Rows(slots, lengths, used), n_pos, prior, WEIGH_STEPS, np.zeros(len(used)), RIDGE)
    out[used] = w
    return out, bias


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows outside the held-out fold: (positive boolean, place long, text) samples, and label counts.

    The samples are the rows with the least hash of doc_id (their place): MAX_POSITIVE toxic ones as
    confirmed examples, and MAX_UNLABELLED of all texts, as unlabelled. The class prior is that of
    all labelled rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold)
    open_rows = docs.select("doc_id", F.xxhash64("doc_id").alias("place")).filter(F.col("doc_id").isNotNull()).filter(fold)
    by = [F.col("place"), F.col("doc_id")]
    toxic = open_rows.join(marks, "doc_id").filter("toxic = 1").select("doc_id", "place").orderBy(*by).limit(MAX_POSITIVE)
    plain = open_rows.orderBy(*by).limit(MAX_UNLABELLED)
    chosen = toxic.withColumn("positive", F.lit(True)).unionByName(plain.withColumn("positive", F.lit(False))).distinct()
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("positive", "place", "text")
    counts = marks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0)).alias("toxic"))
    return rows, counts


class _Weights(Remembered):
    """Word -> its (slot, weight) pairs that count, remembered."""

    def __init__(self, by_slot: dict[int, float]) -> None:
        super().__init__(CACHE_WORDS)
        self.by_slot = by_slot

    def make(self, word: str) -> tuple[tuple[int, float], ...]:
        return tuple((slot, self.by_slot[slot]) for slot in slots_of(word) if slot in self.by_slot)


def scorer(by_slot: dict[int, float], bias: float):
    common.only("toxicity")
    words = _Weights(by_slot)

    def score(text: str | None) -> float:
        known = dict(chain.from_iterable(map(words.__getitem__, set(_word.findall((text or "").lower())))))
        total = bias + sum(known[s] for s in sorted(known))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    return score


def _scores(by_slot: dict[int, float], bias: float, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(by_slot, bias)
        for batch in batches:
            out = pa.array([score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], out], [*kept, "score"])

    return run


def _clean(by_slot: dict[int, float], bias: float):
    """Rows whose text scores below one half; the others do not go back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(by_slot, bias)
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < 0.5 for t in batch.column("text")], pa.bool_()))

    return run


def _within(rows: DataFrame, positive: bool, most: int) -> DataFrame:
    """Rows of one sample by place, as many as have most slots together."""
    places = rows.filter(F.col("positive") == positive).select("place", F.size("slots").alias("n")).orderBy("place").collect()
    fits = np.cumsum([r.n for r in places]) <= most
    last = places[int(fits.sum()) - 1].place if fits.any() else -(2**63)
    return rows.filter((F.col("positive") == positive) & (F.col("place") <= last))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float]:
    """Non-zero weights by slot and the bias. Without a toxic row: no weights, prior of one half of
    a percent. Only the bounded samples' word slots come to the driver."""
    common.ship(docs.sparkSession)
    rows, counts = training_rows(docs, labels)
    n, toxic = counts.first()
    if not toxic:
        return {}, float(-np.log(199.0))
    rows = common.stash(rows.mapInArrow(_slots, "positive boolean, place long, slots array<int>"), "training-slots")
    got = _within(rows, True, MAX_POSITIVE_SLOTS).unionByName(_within(rows, False, MAX_UNLABELLED_SLOTS)).select("positive", "slots").toArrow().combine_chunks()
    common.release(rows)
    positive = got["positive"].to_numpy()
    n_pos = int(positive.sum())
    if not n_pos or n_pos == len(positive):
        return {}, float(-np.log(199.0))
    lists = got["slots"].chunk(0)
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    # An order that no partitioning changes: positive rows first, then by length and slots.
    order = sorted(range(len(positive)), key=lambda i: (not positive[i], offsets[i + 1] - offsets[i], zlib.crc32(values[offsets[i] : offsets[i + 1]])))
    lengths = np.diff(offsets)[order]
    slots = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in order])
    del got, lists, values
    prior = min(0.95, max(1e-3, toxic / n))
    w, bias = fit(slots, lengths, n_pos, prior)
    return {int(i): float(w[i]) for i in np.flatnonzero(w)}, bias


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns of docs (those in keep, or all) and ``score``: how likely the whole text is marked toxic.

    Null and empty texts get the score of no words. Labels without a document, null labels and
    documents without labels are allowed; with repeated labels the highest counts. Rows with null
    doc_ids are scored and never learned from. An empty table gives an empty result. Only the text
    enters a score; a column that is called score already is replaced.
    """
    weights, bias = train(docs, labels)
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = T.StructType([*[f for f in docs.schema if f.name in kept], T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(_scores(weights, bias, kept), schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    scored = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic.

    Nulls, repeated rows and empty tables are as for score_documents(); columns keep their names,
    whatever they are. A text is sent to Python once and comes back once.
    """
    weights, bias = train(docs, labels)
    more = [c for c in docs.columns if c != "text"]
    named = docs.select("text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in more]).alias("rest"))
    left = named.mapInArrow(_clean(weights, bias), named.schema)
    return left.select(*["text" if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])
