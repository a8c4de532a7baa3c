"""SimHash near-duplicates: fingerprints, a trie self-join within a Hamming budget, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 4
BUDGET = 4
SEED = 42
#: First bit of each band, from the top. With more bands than BUDGET, two fingerprints within the
#: budget agree in one band at least.
BANDS = (0, 13, 26, 39, 52)
#: A bucket with more fingerprints is dealt to several tasks by pairs of trie children.
HOT_BUCKET = 200_000
CHILD_BITS = 5
#: Node pairs of at most so many fingerprints a side are compared one by one.
LEAF = 32
#: A fingerprint with more than one of so many rows is looked up by broadcast; so at most so many are.
HOT_SHARE = 1000
#: Pairs compared at a time; bounds memory.
CHUNK = 1 << 20

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[SHINGLE - 1 :].tolist() if len(words) >= SHINGLE else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=True)], dtype=">u8")
    octets = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.only("simhash")
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def trie_join(keys: np.ndarray, same_bits: int, budget: int = BUDGET) -> np.ndarray:
    """Labels of sorted, distinct 64-bit keys: equal where keys link within budget, as a chain.

    The binary trie of the keys is joined with itself: pairs of nodes go down together bit by bit,
    from the roots given by the top same_bits bits, add up the bits in which they differ, and end
    where that exceeds the budget. Nodes are ranges of the sorted keys. Small pairs are compared
    key by key. Labels are indexes into keys.
    """
    labels = np.arange(len(keys))
    if not len(keys):
        return labels
    top = keys >> np.uint64(64 - same_bits)
    lo = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    hi = np.r_[lo[1:], len(keys)]
    stack = [(lo, hi, lo, hi, 63 - same_bits, np.zeros(len(lo), dtype=np.int64))]
    while stack:
        a0, a1, b0, b1, bit, dist = stack.pop()
        if len(a0) > CHUNK // LEAF:
            cut = len(a0) // 2
            stack.append((a0[cut:], a1[cut:], b0[cut:], b1[cut:], bit, dist[cut:]))
            stack.append((a0[:cut], a1[:cut], b0[:cut], b1[:cut], bit, dist[:cut]))
            continue
        small = ((a1 - a0 <= LEAF) & (b1 - b0 <= LEAF)) | (bit < 0)
        labels = _leaves(keys, labels, a0[small], a1[small], b0[small], b1[small], budget)
        a0, a1, b0, b1, dist = (x[~small] for x in (a0, a1, b0, b1, dist))
        if not len(a0):
            continue
        own = (a0 == b0) & (a1 == b1)
        am, bm = _middle(keys, a0, a1, bit), _middle(keys, b0, b1, bit)
        other = ~own
        parts = [
            (a0, am, b0, bm, dist), (am, a1, bm, b1, dist), (a0, am, bm, b1, dist + 1),
            (am[other], a1[other], b0[other], bm[other], dist[other] + 1),
        ]
        a0, a1, b0, b1, dist = (np.concatenate(x) for x in zip(*parts, strict=True))
        go = (a0 < a1) & (b0 < b1) & (dist <= budget)
        if go.any():
            stack.append((a0[go], a1[go], b0[go], b1[go], bit - 1, dist[go]))
    return labels


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    up = np.uint64(bit + 1) if bit < 63 else None
    base = keys[lo] >> up << up if up is not None else np.zeros(len(lo), np.uint64)
    return np.clip(np.searchsorted(keys, base | np.uint64(1 << bit)), lo, hi)


def _leaves(keys, labels, a0, a1, b0, b1, budget):
    counts = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        past = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, past + CHUNK, side="right")))
        n = counts[at:to]
        which = np.repeat(np.arange(at, to), n)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = (b1 - b0)[which]
        i, j = a0[which] + rank // wide, b0[which] + rank % wide
        near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        if near.any():
            labels = unite(labels, i[near], j[near])
        at = to
    return labels


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking i with j, each the least index of its group."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = labels[labels]
            if (nxt == labels).all():
                break
            labels = nxt


def _rotate(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def _band_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star links (a, b) of each bucket in a partition."""
    whole = [f for f in frames if len(f)]
    if not whole:
        return
    rows = pd.concat(whole, ignore_index=True)
    for (band, pair), group in rows.groupby(["band", "pair"], sort=False):
        by, width = BANDS[band], ([*BANDS, 64][band + 1] - BANDS[band])
        fp = np.unique(group["fp"].to_numpy().view(np.uint64))
        keys = _rotate(fp, by)
        order = np.argsort(keys)
        labels = trie_join(keys[order], width)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        back = fp[order].view(np.int64)
        yield pd.DataFrame({"a": back[linked], "b": back[labels[linked]]})


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Star links (a, b) that connect all fingerprints (fp long, distinct) within BUDGET bits.

    Each fingerprint goes to one bucket a band; a bucket's trie is joined with itself in one task.
    Buckets with more than HOT_BUCKET fingerprints are dealt out as pairs of their trie's children,
    so that no link is lost and no task holds the whole bucket.
    """
    bands = F.array(*[
        F.struct(F.lit(i).alias("band"), F.expr(f"shiftrightunsigned(shiftleft(fp, {b}), {64 - ([*BANDS, 64][i + 1] - b)})").cast("int").alias("value"))
        for i, b in enumerate(BANDS)
    ])
    rows = distinct.select("fp", F.inline(bands))
    hot = rows.groupBy("band", "value").count().filter(F.col("count") > HOT_BUCKET).select("band", "value", F.lit(True).alias("hot"))
    rows = rows.join(hot, ["band", "value"], "left")
    turned = F.expr("CASE band " + " ".join(f"WHEN {i} THEN shiftleft(fp, {[*BANDS, 64][i + 1] % 64}) | shiftrightunsigned(fp, {(64 - [*BANDS, 64][i + 1]) % 64})" for i in range(len(BANDS))) + " END")
    child = F.shiftrightunsigned(turned, 64 - CHILD_BITS).cast("int")
    partners = F.filter(F.sequence(F.lit(0), F.lit((1 << CHILD_BITS) - 1)), lambda c: F.bit_count(c.bitwiseXOR(child)) <= BUDGET)
    pairs = F.when(F.col("hot"), F.transform(partners, lambda c: F.least(c, child) * 1000 + F.greatest(c, child))).otherwise(F.array(F.lit(-1)))
    dealt = rows.select("fp", "band", "value", F.explode(pairs).alias("pair"))
    return dealt.repartition("band", "value", "pair").select("fp", "band", "pair").mapInPandas(_band_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs.

    Fingerprints that differ in at most BUDGET bits link; component_id is the smallest doc_id that
    is reachable over links. Null and empty texts, and texts of white space, have fingerprint zero
    and link like any other. Rows with null or repeated doc_ids are rows of their own; component_id
    is null only where no member has an id. Only doc_id and text are read. An empty table gives an
    empty result. Copies meet in one fingerprint before any pair is looked at.
    """
    spark = docs.sparkSession
    common.ship(spark)
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")
    prints = common.stash(prints, "fingerprints")
    classes = common.stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(fingerprint_links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    merged = rooted.groupBy("root").agg(F.min("least").alias("component"))
    moved = rooted.join(merged, "root").select("fp", "component")
    component = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component"))
    final = common.stash(classes.join(moved, "fp", "left").select("fp", "n", component.alias("component_id")), "fingerprint-components")
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(final.filter(F.col("n") * HOT_SHARE > total).select("fp", "component_id"))
    usual = final.filter(F.col("n") * HOT_SHARE <= total).select("fp", "component_id")
    placed = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(usual, "fp"))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near-duplicates: the one with the smallest doc_id.

    Rows with null or repeated doc_ids are rows of their own, kept unless another row of their
    group is. Ids come before nulls; of rows with one id in a group any one, always the same, stays.
    """
    common.ship(docs.sparkSession)
    more = [c for c in docs.columns if c not in ("doc_id", "text")]  # in a struct: names are their own
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in more]).alias("rest"))
    keyed = common.with_row_key(rows, "doc_id", "text")
    place = F.struct(F.col("doc_id").isNull().alias("bare"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("rest").alias("rest"), "_key")
    prints = keyed.select(place.alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id struct<bare: boolean, id: long, rest: long, _key: long>, fp long")
    classes = common.stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(fingerprint_links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "least")
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least._key")
    return keyed.join(kept, "_key", "left_semi").select(*[F.col(f"rest.`{c}`" if c in more else c) for c in docs.columns])


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
