"""Exact top-k by inner product: MaxScore over blocks of queries and shards of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 5
SCALE = 256
EVERY = 50
#: Rows of a shard at most, and queries of a block on average, or fewer so as to have so many values; all bound a task's memory.
SHARD_ROWS, BLOCK_QUERIES, PACKET_VALUES = 8192, 4096, 1 << 22
#: Parts of the vectors at most. A query has k rows of each part to be merged, whatever the number of shards.
PARTS = 32
#: Rows of a posting block, which has bounds of its own.
POSTING_BLOCK = 4096
#: Postings of each end of a dimension that are kept by impact, and dimensions that a query begins with.
IMPACTS, SEED_TERMS = 32, 4
_LEAST, _MOST = -(2**63), 2**63 - 1


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of q with rows of v, of Python's integers where 64 bits may not do."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q.astype(object) @ v.T.astype(object)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class Postings:
    """A shard by dimension: the value of each row, bounds by block of rows, and the outermost rows.

    A dimension is a term. Its contribution to a query's score is not negative once the least that
    it can be in the shard is taken off, which is what MaxScore's bounds are about.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.columns = np.ascontiguousarray(v.T.astype(np.float64))
        self.cuts = list(range(0, len(ids), POSTING_BLOCK))
        self.high = np.maximum.reduceat(self.columns, self.cuts, axis=1)
        self.low = np.minimum.reduceat(self.columns, self.cuts, axis=1)
        self.top, self.bottom = self.high.max(axis=1), self.low.min(axis=1)
        order = np.argsort(self.columns, axis=1, kind="stable")
        self.least, self.most = order[:, :IMPACTS], order[:, -IMPACTS:]


class Best:
    """The k best (score, id) so far, and the score that a row must reach to be among them."""

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.scores, self.threshold = k, np.zeros(0, np.int64), np.zeros(0), -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.r_[self.ids, ids], np.r_[self.scores, scores]
        best = top(ids, scores, self.k)
        self.ids, self.scores = ids[best], scores[best]
        if len(best) == self.k:
            self.threshold = self.scores[-1]


def maxscore(w: np.ndarray, own: int, shard: Postings, k: int, best: Best | None = None) -> Best:
    """The k best rows of a shard, and of those in best if that is given, for one query, its own row aside.

    Rows that are outermost in the query's widest terms are scored first, for a threshold. Blocks
    follow by their bounds until none can reach it. In a block the essential terms are those
    without which a row cannot reach the threshold: the least widest ones are left out whose
    contributions sum to less. The essential postings are traversed for all rows of the block; the
    other terms are probed one by one, the widest first, for the rows that could still reach the
    threshold. Scores that reach it raise it. Rows that only equal it are kept, for ties.
    """
    best = best or Best(k)
    upper = np.maximum(w * shard.top, w * shard.bottom)
    spread = upper - np.minimum(w * shard.top, w * shard.bottom)
    terms = np.argsort(-spread, kind="stable")
    lead = terms[:SEED_TERMS]
    seeds = np.unique(np.where(w[lead, None] >= 0, shard.most[lead], shard.least[lead]))
    seeds = seeds[shard.rows[seeds] != own]
    best.add(shard.ids[seeds], w @ shard.columns[:, seeds])
    seen = np.zeros(len(shard.ids), dtype=bool)
    seen[seeds] = True
    seen[shard.rows == own] = True
    bounds = np.maximum(w[:, None] * shard.high, w[:, None] * shard.low)
    floor = upper.sum() - spread.sum()
    tail = np.r_[np.cumsum(spread[terms][::-1])[::-1], 0.0]  # what the terms from here on contribute at most
    total = bounds.sum(axis=0)
    for b in np.argsort(-total, kind="stable").tolist():
        if total[b] < best.threshold:
            break
        at = shard.cuts[b]
        block = slice(at, min(at + POSTING_BLOCK, len(shard.ids)))
        n = max(1, int(np.argmax(tail < best.threshold - floor)) if best.threshold > -np.inf else len(terms))
        essential, other = terms[:n], terms[n:]
        partial = w[essential] @ shard.columns[essential, block]
        rest = bounds[other, b].sum()
        alive = np.flatnonzero((partial + rest >= best.threshold) & ~seen[block])
        partial = partial[alive]
        for t in other.tolist():
            if not len(alive):
                break
            partial = partial + w[t] * shard.columns[t, at + alive]
            rest -= bounds[t, b]
            go = partial + rest >= best.threshold
            if not go.all():
                alive, partial = alive[go], partial[go]
        if len(alive):
            best.add(shard.ids[at + alive], partial)
    return best


class Block:
    """Queries, and the k best rows for each of them in the shards that the block has met.

    All sums are of integers below 2 ** 53 and so are exact in doubles; where they may be larger
    all rows of a shard are scored in Python's integers, and ``large`` has the best of these shards.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.q, self.k = ids, rows, q, k
        self.w, self.most = q.astype(np.float64), _most(q)
        self.best, self.large = [Best(k) for _ in ids], [[] for _ in ids]

    def meet(self, shard: Shard) -> None:
        if 4 * max(1.0, self.most) * max(1.0, shard.most) * max(1, self.q.shape[1]) < 2**53:
            for i, best in enumerate(self.best):
                maxscore(self.w[i], self.rows[i], shard.postings(), self.k, best)
            return
        for i, large in enumerate(self.large):
            other = np.flatnonzero(shard.rows != self.rows[i])
            scores = exact_scores(self.q[i : i + 1], shard.v[other])[0].tolist()
            found = zip(scores, shard.ids[other].tolist(), strict=True)
            self.large[i] = sorted([*large, *found], key=lambda x: (-x[0], x[1]))[: self.k]

    def found(self) -> Iterator[tuple]:
        """(query row, query id, vector id, score, exact): exact has what is beyond the ends of 64 bits, in an order of strings."""
        for row, query, best, large in zip(self.rows.tolist(), self.ids.tolist(), self.best, self.large, strict=True):
            yield from ((row, query, v, int(x), "") for v, x in zip(best.ids.tolist(), best.scores.tolist(), strict=True))
            yield from ((row, query, v, min(max(x, _LEAST), _MOST), "" if _LEAST < x < _MOST else f"{x + 2**200:051x}") for x, v in large)


def _most(v: np.ndarray) -> float:
    return float(np.abs(v.astype(np.float64)).max(initial=0))


class Shard:
    """Vectors that blocks of queries meet."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.rows, self.v, self.most = ids, rows, v, _most(v)
        self._postings = None

    def postings(self) -> Postings:
        if self._postings is None:
            self._postings = Postings(self.ids, self.rows, self.v)
        return self._postings


def _matrix(rows: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, keys = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
    vectors = rows.column("v")
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return ids, keys, flat.reshape(len(ids), width)
    out = np.zeros((len(ids), width), dtype=np.int64)  # a component that is missing counts as 0
    at = np.repeat(np.arange(len(ids)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return ids, keys, out


def _narrow(v: np.ndarray) -> np.ndarray:
    """v in the least integers that hold it."""
    return next(v.astype(t) for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= v.min(initial=0) and v.max(initial=0) <= np.iinfo(t).max)


_PACKET = "key long, part int, ids binary, rows binary, v binary"


def _pack(width: int, most: int):
    """Rows of a part to packets of at most so many rows; key is a row of the packet, and so its own."""

    def packet(part: int, ids: np.ndarray, rows: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        values = [[int(rows[0])], [part], [ids.astype("<i8").tobytes()], [rows.astype("<i8").tobytes()], [_narrow(v).tobytes()]]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types, strict=True)], [c.split()[0] for c in _PACKET.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("maxscore")
        held, n, part = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                if n + some.num_rows > most:
                    yield packet(part, *map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
                ids, rows, v = _matrix(some, width)
                held.append((ids, rows, _narrow(v)))
                n += some.num_rows
        if held:
            yield packet(part, *map(np.concatenate, zip(*held, strict=True)))

    return run


def _unpack(batch: pa.RecordBatch, i: int, kind: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows, v = (batch.column(f"{kind}_{c}")[i].as_buffer() for c in ("ids", "rows", "v"))
    ids, rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
    return ids.copy(), rows.copy(), np.frombuffer(v, f"<i{v.size // (len(ids) * width)}").reshape(len(ids), width).astype(np.int64)


_FOUND = "query_row long, query_id long, vec_id long, score long, exact string"


def _search(width: int, k: int):
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("maxscore")
        blocks, key, shard = {}, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                query, vector = batch.column("q_key")[i].as_py(), batch.column("v_key")[i].as_py()
                if query not in blocks:
                    blocks[query] = Block(*_unpack(batch, i, "q", width), k)
                if vector != key:
                    key, shard = vector, Shard(*_unpack(batch, i, "v", width))
                blocks[query].meet(shard)
        for block in blocks.values():
            found = list(block.found())
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of every query's k best vectors by inner product.

    queries and vectors have (id long, v array<long>) and may have row, a unique long: a query does
    not find the vector of its own row. Rows are what counts: rows with one id, or equal in all, are
    queries and vectors of their own, each with its own ranks. Without row nothing is left out.
    Queries are dealt to blocks and vectors to at most PARTS parts by a hash, and packed. A task is
    a block and a part, and reads the part's shards one by one from the shuffled packets, which lie
    there once: neither side is copied for the other or passes through the driver (the work is all
    queries against all vectors). A query's threshold goes from shard to shard, and the parts' lists
    are merged by rank, ties to the smaller id. Null ids and null vectors take no part; of vectors
    of different lengths the missing components count as 0; without queries or vectors the result
    is empty. Scores beyond 64 bits are ranked as they are and written as the end of the range.
    """
    spark = vectors.sparkSession
    common.ship(spark)

    def taking_part(df: DataFrame, name: str, less: int) -> DataFrame:
        row = F.col("row") if "row" in df.columns else F.lit(less) - F.monotonically_increasing_id()
        return common.stash(df.filter("id IS NOT NULL AND v IS NOT NULL").select("id", row.cast("long").alias("row"), "v"), name)

    vectors, queries = taking_part(vectors, "vectors", -1), taking_part(queries, "queries", -(2**62))
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_q, width_q = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, width_q, 1)
    shard, block = (max(1, min(rows, PACKET_VALUES // width)) for rows in (SHARD_ROWS, BLOCK_QUERIES))
    parts, blocks = max(1, min(PARTS, -(-n // shard))), max(1, -(-n_q // block))

    def packed(df: DataFrame, parts: int, most: int, kind: str) -> DataFrame:
        rows = df.withColumn("part", F.pmod(F.xxhash64("id", "row"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
        packets = rows.mapInArrow(_pack(width, most), _PACKET).repartitionById(parts, F.col("part"))
        return packets.select(*[F.col(c).alias(f"{kind}_{c}") for c in ("key", "ids", "rows", "v")])

    # the hint keeps the smaller side from being broadcast; a task holds the block and streams the part
    met = packed(vectors, parts, shard, "v").hint("shuffle_replicate_nl").crossJoin(packed(queries, blocks, 2 * block, "q"))
    found = met.mapInArrow(_search(width, k), _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("exact").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_maxscore(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite).select("id", F.monotonically_increasing_id().alias("row"), F.transform("e", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))
    rows = common.stash(rows, "embedding-rows")
    return top_k(rows.filter(F.col("id") % EVERY == 0), rows)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
