"""Mixture-controlled packing: deficit round-robin over source queues into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, without_collector

SEQUENCE = 1024
#: Tokens dealt in one round over all sources: the window whose mixture is controlled.
WINDOW_TOKENS = 64 * SEQUENCE
#: A queue is cut where its deficit has grown to a slice, so no source is dealt out token by token.
SLICE = 64
#: Bits behind the point of a quantum. All cuts are whole numbers, so every task finds the same ones.
FRACTION = 12
#: Queues whose totals every task gets; with more sources, sources share queues by a hash.
MOST_QUEUES = 4096
END_ID = 0

_TOKENS = "_key long, doc_id long, source string, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@cache
def _codec() -> tuple:
    """One compressor and decompressor per worker: making them costs more than a text's ids."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack_ids(ids: bytes) -> bytes:
    """Ids as compressed byte planes, as many as the highest id needs; the first byte is their number."""
    flat = np.frombuffer(ids, dtype="<u4")
    planes = max(1, -(-int(flat.max(initial=0)).bit_length() // 8))
    octets = flat.view(np.uint8).reshape(-1, 4)[:, :planes].T
    return bytes([planes]) + _codec()[0].compress(octets.tobytes())


def unpack_ids(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_codec()[1].decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u4").ravel()


def _tokenize(path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        for batch in batches:
            n, packed = [], []
            with without_collector():
                for text in (t.as_py() for t in batch.column("text")):
                    ids = (ids_of(text) if text else b"") + end
                    n.append(len(ids) // 4)
                    packed.append(pack_ids(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                ["_key", "doc_id", "source", "n_tokens", "ids"],
            )

    return run


class Queues(NamedTuple):
    """The queues in the order in which a round serves them: all tokens, quanta, and phases.

    The queues of a phase are served until they are empty before the next phase begins.
    """

    tokens: np.ndarray
    quantum: np.ndarray  # in units of 2 ** -FRACTION tokens
    phase: np.ndarray

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue (a column) that have been served before each round (a row)."""
        due = (rounds[:, None] * self.quantum[None, :] >> FRACTION) // SLICE * SLICE
        return np.minimum(due, self.tokens[None, :])

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round that serves a token of a queue."""
        quantum = self.quantum[queue]
        return -(-((token // SLICE + 1) * SLICE << FRACTION) // quantum) - 1

    def place(self, queue: np.ndarray, token: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """The place of a token of a queue, served in that round, in the packed order."""
        out = np.zeros(len(queue), dtype=np.int64)
        step = max(1, (1 << 20) // len(self.tokens))
        for at in range(0, len(queue), step):
            own, now = queue[at : at + step], rounds[at : at + step]
            before, after = self.served(now), self.served(now + 1)
            mine = self.phase[None, :] == self.phase[own][:, None]
            earlier = np.arange(len(self.tokens))[None, :] < own[:, None]
            total = np.where(mine, np.where(earlier, after, before), 0).sum(axis=1)
            total += np.where(self.phase[None, :] < self.phase[own][:, None], self.tokens[None, :], 0).sum(axis=1)
            out[at : at + step] = total + token[at : at + step] - before[np.arange(len(own)), own]
        return out


def queues_of(totals: list[tuple[str | None, int]], weights: dict | None) -> Queues:
    """Quanta: the target shares of WINDOW_TOKENS. Queues without a weight come after all others."""
    tokens = np.array([n for _, n in totals], dtype=np.int64)
    weight = tokens.astype(np.float64) if weights is None else np.array([float(weights.get(s, 0)) for s, _ in totals])
    phase = (weight <= 0).astype(np.int64)
    weight = np.where(phase == 1, tokens, weight)
    share = weight / np.maximum(np.bincount(phase, weight, 2), 1e-300)[phase]
    return Queues(tokens, np.maximum(np.floor(share * (WINDOW_TOKENS << FRACTION)).astype(np.int64), 1), phase)


def _pieces(queues: Queues):
    names = [f.split()[0] for f in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queue, ahead, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("queue", "ahead", "n_tokens"))
            doc, token = slices(ahead, n)
            rounds = queues.round_of(queue[doc], token)
            new = np.r_[True, (doc[1:] != doc[:-1]) | (rounds[1:] != rounds[:-1])]
            doc, token, rounds = doc[new], token[new], rounds[new]
            end = np.r_[token[1:], 0]
            last = np.r_[doc[1:] != doc[:-1], True]
            end[last] = (ahead + n)[doc[last]]
            at = queues.place(queue[doc], token, rounds)
            doc, start, at, length = by_sequence(doc, token - ahead[doc], at, end - token)
            crc, ids, held = [], None, -1
            for i, a, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                if i != held:
                    ids, held = unpack_ids(batch.column("ids")[i].as_py()), i
                crc.append(zlib.crc32(ids[a : a + m]))
            columns = [
                batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]),
                pa.array(at // SEQUENCE), pa.array(at % SEQUENCE), batch.column("source").take(pa.array(doc)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def slices(ahead: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of the first token that each document has in each slice of its queue."""
    first, last = ahead // SLICE, (ahead + n - 1) // SLICE
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, np.maximum((first[doc] + rank) * SLICE, ahead[doc])


def by_sequence(doc, start, at, length):
    """Runs of tokens at places of the packed order, cut where a sequence ends."""
    count = (at + length - 1) // SEQUENCE - at // SEQUENCE + 1
    which = np.repeat(np.arange(len(doc)), count)
    rank = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(at[which], (at[which] // SEQUENCE + rank) * SEQUENCE)
    end = np.minimum((at + length)[which], (begin // SEQUENCE + 1) * SEQUENCE)
    return doc[which], start[which] + begin - at[which], begin, end - begin


def pack(docs: DataFrame, tokenizer: str, weights: dict | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of SEQUENCE tokens; only the last sequence is short.

    Every document becomes its ids and end_id (null or empty text: end_id alone). The documents of
    a source, in shuffled order, are its queue. Round r gives every queue its quantum, its target
    share of WINDOW_TOKENS; what a round leaves undealt, less than a slice, is carried to the next
    as the queue's deficit. Documents are cut where a quantum ends. By the start of round r a queue
    has been served r quanta in whole slices, or is empty: a closed form, so deficits carry over
    windows and partitions without any state, and each task places its own documents. Inside a round
    the queues follow one another. So any WINDOW_TOKENS in a row, while no queue is empty, hold of
    every source its quantum to within SLICE times the number of queues and two.

    Target shares are the sources' shares of all tokens unless weights (source -> weight) are given;
    sources without a weight or with none above 0 are packed after all others, by their own shares.
    A null source is a queue of its own. Null and repeated doc_ids are kept as separate documents.
    An empty table gives no pieces. Only doc_id, source and text are read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    keyed = common.with_row_key(plain, "doc_id", "text", "pack-keyed").select("_key", "doc_id", "source", "text")
    tokens = common.stash(keyed.mapInArrow(_tokenize(tokenizer, end_id), _TOKENS), "pack-tokens", "uncompressed")  # ids are compressed
    rows = tokens.select("_key", "source", "n_tokens")
    if rows.select("source").distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES:
        if weights:
            raise ValueError(f"weights are for {MOST_QUEUES} sources at most")
        rows = rows.withColumn("source", F.pmod(F.xxhash64("source"), F.lit(MOST_QUEUES)).cast("string"))
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("source").asc_nulls_last()).collect()
    queues = queues_of([(r.source, r.n) for r in totals], weights)
    number = spark.createDataFrame([(i, r.source) for i, r in enumerate(totals)], "queue int, _source string")
    rows = rows.join(F.broadcast(number), rows.source.eqNullSafe(F.col("_source"))).withColumn("h", common.shuffle_hash(F.col("_key")))
    rows = rows.withColumn("bucket", F.shiftright("h", 32 - common.bucket_bits(sum(r.rows for r in totals))).cast("int"))
    placed = common.before(rows.select("_key", "queue", "n_tokens", "h", "bucket"), ["queue"], "bucket", ["h", "_key"], "n_tokens", "ahead")
    return tokens.join(placed.select("_key", "queue", "ahead"), "_key").select("doc_id", "source", "queue", "ahead", "n_tokens", "ids").mapInArrow(_pieces(queues), _PIECES)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
