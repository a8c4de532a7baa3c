"""Token-id files in patched frame-of-reference blocks, and their reader."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, without_collector

BLOCK = 128
#: The width of a block holds this share of its ids; the others are exceptions.
PERCENTILE = 0.9
END_ID = 2
#: Words of a generation of a worker's cache; it keeps two, about 110 MB each.
CACHE_WORDS = 800_000
#: Tokens after which a file image is closed.
IMAGE_TOKENS = 1 << 18
MAGIC = b"DKTK"
_HEAD = struct.Struct("<4sIQIQQ")  # magic, documents, tokens, blocks, shard, place of the first token in the shard
_EXCEPTION = 5  # bytes: position, high part


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode_image(ids: np.ndarray, lengths: np.ndarray, doc_ids: list | None = None, shard: int = 0, first: int = 0) -> bytes:
    """A file image: head, document lengths, document ids (a bit each for null ones), block index, blocks.

    A block of BLOCK ids subtracts its minimum, keeps PERCENTILE's width of low bits of all, and
    lists the ids that are wider as (position, high part). The index has each block's start.
    """
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, dtype=np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n_blocks, BLOCK)
    least = rows.min(axis=1, initial=2**32 - 1) if n_blocks else np.zeros(0, np.uint32)
    rest = rows - least[:, None]
    at = int(PERCENTILE * (BLOCK - 1))
    width = _bit_length(np.partition(rest, at, axis=1)[:, at]) if n_blocks else np.zeros(0, np.int64)
    high = (rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    which, position = np.nonzero(high)
    n_exc = np.bincount(which, minlength=n_blocks)
    packed = BLOCK // 8 * width
    size = 7 + packed + _EXCEPTION * n_exc
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    head = np.zeros((n_blocks, 7), dtype=np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5:] = width, n_exc.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[start[:, None] + np.arange(7)] = head
    for w in np.unique(width[width > 0]):
        some = np.flatnonzero(width == w)
        size_type = ">u2" if w <= 16 else ">u4"
        low = (rest[some] & np.uint32((1 << int(w)) - 1)).astype(size_type)
        bits = np.unpackbits(low.view(np.uint8).reshape(len(some), BLOCK, -1), axis=2)[:, :, -int(w):]
        out[(start[some] + 7)[:, None] + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(some), -1), axis=1)
    if len(which):
        rank = np.arange(len(which)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        where = (start + 7 + packed)[which] + _EXCEPTION * rank
        out[where] = position
        out[where[:, None] + np.arange(1, 5)] = high[which, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    names = [None] * len(lengths) if doc_ids is None else doc_ids
    known = np.packbits(np.array([x is not None for x in names], dtype=np.uint8)).tobytes()
    head_bytes = _HEAD.pack(MAGIC, len(lengths), len(ids), n_blocks, shard, first)
    return b"".join([head_bytes, lengths.astype("<u4").tobytes(), np.array([x or 0 for x in names], dtype="<i8").tobytes(), known, start.astype("<u8").tobytes(), out.tobytes()])


def _parts(image: bytes):
    """(lengths, document ids, tokens, shard, first, block starts, blocks); ValueError if it is no whole image."""
    if image[:4] != MAGIC or len(image) < _HEAD.size:
        raise ValueError("not a token file")
    _, n_docs, n_tokens, n_blocks, shard, first = _HEAD.unpack_from(image)
    at = _HEAD.size
    known_at, index_at = at + 12 * n_docs, at + 12 * n_docs + -(-n_docs // 8)
    if len(image) < index_at + 8 * n_blocks or n_blocks != -(-n_tokens // BLOCK):
        raise ValueError("a token file that is cut off")
    lengths = np.frombuffer(image, "<u4", n_docs, at)
    names = np.frombuffer(image, "<i8", n_docs, at + 4 * n_docs).tolist()
    known = np.unpackbits(np.frombuffer(image, np.uint8, -(-n_docs // 8), known_at), count=n_docs).tolist()
    start = np.frombuffer(image, "<u8", n_blocks, index_at).astype(np.int64)
    body = np.frombuffer(image, np.uint8, offset=index_at + 8 * n_blocks)
    if n_blocks and start[-1] + 7 > len(body):
        raise ValueError("a token file that is cut off")
    return lengths, [x if k else None for x, k in zip(names, known, strict=True)], n_tokens, shard, first, start, body


def decode_blocks(body: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start there, a row each."""
    head = body[start[:, None] + np.arange(7)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, n_exc = head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 5:]).view("<u2").ravel().astype(np.int64)
    rows = np.zeros((len(start), BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        some = np.flatnonzero(width == w)
        raw = body[(start[some] + 7)[:, None] + np.arange(BLOCK // 8 * w)]
        size = 2 if w <= 16 else 4
        bits = np.zeros((len(some), BLOCK, 8 * size), dtype=np.uint8)
        bits[:, :, -int(w):] = np.unpackbits(raw, axis=1).reshape(len(some), BLOCK, int(w))
        rows[some] = np.packbits(bits, axis=2).view(f">u{size}").reshape(len(some), BLOCK)
    if n_exc.any():
        which = np.repeat(np.arange(len(start)), n_exc)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        where = (start + 7 + BLOCK // 8 * width)[which] + _EXCEPTION * rank
        high = np.ascontiguousarray(body[where[:, None] + np.arange(1, 5)]).view("<u4").ravel()
        rows[which, body[where]] |= (high.astype(np.uint64) << width[which].astype(np.uint64)).astype(np.uint32)
    return rows + least[:, None]


def decode_image(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, document lengths) of a whole image."""
    lengths, _, n_tokens, _, _, start, body = _parts(image)
    try:
        ids = decode_blocks(body, start).ravel()[:n_tokens] if len(start) else np.zeros(0, np.uint32)
    except IndexError as e:
        raise ValueError("a token file that is cut off") from e
    return ids.astype("<u4"), lengths.astype(np.int64)


def documents_of(image: bytes) -> tuple[list, int, int]:
    """(document ids, shard, place of the first token in the shard) of an image."""
    _, names, _, shard, first, _, _ = _parts(image)
    return names, shard, first


def read_range(image: bytes, first: int, last: int) -> np.ndarray:
    """Ids first to last - 1 of an image; only their blocks are read, found by the index."""
    _, _, n_tokens, _, _, start, body = _parts(image)
    first, last = max(0, first), min(last, n_tokens)
    if first >= last:
        return np.zeros(0, np.uint32)
    from_block, to_block = first // BLOCK, -(-last // BLOCK)
    ids = decode_blocks(body, start[from_block:to_block]).ravel()
    return ids[first - from_block * BLOCK : last - from_block * BLOCK]


_FILES = "shard long, n_tokens long, image binary"


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, CACHE_WORDS).ids
        end = np.array([end_id], dtype="<u4").tobytes()
        shard, first = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            image = encode_image(ids, np.array([len(p) // 4 for p in parts], dtype=np.uint32), doc_ids, shard, first)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], ["shard", "n_tokens", "image"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), (t.as_py() for t in batch.column("text")), strict=True):
                with without_collector():
                    parts.append((ids_of(text) if text else b"") + end)
                doc_ids.append(doc_id)
                held += len(parts[-1]) // 4
                if held >= IMAGE_TOKENS:
                    yield close()
                    first += held
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The table of file images of all documents of docs, in ascending doc_id order (nulls first).

    Rows are (shard, n_tokens, image): shards ascend with doc_id. An image says which documents it
    holds, of which shard, and which token of the shard is its first, so it can be read alone. Images
    lie in the shared folder, written by Spark, so any store will do. Null and empty texts are one end_id.
    Repeated doc_ids are separate documents, by text.
    """
    spark = docs.sparkSession
    common.ship(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.stash(ranged.mapInArrow(_write(tokenizer, end_id), _FILES), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column("image"):
            image = cell.as_py()
            ids, lengths = decode_image(image)
            doc_ids, shard, first = documents_of(image)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(ends), shard)), pa.array(first + starts), pa.array(lengths), pa.array(crcs, pa.int64())],
                ["doc_id", "shard", "inside", "n_tokens", "ids_crc32"],
            )


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the images alone.

    Images that are cut off or none raise ValueError. A shard's first position is the sum of the shards before it; there are as many shards as
    partitions, so that sum is over a bounded number of rows and is broadcast.
    """
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    found = files.select("image").mapInArrow(_read, "doc_id long, shard long, inside long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
