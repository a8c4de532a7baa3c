"""Postings in packed form: the terms of many texts at once, dealt to parts by their words, and merged there.

A segment is a run of texts that a worker holds. Its terms and postings go to the shuffle as one
compressed piece a part, so that a posting moves as a few bytes, once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a segment, about; postings of a row of the index and terms of a batch, at most.
SEGMENT_WORDS, BLOCK, BATCH_TERMS, BATCH_POSTINGS = 1_000_000, 1 << 16, 20_000, 1 << 18
#: Texts and bytes that Spark sends a worker at once.
SENT = {"maxRecordsPerBatch": "500", "maxBytesPerBatch": "4m"}
PIECES = "part int, keys binary, size long, piece binary"
_SPREAD = 0x9E3779B1, 0x85EBCA6B


def _dealt(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    mixed = (first * np.uint64(_SPREAD[0]) + second * np.uint64(_SPREAD[1])) & np.uint64(0xFFFFFFFF)
    return ((mixed ^ (mixed >> np.uint64(15))) % np.uint64(parts)).astype(np.int64)


def part_of(term: str, parts: int) -> int:
    """The part that a term's postings are in."""
    first, _, second = term.partition(" ")
    told = [np.array([zlib.crc32(w.encode()) if w else 0], np.uint64) for w in (first, second)]
    return int(_dealt(*told, parts)[0])


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, as most of the higher ones are zero."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs, one run behind the other."""
    return np.repeat(starts - _starts(lengths)[:-1], lengths) + np.arange(int(lengths.sum()))


def _strings(array: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths in bytes and the bytes of an array without nulls."""
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    return np.diff(at), data.to_pybytes()[at[0]:at[-1]] if data is not None else b""


def _segment(held: list[pa.RecordBatch], base: int, parts: int, stop_words: Sequence[str]) -> Iterator[pa.RecordBatch]:
    keys = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
    lists = pa.chunked_array([b.column(1) for b in held])
    n = len(keys)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    told = pa.chunked_array([x.flatten() for x in lists.chunks], lists.type.value_type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(told.dictionary).to_numpy()
    vocabulary = told.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids, docs = rank[told.indices.to_numpy()], np.repeat(np.arange(n), lengths)
    if stop_words and len(ids):
        kept = ~pc.is_in(vocabulary, value_set=pa.array(stop_words, vocabulary.type)).to_numpy(zero_copy_only=False)[ids]
        ids, docs = ids[kept], docs[kept]
    # a term is a number: its first word, then nothing or its second one; sorted as the terms' text would be
    wide = len(order) + 1
    near = np.flatnonzero(docs[1:] == docs[:-1])
    found = np.concatenate([ids * wide * n + docs, (ids[near] * wide + ids[near + 1] + 1) * n + docs[near]])
    found.sort()
    runs = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.empty(0, np.int64)
    tfs = np.diff(np.append(runs, len(found)))
    codes, docs = np.divmod(found[runs], n)
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    counts = np.diff(np.append(begins, len(codes)))
    first, second = np.divmod(codes[begins], wide)
    sums = np.array([zlib.crc32(w.encode()) for w in vocabulary.to_pylist()] + [0], np.uint64)
    part = _dealt(sums[first], sums[second - 1], parts)  # no second word: the last one, 0
    order = np.argsort(part.astype(np.uint16), kind="stable")
    counts_in, begins_in = counts[order], begins[order]
    at = _gathered(begins_in, counts_in)
    docs, tfs = docs[at], tfs[at]
    gaps = np.diff(docs, prepend=0)
    heads = _starts(counts_in)
    gaps[heads[:-1]] = docs[heads[:-1]]
    names = pc.binary_join_element_wise(vocabulary.take(pa.array(first[order])), vocabulary.take(pa.array(second[order] - 1, mask=second[order] == 0)), " ", null_handling="skip")
    sizes, letters = _strings(names)
    byte_at, edges = _starts(sizes), np.searchsorted(part[order], np.arange(parts + 1))
    codec = pa.Codec("zstd", 3)
    stream = pa.BufferOutputStream()
    with pa.ipc.new_stream(stream, pa.schema([("key", keys.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([keys], ["key"]))
    rows = [((base + n) % parts, codec.compress(stream.getvalue(), asbytes=True), len(stream.getvalue()), struct.pack("<q", base))]
    for p in np.flatnonzero(np.diff(edges)):
        a, b = edges[p], edges[p + 1]
        x, y = heads[a], heads[b]
        planes = [_planes(v) for v in (sizes[a:b], counts_in[a:b], gaps[x:y], tfs[x:y])]
        whole = struct.pack("<qqq", base, b - a, y - x) + b"".join(planes) + letters[byte_at[a]:byte_at[b]]
        rows.append((int(p), None, len(whole), codec.compress(whole, asbytes=True)))
    for i in range(0, len(rows), 200):
        columns = zip(*rows[i:i + 200], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["part", "keys", "size", "piece"])


def pieces(parts: int, stop_words: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (key, words): PIECES of the texts' terms, and a row of keys a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held, words = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                words += len(batch.column(1).flatten())
            if words >= SEGMENT_WORDS:
                yield from _segment(held, base, parts, stop_words)
                base, held, words = base + sum(map(len, held)), [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from _segment(held, base, parts, stop_words)
        held = None
        pa.default_memory_pool().release_unused()

    return run


def merged(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over the PIECES of one part: a row for each BLOCK of a term's postings, terms ascending, and one for the keys (of that kind) of each segment."""
    types = {"part": pa.int32(), "term": pa.string(), "block": pa.int32(), "df": pa.int64(), "occurrences": pa.int64(), "texts": pa.list_(pa.int64()), "tfs": pa.list_(pa.int32()), "keys": pa.list_(kind)}

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[name].cast(t) if name in columns else pa.nulls(n, t) for name, t in types.items()], list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, segments = pa.Codec("zstd"), []
        for batch in batches:
            for part, keys, size, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys is None:
                    segments.append((part, size, piece))
                    continue
                held = pa.ipc.open_stream(codec.decompress(keys, size)).read_all().column(0).combine_chunks()
                base = struct.unpack("<q", piece)[0]
                ends = np.array([len(held)])
                yield rows(1, part=pa.array([part]), texts=_listed(np.arange(base, base + len(held)), ends), keys=_listed(held, ends))
        if not segments:
            return
        names, counts, docs, tfs = [], [], [], []
        for i, (_, size, piece) in enumerate(segments):
            segments[i] = segments[i][:1]
            whole = codec.decompress(piece, size, asbytes=True)
            base, terms, postings = struct.unpack_from("<qqq", whole)
            at = 24
            cut = []
            for length in (terms, terms, postings, postings):
                cut.append(_numbers(whole[at:at + 4 * length]))
                at += 4 * length
            lengths = cut[0]
            names.append(pa.LargeStringArray.from_buffers(terms, pa.py_buffer(_starts(lengths)), pa.py_buffer(whole[at:])))
            counts.append(cut[1])
            gaps = cut[2].astype(np.uint32).view(np.int32).astype(np.int64)
            summed, heads = np.cumsum(gaps), _starts(cut[1])[:-1]
            docs.append(base + summed - np.repeat(summed[heads] - gaps[heads], cut[1]))
            tfs.append(cut[3])
        part = segments[0][0]
        told = pa.chunked_array(names).combine_chunks().dictionary_encode()
        counts, docs, tfs = map(np.concatenate, (counts, docs, tfs))
        sorted_by = pc.sort_indices(told.dictionary).to_numpy()
        rank = np.empty(len(sorted_by), np.int64)
        rank[sorted_by] = np.arange(len(sorted_by))
        ranks = rank[told.indices.to_numpy()]
        order = np.lexsort((docs[_starts(counts)[:-1]], ranks))
        at = _gathered(_starts(counts)[:-1][order], counts[order])
        docs, tfs = docs[at], tfs[at]
        df = np.bincount(ranks, counts).astype(np.int64)
        heads = _starts(df)
        occurrences = np.add.reduceat(tfs, heads[:-1])
        terms = told.dictionary.take(pa.array(sorted_by))
        blocks = -(-df // BLOCK)
        of = np.repeat(np.arange(len(df)), blocks)
        block = np.arange(len(of)) - np.repeat(_starts(blocks)[:-1], blocks)
        lengths = np.minimum(BLOCK, df[of] - block * BLOCK)
        ends, a = np.cumsum(lengths), 0
        while a < len(of):
            before = ends[a] - lengths[a]
            b = int(min(max(np.searchsorted(ends, before + BATCH_POSTINGS), a + 1), a + BATCH_TERMS, len(of)))
            here = slice(before, ends[b - 1])
            row = of[a:b]
            yield rows(
                b - a, part=pa.array(np.full(b - a, part)), term=terms.take(pa.array(row)), block=pa.array(block[a:b]), df=pa.array(df[row]), occurrences=pa.array(occurrences[row]),
                texts=_listed(docs[here], lengths[a:b]), tfs=_listed(tfs[here], lengths[a:b]),
            )
            a = b
        pa.default_memory_pool().release_unused()

    return run


def _listed(values: np.ndarray | pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_starts(lengths), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))
