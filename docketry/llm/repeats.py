"""Removal of repeated passages: prefix-free parsing over rolling-hash triggers, exact to the byte.

A text is parsed into phrases. The trigger of a 100-byte window is the least rolling hash among its
TRIGGER-byte strings; a phrase is a run of windows with one trigger, with all their bytes, so that
phrases overlap by a window and no suffix of 100 bytes runs on into the next phrase. Equal windows
have equal triggers, so a window's repeats lie in phrases of that trigger. Three steps follow:

1. The dictionary: equal phrases are the same entry. All occurrences but the earliest are repeats
   from end to end. Only triggers with several entries (passages that begin, end or differ there),
   and phrases that meet their own trigger again, are looked into further.
2. The suffix array of those entries, to a depth of 100 bytes. Entries stand in the order of the
   parse, which is that of the corpus; so the first suffix of each rank is the earliest window, and
   all others are repeats.
3. The repeats of each document are laid over its bytes.

Phrases are equal if trigger and phrase hash are (128 bits), windows in step 2 if their bytes are.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 100
TRIGGER = 37
#: Windows that can share one occurrence of a trigger.
REACH = WINDOW - TRIGGER + 1
#: Text that is hashed at a time; bounds a worker's memory.
CHUNK_BYTES = 2 << 20
#: Deals of the shuffles for each shuffle partition.
DEALS = 8
#: Entries of one trigger beyond which entries are dealt out by content, and their windows one by one.
#: Found by counting the triggers of one document in HOT_SHARE: it decides who does the work, not what is found.
HOT_ENTRIES, HOT_SHARE = 20_000, 64

REPEAT, LOOK, LOOK_APART = 1, 2, 3

_rng = np.random.default_rng(20240229)
_LETTER, _OTHER = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, CHUNK_BYTES + (1 << 18)), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of a buffer."""

    def __init__(self, octets: np.ndarray, letter: np.ndarray = _LETTER) -> None:
        n = len(octets)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(letter[octets] * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def all(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width]


def phrases(octets: np.ndarray, ends: np.ndarray):
    """(trigger, phrase hash, first window, windows, meets its trigger again) of documents in a buffer.

    ends: where each document ends. No window crosses an end.
    """
    nothing = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool)]
    if len(octets) < WINDOW:
        return nothing
    rolling = Rolling(octets)
    grams = _mix(rolling.all(TRIGGER))
    least, width = grams, 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    valid = np.ones(len(least), dtype=bool)
    for back in range(1, WINDOW):  # windows that cross the end of a document
        at = ends - back
        valid[at[(at >= 0) & (at < len(valid))]] = False
    # ends of documents shorter than a window mark windows of the document before, which are
    # invalid anyway; windows that start in a short document cross its end.
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(begin)
    if not len(start):
        return nothing
    stop = np.flatnonzero(valid & np.r_[~valid[1:] | (least[1:] != least[:-1]), True]) + 1
    count = stop - start
    trigger = least[start]
    whole = _mix(rolling.of(start, stop - 1 + WINDOW) + count.astype(np.uint64))
    again = count > REACH
    met = np.zeros(len(start), dtype=np.int8)
    short = np.flatnonzero(~again)
    reach = count[short] + REACH - 1
    for j in range(int(reach.max(initial=0))):
        at = short[reach > j]
        met[at] += grams[start[at] + j] == trigger[at]
    return trigger, whole, start, count, again | (met > 1)


def _packed(arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpacked(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by keys (the most important one first), and which positions begin a new value."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def _chunks(batch: pa.RecordBatch):
    """Documents of a batch in order of their keys: (keys, starts, ends, buffer), CHUNK_BYTES each."""
    keys = batch.column("_key").to_numpy()
    text = batch.column("text")
    held, size, names = [], 0, []
    for i in np.argsort(keys, kind="stable"):
        raw = (text[int(i)].as_py() or "").encode("utf-8", "surrogatepass")
        held.append(raw)
        names.append(keys[i])
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield _buffer(names, held)
            held, size, names = [], 0, []
    if held:
        yield _buffer(names, held)


def _buffer(names, held):
    ends = np.cumsum([len(x) for x in held])
    return np.array(names), ends - [len(x) for x in held], ends, np.frombuffer(b"".join(held), dtype=np.uint8)


def _triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triggers of documents and how many entries of a batch have them."""
    common.only("repeats")
    for batch in batches:
        seen = [np.zeros(0, np.uint64)]
        for _, _, ends, octets in _chunks(batch):
            trigger, whole, *_ = phrases(octets, ends)
            order, new = _first_of_each(trigger, whole)
            seen.append(trigger[order[new]])
        trigger, n = np.unique(np.concatenate(seen), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(trigger.view(np.int64)), pa.array(n)], ["trigger", "n"])


def _parse(deals: int, hot: np.ndarray):
    """Documents to dealt-out dictionary entries, equal ones of a batch met already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("repeats")
        for batch in batches:
            parts = []
            for names, starts, ends, octets in _chunks(batch):
                trigger, whole, first, count, again = phrases(octets, ends)
                doc = np.searchsorted(ends, first, side="right")
                parts.append((trigger, whole, names[doc], first - starts[doc], count, again))
            if not parts:
                continue
            trigger, whole, key, first, count, again = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, new = _first_of_each(trigger, whole)
            out_deal, out_blob = [], []
            late = order[~new]
            if len(late):
                out_deal.append(int(key[late[0]] % deals))
                out_blob.append(_packed(("late", key[late], first[late].astype(np.int32), count[late].astype(np.int32))))
            kept = np.sort(order[new])
            apart = np.isin(trigger[kept], hot)
            deal = (np.where(apart, _mix(trigger[kept] ^ whole[kept]), trigger[kept]) % np.uint64(deals)).astype(np.int64)
            by = np.argsort(deal, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(deal[by]) != 0]) if len(by) else []
            for some in np.split(by, cuts[1:]) if len(by) else []:
                i = kept[some]
                out_deal.append(int(deal[some[0]]))
                out_blob.append(_packed(("entry", trigger[i], whole[i], key[i], first[i].astype(np.int32), count[i].astype(np.int32), again[i], apart[some])))
            yield pa.RecordBatch.from_arrays([pa.array(out_deal, pa.int32()), pa.array(out_blob, pa.binary())], ["deal", "blob"])

    return run


def _by_deal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """What each deal has been dealt; rows come in order of deals, and one deal is held at a time."""
    now, held = None, []
    for batch in batches:
        for deal, blob in zip(batch.column("deal").to_pylist(), batch.column("blob"), strict=True):
            if deal != now and held:
                yield now, held
                held = []
            now = deal
            held.append(_unpacked(blob.as_py()))
    if held:
        yield now, held


_MARKS = "_key long, first int, n int, kind int, deal int"


def _marks(key, first, n, kind, deal) -> pa.RecordBatch:
    rows = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(key, np.int64)), *[pa.array(np.broadcast_to(np.asarray(x, np.int32), rows).astype(np.int32)) for x in (first, n, kind, deal)]],
        [c.split()[0] for c in _MARKS.split(", ")],
    )


def _dictionary(deals: int):
    """Dealt-out entries to marks: repeats, and the earliest of entries that need a look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("repeats")
        for _, held in _by_deal(batches):
            for what, *arrays in held:
                if what == "late":
                    yield _marks(*arrays, REPEAT, 0)
            parts = [arrays for what, *arrays in held if what == "entry"]
            if not parts:
                continue
            trigger, whole, key, first, count, again, apart = (np.concatenate(x) for x in zip(*parts, strict=True))
            place = np.lexsort((first, key))
            trigger, whole, key, first, count, again, apart = (x[place] for x in (trigger, whole, key, first, count, again, apart))
            order, new = _first_of_each(trigger, whole)
            late, early = order[~new], order[new]
            yield _marks(key[late], first[late], count[late], REPEAT, 0)
            group = np.cumsum(np.r_[True, trigger[early][1:] != trigger[early][:-1]]) - 1
            early = early[(np.bincount(group)[group] > 1) | again[early] | apart[early]]
            yield _marks(key[early], first[early], count[early], np.where(apart[early], LOOK_APART, LOOK), (trigger[early] % np.uint64(deals)).astype(np.int32))

    return run


def _suffixes(deals: int):
    """Documents with their entries to look into: contexts dealt by trigger, or windows by content.

    Of equal windows dealt by content a batch sends the earliest; the others are repeats already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("repeats")
        for batch in batches:
            dealt: dict[int, list] = {}
            apart = []
            for i, key in enumerate(batch.column("_key").to_pylist()):
                raw = (batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
                rows = batch.column("looks")[i].values
                columns = (rows.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("first", "n", "kind", "deal"))
                for first, n, kind, deal in zip(*columns, strict=True):
                    context = raw[first : first + n - 1 + WINDOW]
                    if kind == LOOK:
                        dealt.setdefault(deal, []).append((key, first, context))
                    else:
                        octets = np.frombuffer(context, np.uint8)
                        apart.append((Rolling(octets).all(WINDOW), Rolling(octets, _OTHER).all(WINDOW), np.full(n, key), first + np.arange(n)))
            deals_out = list(dealt)
            blobs = [_packed(("contexts", *zip(*dealt[d], strict=True))) for d in deals_out]
            if apart:
                window, other, key, first = (np.concatenate(x) for x in zip(*apart, strict=True))
                place = np.lexsort((first, key))
                window, other, key, first = (x[place] for x in (window, other, key, first))
                order, new = _first_of_each(window, other)
                late, early = np.sort(order[~new]), np.sort(order[new])
                part = (_mix(window[early]) % np.uint64(deals)).astype(np.int64)
                for d in np.unique(part):
                    some = early[part == d]
                    deals_out.append(int(d))
                    blobs.append(_packed(("windows", window[some], other[some], key[some], first[some])))
                if len(late):
                    deals_out.append(int(key[late[0]] % deals))
                    blobs.append(_packed(("late", key[late], first[late])))
            yield pa.RecordBatch.from_arrays([pa.array(deals_out, pa.int32()), pa.array(blobs, pa.binary())], ["deal", "blob"])

    return run


def suffix_ranks(octets: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The rank of each position's suffix by its first depth bytes, equal ones alike; zeros follow the end.

    Ranks by eight bytes are doubled: a suffix is ordered by the rank of its first half and then of
    its second, and last by two halves that overlap.
    """
    n = len(octets)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = octets
    word = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + n]
    rank, known = _dense(word), 8
    while known < depth:
        step = min(known, depth - known)
        later = np.zeros(n, dtype=np.uint64)
        later[: n - step] = rank[step:] + np.uint64(1)
        rank, known = _dense(rank * np.uint64(n + 2) + later), known + step
    return rank


def _dense(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    ordered = values[order]
    rank = np.empty(len(values), dtype=np.uint64)
    rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]) if len(values) else 0
    return rank


def late_windows(keys: np.ndarray, firsts: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of the windows of contexts that an earlier one equals, by their suffix array."""
    place = np.lexsort((firsts, keys))
    lengths = np.array([len(contexts[i]) for i in place])
    ranks = suffix_ranks(np.frombuffer(b"".join([contexts[i] for i in place]), np.uint8))
    n = lengths - WINDOW + 1
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rank = ranks[np.repeat(np.cumsum(lengths) - lengths, n) + inside]
    late = np.ones(len(rank), dtype=bool)
    late[np.unique(rank, return_index=True)[1]] = False
    return np.repeat(keys[place], n)[late], (np.repeat(firsts[place], n) + inside)[late]


def _order_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of windows that an earlier entry has too."""
    common.only("repeats")
    for _, held in _by_deal(batches):
        late = [tuple(arrays) for what, *arrays in held if what == "late"]
        looked = [arrays for what, *arrays in held if what == "contexts"]
        if looked:
            keys, firsts = (np.concatenate([np.array(x[i]) for x in looked]) for i in (0, 1))
            late.append(late_windows(keys, firsts, [c for x in looked for c in x[2]]))
        apart = [arrays for what, *arrays in held if what == "windows"]
        if apart:
            window, other, key, first = (np.concatenate(x) for x in zip(*apart, strict=True))
            place = np.lexsort((first, key))
            order, new = _first_of_each(window[place], other[place])
            late.append((key[place[order[~new]]], first[place[order[~new]]]))
        if not late:
            continue
        key, first = (np.concatenate(x) for x in zip(*late, strict=True))
        if len(key):
            order = np.lexsort((first, key))
            key, first = key[order], first[order]
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (first[1:] != first[:-1] + 1)])
            yield _marks(key[begin], first[begin], np.diff(np.r_[begin, len(key)]), REPEAT, 0)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def lay(raw: bytes, first: np.ndarray, n: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes that no repeated window covers, how many are covered, and in how many runs."""
    if not len(first):
        return raw, 0, 0
    order = np.argsort(first, kind="stable")
    start, end = first[order].astype(np.int64), np.maximum.accumulate((first + n - 1 + WINDOW)[order].astype(np.int64))
    begin = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    starts, ends = start[begin], end[np.r_[begin[1:] - 1, len(end) - 1]]
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), int((ends - starts).sum()), len(starts)


def _lay_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _RESULT.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text, marks in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("marks"), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if marks.is_valid:
                first, n = (marks.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n"))
                kept, removed, spans = lay(raw, first, n)
            else:
                kept, removed, spans = raw, 0, 0
            rows.append((doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names)


def hot_triggers(keyed: DataFrame) -> np.ndarray:
    """Triggers that about HOT_ENTRIES entries or more have; a bounded list, as each has so many."""
    some = keyed.filter(F.pmod(F.xxhash64("_key"), F.lit(HOT_SHARE)) == 0).select("_key", "text")
    counts = some.mapInArrow(_triggers, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") * HOT_SHARE > HOT_ENTRIES).orderBy(F.col("n").desc(), "trigger").limit(HOT_ENTRIES).collect()
    return np.array([r.trigger for r in found], dtype=np.int64).view(np.uint64)


def repeat_marks(keyed: DataFrame) -> DataFrame:
    """(_key, first, n): runs of windows of each text (_key, text) that start earlier in the corpus."""
    spark = keyed.sparkSession
    deals = DEALS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = keyed.select("_key", "text").mapInArrow(_parse(deals, hot_triggers(keyed)), "deal int, blob binary")
    marks = common.stash(entries.repartition("deal").sortWithinPartitions("deal").mapInArrow(_dictionary(deals), _MARKS), "marks")
    looks = marks.filter(F.col("kind") != REPEAT).groupBy("_key").agg(F.collect_list(F.struct("first", "n", "kind", "deal")).alias("looks"))
    met = keyed.select("_key", "text").join(looks, "_key").mapInArrow(_suffixes(deals), "deal int, blob binary")
    more = met.repartition("deal").sortWithinPartitions("deal").mapInArrow(_order_suffixes, _MARKS)
    return marks.filter(F.col("kind") == REPEAT).unionByName(more).select("_key", "first", "n")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Bytes left of every document after removing what repeats earlier text of WINDOW bytes.

    Earlier is a smaller doc_id, or an earlier start in the document; matches do not cross
    documents, and are judged on the input. Texts below WINDOW bytes, null and empty ones lose
    nothing. Null doc_ids come first; repeated doc_ids are documents in the order of their texts'
    hashes. Only doc_id and text are read. An empty table gives an empty result.
    """
    common.ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = common.with_row_key(plain, "doc_id", "text", "repeats-keyed").select("_key", "doc_id", "text")
    marks = repeat_marks(keyed).groupBy("_key").agg(F.collect_list(F.struct("first", "n")).alias("marks"))
    return keyed.join(marks, "_key", "left").select("doc_id", "text", "marks").mapInArrow(_lay_all, _RESULT)


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    return without_repeats(common.documents(spark, sf_dir))
