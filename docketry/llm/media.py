"""Media columns: progressive JPEG files as coefficient arrays and full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNIT = 64
#: Blocks in a row of a payload image, and most rows: the format's height has 16 bits.
ROW_BLOCKS, MOST_ROWS = 1024, 65535 // 8
BANDS = ((1, 5), (6, 63))
#: Bits that a band's first scan leaves to its refinement scan, and the DC scan to its own.
AC_LOW, DC_LOW = 1, 8
#: The size category of all AC coefficients of a payload after the first scan: 64 to 127 and their negatives.
CATEGORY = 7
#: Samples that a file may have at most; a header of more is taken to be corrupt.
MOST_SAMPLES = 1 << 31
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_marker = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _basis() -> np.ndarray:
    """pixel[64] = coefficients in zigzag order @ basis."""
    u = np.arange(8)
    cos = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    full = np.einsum("yv,xu->vuyx", cos, cos).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


BASIS = _basis()


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, lengths: list[int], values: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | number, *lengths, *values]))


def _scan(first: int, last: int, high: int, low: int, dc: int, ac: int, bits: np.ndarray) -> bytes:
    spare = -bits.size % 8
    data = np.packbits(np.r_[bits.ravel(), np.ones(spare, np.uint8)] if spare else bits.ravel()).tobytes()
    head = _segment(0xDA, bytes([1, 1, dc << 4 | ac, first, last, high << 4 | low]))
    return head + data.replace(b"\xff", b"\xff\x00")


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text, zero bytes appended up to a positive multiple of UNIT, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def write_payload(data: bytes) -> bytes:
    """A progressive grey JPEG whose quantised coefficients are the bytes of data, a block for 64.

    The DC coefficient of a block is its first byte. Another byte below 128 is the AC coefficient
    128 + byte, one from 128 on the negative of itself, so that all AC coefficients are in one size
    category. A band's first scan has all their bits but the last, in a byte for each; its refinement
    scan has the last ones. All Huffman tables hold one symbol, so scans have fixed positions; the
    file is an ordinary JPEG all the same. The number of blocks is in a comment; blocks that only
    fill the last row are zero bytes.
    """
    n = len(data) // UNIT
    across = max(min(n, ROW_BLOCKS), -(-n // MOST_ROWS))
    down = -(-n // across)
    octets = np.zeros((across * down, UNIT), dtype=np.uint8)
    octets[:n] = np.frombuffer(data, dtype=np.uint8).reshape(n, UNIT)
    k = len(octets)
    one = [1] + [0] * 15
    out = [
        b"\xff\xd8", _segment(0xFE, b"DKPL" + struct.pack(">Q", n)), _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + bytes([1, 0x11, 0])),
        _table(0, 0, one, [0]), _table(1, 0, one, [CATEGORY]), _table(1, 1, one, [0]),
        _scan(0, 0, 0, DC_LOW, 0, 0, np.zeros(k, np.uint8)),
    ]
    for low in range(DC_LOW - 1, -1, -1):
        out.append(_scan(0, 0, low + 1, low, 0, 0, octets[:, 0] >> low & 1))
    for a, b in BANDS:
        band = octets[:, a : b + 1]
        half = (band & 127) >> 1
        first = np.where(band < 128, 64 + half, 63 - half).astype(np.uint8)  # the code 0, then the bits of the value
        out.append(_scan(a, b, 0, AC_LOW, 0, 0, np.unpackbits(first)))
        more = np.zeros((k, b - a + 2), dtype=np.uint8)  # end of band, then a bit of each
        more[:, 1:] = band & 1
        out.append(_scan(a, b, AC_LOW, 0, 0, 1, more))
    return b"".join([*out, b"\xff\xd9"])


# Reading


@dataclass
class Component:
    number: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks that the image needs
    down: int = 0
    wide: int = 0  # blocks stored: whole MCUs
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Image:
    """A decoded file: quantised coefficients by component (zigzag order), and what they mean."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist() + [1] * 64
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out << 1 | b
        self.at += n
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")


def _codes(lengths: bytes, values: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def _single(codes: dict) -> int | None:
    return next(iter(codes.values())) if len(codes) == 1 and (1, 0) in codes else None


def decode(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated into coefficient arrays.

    Spectral selection and successive approximation of DC and AC, interleaved DC scans, restart
    intervals and subsampling are read. Where a scan's table has one symbol with a one-bit code and
    the scan's positions are therefore fixed, numpy reads the scan at once. A file that is cut off,
    corrupt or of another kind raises ValueError.
    """
    try:
        return _decode_file(data)
    except (IndexError, KeyError, StopIteration, OverflowError, ZeroDivisionError, struct.error) as e:
        raise ValueError(f"corrupt file: {type(e).__name__} {e}") from e


def _decode_file(data: bytes) -> Image:
    image, tables, restart, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        if marker == 0xD9:
            if not image.components:
                raise ValueError("no frame")
            return image
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            _lay_out(image)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman file")
        elif marker == 0xDA:
            found = _marker.search(data, at)
            end = found.start() if found else len(data)
            _read_scan(image, tables, restart, body, data[at:end])
            at = end


def _lay_out(image: Image) -> None:
    if not (0 < image.width * image.height * len(image.components) <= MOST_SAMPLES and all(0 < x <= 4 for c in image.components for x in (c.h, c.v))):
        raise ValueError("no such frame")
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    mcus_x, mcus_y = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
    alone = len(image.components) == 1
    for c in image.components:
        c.across = -(-(-(-image.width * c.h // most_h)) // 8)
        c.down = -(-(-(-image.height * c.v // most_v)) // 8)
        c.wide = c.across if alone else mcus_x * c.h
        c.coefficients = np.zeros((c.down if alone else mcus_y * c.v, c.wide, 64), np.int32)


def _read_scan(image: Image, tables: dict, restart: int, head: bytes, data: bytes) -> None:
    chosen = [(next(c for c in image.components if c.number == head[1 + 2 * i]), head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(head[0])]
    first, last, high, low = head[1 + 2 * head[0]], head[2 + 2 * head[0]], head[3 + 2 * head[0]] >> 4, head[3 + 2 * head[0]] & 15
    if len(chosen) == 1 and not restart:
        c, dc, ac = chosen[0]
        if _read_fixed(c, _single(tables.get(dc, {})) if not first else _single(tables.get(16 | ac, {})), first, last, high, low, data):
            return
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in (re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data])]
    units = list(_units(image, chosen))
    step = restart or len(units)
    for i, piece in enumerate(pieces):
        reader, state = _Bits(piece), {"run": 0, "dc": dict.fromkeys((c.number for c, _, _ in chosen), 0)}
        for unit in units[i * step : (i + 1) * step]:
            for c, dc, ac, y, x in unit:
                block = c.coefficients[y, x]
                if first == 0:
                    if high:
                        block[0] |= reader.take(1) << low
                    else:
                        size = reader.symbol(tables[dc])
                        state["dc"][c.number] += _extend(reader.take(size), size)
                        block[0] = state["dc"][c.number] << low
                elif high:
                    _refine(reader, tables[16 | ac], block, first, last, low, state)
                else:
                    _first_ac(reader, tables[16 | ac], block, first, last, low, state)


def _units(image: Image, chosen: list):
    if len(chosen) == 1:
        c, dc, ac = chosen[0]
        for y in range(c.down):
            for x in range(c.across):
                yield [(c, dc, ac, y, x)]
        return
    c = chosen[0][0]
    for my in range(c.coefficients.shape[0] // c.v):
        for mx in range(c.coefficients.shape[1] // c.h):
            yield [(k, dc, ac, my * k.v + y, mx * k.h + x) for k, dc, ac in chosen for y in range(k.v) for x in range(k.h)]


def _read_fixed(c: Component, symbol: int | None, first: int, last: int, high: int, low: int, data: bytes) -> bool:
    """Read a scan whose every bit has a known place; False if this one is of another kind."""
    k, n = c.down * c.across, last - first + 1
    blocks = c.coefficients[: c.down, : c.across]
    if not (blocks.base is None or blocks.flags.c_contiguous) or c.across != c.wide:
        return False
    flat = blocks.reshape(k, 64)
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)

    def has(bits: int) -> None:
        if len(raw) * 8 < bits:
            raise ValueError("a scan is cut off")

    if first == 0 and high:
        has(k)
        flat[:, 0] |= np.unpackbits(raw, count=k).astype(np.int32) << low
    elif first == 0:
        if symbol != 0:  # category 0 alone: every difference is 0
            return False
    elif not high:
        if symbol is None or symbol >> 4 or symbol == 0:
            return False
        has(k * n * (symbol + 1))
        if symbol == 7:
            bits = raw[: k * n].reshape(k, n)
        else:
            bits = np.packbits(np.unpackbits(raw, count=k * n * (symbol + 1)).reshape(k, n, symbol + 1), axis=2)
            if bits.shape[2] != 1:
                return False
            bits = bits[:, :, 0] >> (7 - symbol)
        value = bits.astype(np.int32)
        flat[:, first : last + 1] = np.where(value >> (symbol - 1), value, value - (1 << symbol) + 1) << low
    else:
        if symbol != 0 or not flat[:, first : last + 1].all():
            return False
        has(k * (n + 1))
        bits = np.unpackbits(raw, count=k * (n + 1)).reshape(k, n + 1)[:, 1:].astype(np.int32)
        band = flat[:, first : last + 1]
        band += np.where(band > 0, bits, -bits) << low
    return True


def _first_ac(reader: _Bits, codes: dict, block: np.ndarray, first: int, last: int, low: int, state: dict) -> None:
    if state["run"]:
        state["run"] -= 1
        return
    k = first
    while k <= last:
        run, size = divmod(reader.symbol(codes), 16)
        if size:
            k += run
            block[k] = _extend(reader.take(size), size) << low
            k += 1
        elif run == 15:
            k += 16
        else:
            state["run"] = (1 << run) + reader.take(run) - 1
            return


def _refine(reader: _Bits, codes: dict, block: np.ndarray, first: int, last: int, low: int, state: dict) -> None:
    def correct(k: int) -> None:
        if reader.take(1):
            block[k] += (1 << low) if block[k] > 0 else -(1 << low)

    k = first
    while k <= last and not state["run"]:
        run, size = divmod(reader.symbol(codes), 16)
        value = 0
        if size:
            value = (1 << low) if reader.take(1) else -(1 << low)
        elif run < 15:
            state["run"] = (1 << run) + reader.take(run)
            break
        while k <= last:
            if block[k]:
                correct(k)
            elif run == 0:
                break
            else:
                run -= 1
            k += 1
        if value and k <= last:
            block[k] = value
        k += 1
    if state["run"]:
        for j in range(k, last + 1):
            if block[j]:
                correct(j)
        state["run"] -= 1


def plane(image: Image, c: Component) -> np.ndarray:
    """One component's samples, 0 to 255, at its own resolution."""
    rows, wide, _ = c.coefficients.shape
    scaled = (c.coefficients * image.quant[c.table]).reshape(-1, 64).astype(np.float32)
    samples = np.clip(np.rint(scaled @ BASIS + 128), 0, 255).astype(np.uint8)
    return samples.reshape(rows, wide, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, wide * 8)


def rgb(image: Image) -> np.ndarray:
    """The (height, width, 3) tensor of 8-bit samples; chroma is brought up to full resolution.

    Each sample stands for the places of the full grid that its own covers, whatever the ratio.
    """
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    if len(image.components) not in (1, 3) or any(c.table not in image.quant for c in image.components):
        raise ValueError("no grey or colour file")
    planes = []
    for c in image.components:
        own = plane(image, c)
        if (c.h, c.v) != (most_h, most_v):
            rows, columns = np.arange(image.height) * c.v // most_v, np.arange(image.width) * c.h // most_h
            own = own[rows[:, None], columns[None, :]]
        planes.append(own[: image.height, : image.width])
    if len(planes) == 1:
        return planes[0][:, :, None].repeat(3, axis=2)
    y, cb, cr = (p.astype(np.float32) for p in planes[:3])
    out = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def read_payload(image: Image) -> bytes:
    """The bytes that write_payload stored."""
    if image.comment[:4] != b"DKPL":
        raise ValueError("the file holds no payload")
    (n,) = struct.unpack(">Q", image.comment[4:12])
    flat = image.components[0].coefficients.reshape(-1, 64)[:n]
    octets = np.where(flat > 0, flat - 128, -flat).astype(np.uint8)
    octets[:, 0] = flat[:, 0]
    return octets.tobytes()


def feature(tensor: np.ndarray) -> str:
    """Size, sum of samples, and how many samples lie in each quarter of the range, of an RGB tensor."""
    least = [tensor.size, *(int(np.count_nonzero(tensor >= 64 * i)) for i in (1, 2, 3)), 0]
    counts = [a - b for a, b in zip(least, least[1:], strict=False)]
    return f"{tensor.shape[0]}x{tensor.shape[1]}x3:{int(tensor.sum(dtype=np.int64))}:" + "/".join(map(str, counts))


_MEDIA = "doc_id long, n_bytes long, media binary"
_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
#: Bytes of media that pass between the steps at a time.
BATCH_BYTES = 16 << 20


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(ids, sizes, media):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    common.only("media")
    for batch in batches:
        ids, sizes, media, held = [], [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            data, n = payload(text.as_py())
            ids.append(doc_id)
            sizes.append(n)
            media.append(write_payload(data))
            held += len(media[-1])
            if held >= BATCH_BYTES:
                yield batch_of(ids, sizes, media)
                ids, sizes, media, held = [], [], [], 0
        yield batch_of(ids, sizes, media)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.only("media")
    names = [c.split()[0] for c in _FEATURES.split(", ")]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3]
    for batch in batches:
        rows = []
        for doc_id, n, cell in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            media = cell.as_py()
            stored = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
            try:
                image = decode(media or b"")
                data = read_payload(image)
                rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), *stored, feature(rgb(image)), None))
            except ValueError as e:
                rows.append((doc_id, n, None, None, None, *stored, None, "no file" if media is None else str(e)))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column: every whole text as a progressive JPEG, losslessly.

    Null text counts as empty: one block of zeros. Null and repeated doc_ids stay rows of their
    own; equal texts give equal files. Only doc_id and text are read.
    """
    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode, _MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """Digests of the payload read back from each media file, and the feature of its RGB tensor.

    A file that is null, cut off, corrupt, of another kind or without a payload has nulls there and
    says why in error. Null and repeated doc_ids stay rows of their own; an empty table gives none.
    """
    common.ship(media.sparkSession)
    return media.mapInArrow(_decode, _FEATURES)


_TENSORS = "doc_id long, height int, width int, tensor binary, error string"


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.only("media")
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    for batch in batches:
        for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
            try:
                tensor = rgb(decode(cell.as_py()))
                row = doc_id, *tensor.shape[:2], np.ascontiguousarray(tensor).tobytes(), None
            except ValueError as e:
                row = doc_id, None, None, None, str(e)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [c.split()[0] for c in _TENSORS.split(", ")])


def rgb_tensors(media: DataFrame, path: str) -> DataFrame:
    """Store the full-resolution RGB tensor of each progressive JPEG of (doc_id, media) at path.

    tensor holds height * width * 3 samples of 8 bits, row by row. Files that cannot be read have
    null tensors and say why in error; rows without media are left out. Null and repeated doc_ids
    stay rows of their own; other columns are not read.
    """
    common.ship(media.sparkSession)
    media.filter("media IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(_tensors, _TENSORS).write.mode("overwrite").parquet(path)
    return media.sparkSession.read.schema(_TENSORS).parquet(path)


def op6_media(spark, sf_dir: str) -> DataFrame:
    return media_features(common.stash(media_column(common.documents(spark, sf_dir)), "media"))
