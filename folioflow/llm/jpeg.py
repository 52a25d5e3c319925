"""Operator 4: media columns, as baseline JPEG.

Write side: a payload whose size is a multiple of 64 becomes a grey baseline JPEG in which every 64 bytes
are the quantised coefficients of one 8x8 block (zigzag order, byte value + 256, quantiser 1), so the
stored form is lossless in the format's own unit. All coefficients then fall in magnitude category 9 and
the file's Huffman tables hold that symbol alone; a restart marker follows each block.

Read side: a parser of baseline JPEG (one component or several, any sampling, any Huffman tables,
restart intervals or none). Entropy-coded segments between restart markers are independent, so numpy
decodes one symbol of all segments at a time. The DC coefficients of the first component give a luminance
thumbnail of one pixel a block without any inverse transform; its size and hashes describe the image.

Large payloads are split over several images of at most ``MAX_BLOCKS`` blocks, stored one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import chunks, ragged

#: Blocks in a row of a stored image, and most blocks in one image (16 MB of payload).
ROW_BLOCKS = 256
MAX_BLOCKS = 1 << 18
BIAS = 256
CATEGORY = 9
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, images long"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _single_symbol_table(kind: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))


_TABLES = _segment(0xDB, bytes([0, *[1] * 64])) + _single_symbol_table(0x00, CATEGORY) + _single_symbol_table(0x10, CATEGORY) + _segment(0xDD, struct.pack(">H", 1))


def _head(blocks: int) -> tuple[bytes, int]:
    """Everything before the scan's data, and the number of blocks of the grid."""
    down = -(-blocks // ROW_BLOCKS)
    across = -(-blocks // down)
    frame = _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + bytes([1, 0x11, 0]))
    note = _segment(0xFE, b"blocks=%d" % blocks)
    return b"\xff\xd8" + note + _TABLES + frame + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])), across * down


def _scan(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n, 64), each one 80 bytes and stuffing, and the bytes of each block."""
    n = len(blocks)
    # A coefficient is '0' (the only code), then category 9's amplitude: 1bbbbbbbb. Four of them are five bytes.
    v = (blocks.astype(np.uint64) | np.uint64(0x100)).reshape(n, 16, 4)
    word = (v[:, :, 0] << np.uint64(30)) | (v[:, :, 1] << np.uint64(20)) | (v[:, :, 2] << np.uint64(10)) | v[:, :, 3]
    out = word.astype(">u8").view(np.uint8).reshape(n, 16, 8)[:, :, 3:].reshape(n, 80)
    full = out == 0xFF
    sizes = 80 + full.sum(axis=1)
    if not full.any():
        return out.reshape(-1), sizes
    flat, at = out.reshape(-1), np.flatnonzero(full.reshape(-1))
    return np.insert(flat, at + 1, 0), sizes


def write_image(payload: np.ndarray) -> bytes:
    """A payload of 64 * k bytes (k <= MAX_BLOCKS) as a JPEG."""
    head, grid = _head(len(payload) // 64)
    blocks = np.zeros((grid, 64), dtype=np.uint8)
    blocks.reshape(-1)[: len(payload)] = payload
    data, sizes = _scan(blocks)
    ends = np.cumsum(sizes)
    out = np.empty(len(data) + 2 * grid, dtype=np.uint8)
    marks = ends + 2 * np.arange(grid)
    out[marks], out[marks + 1] = 0xFF, 0xD0 + np.arange(grid) % 8
    keep = np.ones(len(out), dtype=bool)
    keep[marks] = keep[marks + 1] = False
    out[keep] = data
    out[-1] = 0xD9  # the last restart marker's place is the end marker's
    return head + out.tobytes()


def write_media(payload: bytes) -> bytes:
    """Any non-empty payload of 64 * k bytes as one image or several, one after the other."""
    array = np.frombuffer(payload, dtype=np.uint8)
    return b"".join(write_image(array[k : k + 64 * MAX_BLOCKS]) for k in range(0, len(array), 64 * MAX_BLOCKS))


@dataclass
class Component:
    id: int
    across: int  # sampling factors
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    """A parsed baseline JPEG: header fields, and where its entropy-coded segments lie in ``data``."""

    data: np.ndarray
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    interval: int = 0
    comment: bytes = b""
    starts: np.ndarray | None = None
    stops: np.ndarray | None = None
    end: int = 0


def parse(data: bytes, at: int = 0) -> Image:
    """Read the markers of the image at ``at``. Raises ValueError on anything that is not baseline JPEG."""
    raw = np.frombuffer(data, dtype=np.uint8)
    image, scan = Image(raw), []
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG start marker")
    at += 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 64 * (wide + 1)
                image.quantisers[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC0:
            precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit samples")
            for k in range(n):
                number, factors, quantiser = body[6 + 3 * k : 9 + 3 * k]
                image.components.append(Component(number, factors >> 4, factors & 15, quantiser))
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            for k in range(body[0]):
                number, tables = body[1 + 2 * k : 3 + 2 * k]
                for c in image.components:
                    if c.id == number:
                        c.dc, c.ac = tables >> 4, tables & 15
                        scan.append(c)
            break
    if len(scan) != len(image.components) or not scan:
        raise ValueError("all components must stand in one scan")
    # Segments end at restart markers; the scan ends at any other marker that is not a stuffed zero.
    where = np.flatnonzero(raw[at:-1] == 0xFF) + at if len(raw) - at < 1 << 16 else _marks(raw, at)
    kinds = raw[where + 1]
    restart = (kinds >= 0xD0) & (kinds <= 0xD7)
    over = np.flatnonzero(~restart & (kinds != 0) & (kinds != 0xFF))
    if not len(over):
        raise ValueError("no end of the scan")
    cuts = where[: over[0]][restart[: over[0]]]
    image.starts = np.concatenate(([at], cuts + 2))
    image.stops = np.append(cuts, where[over[0]])
    image.end = int(where[over[0]]) + 2
    return image


def _marks(raw: np.ndarray, at: int) -> np.ndarray:
    """Places of 0xFF from ``at`` on, up to the first end-of-image marker found in growing windows."""
    size = 1 << 20
    while True:
        stop = min(len(raw), at + size)
        where = np.flatnonzero(raw[at : stop - 1] == 0xFF) + at
        kinds = raw[where + 1]
        if stop == len(raw) or ((kinds != 0) & (kinds != 0xFF) & ((kinds < 0xD0) | (kinds > 0xD7))).any():
            return where
        size *= 4


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """For every 16 bits that may follow: code length << 8 | symbol, 0 where no code begins so."""
    lengths, symbols = table
    out, code, k = np.zeros(1 << 16, dtype=np.uint16), 0, 0
    for length, count in enumerate(lengths, 1):
        for _ in range(count):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Reads bits of many segments at once; the bytes are unstuffed and padded with ones."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        sizes = stops - starts
        data = raw[ragged(starts, sizes)]
        stuffed = np.zeros(len(data), dtype=bool)
        stuffed[1:] = (data[1:] == 0) & (data[:-1] == 0xFF)
        ends = np.cumsum(sizes)
        if stuffed.any():
            dropped = np.concatenate(([0], np.cumsum(stuffed)))
            data, ends = data[~stuffed], ends - dropped[ends]
        self.data = np.concatenate([data, np.full(8, 0xFF, dtype=np.uint8)])
        self.at = np.concatenate(([0], ends[:-1])).astype(np.int64) * 8
        self.end = ends.astype(np.int64) * 8

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 32 bits, of which 25 at least are good."""
        at = self.at[lanes]
        byte = at >> 3
        d = self.data
        word = (d[byte].astype(np.uint64) << np.uint64(32)) | (d[byte + 1].astype(np.uint64) << np.uint64(24)) | (d[byte + 2].astype(np.uint64) << np.uint64(16)) | (d[byte + 3].astype(np.uint64) << np.uint64(8)) | d[byte + 4].astype(np.uint64)
        return (word >> (np.uint64(8) - (at & 7).astype(np.uint64))) & np.uint64(0xFFFFFFFF)


def _amplitude(word: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of ``size`` bits that follow ``used`` bits."""
    bits = ((word << used.astype(np.uint64)) & np.uint64(0xFFFFFFFF)) >> (np.uint64(32) - size.astype(np.uint64))
    value = bits.astype(np.int64)
    half = np.left_shift(1, np.maximum(size - 1, 0))
    return np.where((size > 0) & (value < half), value - (half << 1) + 1, value)


def _step(bits: _Bits, lanes: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Read one symbol and its amplitude in each lane: (run, size, value)."""
    word = bits.peek(lanes)
    found = lookup[(word >> np.uint64(16)).astype(np.int64)].astype(np.int64)
    length, symbol = found >> 8, found & 0xFF
    if not length.all():
        raise ValueError("no such Huffman code")
    size = symbol & 15
    value = _amplitude(word, length, size)
    bits.at[lanes] += length + size
    return symbol >> 4, size, value


def coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """Quantised coefficients (blocks, 64), zigzag order, by image and component. Images alike in their tables go together."""
    out: list[list[np.ndarray]] = [[] for _ in images]
    alike: dict[tuple, list[int]] = {}
    for k, x in enumerate(images):
        key = (tuple(sorted(x.huffman.items())), tuple((c.across, c.down, c.dc, c.ac) for c in x.components), x.interval)
        alike.setdefault(key, []).append(k)
    for (tables, shape, interval), group in alike.items():
        lookups = {number: _lookup(t) for number, t in tables}
        units = []
        for k in group:
            x = images[k]
            wide, tall = (8 * max(c.across for c in x.components), 8 * max(c.down for c in x.components)) if len(shape) > 1 else (8, 8)
            units.append(-(-x.width // wide) * -(-x.height // tall))
        per_segment = []
        for k, n in zip(group, units, strict=True):
            step = interval or n
            sizes = np.full(-(-n // step), step, dtype=np.int64)
            sizes[-1] = n - step * (len(sizes) - 1)
            if len(sizes) != len(images[k].starts):
                raise ValueError("segments missing")
            per_segment.append(sizes)
        todo = np.concatenate(per_segment)
        # All payloads may live in different buffers; one buffer holds the segments of the group.
        raw = np.concatenate([images[k].data[images[k].starts[0] : images[k].stops[-1]] for k in group])
        base = np.cumsum([0] + [int(images[k].stops[-1] - images[k].starts[0]) for k in group])[:-1]
        starts = np.concatenate([images[k].starts - images[k].starts[0] + b for k, b in zip(group, base, strict=True)])
        stops = np.concatenate([images[k].stops - images[k].starts[0] + b for k, b in zip(group, base, strict=True)])
        bits = _Bits(raw, starts, stops)
        firsts = np.cumsum(todo) - todo
        factors = [(across * down if len(shape) > 1 else 1) for across, down, _, _ in shape]
        found = [np.zeros((int(todo.sum()) * f, 64), dtype=np.int16) for f in factors]
        predictors = np.zeros((len(shape), len(todo)), dtype=np.int64)
        for unit in range(int(todo.max())):
            lanes = np.flatnonzero(todo > unit)
            for c, (_, _, dc, ac) in enumerate(shape):
                for part in range(factors[c]):
                    rows = (firsts[lanes] + unit) * factors[c] + part
                    _, _, value = _step(bits, lanes, lookups[dc])
                    predictors[c, lanes] += value
                    found[c][rows, 0] = predictors[c, lanes]
                    _block(bits, lanes, lookups[0x10 | ac], found[c], rows)
        if (bits.at > bits.end).any():
            raise ValueError("a segment ends early")
        ends = np.cumsum(units)
        for k, a, b in zip(group, ends - units, ends, strict=True):
            out[k] = [f[a * n : b * n] for f, n in zip(found, factors, strict=True)]
    return out


def _block(bits: _Bits, lanes: np.ndarray, lookup: np.ndarray, found: np.ndarray, rows: np.ndarray) -> None:
    """The 63 AC coefficients of one block in each lane."""
    at = np.ones(len(lanes), dtype=np.int64)
    while len(lanes):
        run, size, value = _step(bits, lanes, lookup)
        at += run
        if (at[size > 0] > 63).any():
            raise ValueError("too many coefficients in a block")
        if size.all():
            found[rows, at] = value
            at += 1
            done = at > 63
        else:
            some = size > 0
            found[rows[some], at[some]] = value[some]
            at += some | (run == 15)  # a run of 16 zeros
            done = (at > 63) | (~some & (run != 15))
        if done.any():
            keep = ~done
            lanes, rows, at = lanes[keep], rows[keep], at[keep]


def thumbnail(image: Image, first: np.ndarray) -> np.ndarray:
    """DC-only luminance picture, a pixel a block; block order of several blocks a unit is put right."""
    c = image.components[0]
    dc = first[:, 0].astype(np.int64) * int(image.quantisers[c.quantiser][0])
    pixels = np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    if len(image.components) == 1:
        return pixels.reshape(-1, -(-image.width // 8))
    across = -(-image.width // (8 * max(x.across for x in image.components)))
    grid = pixels.reshape(-1, across, c.down, c.across)
    return grid.transpose(0, 2, 1, 3).reshape(-1, across * c.across)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: does the brightness rise from a cell to the next one, on a grid of 8 by 9 cells?"""
    rows = np.arange(8) * pixels.shape[0] // 8
    columns = np.arange(9) * pixels.shape[1] // 9
    cells = pixels[rows][:, columns].astype(np.int16)
    return int.from_bytes(np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes(), "big")


def stacked(thumbs: list[np.ndarray]) -> np.ndarray:
    """The thumbnails of all images of a value as one picture, one below the other, narrower ones continued by their last column."""
    width = max(t.shape[1] for t in thumbs)
    return np.vstack([np.pad(t, ((0, 0), (0, width - t.shape[1])), mode="edge") for t in thumbs])


def split_images(media: bytes) -> list[Image]:
    """All images of a media value."""
    found, at = [], 0
    while at < len(media):
        found.append(parse(media, at))
        at = found[-1].end
    return found


def read_media(values: list[bytes]) -> list[tuple[bytes, list[Image], list[np.ndarray]]]:
    """Payload, images and thumbnails of each media value that ``write_media`` made."""
    images = [split_images(v) for v in values]
    flat = [x for group in images for x in group]
    found, out, at = coefficients(flat), [], 0
    for group in images:
        payload, thumbs = [], []
        for x in group:
            blocks = found[at][0]
            n = int(x.comment.rpartition(b"=")[2])
            payload.append((blocks[:n] - BIAS).astype(np.uint8).tobytes())
            thumbs.append(thumbnail(x, blocks))
            at += 1
        out.append((b"".join(payload), group, thumbs))
    return out


def text_to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (JPEG) of each text: its UTF-8, zero bytes up to a positive multiple of 64. Null counts as empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4_000_000):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = [write_media(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(task, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: the payload's digests, the images' size, and the thumbnails' hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in chunks(batches, "media", 3_000_000):
            values = batch.column("media").to_pylist()
            rows = []
            for value, (payload, images, thumbs) in zip(values, read_media(values), strict=True):
                digest = hashlib.sha256()
                for t in thumbs:
                    digest.update(t.tobytes())
                feature = f"jpeg:{max(x.width for x in images)}x{sum(x.height for x in images)}:dhash={difference_hash(stacked(thumbs)):016x}:thumb={digest.hexdigest()[:16]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(value), hashlib.sha256(value).hexdigest(), feature, max(x.width for x in images), sum(x.height for x in images), len(images)))
            columns = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c) for c in zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return media.mapInArrow(task, RESULT)


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text of ``docs`` (doc_id, text) as JPEG and describe it from the stored bytes.

    Null and empty texts are 64 zero bytes; equal texts give equal values; a null doc_id stays; an empty
    table gives no row. Other columns are ignored.
    """
    return describe_media(text_to_media(docs))
