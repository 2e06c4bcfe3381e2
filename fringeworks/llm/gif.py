"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

Decoding works on numpy arrays and reads a whole run of codes between clear codes at once: code widths follow from a code's place in its run, string
lengths and source places from the codes' parents by pointer doubling, so that no string table is built. Encoding is the usual greedy search of the longest entry.

Defined cases: decode raises ValueError on data that is no GIF, is cut off, or has a code that can't stand where it does; the table operator gives such a row one line
with the message in error; null media give the same; frames may be interlaced, have own palettes and lie anywhere within the screen.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KEEP, BACKGROUND, PREVIOUS = 1, 2, 3
GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
#: A histogram has 64 bins: two bits each of red, green and blue.
BINS = 64


@dataclass
class Frame:
    """indices: height x width palette indices; delay in hundredths of a second; palette None: the global one."""

    indices: np.ndarray
    delay: int = 10
    left: int = 0
    top: int = 0
    disposal: int = KEEP
    transparent: int | None = None
    palette: np.ndarray | None = None


# ---------------------------------------------------------------- LZW


_POWERS = 1 << np.arange(40)


def _width(place: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the code at a place after a clear code (0 the first): the table had (1 << bits) + 1 + place entries before it, or 4096."""
    return np.minimum(12, np.searchsorted(_POWERS, np.maximum((1 << bits) + 2, (1 << bits) + 1 + place), side="right"))


@cache
def _layout(first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of 4096 codes from a place on, and their offsets from there (all codes from 4096 on have 12 bits)."""
    width = _width(np.arange(first, first + 4096), bits)
    return width, np.cumsum(width) - width


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A code stream: the longest entry each time, a new entry for it and the value behind it, and a clear code when the table is full."""
    clear = 1 << bits
    runs, table = [], {}
    # codes are kept a byte to the left, where the value behind them fits in; a table's keys, in the order they came, are the codes of its run
    free, full, prefix = clear + 2 << 8, 4096 << 8, -1
    for v in data:
        key = prefix | v
        if key in table:
            prefix = table[key]
        elif prefix < 0:
            prefix = v << 8
        else:
            table[key] = free
            free += 256
            prefix = v << 8
            if free == full:
                runs.append(np.fromiter(table, np.int64, len(table)) >> 8)
                table, free = {}, clear + 2 << 8
    last = [prefix >> 8] if prefix >= 0 else []
    runs.append(np.append(np.fromiter(table, np.int64, len(table)) >> 8, np.array(last, np.int64)))
    # each run has a clear code before it, whose width is that of the code that would have come there
    code = np.concatenate([x for r in runs for x in ([clear], r)] + [[clear + 1]])
    place = np.concatenate([x for r, before in zip(runs, [0, *map(len, runs)]) for x in ([before], np.arange(len(r)))] + [[len(runs[-1])]])
    width = _width(place, bits)
    at = np.cumsum(width) - width
    size = (int(at[-1] + width[-1]) + 7) // 8
    # no two codes share a bit, so sums of their bytes are unions
    shifted, byte = code << (at & 7), at >> 3
    out = sum(np.bincount(byte + k, (shifted >> (8 * k)) & 255, size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _run(codes: np.ndarray, clear: int) -> np.ndarray:
    """Output of the codes between two clear codes."""
    place = np.arange(len(codes))
    parent = codes - (clear + 2)
    if codes[0] >= clear or (parent >= np.minimum(place, 4096 - clear - 2)).any() or (codes == clear + 1).any():
        raise ValueError("LZW code before its entry")
    parent = np.where(parent < 0, -1, parent)
    length, hop = np.ones(len(codes), np.int64), parent.copy()
    while (live := np.flatnonzero(hop >= 0)).size:
        to = hop[live]
        more, step = length[to], hop[to]
        length[live] += more
        hop[live] = step
    start = np.cumsum(length) - length
    total = int(start[-1] + length[-1])
    literal = parent < 0
    value = np.zeros(total, np.uint8)
    value[start[literal]] = codes[literal]
    # an entry is its parent's output and the character after that
    source = np.arange(total) - np.repeat(np.where(literal, 0, start - start[np.maximum(parent, 0)]), length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return value[source]
        source = further


def lzw_decode(data: bytes, bits: int, size: int) -> np.ndarray:
    """The first size values of a code stream."""
    clear = 1 << bits
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    have, bit, got, out = len(data) * 8, 0, 0, []
    while got < size:
        codes = np.empty(0, np.int64)
        at, fresh, stop = bit, 0, None
        while stop is None:  # codes of this run, some thousand at a time
            width, offset = _layout(min(fresh, 4096), bits)
            most = min(4096, (have - at) // (bits + 1) + 1)
            width, offset = width[:most], at + offset[:most]
            width = width[offset + width <= have]
            offset = offset[: len(width)]
            if not len(width):
                raise ValueError("LZW stream is cut off")
            o = offset >> 3
            code = ((raw[o] | raw[o + 1] << 8 | raw[o + 2] << 16) >> (offset & 7)) & ((1 << width) - 1)
            ends = np.flatnonzero((code == clear) | (code == clear + 1))
            if len(ends):
                stop = int(ends[0])
                bit = int(offset[stop] + width[stop])
                last = code[stop] == clear + 1
                code = code[:stop]
            codes = np.append(codes, code)
            at, fresh = int(offset[-1] + width[-1]), fresh + len(width)
        if len(codes):
            out.append(_run(codes, clear))
            got += len(out[-1])
        if last:
            break
    if got < size:
        raise ValueError("LZW stream has too few values")
    return np.concatenate(out)[:size] if out else np.empty(0, np.uint8)


# ---------------------------------------------------------------- files


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[i : i + 255])]) + p for i in range(0, len(data), 255)) + b"\0"


def _table(palette: np.ndarray) -> tuple[int, bytes]:
    """Size field and bytes of a palette, padded with black to a power of two."""
    field = max(1, int(len(palette) - 1).bit_length())
    full = np.zeros((1 << field, 3), np.uint8)
    full[: len(palette)] = palette
    return field - 1, full.tobytes()


def encode(frames: list[Frame], palette: np.ndarray = GREYS, loop: int | None = None) -> bytes:
    """A GIF89a file; the screen spans all frames."""
    width = max(f.left + f.indices.shape[1] for f in frames)
    height = max(f.top + f.indices.shape[0] for f in frames)
    field, table = _table(palette)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 7 << 4 | field, 0, 0), table]
    if loop is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loop) + b"\0")
    for f in frames:
        h, w = f.indices.shape
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0, 0))
        flags, own = 0, b""
        if f.palette is not None:
            field, own = _table(f.palette)
            flags = 0x80 | field
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, w, h, flags) + own)
        colours = len(f.palette if f.palette is not None else palette)
        bits = max(2, int(colours - 1).bit_length())
        out.append(bytes([bits]) + _blocks(lzw_encode(f.indices.tobytes(), bits)))
    return b"".join(out) + b";"


@dataclass
class Shown:
    """A frame as read: its indices and what the screen shows from start on (milliseconds), as height x width x 4 RGBA."""

    frame: Frame
    start_ms: int
    screen: np.ndarray

    def own(self) -> np.ndarray:
        """The screen within the frame's rectangle."""
        f = self.frame
        return self.screen[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1]]


def _interlaced(x: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(x), 0
    for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)):
        n = len(range(first, len(x), step))
        out[first::step] = x[at : at + n]
        at += n
    return out


def decode(data: bytes) -> Iterator[Shown]:
    """Frames in order, composed on the screen by disposal and transparency."""

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("GIF is cut off")
        at += n
        return data[at - n : at]

    def blocks() -> bytes:
        parts = []
        while n := take(1)[0]:
            parts.append(take(n))
        return b"".join(parts)

    def palette(flags: int) -> np.ndarray | None:
        return np.frombuffer(take(3 << (flags & 7) + 1), np.uint8).reshape(-1, 3) if flags & 0x80 else None

    at = 0
    if take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", take(7))
    common = palette(flags)
    screen = np.zeros((height, width, 4), np.uint8)
    clock, control = 0, (0, 0, None)
    while (kind := take(1)[0]) != 0x3B:
        if kind == 0x21:
            label, body = take(1)[0], blocks()
            if label == 0xF9:
                if len(body) < 4:
                    raise ValueError("GIF control block is cut off")
                packed, delay, colour = struct.unpack("<BHB", body[:4])
                control = (packed >> 2 & 7, delay, colour if packed & 1 else None)
            continue
        if kind != 0x2C:
            raise ValueError("GIF block of unknown kind")
        left, top, w, h, flags = struct.unpack("<HHHHB", take(9))
        own = palette(flags)
        colours = own if own is not None else common
        if colours is None or left + w > width or top + h > height:
            raise ValueError("GIF frame without palette or outside the screen")
        bits = take(1)[0]
        if not 2 <= bits <= 8:
            raise ValueError("GIF code size")
        x = lzw_decode(blocks(), bits, w * h).reshape(h, w)
        if flags & 0x40:
            x = _interlaced(x)
        if x.size and int(x.max()) >= len(colours):
            raise ValueError("GIF colour outside its palette")
        disposal, delay, transparent = control
        before = screen.copy() if disposal == PREVIOUS else None
        part = screen[top : top + h, left : left + w]
        rgba = np.full((len(colours), 4), 255, np.uint8)
        rgba[:, :3] = colours
        np.copyto(part.view(np.uint32)[..., 0], rgba.view(np.uint32)[:, 0].take(x), where=True if transparent is None else x != transparent)
        yield Shown(Frame(x, delay, left, top, disposal, transparent, own), clock, screen)
        clock += delay * 10
        if disposal == BACKGROUND:
            screen[top : top + h, left : left + w] = 0
        elif before is not None:
            screen = before
        control = (0, 0, None)


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels in BINS colour bins."""
    r, g, b = (rgba[..., i] >> 6 for i in range(3))
    return np.bincount((r << 4 | g << 2 | b)[rgba[..., 3] > 0], minlength=BINS)


FRAMES = "id bigint, frame int, start_ms bigint, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, own_palette int, histogram array<bigint>, pixels binary, error string"


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", also: tuple[str, ...] = (), grey: bool = False) -> DataFrame:
    """A row for each frame of each file, a file's frames one after another: its times, rectangle, rules, colours of its own palette, the screen's colour histogram and its own rectangle's
    red, green, blue and alpha bytes (grey: its red ones only). Columns of media that also names stand on each of its rows."""
    kinds = [("id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), *((n, pa.int32()) for n in ("left", "top", "width", "height", "disposal", "transparent", "own_palette")), ("histogram", pa.list_(pa.int64())), ("pixels", pa.binary()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, (i, data) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                rows, error = [], None
                try:
                    for k, s in enumerate(decode(data if data is not None else b"")):
                        f, own = s.frame, s.own()
                        pixels = (own[..., 0] if grey else own).tobytes()
                        rows.append((i, k, s.start_ms, f.delay * 10, f.left, f.top, f.indices.shape[1], f.indices.shape[0], f.disposal, f.transparent, None if f.palette is None else len(f.palette), histogram(s.screen).tolist(), pixels, None))
                except ValueError as e:
                    error = str(e)
                if error or not rows:
                    rows = [(i, *[None] * (len(kinds) - 2), error or "GIF without frames")]
                more = [b.column(2 + j).slice(at, 1).take(pa.array([0] * len(rows))) for j in range(len(also))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds, strict=True)] + more, [n for n, _ in kinds] + list(also))

    kept = media.select(F.col(id_col).cast("bigint"), F.col(media_col), *also)
    return kept.mapInArrow(run, ", ".join([FRAMES, *(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in also)]))


# ---------------------------------------------------------------- texts as media

UNIT = 192
FRAME_ROWS = 16


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, blanks appended up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def stored(data: bytes) -> bytes:
    """A payload as grey samples, UNIT a row and FRAME_ROWS rows a frame, all at the screen's top, a tenth of a second each. The file's palette has the greys that occur, in order, and one more entry for
    transparency; a frame whose own greys need fewer bits has its own palette. Frames stay, give the screen back to the one before, or clear their rectangle, in turn. Samples that
    the screen shows already are transparent. Read back by these rules, each frame's rectangle holds its samples."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    every = np.unique(rows)
    bits = max(2, len(every).bit_length())
    screen = np.full((min(FRAME_ROWS, len(rows)), UNIT), -1)
    out = []
    for k, at in enumerate(range(0, len(rows), FRAME_ROWS)):
        part = rows[at : at + FRAME_ROWS]
        greys = np.unique(part)
        own = max(2, len(greys).bit_length()) < bits
        have = greys if own else every
        shown = screen[: len(part)] == part
        disposal = (KEEP, PREVIOUS, BACKGROUND)[k % 3]
        palette = np.repeat(np.append(have, 0)[:, None], 3, axis=1).astype(np.uint8) if own else None
        out.append(Frame(np.where(shown, len(have), np.searchsorted(have, part)).astype(np.uint8), disposal=disposal, transparent=len(have), palette=palette))
        if disposal == KEEP:
            screen[: len(part)] = part
        elif disposal == BACKGROUND:
            screen[: len(part)] = -1
    return encode(out, np.repeat(np.append(every, 0)[:, None], 3, axis=1).astype(np.uint8))


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([stored(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")
