"""GIF images as columns: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm import words

# Fixed values of the format.
WIDEST_CODE = 12
MOST_CODES = 1 << WIDEST_CODE
IMAGE, EXTENSION, TRAILER = 0x2C, 0x21, 0x3B
CONTROL = 0xF9
KEEP, TO_BACKGROUND, TO_PREVIOUS = 1, 2, 3
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))

PAYLOAD_UNIT = 64
FRAME_ROWS = 1024
FRAME_DELAY = 10  # hundredths of a second
HISTOGRAM_BINS = 4  # per colour channel
_CHUNK = 4096


class GifError(ValueError):
    """The bytes are not a readable GIF."""


@lru_cache
def _all_widths(size: int) -> np.ndarray:
    entries = (1 << size) + 2 + np.maximum(np.arange(2 * _CHUNK) - 1, 0)
    widths = np.frexp(np.minimum(entries, MOST_CODES - 1).astype(np.float64))[1]
    return np.maximum(widths, size + 1).astype(np.int64)


def _code_widths(first: int, count: int, size: int) -> np.ndarray:
    """Bits of the codes number ``first`` on after a clear code, for a smallest code size of ``size``."""
    first = min(first, _CHUNK)  # from there on all are of the widest
    return _all_widths(size)[first : first + count]


_PAIRS = [0] * (MOST_CODES << 8)  # code << 8 of the string "prefix code, byte"; empty between calls


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of samples below ``2 ** size``; a full table is cleared."""
    clear, end = 1 << size, (1 << size) + 1
    runs: list[list[int]] = [[]]
    made: list[int] = []
    pairs, add, note, following, most = _PAIRS, runs[0].append, made.append, end + 1, MOST_CODES
    samples = iter(data)
    prefix = next(samples, -1) << 8
    for byte in samples:
        pair = prefix | byte
        code = pairs[pair]
        if code:
            prefix = code
            continue
        add(prefix >> 8)
        prefix = byte << 8
        pairs[pair] = following << 8
        note(pair)
        following += 1
        if following == most:
            for pair in made:
                pairs[pair] = 0
            made.clear()
            following = end + 1
            runs.append([])
            add = runs[-1].append
    for pair in made:
        pairs[pair] = 0
    if prefix >= 0:
        add(prefix >> 8)
    values, widths = [np.array([clear])], [np.array([size + 1])]
    for k, run in enumerate(runs):
        stop = end if k == len(runs) - 1 else clear
        values.append(np.array([*run, stop], dtype=np.int64))
        widths.append(_code_widths(0, len(run) + 1, size))
    return _pack(np.concatenate(values), np.concatenate(widths))


def _pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    bits = np.zeros(int(ends[-1] + 7) // 8 * 8, dtype=np.uint8)
    starts, least = ends - widths, int(widths.min())
    for k in range(WIDEST_CODE):
        if k >= least:
            starts, values, widths = (x[widths > k] for x in (starts, values, widths))
        bits[starts + k] = values >> k & 1
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, expected: int) -> bytes:
    """The samples of a code stream; at most ``expected``, zeros for what a short stream lacks."""
    clear, end = 1 << size, (1 << size) + 1
    data = np.frombuffer(stream + b"\0" * 4, dtype=np.uint8)
    n_bits = len(stream) * 8
    out: list[bytes] = []
    made = bit = since = 0
    run: list[np.ndarray] = []
    while made < expected:
        widths = _code_widths(since, _CHUNK, size)
        ends = bit + np.cumsum(widths)
        fits = int(np.searchsorted(ends, n_bits, side="right"))
        widths, at = widths[:fits], ends[:fits] - widths[:fits]
        place = at >> 3
        codes = data[place].astype(np.int64) | data[place + 1].astype(np.int64) << 8 | data[place + 2].astype(np.int64) << 16
        codes = codes >> (at & 7) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stops[0]) if len(stops) else fits
        run.append(codes[:used])
        if not len(stops) and fits:
            bit, since = int(ends[fits - 1]), since + fits
            continue
        out.append(_expand(np.concatenate(run), end, expected - made))
        made += len(out[-1])
        if not len(stops) or codes[used] == end:
            break
        bit, since, run = int(ends[used]), 0, []
    return b"".join(out)[:expected].ljust(expected, b"\0")


def _expand(codes: np.ndarray, end: int, wanted: int) -> bytes:
    """Samples of the codes between two clear codes.

    Table entry k is what code k wrote and the sample after it. So each code
    points back to an earlier place of the output; pointers are followed by
    doubling, for the lengths of all codes and then for all samples.
    """
    n = len(codes)
    made = codes > end
    back = np.where(made, codes - end - 1, np.arange(n))
    if np.any(made & (back >= np.arange(n))):
        raise GifError("a code before it is made")
    length, parent = made.astype(np.int64), back
    while True:
        further = parent[parent]
        if np.array_equal(further, parent):
            break
        length += length[parent]
        parent = further
    length += 1
    starts = np.cumsum(length) - length
    n = int(np.searchsorted(starts, wanted))
    starts, length, back, made, codes = starts[:n], length[:n], back[:n], made[:n], codes[:n]
    shift = np.where(made, starts[back] - starts, 0)
    total = int(length.sum())
    source = np.arange(total) + np.repeat(shift, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    first = np.zeros(total, dtype=np.uint8)
    first[starts[~made]] = codes[~made]
    return first[source].tobytes()


def _blocks(data: bytes) -> bytes:
    parts = []
    for at in range(0, len(data), 255):
        part = data[at : at + 255]
        parts += (bytes([len(part)]), part)
    return b"".join((*parts, b"\0"))


def encode_gray(payload: bytes, width: int = PAYLOAD_UNIT, rows: int = FRAME_ROWS, delay: int = FRAME_DELAY) -> bytes:
    """A GIF whose frames hold ``payload`` as gray samples, ``width`` per row and ``rows`` per frame."""
    if not payload or len(payload) % width:
        raise ValueError(f"the payload is a positive multiple of {width}")
    height = min(len(payload) // width, rows)
    gray = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", gray]
    step = width * rows
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        out += (b"\x21\xf9\x04", bytes([KEEP << 2]), delay.to_bytes(2, "little"), b"\0\0")
        out += (b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(part) // width).to_bytes(2, "little"), b"\0")
        out += (b"\x08", _blocks(lzw_encode(part)))
    return b"".join((*out, b"\x3b"))


@dataclass
class Frame:
    """One shown picture: the whole canvas as RGBA after this frame, and where the frame was drawn."""

    index: int
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    canvas: np.ndarray

    def region(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


class _Source:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise GifError("the file ends too early")
        self.at += n
        return part

    def short(self) -> int:
        return int.from_bytes(self.take(2), "little")

    def byte(self) -> int:
        return self.take(1)[0]

    def blocks(self) -> bytes:
        parts = []
        while n := self.byte():
            parts.append(self.take(n))
        return b"".join(parts)

    def palette(self, flags: int) -> np.ndarray | None:
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        return np.frombuffer(self.take(3 * n), dtype=np.uint8).reshape(n, 3)


def frames(media: bytes) -> Iterator[Frame]:
    """Frames in order. A canvas starts transparent; its array is reused by the next frame."""
    source = _Source(media)
    if source.take(6) not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    width, height, flags = source.short(), source.short(), source.byte()
    source.take(2)
    shared = source.palette(flags)
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    control = (0, 0, None)
    index = clock = 0
    while (kind := source.byte()) != TRAILER:
        if kind == EXTENSION:
            label, body = source.byte(), source.blocks()
            if label == CONTROL and len(body) >= 4:
                transparent = body[3] if body[0] & 1 else None
                control = (body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10, transparent)
            continue
        if kind != IMAGE:
            raise GifError(f"unknown block {kind}")
        left, top, w, h, flags = source.short(), source.short(), source.short(), source.short(), source.byte()
        palette = source.palette(flags)
        palette = shared if palette is None else palette
        if palette is None:
            raise GifError("an image without a palette")
        size = source.byte()
        if not 1 <= size <= 8:
            raise GifError(f"code size {size}")
        samples = np.frombuffer(lzw_decode(source.blocks(), size, w * h), dtype=np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(first, h, step) for first, step in INTERLACE])
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        disposal, delay, transparent = control
        before = canvas.copy() if disposal == TO_PREVIOUS else None
        _draw(canvas, samples, palette, left, top, transparent)
        yield Frame(index, clock, delay, left, top, w, h, disposal, canvas)
        if disposal == TO_BACKGROUND:
            canvas[top : top + h, left : left + w] = 0
        elif before is not None:
            canvas = before
        index, clock, control = index + 1, clock + delay, (0, 0, None)


def _draw(canvas: np.ndarray, samples: np.ndarray, palette: np.ndarray, left: int, top: int, transparent: int | None) -> None:
    """Puts a frame's opaque samples on the canvas; what lies outside of it is cut off."""
    colours = np.zeros((256, 4), dtype=np.uint8)
    colours[: len(palette), :3] = palette
    colours[:, 3] = 255
    area = canvas[top : top + samples.shape[0], left : left + samples.shape[1]]
    seen = samples[: area.shape[0], : area.shape[1]]
    if transparent is None:
        area[:] = colours[seen]
    else:
        opaque = seen != transparent
        area[opaque] = colours[seen[opaque]]


def histogram(pixels: np.ndarray, bins: int = HISTOGRAM_BINS) -> np.ndarray:
    """Counts of visible pixels per cell of ``bins`` steps of red, green and blue."""
    step = 256 // bins
    shown = pixels[pixels[..., 3] > 0].astype(np.int64) // step
    return np.bincount((shown[:, 0] * bins + shown[:, 1]) * bins + shown[:, 2], minlength=bins**3)


FRAME_SCHEMA = (
    "frame int, start_ms bigint, delay_ms bigint, left int, top int, width int, height int, disposal int, "
    "pixels binary, histogram array<bigint>, error string"
)
_FRAME_TYPES = pa.schema(
    [
        *((name, pa.int32()) for name in ("frame",)),
        *((name, pa.int64()) for name in ("start_ms", "delay_ms")),
        *((name, pa.int32()) for name in ("left", "top", "width", "height", "disposal")),
        ("pixels", pa.binary()),
        ("histogram", pa.list_(pa.int64())),
        ("error", pa.string()),
    ]
)


def gif_frames(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """``(key, frame, start_ms, delay_ms, left, top, width, height, disposal, pixels, histogram, error)``.

    One row per frame: ``pixels`` are the canvas as RGBA once the frame is drawn.
    A null value has no frames; bytes that cannot be read give one row with the
    ``error``, after the frames read before it. Rows go out frame by frame.
    """
    kind = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column("_media")[at].as_py()
                for row in [] if data is None else _frame_rows(data):
                    columns = [batch.column("_key").slice(at, 1), *(pa.array([v], f.type) for v, f in zip(row, _FRAME_TYPES, strict=True))]
                    yield pa.record_batch(columns, names=[key, *_FRAME_TYPES.names])

    rows = df.select(df[key].alias("_key"), df[media].alias("_media"))
    return rows.mapInArrow(read, f"`{key}` {kind}, {FRAME_SCHEMA}")


def _frame_rows(data: bytes) -> Iterator[tuple]:
    try:
        for f in frames(data):
            shown = (f.canvas.tobytes(), histogram(f.canvas).tolist(), None)
            yield (f.index, f.start_ms, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, *shown)
    except GifError as error:
        yield (None, None, None, None, None, None, None, None, None, None, str(error))


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text", unit: int = PAYLOAD_UNIT) -> DataFrame:
    """``(key, n_bytes, media)``: each whole text as a GIF of its UTF-8 bytes, padded with 0 to ``unit``.

    A null text is stored as an empty one: one unit of zeros.
    """
    kind = df.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "_text"):
                sizes, media = [], []
                for text in part.column("_text").to_pylist():
                    data = (text or "").encode()
                    sizes.append(len(data))
                    media.append(encode_gray(data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0"), unit))
                yield pa.record_batch([part.column("_key"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    rows = df.select(df[key].alias("_key"), df[text].alias("_text"))
    return rows.mapInArrow(write, f"`{key}` {kind}, n_bytes bigint, media binary")


PAYLOAD_SCHEMA = (
    "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string, n_frames bigint, duration_ms bigint"
)


def payload_features(stored: DataFrame, key: str = "doc_id", unit: int = PAYLOAD_UNIT) -> DataFrame:
    """Decodes ``store_texts``'s GIFs and digests the samples read back.

    ``feature`` is the colour histogram of all drawn pixels as ``cell:count`` of
    the cells that occur. A file is read frame by frame.
    """
    kind = stored.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(media.as_py(), unit) for media in batch.column("media")]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            names = [name.split()[0] for name in PAYLOAD_SCHEMA.split(", ")]
            yield pa.record_batch([batch.column(key), batch.column("n_bytes"), *arrays], names=[key, *names])

    return stored.mapInArrow(read, f"`{key}` {kind}, {PAYLOAD_SCHEMA}")


def _digest(media: bytes, unit: int) -> tuple:
    sha, tail, n, cells, count, end = hashlib.sha256(), b"", 0, 0, 0, 0
    for frame in frames(media):
        drawn = frame.region()
        samples = drawn[..., 0].tobytes()
        sha.update(samples)
        tail, n = samples[-unit:], n + len(samples)
        cells = cells + histogram(drawn)
        count, end = count + 1, frame.start_ms + frame.delay_ms
    feature = ",".join(f"{cell}:{cells[cell]}" for cell in np.flatnonzero(cells))
    return (n, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, count, end)
