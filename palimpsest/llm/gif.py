"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, histograms.

``read_gif`` decodes any GIF87a or GIF89a: global and local palettes,
interlaced frames, transparent indices, all disposal methods.  ``write_gif``
stores byte strings losslessly: a byte is a palette index, a frame holds rows
of 24 samples, and frames follow each other in time.

Defined cases: a null text counts as empty; an empty payload is one tile of
padding; equal texts give equal files; null ids stay null; a code stream that
ends early leaves the rest of its frame transparent (canvas) and absent
(indices).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import arrow_batches, slices, texts_of

#: A tile is 24 x 24 samples; a frame has up to TILES of them, one below the other.
SIDE, TILES = 24, 16
TILE_BYTES = SIDE * SIDE
BINS = 16
#: Hundredths of a second that a written frame is shown.
DELAY = 4


@dataclass
class Frame:
    """A decoded frame: its rectangle, time, disposal, palette, indices, and the canvas it leaves on screen."""

    left: int
    top: int
    width: int
    height: int
    delay: int
    start: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    indices: np.ndarray
    canvas: np.ndarray | None = None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


# ---------------------------------------------------------------------- codes


def _widths(least: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code, when each code but the first adds an entry."""
    entries = np.minimum((1 << least) + 1 + np.arange(n), 4095)
    return np.frexp(np.maximum(entries, (1 << (least + 1)) - 1).astype(np.float64))[1]


_schedules: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and starting bits of the codes after a clear code, until the table must be full long since."""
    if least not in _schedules:
        widths = _widths(least, 8192)
        _schedules[least] = widths, np.concatenate(([0], np.cumsum(widths)))
    return _schedules[least]


def _unpack(words: np.ndarray, at: int, least: int, n: int, full: bool = False) -> np.ndarray:
    """Up to n codes from bit ``at``, widths as after a clear code or of a full table; ``words`` has the 32 bits from each byte on."""
    widths, starts = (np.full(n, 12), 12 * np.arange(n + 1)) if full else _schedule(least)
    n = min(n, int(np.searchsorted(starts, 8 * len(words) - at, side="right")) - 1)
    if n <= 0:
        return np.empty(0, np.int64)
    place = at + starts[:n]
    return (words[place >> 3] >> (place & 7)) & ((1 << widths[:n]) - 1)


def lzw_decode(data: bytes, least: int, size: int) -> bytes:
    """Samples of an LZW code stream, ``size`` at most."""
    clear, end = 1 << least, (1 << least) + 1
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    words = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
    single = [bytes([k]) for k in range(clear)] + [b"", b""]
    out: list[bytes] = []
    done, at = 0, 0
    limit, full = 512, False
    table: list[bytes] = []
    before = b""
    while done < size:
        codes = _unpack(words, at, least, min(limit, 8192), full)
        if not len(codes):
            break
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and len(codes) == limit and limit < 8192:
            limit *= 4  # the segment is longer: read more of it at once
            continue
        own = codes[: stop[0]].tolist() if len(stop) else codes.tolist()
        if not full:
            table, before = single.copy(), b""
        for code in own:
            if code < len(table):
                entry = table[code]
            elif before and code == len(table):
                entry = before + before[:1]
            else:
                return b"".join(out)[:size]  # not a code that can stand here
            out.append(entry)
            done += len(entry)
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            before = entry
        if not len(stop) and len(codes) == 8192:
            # a deferred clear code: the table is full and stays as it is
            at += 8192 * 12 if full else int(_schedule(least)[1][8192])
            full = True
            continue
        if not len(stop) or codes[stop[0]] == end:
            break
        at += 12 * (int(stop[0]) + 1) if full else int(_schedule(least)[1][stop[0] + 1])
        limit, full = 512, False
    return b"".join(out)[:size]


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    """LZW code stream of samples; a clear code whenever the table is full."""
    clear, end = 1 << least, (1 << least) + 1
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    following, prefix = end + 1, -1
    for byte in samples:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get(key := prefix << 8 | byte)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = byte
        if following < 4095:
            table[key] = following
            following += 1
        else:
            codes.append(clear)
            segments.append(codes)
            codes, table, following = [], {}, end + 1
    if prefix >= 0:
        codes.append(prefix)
    codes.append(end)
    segments.append(codes)
    widths = _schedule(least)[0]
    # the stream opens with a clear code
    every = np.concatenate([[clear], *segments])
    bits = np.concatenate([widths[:1], *(widths[: len(s)] for s in segments)])
    start = np.cumsum(bits) - bits
    n_bytes = -(-int(bits.sum()) // 8)
    # a code touches three bytes at most, and no two codes share a bit
    spread = every << (start & 7)
    parts = [np.bincount((start >> 3) + k, weights=(spread >> (8 * k)) & 255, minlength=n_bytes + 3) for k in range(3)]
    return sum(parts)[:n_bytes].astype(np.uint8).tobytes()


# ---------------------------------------------------------------------- files


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes, and the empty one that ends them."""
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    """Contents of sub-blocks, and where they end."""
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


#: Palette of written files: index k is grey level k.
_GREYS = bytes(k for level in range(256) for k in (level, level, level))


def write_gif(payload: bytes) -> bytes:
    """A GIF whose samples, frame by frame, are the payload; its length is a multiple of a tile."""
    rows = min(len(payload) // SIDE, SIDE * TILES)
    out = [b"GIF89a", struct.pack("<HHBBB", SIDE, rows, 0xF7, 0, 0), _GREYS]
    for at in range(0, len(payload), TILE_BYTES * TILES):
        part = payload[at : at + TILE_BYTES * TILES]
        # restore to background after each frame, no transparent index
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, len(part) // SIDE, 0))
        out.append(b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def _rows_in_order(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes, composite: bool = True) -> Gif:
    """Frames of a GIF; with ``composite`` the canvas after each frame (height x width x RGBA)."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n
    gif, clock = Gif(width, height), 0
    canvas = np.zeros((height, width, 4), np.uint8) if composite else None
    disposal, delay, transparent = 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _joined(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if local & 0x80:
                n = 2 << (local & 7)
                palette = np.zeros((256, 3), np.uint8)
                palette[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
                at += 3 * n
            least = data[at]
            stream, at = _joined(data, at + 1)
            samples = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8)
            frame = Frame(left, top, w, h, delay, clock, disposal, transparent, palette, samples)
            if local & 0x40 and len(samples) == w * h:
                straight = np.empty((h, w), np.uint8)
                straight[_rows_in_order(h, True)] = samples.reshape(h, w)
                frame.indices = straight.reshape(-1)
            if composite:
                canvas = _show(canvas, frame)
            gif.frames.append(frame)
            clock += delay
            disposal, delay, transparent = 0, 0, None
        else:
            break
    return gif


def _show(canvas: np.ndarray, frame: Frame) -> np.ndarray:
    """Draw a frame, keep what is then on screen, and dispose of it."""
    before = canvas.copy() if frame.disposal == 3 else None
    area = canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]
    full = np.zeros(frame.width * frame.height, np.int64) - 1
    full[: len(frame.indices)] = frame.indices
    full = full.reshape(frame.height, frame.width)[: area.shape[0], : area.shape[1]]
    drawn = full >= 0
    if frame.transparent is not None:
        drawn &= full != frame.transparent
    area[drawn, :3] = frame.palette[full[drawn]]
    area[drawn, 3] = 255
    frame.canvas = canvas.copy()
    if frame.disposal == 2:
        area[:] = 0
    elif frame.disposal == 3:
        canvas = before
    return canvas


def histogram(frame: Frame) -> np.ndarray:
    """Samples of a frame by the brightness of their colour, in equal ranges; transparent ones do not count."""
    grey = (frame.palette.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(axis=1) // 1000
    counts = np.bincount(frame.indices, minlength=256)
    if frame.transparent is not None:
        counts[frame.transparent] = 0
    return np.bincount(grey * BINS // 256, weights=counts, minlength=BINS).astype(np.int64)


def shown(frame: Frame) -> np.ndarray:
    """Pixels on the canvas after a frame by the brightness of their colour, in equal ranges; transparent ones do not count."""
    seen = frame.canvas[frame.canvas[:, :, 3] > 0][:, :3]
    grey = (seen.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) // 1000
    return np.bincount(grey * BINS // 256, minlength=BINS).astype(np.int64)


def samples(gif: Gif) -> bytes:
    """The stored bytes again."""
    return b"".join(f.indices.tobytes() for f in gif.frames)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and its payload: bytes 255 fill the last tile, and an empty text has one tile."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % TILE_BYTES if raw else TILE_BYTES)


def media(df: DataFrame, with_media: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text stored as a GIF, read back, and described.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (histogram of all frames as composited); with
    ``with_media`` the file and its frames (start and delay in hundredths of a second, height, histogram).
    """
    arrow_batches(df.sparkSession)
    frame_type = pa.struct([("start", pa.int64()), ("delay", pa.int64()), ("height", pa.int64()), ("histogram", pa.list_(pa.int64()))])
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields + ([("media", pa.binary()), ("frames", pa.list_(frame_type))] if with_media else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n_bytes, payload = payload_of(text)
                stored = write_gif(payload)
                gif = read_gif(stored)
                back = samples(gif)
                bins = [shown(f) for f in gif.frames]
                row = [doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), ",".join(map(str, sum(bins).tolist()))]
                if with_media:
                    row += [stored, [{"start": f.start, "delay": f.delay, "height": f.height, "histogram": b.tolist()} for f, b in zip(gif.frames, bins)]]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return texts_of(df, id_col, text_col).mapInArrow(run, columns + ", media binary, frames array<struct<start:long,delay:long,height:long,histogram:array<long>>>" * with_media)


_FRAMES = "array<struct<start:long,delay:long,disposal:int,left:int,top:int,width:int,height:int,histogram:array<long>,canvas_sha256:string>>"


def frames(df: DataFrame, id_col: str = "doc_id", gif_col: str = "media") -> DataFrame:
    """Per row of a column of GIF files: doc_id, width, height, and its timed frames as composited.

    A frame has its time, disposal and rectangle, the histogram of what is then
    on the canvas, and the digest of the canvas (RGBA).  A null or broken file
    has null frames.
    """
    arrow_batches(df.sparkSession, 100)
    names = ("start", "delay", "disposal", "left", "top", "width", "height")
    kind = pa.struct([(n, pa.int64() if n in ("start", "delay") else pa.int32()) for n in names] + [("histogram", pa.list_(pa.int64())), ("canvas_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2_000_000):
            rows = []
            for raw in batch.column(1).to_pylist():
                try:
                    gif = read_gif(raw)
                    rows.append((gif.width, gif.height, [{n: getattr(f, n) for n in names} | {"histogram": shown(f).tolist(), "canvas_sha256": hashlib.sha256(f.canvas.tobytes()).hexdigest()} for f in gif.frames]))
                except (TypeError, ValueError, IndexError, struct.error):
                    rows.append((None, None, None))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.list_(kind))))], ["doc_id", "width", "height", "frames"])

    from pyspark.sql import functions as F

    files = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(gif_col).cast("binary").alias("media"))
    return files.mapInArrow(run, f"doc_id long, width int, height int, frames {_FRAMES}")
