"""Code streams of encoders that do not clear a full table."""

import struct

import numpy as np
import pytest

from palimpsest.llm import gif


def deferred(samples: bytes, least: int, clear_at: int = 0) -> bytes:
    """LZW of a plain encoder that writes a clear code first, and once more after ``clear_at`` codes (never where 0)."""
    clear, end = 1 << least, (1 << least) + 1
    out = count = bits = 0

    def put(code: int, width: int) -> None:
        nonlocal out, bits
        out |= code << bits
        bits += width

    fresh = lambda: {bytes([k]): k for k in range(clear)}
    table, following, width, prefix = fresh(), end + 1, least + 1, b""
    put(clear, width)
    for k in range(len(samples)):
        longer = prefix + samples[k : k + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        count += 1
        if following < 4096:
            table[longer] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        prefix = samples[k : k + 1]
        if count == clear_at:
            put(clear, width)
            table, following, width = fresh(), end + 1, least + 1
    put(table[prefix], width)
    if following == 1 << width and width < 12:
        width += 1
    put(end, width)
    return out.to_bytes(-(-bits // 8), "little")


@pytest.mark.parametrize("clear_at", [0, 3000, 8192, 9000, 16384, 20000])
@pytest.mark.parametrize("n", [100, 40_000])
def test_deferred_clear_codes(n, clear_at):
    samples = np.random.default_rng(n).integers(0, 64, n, dtype=np.uint8).tobytes()
    assert gif.lzw_decode(deferred(samples, 6, clear_at), 6, n) == samples


def test_written_streams_still_decode():
    samples = np.random.default_rng(1).integers(0, 256, 50_000, dtype=np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(samples), 8, len(samples)) == samples


PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])  # black, red, green, blue


def handmade(*frames) -> bytes:
    """A 4 x 2 GIF of frames (left, top, width, height, indices, disposal, delay, transparent, interlaced, own palette)."""
    out = [b"GIF89a", struct.pack("<HHBBB", 4, 2, 0x81, 0, 0), PALETTE]
    for left, top, width, height, indices, disposal, delay, transparent, interlaced, own in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, width, height, 0x40 * interlaced | (0x81 if own else 0)) + (own or b""))
        out.append(b"\x02" + gif._blocks(gif.lzw_encode(bytes(indices), 2)))
    return b"".join([*out, b"\x3b"])


def colours(canvas) -> list[str]:
    name = {(0, 0, 0, 255): "k", (255, 0, 0, 255): "r", (0, 255, 0, 255): "g", (0, 0, 255, 255): "b", (0, 0, 0, 0): ".", (9, 9, 9, 255): "n"}
    return ["".join(name[tuple(p)] for p in row.tolist()) for row in canvas]


def test_disposal_transparency_and_palettes():
    own = bytes([9, 9, 9] * 4)
    data = handmade(
        (0, 0, 4, 2, [1] * 8, 1, 5, None, False, None),
        (0, 0, 2, 1, [2, 3], 2, 7, 3, False, None),
        (1, 0, 2, 2, [3, 3, 3, 3], 3, 0, None, False, None),
        (3, 1, 1, 1, [0], 0, 2, None, False, own),
    )
    found = gif.read_gif(data)
    assert [colours(f.canvas) for f in found.frames] == [["rrrr", "rrrr"], ["grrr", "rrrr"], [".bbr", "rbbr"], ["..rr", "rrrn"]]
    assert [(f.start, f.delay, f.disposal) for f in found.frames] == [(0, 5, 1), (5, 7, 2), (12, 0, 3), (12, 2, 0)]


def test_interlaced_rows():
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    out = [b"GIF87a", struct.pack("<HHBBB", 1, 9, 0x83, 0, 0), bytes(3 * 16), b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 9, 0x40), b"\x04" + gif._blocks(gif.lzw_encode(bytes(rows), 4)), b"\x3b"]
    assert gif.read_gif(b"".join(out)).frames[0].indices.tolist() == list(range(9))


def test_frames_of_a_column(spark):
    data = handmade((0, 0, 4, 2, [1] * 8, 2, 5, None, False, None), (0, 0, 1, 1, [2], 0, 5, None, False, None))
    rows = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"GIF89a")), (4, bytearray(b"no"))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in gif.frames(rows).collect()}
    assert [sum(f["histogram"]) for f in got[1]["frames"]] == [8, 1] and (got[1]["width"], got[1]["height"]) == (4, 2)
    assert [f["start"] for f in got[1]["frames"]] == [0, 5]
    assert got[2]["frames"] is None and got[3]["frames"] is None and got[4]["frames"] is None


def test_stored_frames(spark):
    texts = spark.createDataFrame([(1, "x" * 20_000), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in gif.media(texts, with_media=True).collect()}
    assert [f["start"] for f in got[1]["frames"]] == [0, 4, 8] and len(got[2]["frames"]) == 1
    assert ",".join(str(sum(k)) for k in zip(*(f["histogram"] for f in got[1]["frames"]))) == got[1]["feature"]
