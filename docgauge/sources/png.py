"""PNG files to samples and back: every colour type, depth, filter and interlace.

A row's Average and Paeth filters need the sample before and the row above, so
rows can't be undone at once, but samples on an anti-diagonal can: what they need
lies on the two diagonals before.  A step works on all rows' samples of one
diagonal, whatever filter each row has; width + height steps undo an image.
Images without these filters are undone row by row.

What is decompressed is bounded by what the header announces, and a header that
announces more than its data could hold is refused.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel and depths of the colour types; first column and row, and steps, of the passes of an interlaced image.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Bytes that one byte of deflated data can become at most.
RATIO = 1032
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _paeth(left, up, corner):
    to_left, to_up = up - corner, left - corner
    to_corner = np.abs(to_left + to_up)
    to_left, to_up = np.abs(to_left), np.abs(to_up)
    return np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))


def _by_rows(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    above = np.zeros(rows.shape[1], np.uint8)
    for kind, line in zip(kinds.tolist(), rows):
        if kind == SUB:
            line[:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == UP:
            line += above
        above = line
    return rows


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    high, wide = len(rows), rows.shape[1] // step
    flat = rows.reshape(high * wide, step)
    masks = {k: (kinds == k).astype(np.int16)[:, None] for k in (SUB, UP, AVERAGE, PAETH) if (kinds == k).any()}
    # of the diagonals before: row y's sample stands at y + 1, so the row above is one place ahead
    last, older = np.zeros((high + 1, step), np.int16), np.zeros((high + 1, step), np.int16)
    jump = max(1, wide - 1)
    for t in range(wide + high - 1):
        a, b = max(0, t - wide + 1), min(high - 1, t) + 1
        at = slice(a * (wide - 1) + t, (b - 1) * (wide - 1) + t + 1, jump)
        left, up, corner = last[a + 1 : b + 1], last[a:b], older[a:b]
        # a row's first sample has nothing to its left; the diagonals hold what was there before
        guess = 0
        if SUB in masks:
            guess = masks[SUB][a:b] * left
        if UP in masks:
            guess = guess + masks[UP][a:b] * up
        if AVERAGE in masks:
            guess = guess + masks[AVERAGE][a:b] * (left + up >> 1)
        if PAETH in masks:
            guess = guess + masks[PAETH][a:b] * _paeth(left, up, corner)
        now = flat[at] + guess & 255
        flat[at] = now
        older, last = last, older
        last[a + 1 : b + 1] = now
        if b < high:
            # row b begins on the next diagonal: nothing is to its left
            last[b + 1] = 0
        last[0] = 0
    return rows


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a filter byte and bytes of samples -> the bytes of samples; `step`: bytes from a sample to the one before."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError(f"unknown filter {kinds.max()}")
    return (_by_diagonals if (kinds >= AVERAGE).any() else _by_rows)(kinds, rows, step)


def filtered(rows: np.ndarray, step: int, kinds: np.ndarray) -> np.ndarray:
    """The other way: rows of bytes of samples -> rows with their filter byte, filtered by `kinds`."""
    x = rows.astype(np.int16)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, step:], up[1:] = x[:, :-step], x[:-1]
    corner = np.zeros_like(x)
    corner[1:, step:] = x[:-1, :-step]
    guess = np.choose(kinds[:, None], [np.zeros_like(x), left, up, left + up >> 1, _paeth(left, up, corner)])
    return np.concatenate([kinds[:, None].astype(np.uint8), (x - guess & 255).astype(np.uint8)], axis=1)


def _samples(rows: np.ndarray, width: int, channels: int, bits: int) -> np.ndarray:
    """Rows of bytes -> (height, width, channels) samples of `bits` bits; of 16 the high eight."""
    if bits == 16:
        rows = rows[:, ::2]
    elif bits < 8:
        places = np.arange(8 - bits, -1, -bits)
        rows = (rows[:, :, None] >> places & (1 << bits) - 1).astype(np.uint8).reshape(len(rows), -1)[:, : width * channels]
    return rows.reshape(len(rows), width, channels)


def _sizes(width: int, height: int, interlaced: int):
    """(first column, first row, column step, row step, width, height) of each pass that has pixels."""
    for x, y, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            yield x, y, dx, dy, w, h


def header(raw: bytes) -> tuple[int, int, int, int, int]:
    """(width, height, bits, colour type, interlaced)."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR" or len(raw) < 33:
        raise ValueError("not a PNG image")
    width, height, bits, colour, packing, filters, interlaced = struct.unpack(">IIBBBBB", raw[16:29])
    if not 0 < width < 1 << 31 or not 0 < height < 1 << 31 or bits not in DEPTHS.get(colour, ()) or packing or filters or interlaced > 1:
        raise ValueError(f"PNG header of {width} x {height}, {bits} bits, colour type {colour}, interlace {interlaced}")
    return width, height, bits, colour, interlaced


def decode(raw: bytes) -> np.ndarray:
    """(height, width, channels) 8-bit samples; shallow greys are spread over 0 to 255, palettes give their colours."""
    width, height, bits, colour, interlaced = header(raw)
    at, packed, palette = 8, [], None
    while at + 12 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if kind in (b"IHDR", b"PLTE", b"IDAT") and (len(body) < n or raw[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body))):
            raise ValueError("damaged PNG chunk")
        if kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    channels = CHANNELS[colour]
    sizes = list(_sizes(width, height, interlaced))
    lengths = [(1 + -(-w * channels * bits // 8)) * h for *_, w, h in sizes]
    packed = b"".join(packed)
    if sum(lengths) > RATIO * len(packed):
        raise ValueError(f"{len(packed)} bytes can't hold {width} x {height} pixels")
    data = zlib.decompressobj().decompress(packed, sum(lengths))
    if len(data) < sum(lengths):
        raise ValueError("PNG data ends early")
    out, done = np.empty((height, width, channels), np.uint8), 0
    for (x, y, dx, dy, w, h), n in zip(sizes, lengths):
        rows = np.frombuffer(data, np.uint8, n, done).reshape(h, -1)
        out[y::dy, x::dx] = _samples(unfiltered(rows, max(1, channels * bits // 8)), w, channels, bits)
        done += n
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise ValueError("a colour isn't in the palette")
        return palette[out[..., 0]]
    return out * (255 // ((1 << bits) - 1)) if bits < 8 else out


def encode(p: np.ndarray, bits: int = 8, kinds: np.ndarray | None = None, interlaced: bool = False, palette: np.ndarray | None = None) -> bytes:
    """(height, width) or (height, width, 1 to 4) samples of `bits` bits as a file; rows are filtered by `kinds`, one for each row and cyclic."""
    p = p if p.ndim == 3 else p[..., None]
    height, width, channels = p.shape
    colour = 3 if palette is not None else {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    if bits not in DEPTHS[colour]:
        raise ValueError(f"no {bits} bits in colour type {colour}")
    kinds = np.zeros(1, np.int64) if kinds is None else np.asarray(kinds)
    parts = []
    for x, y, dx, dy, w, h in _sizes(width, height, interlaced):
        own = p[y::dy, x::dx].reshape(h, w * channels)
        if bits == 16:
            rows = own.astype(">u2").view(np.uint8).reshape(h, -1)
        elif bits == 8:
            rows = own.astype(np.uint8)
        else:
            own = np.pad(own, ((0, 0), (0, -own.shape[1] % (8 // bits)))).reshape(h, -1, 8 // bits)
            rows = (own << np.arange(8 - bits, -1, -bits)).sum(axis=2).astype(np.uint8)
        parts.append(filtered(rows, max(1, channels * bits // 8), np.resize(kinds, h)).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    colours = b"" if palette is None else chunk(b"PLTE", np.asarray(palette, np.uint8).tobytes())
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, int(interlaced))) + colours + chunk(b"IDAT", zlib.compress(b"".join(parts))) + chunk(b"IEND", b"")
