"""Baseline JPEG files to samples.

A scan's bits are read one code after the other, as each says where the next one
begins: a table by the next 16 bits gives code, length and the bits of the value
at once, and coefficients are kept as (place, value) pairs.  What follows is done
for all blocks together: dequantising, the inverse cosine transform as two small
matrix products, spreading subsampled colours and the change of colours.

Read are Huffman-coded sequential files with 8 bits, of one or three components,
any subsampling, with or without restarts.  Progressive and arithmetic files,
12 bits and four components give an error.
"""

from __future__ import annotations

import struct

import numpy as np

#: The order of a block's coefficients (fixed by rule: diagonals of an 8 x 8 square, alternately upwards and downwards).
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: A row per frequency, a column per sample.
COSINES = np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
#: What the two colour differences add to red, green and blue.
FROM_RED, FROM_BLUE = (1.402, -0.714136, 0.0), (0.0, -0.344136, 1.772)
#: Bits that a block takes at least.
LEAST_BITS = 2


def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: length of the code << 8 | symbol, or 0 where no code begins so."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            if code >= 1 << length:
                raise ValueError("damaged JPEG code table")
            table[code << 16 - length : code + 1 << 16 - length] = length << 8 | s
            code += 1
        at += n
        code <<= 1
    return table.tolist()


def _scan(data: bytes, at: int, plan: list[tuple[int, list[int], list[int], int]], units: int, restart: int):
    """Reads `units` groups of blocks, each as `plan` tells (component, table of first values, of others, blocks); per component the places and values of coefficients, and blocks read."""
    n = max((c for c, *_ in plan), default=0) + 1
    places: list[list[int]] = [[] for _ in range(n)]
    values: list[list[int]] = [[] for _ in range(n)]
    blocks, first = [0] * n, [0] * n
    zigzag = ZIGZAG.tolist()
    held = count = 0  # bits that were taken from the data and not used yet
    end, ended = len(data), 0
    for unit in range(units):
        if restart and unit and unit % restart == 0:
            # the rest of the byte is filling; a marker comes next
            held = count = 0
            while at + 1 < end and not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at += 2
            ended, first = 0, [0] * n
        for c, of_first, of_others, times in plan:
            own_places, own_values = places[c], values[c]
            for _ in range(times):
                base, k = blocks[c] * 64, 0
                while k < 64:
                    while count < 32:
                        if at < end and not (data[at] == 0xFF and at + 1 < end and data[at + 1]):
                            held = held << 8 | data[at]
                            at += 2 if data[at] == 0xFF else 1
                        else:
                            # a marker or the end: what is missing counts as zeros, a few bytes at most
                            ended += 1
                            if ended > 8:
                                raise ValueError("JPEG data ends early")
                            held <<= 8
                        count += 8
                    got = (of_others if k else of_first)[held >> count - 16 & 0xFFFF]
                    if not got:
                        raise ValueError("damaged JPEG data")
                    count -= got >> 8
                    size = got & 15
                    if k:
                        run = got >> 4 & 15
                        if not size:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        if k > 63:
                            raise ValueError("damaged JPEG data")
                    value = 0
                    if size:
                        count -= size
                        value = held >> count & (1 << size) - 1
                        if value < 1 << size - 1:
                            value += 1 - (1 << size)
                    held &= (1 << count) - 1
                    if not k:
                        first[c] = value = first[c] + value
                    if value:
                        own_places.append(base + zigzag[k])
                        own_values.append(value)
                    k += 1
                blocks[c] += 1
    return places, values, blocks, at


def decode(raw: bytes) -> np.ndarray:
    """(height, width, 1 or 3) samples; three components as red, green and blue."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, restart, adobe = 2, 0, None
    quant, codes, frame = {}, {}, None
    grids: dict[int, np.ndarray] = {}
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            at += 1
            continue
        kind = raw[at + 1]
        if kind == 0xFF or kind == 0 or 0xD0 <= kind <= 0xD8 or kind == 1:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        n = struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                table = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float64)
                natural = np.empty(64)
                natural[ZIGZAG] = table
                quant[body[k] & 15] = natural
                k += 1 + 64 * (1 + bool(wide))
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                codes[body[k]] = lookup(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif kind in (0xC0, 0xC1):
            bits, high, wide, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts not in (1, 3) or not high or not wide:
                raise ValueError(f"JPEG of {wide} x {high}, {bits} bits, {parts} components isn't read")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
            if any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in frame):
                raise ValueError("damaged JPEG header")
        elif 0xC0 < kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only sequential Huffman-coded JPEG is read")
        elif kind == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("JPEG scan without a header")
            names = [f[0] for f in frame]
            chosen = [(names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
            across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
            if len(chosen) == 1:
                # a component alone: its own blocks, row by row
                c = chosen[0][0]
                bw, bh = -(-wide * frame[c][1] // (8 * most_h)), -(-high * frame[c][2] // (8 * most_v))
                plan, units = [(0, codes[chosen[0][1] >> 4], codes[16 | chosen[0][1] & 15], 1)], bw * bh
            else:
                plan, units = [(i, codes[t >> 4], codes[16 | t & 15], frame[c][1] * frame[c][2]) for i, (c, t) in enumerate(chosen)], across * down
            if units * sum(p[3] for p in plan) * LEAST_BITS > 8 * (len(raw) - at + 8):
                raise ValueError(f"{len(raw)} bytes can't hold {wide} x {high} pixels")
            places, values, blocks, at = _scan(raw, at, plan, units, restart)
            for i, (c, _) in enumerate(chosen):
                _, h, v, q = frame[c]
                flat = np.zeros(blocks[i] * 64)
                flat[places[i]] = values[i]
                flat = (flat.reshape(-1, 64) * quant[q]).reshape(-1, 8, 8)
                own = COSINES.T @ flat @ COSINES
                if len(chosen) == 1:
                    own = own.reshape(bh, bw, 8, 8).transpose(0, 2, 1, 3).reshape(bh * 8, bw * 8)
                else:
                    own = own.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
                grids[c] = np.clip(np.rint(own + 128), 0, 255)
    if frame is None or len(grids) < len(frame):
        raise ValueError("JPEG data ends early")
    whole = []
    for c, (_, h, v, _) in enumerate(frame):
        rows, columns = np.arange(high) * v // most_v, np.arange(wide) * h // most_h
        whole.append(grids[c][rows][:, columns])
    if len(whole) == 1:
        return whole[0].astype(np.uint8)[..., None]
    if adobe == 0 or [f[0] for f in frame] == [82, 71, 66]:
        return np.stack(whole, axis=2).astype(np.uint8)
    light, blue, red = whole[0], whole[1] - 128, whole[2] - 128
    return np.stack([np.clip(np.rint(light + FROM_RED[k] * red + FROM_BLUE[k] * blue), 0, 255) for k in range(3)], axis=2).astype(np.uint8)
