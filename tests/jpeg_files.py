"""A small writer of baseline JPEG files for tests: random code tables, any subsampling, restarts."""

import struct

import numpy as np

from docgauge.sources.jpeg import COSINES, ZIGZAG


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00") if bits else b""


def table(symbols):
    """(counts, symbols, code and length by symbol): a few short codes, the others of nine bits and more."""
    lengths = [3, 4, 5, 6, 7][: min(5, len(symbols))] + [9 + (k > 150) for k in range(len(symbols) - 5)]
    counts = [lengths.count(n) for n in range(1, 17)]
    code, out, last = 0, {}, lengths[0]
    for s, n in zip(symbols, lengths):
        code <<= n - last
        last = n
        out[s] = (code, n)
        code += 1
    return bytes(counts), bytes(symbols), out


def sized(value):
    n = int(abs(value)).bit_length()
    return n, value if value > 0 else value + (1 << n) - 1


def jpeg(planes, factors, quant, restart=0, alone=False, names=(1, 2, 3), markers=b""):
    """`planes`: whole-size samples of each component, averaged down where its factors are smaller than the greatest."""
    high, wide = planes[0].shape
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    across, down = -(-wide // (8 * h)), -(-high // (8 * v))
    grids = []
    for p, (fh, fv) in zip(planes, factors):
        full = np.pad(p.astype(float), ((0, down * 8 * v - high), (0, across * 8 * h - wide)), mode="edge")
        small = full.reshape(full.shape[0] * fv // v, v // fv, full.shape[1] * fh // h, h // fh).mean(axis=(1, 3)) - 128
        blocks = small.reshape(small.shape[0] // 8, 8, small.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        grids.append(np.rint(COSINES @ blocks @ COSINES.T / quant.reshape(8, 8)).astype(int).reshape(*blocks.shape[:2], 64)[..., ZIGZAG])
    dc, ac = table(list(range(12))), table([0, 1, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11) if (r, s) != (0, 1))])
    put = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + markers + put(0xDB, b"\0" + bytes(quant[ZIGZAG].astype(np.uint8)))
    out += put(0xC0, struct.pack(">BHHB", 8, high, wide, len(planes)) + b"".join(bytes([n, fh << 4 | fv, 0]) for n, (fh, fv) in zip(names, factors)))
    out += put(0xC4, b"\0" + dc[0] + dc[1] + b"\x10" + ac[0] + ac[1]) + (put(0xDD, struct.pack(">H", restart)) if restart else b"")

    def scan(units):
        nonlocal out
        bits, last = Bits(), {}
        for u, unit in enumerate(units):
            if restart and u and u % restart == 0:
                out += bits.bytes() + bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
                bits, last = Bits(), {}
            for c, block in unit:
                n, value = sized(int(block[0]) - last.get(c, 0))
                last[c] = int(block[0])
                bits.put(*dc[2][n])
                bits.put(value, n)
                run = 0
                for x in block[1:].tolist():
                    if not x:
                        run += 1
                        continue
                    while run > 15:
                        bits.put(*ac[2][0xF0])
                        run -= 16
                    n, value = sized(x)
                    bits.put(*ac[2][run << 4 | n])
                    bits.put(value, n)
                    run = 0
                if run:
                    bits.put(*ac[2][0])
        out += bits.bytes()

    if alone or len(planes) == 1:
        for c, (fh, fv) in enumerate(factors):
            bw, bh = -(-wide * fh // (8 * h)), -(-high * fv // (8 * v))
            out += put(0xDA, bytes([1, names[c], 0, 0, 63, 0]))
            scan([[(c, grids[c][y, x])] for y in range(bh) for x in range(bw)])
    else:
        out += put(0xDA, bytes([len(planes)]) + b"".join(bytes([n, 0]) for n in names[: len(planes)]) + b"\0\x3f\0")
        scan([[(c, grids[c][my * fv + y, mx * fh + x]) for c, (fh, fv) in enumerate(factors) for y in range(fv) for x in range(fh)] for my in range(down) for mx in range(across)])
    return out + b"\xff\xd9"
