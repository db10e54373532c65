"""PNG of every kind and baseline JPEG against samples that were written; damaged files; the time of large ones."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgauge.sources import images, jpeg, png
from jpeg_files import jpeg as written


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.integers(1, 40), st.integers(1, 40), st.booleans(), st.randoms(use_true_random=False))
def test_png_of_every_kind(channels, high, wide, interlaced, draw):
    rng = np.random.default_rng(draw.randrange(1 << 30))
    bits = int(draw.choice(png.DEPTHS[{1: 0, 2: 4, 3: 2, 4: 6}[channels]]))
    p = rng.integers(0, 1 << bits, (high, wide, channels))
    raw = png.encode(p, bits, rng.integers(0, 5, high), interlaced)
    assert (images.pixels(raw) == (p >> 8 if bits == 16 else p * (255 // ((1 << bits) - 1)))).all()


def by_hand(kinds, rows, step):
    """The filters' definitions, byte by byte."""
    out = []
    for y, (kind, row) in enumerate(zip(kinds, rows)):
        line = []
        for x, v in enumerate(row):
            a, b, c = line[x - step] if x >= step else 0, out[y - 1][x] if y else 0, out[y - 1][x - step] if y and x >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v + (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out.append(line)
    return out


@pytest.mark.parametrize("step", [1, 2, 3, 4, 6, 8])
def test_filters_are_undone(step):
    rng = np.random.default_rng(step)
    for kinds in ([0, 1, 2, 3, 4] * 2, [4], [3], [1, 2, 0], [4, 4, 3, 3, 2]):
        raw = rng.integers(0, 256, (len(kinds), 1 + 7 * step)).astype(np.uint8)
        raw[:, 0] = kinds
        assert png.unfiltered(raw, step).tolist() == by_hand(kinds, raw[:, 1:].tolist(), step)


def test_palettes():
    rng = np.random.default_rng(5)
    for bits in (1, 2, 4, 8):
        colours, p = rng.integers(0, 256, (1 << bits, 3)), rng.integers(0, 1 << bits, (9, 13))
        assert (images.pixels(png.encode(p, bits, np.array([4, 1]), bits == 2, colours)) == colours[p]).all()
    with pytest.raises(ValueError, match="palette"):
        images.pixels(png.encode(np.full((2, 2), 3), 2, None, False, np.zeros((2, 3))))


def test_damaged_png():
    raw = png.encode(np.arange(400).reshape(20, 20) % 256, 8, np.array([4]))
    for bad in (raw[:40], raw[:-30], raw[:60] + b"\0" + raw[61:], raw[:16] + b"\x7f\xff\xff\xff" * 2 + raw[24:], b"", b"\x89PNG\r\n\x1a\n"):
        assert images.features_of(bad)["error"]
    import struct
    import zlib

    head = struct.pack(">IIBBBBB", 60_000, 60_000, 8, 6, 0, 0, 0)
    huge = raw[:16] + head + struct.pack(">I", zlib.crc32(b"IHDR" + head)) + raw[33:]
    began = time.perf_counter()
    assert "can't hold" in images.features_of(huge)["error"] and time.perf_counter() - began < 1


def test_ten_megapixels_take_seconds():
    p = np.cumsum(np.random.default_rng(1).integers(0, 4, (3200, 3200, 3)), axis=1).astype(np.uint8)
    raw = png.encode(p, 8, np.array([4, 3, 4, 2, 1]))
    spin = time.process_time()
    sum(range(5_000_000))
    spin = time.process_time() - spin  # what this machine's CPU takes for a fixed piece of work, about 0.1 s
    began = time.process_time()
    assert (images.pixels(raw) == p).all()
    assert time.process_time() - began < 2 * max(1, spin / 0.1)


def smooth(high, wide):
    return (128 + 60 * np.sin(np.arange(high)[:, None] / 7) + 50 * np.cos(np.arange(wide) / 5)).clip(0, 255)


@pytest.mark.parametrize("high,wide", [(1, 1), (8, 8), (17, 23), (40, 33)])
def test_grey_jpeg(high, wide):
    noise = np.random.default_rng(high).integers(0, 256, (high, wide))
    for p, most in ((smooth(high, wide), 1.5), (noise, 3)):
        for restart in (0, 1, 3):
            got = images.pixels(written([p], [(1, 1)], np.ones(64), restart))
            assert got.shape == (high, wide, 1) and abs(got[..., 0] - p).max() <= most


@pytest.mark.parametrize("factors", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(4, 1), (2, 1), (1, 1)]])
def test_colour_jpeg(factors):
    high, wide = 37, 45
    light, blue, red = smooth(high, wide), 128 + 20 * np.sin(np.arange(wide) / 19) + np.zeros((high, 1)), 128 - 15 * np.cos(np.arange(high) / 18)[:, None] + np.zeros(wide)
    want = np.stack([light + 1.402 * (red - 128), light - 0.344136 * (blue - 128) - 0.714136 * (red - 128), light + 1.772 * (blue - 128)], axis=2).clip(0, 255)
    for alone in (False, True):
        assert abs(images.pixels(written([light, blue, red], factors, np.ones(64), 2, alone)) - want).max() <= 5
    plain = images.pixels(written([light, blue, red], factors, np.ones(64), names=(82, 71, 66)))
    assert abs(plain - np.stack([light, blue, red], axis=2)).max() <= 5


def test_damaged_jpeg():
    raw = written([smooth(64, 64)], [(1, 1)], np.ones(64))
    for bad in (raw[:40], raw[:-200], raw.replace(b"\xff\xc0", b"\xff\xc2"), raw.replace(b"\xff\xc4", b"\xff\xfe"), b"\xff\xd8\xff\xd9", b"\xff\xd8"):
        assert images.features_of(bad)["error"]
    huge = raw.replace(b"\x08\x00\x40\x00\x40", b"\x08\xff\xff\xff\xff")
    assert "can't hold" in images.features_of(huge)["error"]


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64)) and jpeg.ZIGZAG[-1] == 63


def python_processes(df) -> int:
    """Python steps of the plan that have a process of their own in each task."""
    return str(df._jdf.queryExecution().executedPlan()).count("MapInArrow")


@pytest.mark.parametrize("name", ["image_overlays", "image_kinds", "image_crops"])
def test_one_python_process_a_task(spark, sf, name):
    from docgauge.plans import catalogue

    assert python_processes(catalogue.QUERIES[name](spark, sf)) == 1


def test_sums_hold_one_image():
    import tracemalloc

    import pyarrow as pa

    from docgauge.plans.catalogue import placed_sums

    raw = images.to_png(np.full((25, 16, 3), 7, np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(4000)]), pa.array([raw] * 4000, pa.binary())], ["image", "content"])
    tracemalloc.start()
    sums = pa.Table.from_batches(placed_sums([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(sums["total"].to_pylist()) == {25 * 16 * 3 * 7} and most < 10e6  # all images' samples as whole numbers: 38 MB
