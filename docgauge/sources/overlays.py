"""Boxes drawn on images: outlines with numbers, true and predicted ones in their colours, one image or three side by side.

Drawing is slicing of sample arrays; each image is a row of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docgauge.sources import images, png

#: Colours and widths of true and predicted boxes, the ground of side-by-side images.
TRUE, PREDICTED, GROUND = (0, 200, 0), (255, 40, 40), (30, 30, 30)
TRUE_WIDTH, PREDICTED_WIDTH, GAP, FOOT = 3, 2, 10, 40
#: Digits and the letters of labels, three columns by five rows, a row per group of marks.
GLYPHS = {
    "0": "### #.# #.# #.# ###", "1": ".#. ##. .#. .#. ###", "2": "### ..# ### #.. ###", "3": "### ..# ### ..# ###", "4": "#.# #.# ### ..# ..#",
    "5": "### #.. ### ..# ###", "6": "### #.. ### #.# ###", "7": "### ..# ..# ..# ..#", "8": "### #.# ### #.# ###", "9": "### #.# ### ..# ###",
    "G": "### #.. #.# #.# ###", "P": "### #.# ### #.. #..", "T": "### .#. .#. .#. .#.",
}


def outline(p: np.ndarray, box, colour, width: int) -> None:
    """A rectangle with its corners' samples included, `width` samples inwards; what lies outside the image is left out. xywh boxes count as such where a second corner lies before the first."""
    x1, y1, x2, y2 = (int(v) for v in box)
    if x2 < x1 or y2 < y1:
        x2, y2 = x1 + x2, y1 + y2
    if x2 < x1 or y2 < y1:
        return
    cut = lambda a, b, n: slice(max(0, min(a, n)), max(0, min(b, n)))
    high, wide = p.shape[:2]
    w = max(1, width)
    for rows, columns in (((y1, min(y1 + w, y2 + 1)), (x1, x2 + 1)), ((max(y2 - w + 1, y1), y2 + 1), (x1, x2 + 1)), ((y1, y2 + 1), (x1, min(x1 + w, x2 + 1))), ((y1, y2 + 1), (max(x2 - w + 1, x1), x2 + 1))):
        p[cut(*rows, high), cut(*columns, wide)] = colour


def label(p: np.ndarray, x: int, y: int, text: str, colour, scale: int = 2) -> None:
    """Digits and the letters of `GLYPHS` from (x, y) on, each sample `scale` wide; other characters leave a gap."""
    high, wide = p.shape[:2]
    for c in text:
        if c in GLYPHS:
            marks = np.array([[m == "#" for m in row] for row in GLYPHS[c].split()])
            rows, columns = np.nonzero(np.kron(marks, np.ones((scale, scale), bool)))
            rows, columns = rows + y, columns + x
            there = (rows >= 0) & (rows < high) & (columns >= 0) & (columns < wide)
            p[rows[there], columns[there]] = colour
        x += 4 * scale


def colours(p: np.ndarray) -> np.ndarray:
    """Samples as red, green and blue, to draw on."""
    return np.repeat(images.grey(p)[..., None], 3, axis=2) if p.shape[2] < 3 else p[..., :3].copy()


def draw(p: np.ndarray, boxes, colour, width: int, prefix: str = "", labels: bool = True) -> np.ndarray:
    """Boxes of four numbers in turn, each with its number; others are left out."""
    for k, box in enumerate(boxes or [], 1):
        if box is None or len(box) != 4 or any(v is None for v in box):
            continue
        outline(p, box, colour, width)
        if labels:
            x, y = int(box[0]), int(box[1])
            label(p, x + 2, y - 16, f"{prefix}{k}", colour)
    return p


def overlay(raw: bytes, truth, predicted, side_by_side: bool = False, labels: bool = True) -> np.ndarray:
    """True boxes, then predicted ones over them; or the image, the true boxes' and the predicted ones' beside one another."""
    plain = colours(images.pixels(raw))
    if not side_by_side:
        return draw(draw(plain, truth, TRUE, TRUE_WIDTH, "", labels), predicted, PREDICTED, PREDICTED_WIDTH, "", labels)
    high, wide = plain.shape[:2]
    out = np.empty((high + FOOT, 3 * wide + 2 * GAP, 3), np.uint8)
    out[:] = GROUND
    for k, p in enumerate((plain, draw(plain.copy(), truth, TRUE, TRUE_WIDTH, "GT", labels), draw(plain.copy(), predicted, PREDICTED, PREDICTED_WIDTH, "", labels))):
        out[:high, k * (wide + GAP) : k * (wide + GAP) + wide] = p
    return out


OVERLAYS = "image string, content binary, width int, height int, error string"


def drawn(side_by_side: bool = False, labels: bool = True):
    """The step of `overlays`: batches of image, content, gt, pred -> a batch an image."""

    def make(batches):
        for b in images.few(batches):
            for image, raw, truth, predicted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                content = width = height = error = None
                try:
                    p = overlay(raw.as_py() or b"", truth, predicted, side_by_side, labels)
                    content, width, height = png.encode(p), p.shape[1], len(p)
                except Exception as e:  # an image that can't be read is a row
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([image], pa.string()), pa.array([content], pa.binary()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([error], pa.string())], ["image", "content", "width", "height", "error"])

    return make


def overlays(rows: DataFrame, side_by_side: bool = False, labels: bool = True) -> DataFrame:
    """`rows` (image, content, gt and pred: arrays of boxes) -> image, content (a PNG file), width, height, error; `images.save_files` writes them."""
    return rows.select("image", "content", "gt", "pred").mapInArrow(drawn(side_by_side, labels), OVERLAYS)
