"""Images from their bytes: grey samples, features, crops.

PNG and baseline JPEG are decoded here (`png`, `jpeg`); other formats where the
optional imaging library is there, else they give a row with an error, as files
that can't be read do.  Each image is a row of its own, so nothing is gathered; a
task holds one image's samples.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docgauge.sources import jpeg, png

FEATURES = "image string, path string, sha256 string, width int, height int, aspect_ratio double, text_density double, contrast double, estimated_lines int, error string"
#: Weights of red, green and blue in 2 ** 16.
GREY = (19595, 38470, 7471)


def pixels(raw: bytes) -> np.ndarray:
    """(height, width, channels) of an image file."""
    if raw[:8] == png.SIGNATURE:
        return png.decode(raw)
    if raw[:2] == b"\xff\xd8":
        return jpeg.decode(raw)
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("only PNG and JPEG images are read here") from None
    image = np.asarray(Image.open(io.BytesIO(raw)))
    return image if image.ndim == 3 else image[..., None]


def grey(p: np.ndarray) -> np.ndarray:
    """Luma of colours (alpha left out), in whole numbers."""
    if p.shape[2] < 3:
        return p[..., 0]
    r, g, b = (p[..., k].astype(np.int64) for k in range(3))
    return ((GREY[0] * r + GREY[1] * g + GREY[2] * b + 0x8000) >> 16).astype(np.uint8)


def to_png(p: np.ndarray) -> bytes:
    """(height, width) or (height, width, 1, 2, 3 or 4) samples as a PNG file."""
    return png.encode(p)


def features_of(raw: bytes) -> dict:
    """Width, height, their ratio, share of dark samples, deviation, and lines told from rows darker than most; or an error."""
    try:
        g = grey(pixels(raw)).astype(np.float64)
        dark = g < 128
        rows = dark.mean(axis=1)
        lines = int((rows > rows.mean() + 0.5 * rows.std()).sum() / (len(g) * 0.02))
        return {"width": g.shape[1], "height": len(g), "aspect_ratio": round(g.shape[1] / len(g), 3), "text_density": round(float(dark.mean()), 4), "contrast": round(float(g.std()), 2), "estimated_lines": max(1, lines)}
    except Exception as e:  # a file that can't be read is a row
        return {"error": str(e) or type(e).__name__}


def manifest(images: DataFrame) -> DataFrame:
    """`images` as readers.images gives them with content -> a manifest row each."""
    import hashlib

    names = [c.split()[0] for c in FEATURES.split(", ")]

    def rows(batches):
        for b in batches:
            for image, path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = raw.as_py() or b""
                row = {"image": image, "path": path, "sha256": hashlib.sha256(raw).hexdigest()[:16], **features_of(raw)}
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], k) for n, k in zip(names, kinds)], names)

    return images.select("image", "path", "content").mapInArrow(rows, FEATURES)


def in_turn(rows: DataFrame, schema: str, *steps) -> DataFrame:
    """`rows` through steps, each from an iterator of record batches to the next one's: a task has one Python process however many steps there are."""

    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return rows.mapInArrow(run, schema)


def few(batches, n: int = 256):
    """The batches in slices of `n` rows: steps that make or read samples hold those of one slice at most."""
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


CROPPED = "image string, content binary, width int, height int, error string"


def crops(pad: int = 20):
    """The step of `cropped`: batches of image, content, crop_bbox -> a batch an image."""

    def rows(batches):
        for b in few(batches):
            for image, raw, box in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                content = width = height = error = None
                try:
                    p = pixels(raw.as_py() or b"")
                    x1, y1, x2, y2 = box
                    p = p[max(0, y1 - pad) : max(0, min(len(p), y2 + pad)), max(0, x1 - pad) : max(0, min(p.shape[1], x2 + pad))]
                    if not p.size:
                        raise ValueError("the box lies outside the image")
                    content, width, height = to_png(p), p.shape[1], len(p)
                except Exception as e:
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([content], pa.binary()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([error], pa.string())], ["image", "content", "width", "height", "error"])

    return rows


def cropped(images: DataFrame, pad: int = 20) -> DataFrame:
    """`images` (image, content, crop_bbox) -> image, content (a PNG file of the padded box), width, height, error."""
    return images.select("image", "content", "crop_bbox").mapInArrow(crops(pad), CROPPED)


def save_files(images: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content to folder/image (any store that Arrow knows) under its name only when complete; gives image, path."""

    def rows(batches):
        import uuid

        from pyarrow import fs

        for b in batches:
            store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
            store.create_dir(root, recursive=True)
            names = b.column(0).to_pylist()
            for image, raw in zip(names, b.column(1)):
                part = f"{root}/{image}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(part) as out:
                    out.write(raw.as_py())
                store.move(part, f"{root}/{image}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"{folder}/{n}" for n in names], pa.string())], ["image", "path"])

    return images.select("image", "content").where("content IS NOT NULL").mapInArrow(rows, "image string, path string")
