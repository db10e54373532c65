"""Media columns: content-addressed payloads in tar shards.

A document's bytes, padded with 255 to a positive multiple of `WIDTH`, are the
8-bit grey samples of an image `WIDTH` samples wide, stored losslessly as PNG in
a tar file under its payload's digest.  Rows carry digest, shard, offset and
length.  A task writes its own shard and stores a payload once in it; where
several shards hold a payload, all rows refer to the first of them, so equal
texts have equal values and no text is shuffled.  (What other shards hold of the
same payload is not referred to: a copy a shard at most.)

Metadata columns (width, height, bits) come from range reads of the image's first
33 bytes, signature and IHDR; features from reading the stored bytes back, once
per payload.

Rules for odd rows: null and empty texts are `WIDTH` bytes of padding; very long
texts are one tall image; repeated rows and null doc_ids each give a row; an
empty table gives no rows; other columns are left unread.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import WholeFile, file_system, make_dir, shared_dir, ship, written

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEAD = 33


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload as an image, a row per `width` bytes, each with filter type 0."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height = len(payload) // width
    rows = b"".join(b"\0" + payload[i : i + width] for i in range(0, len(payload), width))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def png_head(raw: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", raw[16:25])


def from_png(raw: bytes) -> bytes:
    width, _, _ = png_head(raw)
    at, packed = 8, []
    while at < len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"IDAT":
            packed.append(raw[at + 8 : at + 8 + n])
        at += 12 + n
    rows = zlib.decompress(b"".join(packed))
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


def store(docs: DataFrame) -> DataFrame:
    """Writes the shards; a row per document: doc_id, n_bytes, digest, shard, offset, length."""
    spark = docs.sparkSession
    ship(spark)
    root = make_dir(shared_dir(spark, "media"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))

    def sharded(batches):
        first = next(batches, None)
        if first is None:
            return
        uri, seen = f"{root}/shard-{TaskContext.get().partitionId():06d}.tar", {}

        def every():
            yield first
            yield from batches

        with WholeFile(uri) as out, tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT) as tar:
            for b in every():
                rows = []
                for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1)):
                    raw = raw.as_py()
                    payload = padded(raw)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in seen:
                        image = to_png(payload)
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(image)
                        seen[digest] = (tar.offset + tarfile.BLOCKSIZE, len(image))
                        tar.addfile(info, io.BytesIO(image))
                    rows.append((doc_id, len(raw), digest.hex(), uri, *seen[digest]))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])

    return written(docs.mapInArrow(sharded, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media-rows")


def places(rows: DataFrame) -> DataFrame:
    """Where each payload is: digest, shard, offset, length; the first place of several."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")


def _ranged(places: DataFrame, read, schema: str) -> DataFrame:
    """`read(open file, digest, offset, length)` of each place, shard by shard and in order of offset."""
    ship(places.sparkSession)

    def ranges(batches):
        names, kinds = zip(*((f.name, f.type) for f in wanted))
        opened, file = None, None
        for b in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if shard != opened:
                    if file:
                        file.close()
                    fs, path = file_system(shard)
                    opened, file = shard, fs.open_input_file(path)
                rows.append((digest, *read(file, offset, length)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], list(names))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))
    spread = places.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")
    return spread.mapInArrow(ranges, schema)


def metadata(places: DataFrame) -> DataFrame:
    """digest, width, height, bits: only headers are read."""
    return _ranged(places, lambda f, offset, _: png_head(f.read_at(HEAD, offset)), "digest string, width int, height int, bits int")


def features(places: DataFrame) -> DataFrame:
    """From the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (size, grey mean, share of padding)."""

    def read(f, offset, length):
        raw = f.read_at(length, offset)
        width, height, bits = png_head(raw[:HEAD])
        payload = from_png(raw)
        total, pad = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)), payload.count(b"\xff")
        feature = f"png:{width}x{height}x{bits} mean={total / len(payload):.4f} pad={pad}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature

    return _ranged(places, read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """A row per document with its payload's digest, shard, offset and length, what its header tells (width, height, bits), and what its stored bytes give."""
    rows = store(docs)
    at = places(rows)
    found = features(at).join(metadata(at), "digest").join(at, "digest")
    return rows.select("doc_id", "n_bytes", "digest").join(found, "digest")
