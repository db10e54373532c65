"""WARC archives: written with revisit records, read back by a splittable reader.

Writing.  A page's payload is its html in UTF-8.  Among equal payloads of at
least `LEAST` bytes the one with the smallest page_id is a response, the others
are revisits that carry the digest, the HTTP head (with the payload's length)
and the response's id, but no body.  Each record is a gzip member of its own.
Which payloads repeat is found from digests, pre-aggregated before the shuffle.

Reading.  A file is cut into byte ranges.  A task scans its range for the gzip
magic, takes a candidate for a member only if its head decodes to a WARC version
line, and owns the records that start in its range, reading past its end to
finish the last one.

Rules for odd rows: null html is an empty payload; shorter payloads are always
responses; rows that share the smallest page_id of a payload are all responses;
pages with a null page_id never are the response of others and revisit as others
do; a null or odd url is percent-encoded; an empty table gives no records; other
columns are left unread.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import WholeFile, file_system, make_dir, shared_dir, ship, small, written

LEAST, FILE, RANGE, STEP, PIECE = 100, 256 << 20, 4 << 20, 1 << 20, 16 << 10
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The record, as a gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]' + chr(39))}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record; names in lower case."""
    top, _, rest = raw.partition(b"\r\n\r\n")

    def fields(text: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.decode("utf-8", "replace").split("\r\n")[1:])}

    warc = fields(top)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes all pages; returns uri and n_bytes of each archive."""
    spark = pages.sparkSession
    ship(spark)
    root = make_dir(shared_dir(spark, "warc"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    again = pages.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    again = small(again.select(F.col("digest").alias("d"), "first_id"), "warc-again")
    pages = pages.join(again, F.col("digest") == F.col("d"), "left")
    pages = pages.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def archived(batches):
        task, seq = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        r = next(rows, None)
        while r is not None:
            uri, size = f"{root}/part-{task:06d}-{seq:04d}.warc.gz", 0
            with WholeFile(uri) as out:
                while r is not None and size < FILE:
                    raw = record(*r)
                    out.write(raw)
                    size += len(raw)
                    r = next(rows, None)
            seq += 1
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64())], ["uri", "n_bytes"])

    return written(pages.mapInArrow(archived, "uri string, n_bytes long"), "warc-manifest")


class _Ahead:
    """A file's bytes from some place on, read step by step and let go of behind."""

    def __init__(self, file, at: int, step: int):
        self.file, self.base, self.held, self.step, self.size = file, at, b"", step, file.size()

    def more(self) -> bool:
        got = self.file.read_at(self.step, self.base + len(self.held)) if self.base + len(self.held) < self.size else b""
        self.held += got
        return bool(got)

    def let_go(self, upto: int) -> None:
        if upto - self.base > self.step:
            self.held, self.base = self.held[upto - self.base :], upto

    def member(self, at: int, head_only: bool = False) -> tuple[bytes, int] | None:
        """(decoded record, its end) if a record's gzip member starts at `at`; of the record, its first bytes if only those are asked for."""
        z, out, used = zlib.decompressobj(31), b"", at - self.base
        parts = []
        try:
            while not z.eof:
                if used >= len(self.held) and not self.more():
                    return None
                part = z.decompress(self.held[used : used + PIECE])
                used = min(len(self.held), used + PIECE)
                parts.append(part)
                if len(out) < len(VERSION):
                    out += part
                    if not out.startswith(VERSION[: len(out)]):
                        return None
                    if head_only and len(out) >= len(VERSION):
                        return out, at
        except zlib.error:
            return None
        return (b"".join(parts), self.base + used - len(z.unused_data)) if len(out) >= len(VERSION) else None


def members(uri: str, start: int, end: int, step: int = STEP):
    """The decoded records whose members start in start..end-1 of a file.

    A range that starts inside a record may meet a whole gzip member within that
    record's bytes (an archive in an archive), so its first member must also be
    followed by another record or by the end of the file; from there on, each
    record starts where the last one ended.
    """
    store, path = file_system(uri)
    with store.open_input_file(path) as f:
        ahead, at, sure = _Ahead(f, start, step), start, start == 0
        while at < end:
            ahead.let_go(at)
            k = ahead.held.find(MAGIC, at - ahead.base)
            if k < 0:
                at = max(at, ahead.base + len(ahead.held) - len(MAGIC) + 1)  # a magic may go on in what comes next
                if not ahead.more():
                    return
                continue
            sure, at = sure and ahead.base + k == at, ahead.base + k
            if at >= end:
                return
            got = ahead.member(at)
            if got and (sure or got[1] == ahead.size or ahead.member(got[1], head_only=True)):
                yield got[0]
                at, sure = got[1], True
            else:
                at, sure = at + 1, False


def read_archives(archives: DataFrame, size: int = RANGE) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. Responses' digests are those of the bytes read."""
    ship(archives.sparkSession)

    def scanned(batches):
        for b in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                for raw in members(uri, start, end):
                    warc, http, payload = parse(raw)
                    of = [re.fullmatch(rf"<{ID}(-?\d*)>", warc.get(k, "")) for k in ("warc-record-id", "warc-refers-to")]
                    page_id, refers_to = (int(m[1]) if m and m[1] else None for m in of)
                    kind = warc["warc-type"]
                    if kind == "response":
                        rows.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), kind, None))
                    elif kind == "revisit":
                        rows.append((page_id, int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha256:"), kind, refers_to))
                if rows:
                    a, n, d, k, r = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(d), pa.array(k), pa.array(r, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ranges = archives.where("n_bytes > 0").select("uri", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(size).cast("long"))).alias("start"), "n_bytes")
    ranges = ranges.select("uri", "start", F.least("n_bytes", F.col("start") + size).alias("end"))
    return ranges.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(scanned, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= {LEAST} GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d
"""
