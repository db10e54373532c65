"""Token ids in files of directly addressable codes, with random access to any token.

An id is split into chunks of `CHUNK` bits.  Level k holds the k-th chunk of all
ids that have one, a continuation bitmap (bit set: the id goes on in level k+1)
and a rank directory (set bits before each block of `BLOCK` bits).  Token i is
found by one look-up in level 0 and one rank per further level; no block is
decoded.  Each document's place is in the file's own directory.

File, little-endian throughout: magic, uint32 length of a JSON header, the
header, then the sections it names: doc_ids int64, doc_null uint8, starts
int64 (n_docs + 1), and per level chunks uint8, bits (packed, lowest first),
ranks uint64.

Ids are made once per document in the scan's own tasks, dealt by ranges of
doc_id that Spark's own range partitioning of the ids alone has cut, two bytes an
id where the vocabulary allows, sorted within a range and written in segments of about `SEGMENT` tokens, so a task holds one segment at most.  A
file appears only when complete, under a name that the range fixes: a task that
is lost is run again and writes the same file.

Rules for odd rows: null and empty texts have the end id alone; null doc_ids
come first; equal doc_ids follow each other in order of their ids; an empty
table gives no file and no rows; other columns are left unread.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.common import WholeFile, file_system, make_dir, shared_dir, ship, written
from docgauge.llm.tokens import cache_for, gathered, tokenizer_path

MAGIC = b"DACTOK1\n"
CHUNK, BLOCK, SEGMENT = 8, 512, 4_000_000
#: Bytes of a section that are read at once.
AHEAD = 1 << 20
END = 1


class Dac:
    """The levels of one sequence of ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @classmethod
    def of(cls, ids: np.ndarray) -> Dac:
        rest, levels = ids.astype(np.uint32), []
        while True:
            more = rest >> CHUNK > 0
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            levels.append(((rest & (2**CHUNK - 1)).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if len(ones) else np.zeros(0, "<u8")))
            if not more.any():
                return cls(levels, len(ids))
            rest = rest[more] >> CHUNK

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        _, bits, ranks = self.levels[level]
        block, words = at // BLOCK, bits.view("<u8")
        out = ranks[block].astype(np.int64)
        first, place = block * (BLOCK // 64), at // 64
        for k in range(BLOCK // 64 - 1):
            out += np.where(first + k < place, np.bitwise_count(words[first + k]), 0)
        return out + np.bitwise_count(words[place] & ((np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)))

    def take(self, at) -> np.ndarray:
        """The ids at any places, in any order."""
        at = np.asarray(at, np.int64)
        out, where = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK * k)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            if not more.any():
                return out
            where, at = where[more], self.rank(k, at[more])
        return out

    def run(self, a: int, b: int) -> np.ndarray:
        """The ids at a..b-1: one rank per level, then straight on."""
        out, where = np.zeros(b - a, np.uint32), np.arange(b - a)
        for k, (chunks, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(CHUNK * k)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
            where = where[more]
            a = int(self.rank(k, np.array([a]))[0])
            b = a + len(where)
        return out


def write_segment(uri: str, doc_ids: list, starts: np.ndarray, ids: np.ndarray) -> None:
    dac, sections, head = Dac.of(ids), [], {"n_tokens": len(ids), "n_docs": len(doc_ids), "chunk": CHUNK, "block": BLOCK, "sections": []}

    def put(name: str, data: np.ndarray) -> None:
        raw = np.ascontiguousarray(data).tobytes()
        head["sections"].append([name, data.dtype.str, len(raw)])
        sections.append(raw)

    put("doc_ids", np.array([0 if x is None else x for x in doc_ids], "<i8"))
    put("doc_null", np.array([x is None for x in doc_ids], "u1"))
    put("starts", starts.astype("<i8"))
    for k, parts in enumerate(dac.levels):
        for name, data in zip(("chunks", "bits", "ranks"), parts):
            put(f"{name}{k}", data)
    text = json.dumps(head).encode()
    with WholeFile(uri) as out:
        out.write(MAGIC + struct.pack("<I", len(text)) + text)
        for raw in sections:
            out.write(raw)


class Segment:
    """A file, opened lazily: the header, the documents' directory and the ranks are read, codes only where they are asked for.

    `document(i)` finds a document's codes on each level by one look-up in the rank
    directory.  Reads go `AHEAD` bytes on, so documents asked for in turn share them.
    """

    def __init__(self, uri: str, ahead: int = AHEAD):
        store, path = file_system(uri)
        self.file, self.ahead, self.bytes_read, self._held = store.open_input_file(path), ahead, 0, {}
        start = self._at(0, 12)
        if start[:8] != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        (n,) = struct.unpack_from("<I", start, 8)
        head, at = json.loads(self._at(12, n)), 12 + n
        self.sections = {}
        for name, kind, size in head["sections"]:
            self.sections[name] = (at, np.dtype(kind), size)
            at += size
        whole = lambda name: np.frombuffer(self._at(self.sections[name][0], self.sections[name][2]), self.sections[name][1])
        self.doc_ids = [None if null else x for x, null in zip(whole("doc_ids").tolist(), whole("doc_null").tolist())]
        self.starts, self.n = whole("starts"), head["n_tokens"]
        self.ranks = [whole(name) for name in self.sections if name.startswith("ranks")]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _at(self, offset: int, n: int) -> bytes:
        self.bytes_read += n
        return self.file.read_at(n, offset)

    def _bytes(self, name: str, a: int, b: int) -> np.ndarray:
        """Bytes a..b-1 of a section."""
        at, _, size = self.sections[name]
        first, held = self._held.get(name, (0, b""))
        if not first <= a <= b <= first + len(held):
            first, held = a, self._at(at + a, min(size - a, max(b - a, self.ahead)))
            self._held[name] = first, held
        return np.frombuffer(held, np.uint8, b - a, a - first)

    def run(self, a: int, b: int) -> np.ndarray:
        """The ids at a..b-1: on each level a rank, and the codes from there on."""
        out, where = np.zeros(b - a, np.uint32), None
        for k, ranks in enumerate(self.ranks):
            if a >= b:
                break
            chunks = self._bytes(f"chunks{k}", a, b).astype(np.uint32)
            if where is None:
                out |= chunks
            else:
                out[where] |= chunks << np.uint32(CHUNK * k)
            if k + 1 == len(self.ranks):
                break
            block = a // BLOCK
            bits = np.unpackbits(self._bytes(f"bits{k}", block * BLOCK // 8, (b + 7) // 8), bitorder="little")
            before, more = bits[: a - block * BLOCK], bits[a - block * BLOCK : b - block * BLOCK]
            on = np.flatnonzero(more)
            where = on if where is None else where[on]
            a = int(ranks[block]) + int(np.count_nonzero(before))
            b = a + len(on)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.run(int(self.starts[i]), int(self.starts[i + 1]))


def write_files(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Writes all documents' ids; returns the manifest: part, seq, uri, n_tokens, n_docs, first (ids before the file)."""
    spark = docs.sparkSession
    ship(spark)
    root = make_dir(shared_dir(spark, "tokens"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, docs.rdd.getNumPartitions())
    # the ids alone are dealt by ranges; a row a range reaches the driver
    dealt = docs.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
    cuts = np.array(sorted(r.low for r in dealt.collect())[1:], np.int64)

    def encoded(batches):
        cache = cache_for(path)
        for b in gathered(batches, 1):
            doc_ids, texts = b.column(0), b.column(1)
            part = np.searchsorted(cuts, doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            for a, ids, offsets in cache.encode_in_parts(texts):
                rows, ids = len(offsets) - 1, ids.astype(cache.kind)
                raw = [ids[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(part[a : a + rows], pa.int32()), doc_ids.slice(a, rows), pa.array(raw, pa.binary()), pa.array(np.full(rows, cache.kind.itemsize, np.int32))], ["part", "doc_id", "ids", "width"])

    def stored(batches):
        seq, ids, doc_ids, held = 0, [], [], 0
        part = TaskContext.get().partitionId()

        def out():
            sizes = np.array([len(x) for x in ids], np.int64)
            uri = f"{root}/part-{part:06d}-{seq:04d}.dac"
            write_segment(uri, doc_ids, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([uri]), pa.array([int(sizes.sum())], pa.int64()), pa.array([len(ids)], pa.int64())], ["part", "seq", "uri", "n_tokens", "n_docs"])

        for b in batches:
            for doc_id, raw, width in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                x = np.append(np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4"), np.uint32(end))
                ids.append(x)
                doc_ids.append(doc_id)
                held += len(x)
                if held >= SEGMENT:
                    yield out()
                    seq, ids, doc_ids, held = seq + 1, [], [], 0
        if ids:
            yield out()

    coded = docs.mapInArrow(encoded, "part int, doc_id long, ids binary, width int")
    dealt = coded.repartitionById(n, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    manifest = written(dealt.mapInArrow(stored, "part int, seq int, uri string, n_tokens long, n_docs long"), "tokens-manifest")
    # a row a file: one ordered window over it is a small sum
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_files(manifest: DataFrame) -> DataFrame:
    """From the files, each document by random access: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for uri, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with Segment(uri) as s:
                    found = [s.document(i) for i in range(len(s.doc_ids))]
                crcs = [zlib.crc32(x.astype("<u4", copy=False)) for x in found]
                columns = [pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1] + first), pa.array([len(x) for x in found], pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("uri", "first")
    return files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = END) -> DataFrame:
    return read_files(write_files(docs, tokenizer_path(vocabulary), end))
