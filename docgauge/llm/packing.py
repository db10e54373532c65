"""Packing documents into sequences of a fixed number of tokens.

Large items (above a third of the capacity) pair at most twice per bin by greedy
matching: the largest with the largest partner that fits beside it.  Smaller
items, from large to small, go where they leave the least gap; a new bin opens
only where no gap takes them.

Token counts are whole numbers up to the capacity, so all this runs on the
*histogram* of lengths (a row per length, `capacity` rows at most, whatever the
corpus): equal bins are handled as one group with a count, and the plan is a
list of groups, whose number too depends on the capacity alone.  Pieces then find their bin by their length and their rank among
pieces of that length.  A rank is the task's own running count plus the counts of
earlier tasks, so a length that a third of all pieces share is never gathered.

Rules for odd rows: null and empty texts are one piece of the end id; null
doc_ids, equal doc_ids and repeated rows are documents of their own; an empty
table gives no rows; other columns are left unread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.common import ship, small, written
from docgauge.llm.tokens import cache_for, gathered, tokenizer_path

CAPACITY, END = 2048, 0


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """{length: pieces} -> [(bins, lengths in each of them)]."""
    left = [0] * (capacity + 1)
    for s, n in counts.items():
        left[s] += n
    groups: list[tuple[int, list[int]]] = []
    gaps: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]

    def put(n: int, items: list[int], gap: int) -> None:
        if gap:
            gaps[gap].append((n, items))
        else:
            groups.append((n, items))

    third = capacity // 3
    for s in range(capacity, third, -1):
        t = min(s, capacity - s)
        while left[s]:
            while t > third and not left[t] - (t == s and left[t] == 1):
                t -= 1
            if t <= third:
                put(left[s], [s], capacity - s)
                left[s] = 0
            else:
                n = left[s] // 2 if t == s else min(left[s], left[t])
                left[s] -= n
                left[t] -= n
                put(n, [s, t], capacity - s - t)
    for s in range(third, 0, -1):
        n, gap = left[s], s
        while n:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // s
                if n >= each:
                    put(n // each, [s] * each, capacity - each * s)
                if n % each:
                    put(1, [s] * (n % each), capacity - n % each * s)
                break
            m, items = gaps[gap].pop()
            if m > n:
                gaps[gap].append((m - n, items))
                m = n
            n -= m
            put(m, [*items, s], gap - s)
            gap = max(s, gap - s) if gap - s >= s else gap
    return groups + [g for x in gaps for g in x]


def _slots(groups: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length, in order of rank: first rank, first bin, offset in the bin."""
    upto: dict[int, int] = {}
    out: dict[int, list] = {}
    base = 0
    for n, items in groups:
        at = 0
        for s in items:
            out.setdefault(s, []).append((upto.get(s, 0), base, at))
            upto[s] = upto.get(s, 0) + n
            at += s
        base += n
    return {s: np.array(x, np.int64).T for s, x in out.items()}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and its task and rank among the task's pieces of that length."""
    ship(docs.sparkSession)

    def cut(batches):
        cache, seen, task = cache_for(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in gathered(batches, 1):
            for a, ids, offsets in cache.encode_in_parts(b.column(1)):
                doc_ids = b.column(0).slice(a, len(offsets) - 1)
                n = np.diff(offsets) + 1
                many = -(-n // capacity)
                head = n - (many - 1) * capacity
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                with_end = np.insert(ids, offsets[1:], end).astype("<u4") if len(n) else ids
                raw = memoryview(with_end.tobytes())
                at = (offsets[:-1] + np.arange(len(n)))[row] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                by = length[order]
                new = np.flatnonzero(np.diff(by, prepend=-1))
                rank = np.empty(len(by), np.int64)
                rank[order] = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by)))) + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row)), *(pa.array(x, k) for x, k in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (np.full(len(row), task), pa.int32()), (rank, pa.int64())))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    items = written(pieces(docs, tokenizer_path(vocabulary), capacity, end), "pack-pieces")
    counts = written(items.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    # at most `capacity` rows reach the driver
    slots = _slots(pack_histogram({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    # a row per task and length: beyond the rows that may be broadcast it is joined by a shuffle of the narrow rows
    before = small(counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")), "pack-before", merge=True)
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def placed(batches):
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in (3, 5))
            bins, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            new = np.flatnonzero(np.diff(length[order], prepend=-1)) if len(order) else []
            for rows in np.split(order, new[1:]) if len(order) else []:
                first, base, offset = shared.value[int(length[rows[0]])]
                slot = np.searchsorted(first, rank[rows], "right") - 1
                bins[rows] = base[slot] + rank[rows] - first[slot]
                at[rows] = offset[slot]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(bins), pa.array(at)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = items.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
