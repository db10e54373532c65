"""Exact removal of long byte strings that a smaller doc_id holds too, by suffix sorting of shards.

A byte goes if it lies in a `LENGTH`-byte string that also starts in a document
with a smaller doc_id.

1. Equal texts are one; a copy of `LENGTH` bytes or more goes whole.
2. Each string of `LENGTH` bytes has an anchor, its `GRAM`-byte piece of least
   hash (the left-most of equals), so equal strings have equal anchors at equal
   places.  Runs of strings with the same anchor are one row, about 6 in 100 bytes.
   Any string reaches `SIDE` bytes beyond its anchor to the left or to the right,
   so only runs that share their anchor and the hash of either side with another
   document go on: no string that repeats is lost.
3. The bytes of those runs are fragments; equal ones are joined before the
   shuffle, with the smallest doc_id.  Shards of fragments, by anchor, are
   suffix-sorted by external induced sorting (see `induced`) with common-prefix
   values, and neighbours that share `LENGTH` bytes are groups, each with its
   smallest doc_id.  A fragment reaches up to 34 bytes beyond a passage, so one
   that many documents hold in different surroundings gives its outer anchors as
   many fragments: anchors with runs of more than `HOT` bytes aren't sorted, their
   strings are grouped one by one, by the hash of all their bytes.
4. A fragment's strings are marked for the document that is its smallest where a
   group's smallest is smaller still, and all of them for the others; marks are
   joined to runs per document, and the bytes they cover are cut.

Rules for odd rows: null and empty texts have no bytes; texts shorter than
`LENGTH` lose none; a null doc_id loses none and is no other's source, and so are
rows of a doc_id that stands for several different texts; repeated rows of one
text and id fare alike; an empty table gives no rows; other columns are left
unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.common import ship, small, written
from docgauge.llm.induced import InducedSort, _words
from docgauge.llm.shingles import _ODD, mixed

LENGTH, GRAM = 50, 16
WINDOW, SIDE = LENGTH - GRAM + 1, (LENGTH - GRAM) // 2
SLICE, IDS = 2 << 20, 500_000
NONE = 0xFFF
SHARD = 6 << 20
HOT = SHARD
#: Anchors are told apart by so many bits: what they let through beyond is told apart by its bytes.
KEY = np.uint64(2**48 - 1)


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Runs of strings with one anchor: (document, first string's place, further strings, anchor's hash, hashes of its sides) of the joined texts."""
    n = len(raw)
    count = n - LENGTH + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 6
    eight = mixed(_words(raw) ^ _ODD[6])
    gram = mixed(eight[: n - GRAM + 1] * _ODD[0] + eight[8 : n - GRAM + 9])
    low = np.uint64(0xFFFFFFFF)
    least, size = (gram & ~low) | np.arange(len(gram), dtype=np.uint64), 1
    whole = len(least)
    while size * 2 <= WINDOW:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < WINDOW:
        m = whole - WINDOW + 1
        least = np.minimum(least[:m], least[WINDOW - size : WINDOW - size + m])
    place = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), ends - starts)[:count]
    inside = np.arange(count) + LENGTH <= ends[doc]
    new = inside & np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(new)
    more = np.diff(np.append(np.searchsorted(np.flatnonzero(inside), first), inside.sum())) - 1
    at, d = place[first], doc[first]

    def side(q):
        ok = (q >= starts[d]) & (q + SIDE <= ends[d])
        q = np.where(ok, q, 0)
        h = mixed(eight[q] * _ODD[1] + eight[np.minimum(q + 8, n - 1)]) + raw[np.minimum(q + 16, n - 1)].astype(np.uint64) * _ODD[2]
        return np.where(ok, (mixed(h) >> np.uint64(40)) % np.uint64(NONE), np.uint64(NONE)).astype(np.int64)

    return d, first, more, (gram[at] & KEY).view(np.int64), side(at - SIDE), side(at + GRAM)


def runs(texts: DataFrame) -> DataFrame:
    """`texts`: doc, raw. A row per run: key (the anchor), doc, first, more, left, right."""
    ship(texts.sparkSession)

    def found(batches):
        for b in batches:
            raws = b.column(1).to_pylist()
            lengths = np.array([len(x) for x in raws], np.int64)
            part = np.cumsum(lengths) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)] if len(lengths) else [0]
            docs = b.column(0).to_numpy()
            for x, y in zip(cuts, cuts[1:]):
                ends = np.cumsum(lengths[x:y])
                starts = ends - lengths[x:y]
                d, first, more, key, left, right = anchors(np.frombuffer(b"".join(raws[x:y]), np.uint8), starts, ends)
                packed = (first - starts[d] if len(d) else first) << 30 | more << 24 | left << 12 | right
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(docs[x:y][d] if len(d) else d, pa.int64()), pa.array(packed)], ["key", "doc", "packed"])

    return texts.mapInArrow(found, "key long, doc long, packed long")


def shared_runs(found: DataFrame) -> DataFrame:
    """Runs whose anchor and either side another document has too: key, doc, first, more, hot (the anchor's runs have more than HOT bytes)."""
    found = found.repartition("key")
    left, right = F.shiftright("packed", 12).bitwiseAND(NONE), F.col("packed").bitwiseAND(NONE)
    several = lambda w: F.min("doc").over(w) < F.max("doc").over(w)
    more = F.shiftright("packed", 24).bitwiseAND(63)
    hot = F.sum(more + LENGTH).over(Window.partitionBy("key")) > HOT
    found = found.withColumn("several", several(Window.partitionBy("key"))).withColumn("hot", hot).where("several")
    found = found.withColumn("l", left).withColumn("r", right)
    found = found.withColumn("a", several(Window.partitionBy("key", "l"))).withColumn("b", several(Window.partitionBy("key", "r"))).where("a OR b")
    return found.select("key", "doc", F.shiftright("packed", 30).alias("first"), more.cast("int").alias("more"), "hot")


def fragments(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """The bytes of the runs: key, mark (the fragment's hash), doc, first, size, fragment."""
    per = shared.groupBy("doc").agg(F.collect_list(F.struct("key", "first", "more")).alias("runs"))  # a document's own, bounded by its length
    joined = texts.join(per, "doc").select("doc", "raw", "runs")

    def cut(batches):
        import xxhash

        for b in batches:
            own = b.column(2)
            at, flat = own.offsets.to_numpy(), own.flatten()
            at = at - at[0]
            key, first, more = (flat.field(k) for k in range(3))
            ends = first.to_numpy() + more.to_numpy() + LENGTH
            parts = []
            for raw, x, y in zip(b.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                parts += [raw[p:q] for p, q in zip(first[x:y].to_pylist(), ends[x:y].tolist())]
            marks = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)).view(np.int64)
            docs = np.repeat(b.column(0).to_numpy(), np.diff(at))
            yield pa.RecordBatch.from_arrays([key, pa.array(marks), pa.array(docs), first, pa.array(ends - first.to_numpy(), pa.int32()), pa.array(parts, pa.binary())], ["key", "mark", "doc", "first", "size", "fragment"])

    return joined.mapInArrow(cut, "key long, mark long, doc long, first long, size int, fragment binary")


def repeated_strings(parts: list[bytes], docs: np.ndarray) -> list[list[int]]:
    """For each fragment the starts of strings of LENGTH bytes that a smaller document's fragment holds too."""
    s = InducedSort(parts, LENGTH).run()
    of = np.searchsorted(s.starts, s.places, "right") - 1
    long = s.left[s.places] >= LENGTH
    group = np.cumsum(s.lcp < LENGTH)[long]
    of, at = of[long], (s.places - s.starts[of])[long]
    out: list[list[int]] = [[] for _ in parts]
    if len(of):
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.repeat(np.minimum.reduceat(docs[of], cut), np.diff(np.append(cut, len(of))))
        for k, a in sorted(zip(of[docs[of] > least].tolist(), at[docs[of] > least].tolist())):
            out[k].append(a)
    return out


def marked(distinct: DataFrame) -> DataFrame:
    """`distinct`: key, mark, low (smallest doc), several, fragment. Gives key, mark, low, starts for those that lose strings."""

    def sort(batches):
        keys, marks, lows, several, parts, size = [], [], [], [], [], 0
        single: list[tuple] = []  # anchors with one fragment: its strings are nowhere else, copies of it lose all
        pending: list[tuple] = []

        def singles():
            rows = [(key, mark, low, []) for key, mark, low, more, _ in single if more]
            single.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else ((), (), (), ()), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["key", "mark", "low", "starts"])

        def settle():
            nonlocal size
            if len(pending) == 1:
                single.append(pending[0])
            else:
                for key, mark, low, more, part in pending:
                    keys.append(key), marks.append(mark), lows.append(low), several.append(more), parts.append(part)
                    size += len(part)
            pending.clear()

        def done():
            found = repeated_strings(parts, np.array(lows, np.int64))
            keep = [i for i, f in enumerate(found) if f or several[i]]
            take = lambda xs: [xs[i] for i in keep]
            return pa.RecordBatch.from_arrays([pa.array(take(keys), pa.int64()), pa.array(take(marks), pa.int64()), pa.array(take(lows), pa.int64()), pa.array(take(found), pa.list_(pa.int32()))], ["key", "mark", "low", "starts"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if pending and row[0] != pending[-1][0]:  # an anchor's fragments stay together
                    settle()
                    if size > SHARD:
                        yield done()
                        keys, marks, lows, several, parts, size = [], [], [], [], [], 0
                pending.append(row)
            yield singles()
        settle()
        yield singles()
        if parts:
            yield done()

    rows = distinct.select("key", "mark", "low", "several", "fragment").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(sort, "key long, mark long, low long, starts array<int>")


def marked_by_string(distinct: DataFrame) -> DataFrame:
    """As `marked`, for hot anchors: each string is a group by anchor and hash, so no task holds all fragments of an anchor."""

    def cut(batches):
        import xxhash

        for b in batches:
            parts = b.column(3).to_pylist()
            n = np.array([len(x) - LENGTH + 1 for x in parts], np.int64)
            row = np.repeat(np.arange(len(parts)), n)
            start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            strings = (parts[i][a : a + LENGTH] for i, a in zip(row.tolist(), start.tolist()))
            found = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(row)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row)) for k in range(3)), pa.array(start, pa.int32()), pa.array(found)], ["key", "mark", "low", "start", "string"])

    strings = distinct.select("key", "mark", "low", "fragment").mapInArrow(cut, "key long, mark long, low long, start int, string long")
    least = strings.groupBy("key", "string").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most").drop("most")
    lost = strings.join(least, ["key", "string"]).where("low > least").groupBy("key", "mark").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    rows = distinct.select("key", "mark", "low", "several").join(lost, ["key", "mark"], "left").where("several OR starts IS NOT NULL")
    return rows.select("key", "mark", "low", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(bytes removed, maximal runs removed, sha256 of the rest)."""
    h, removed, n, upto = hashlib.sha256(), 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:  # a new run
            h.update(raw[upto:a])
            n += 1
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
        upto = max(upto, end)
    h.update(raw[upto:])
    return removed, n, h.hexdigest()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ship(docs.sparkSession)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    base = written(docs.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha")), "substring-texts")
    first = base.groupBy("sha").agg(F.min("doc_id").alias("low"))
    rows = written(base.join(first, "sha"), "substring-rows")
    odd = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("doc_id")
    odd = small(odd, "substring-odd", IDS)
    copies = rows.where("doc_id > low").join(odd, "doc_id", "left_anti")
    gone = small(copies.select("doc_id").distinct(), "substring-copies", IDS)

    own = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").join(odd, "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), "raw")
    shared = written(shared_runs(runs(own)), "substring-runs")
    touched = small(shared.select("doc").distinct(), "substring-docs", IDS)
    parts = written(fragments(own.join(touched, "doc", "left_semi").dropDuplicates(["doc"]), shared), "substring-fragments")
    distinct = lambda rows: rows.groupBy("key", "mark").agg(F.min("doc").alias("low"), (F.max("doc") > F.min("doc")).alias("several"), F.first("fragment").alias("fragment"))
    hot = small(shared.where("hot").select("key").distinct(), "substring-hot")
    if hot.isEmpty():
        lost = written(marked(distinct(parts)), "substring-marked")
    else:
        many = written(distinct(parts.join(hot, "key", "left_semi")), "substring-hot-fragments")
        lost = marked(distinct(parts.join(hot, "key", "left_anti"))).unionByName(marked_by_string(many))
        lost = written(lost, "substring-marked")
    hit = parts.select("key", "mark", "doc", "first", "size").join(lost, ["key", "mark"])
    every = F.array(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("size")).alias("b")))
    some = F.transform("starts", lambda s: F.struct((F.col("first") + s).alias("a"), (F.col("first") + s + LENGTH).alias("b")))
    spans = hit.select("doc", F.explode(F.when(F.col("doc") > F.col("low"), every).otherwise(some)).alias("s"))
    spans = written(spans.groupBy("doc").agg(F.collect_list("s").alias("spans")), "substring-spans")  # a document's own
    cut = small(spans.select(F.col("doc").alias("doc_id")), "substring-cut", IDS)

    def trimmed(batches):
        for b in batches:
            found = [kept_bytes(raw, [(s["a"], s["b"]) for s in own]) for raw, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            n = [len(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    changed = docs.join(cut, "doc_id", "left_semi").join(spans, F.col("doc_id") == F.col("doc")).select("doc_id", "raw", "spans").mapInArrow(trimmed, schema)
    long_copy = (F.col("doc_id") > F.col("low")) & (F.col("n_bytes") >= LENGTH) & F.col("odd").isNull()
    lost_all = F.coalesce(long_copy, F.lit(False))
    rest = rows.join(cut, "doc_id", "left_anti").join(odd.withColumn("odd", F.lit(1)), "doc_id", "left")
    rest = rest.select("doc_id", "n_bytes", F.when(lost_all, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), F.when(lost_all, 1).otherwise(0).cast("long").alias("n_spans"), F.when(lost_all, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"))
    return changed.unionByName(rest)
