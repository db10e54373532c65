"""Jaccard join on word shingles, with count-vector R-trees.

A document's set holds the hashes of its distinct shingles; equal sets are one
class, told by two fingerprints and the size, and only classes go on.

Candidates.  Linked sets of sizes a <= b differ in at most
(a + b) (1 - t) / (1 + t) shingles.  Sizes fall into ranges that grow by 1 / t twice
(sets link in a range or with the next one's); in a range whose largest difference is r, hash space is cut into r + 1 + s parts, so
linked sets agree in at least s + 1 parts, and in one of any r + 1.  Each part that
isn't empty gives a key (range, part, content).

* First a key counts that at most `HOT` sets share; the others are hot (a passage
  that many documents hold makes such parts).  A set with r + 1 keys that aren't
  hot shares one of them with any partner.  The few sets that share a key are
  pairs.
* Sets with fewer such keys are taken again, among themselves, with all their keys:
  if a linked pair shares no key that isn't hot, both are of these.  Where they
  agree in empty parts alone both have more than s of them; a set with so many also
  gives the keys of a second cut, by other bits of the hashes, and so on for up to
  `CUTS` cuts and then the range's `empty` key.  What shares a key is joined to the
  smallest of it, a row each, and what hangs together is a candidate group.

In both steps a slice of documents is joined first, so a key that many hold is a
row or a few a slice, and nowhere all pairs of many sets are made.

Verification.  Shingles are hashed into counters, one for two to four shingles; two
sets' overlap is at most the sum of the minima of their counts, and what that bound
leaves is verified on the sets.  For the first step's pairs the count vectors are
joined to the pairs, and then the sets to what is left.  A group's count vectors go
into an R-tree: nodes and entries whose bound is below the overlap that the sizes
need are passed over, as are entries that already hang together with the query;
surviving pairs are verified on the sets, as rows of bits over the shingles that
the group repeats.  Groups of more than `CHUNK` classes or `SHINGLES` shingles are
cut into chunks, each of one range of sizes: first each chunk is joined with the
first one of its range and these with those of the next range, then, only where a
group is still in pieces, the other pairs of chunks of a range or of neighbours
are, each pair a task's step of its own.

Rules for odd rows: a text without words has an empty set and links with nothing;
fewer words than a shingle are one shingle; a null doc_id links with nothing and
its component is null; rows that repeat a doc_id are the same node, also where
their texts differ: what links with one is reachable from all; an empty table
gives no rows; other columns are left unread.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.common import free_names, ship, small, sole_cache, trim, written
from docgauge.llm.components import components

WORDS, PERCENT = 5, 80
#: Sets that share a key that isn't hot; results don't depend on it.
HOT = 3
CHUNK, SHINGLES, LEAF, CUTS = 2000, 1_000_000, 32, 6
#: Documents and bytes of text that are handled at once.
SLICE, SLICE_BYTES = 4096, 1 << 20
#: Bytes of bit rows that a group may take; beyond them pairs are compared one by one.
BITS = 32 << 20
#: Ids that may be broadcast, after they have been counted.
IDS = 500_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte, the same for a letter's two cases; 0 for the six white spaces, which part words.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
#: Powers of an odd base and of its inverse modulo 2 ** 64, as many as the longest slice has needed.
_BASE = int(_ODD[1])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_upto(n: int) -> list[np.ndarray]:
    sole_cache("powers", lambda: _powers.__setitem__(slice(None), [np.ones(1, np.uint64)] * 2))
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
    return _powers


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings, nulls as empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word in order, words of each text): sums of byte numbers times powers of the place in the word."""
    raw, offsets = _bytes_of(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    value = _BYTE[raw]
    word = value != 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]  # texts follow each other without a gap
    first[edge] |= word[edge]
    last[edge - 1] |= word[edge - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _powers_upto(len(raw))
    value *= power[: len(raw)]
    upto = np.cumsum(value)
    total = upto[last] - upto[first] + value[first]
    return mixed(total * inverse[first]), np.diff(np.searchsorted(first, offsets))


def _in_order(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (set, hash) in order, for set numbers below n."""
    bits = np.uint64(max(1, (n - 1).bit_length()))
    order = np.argsort((of.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    a, b = of[order], h[order]
    if ((a[1:] == a[:-1]) & (b[1:] < b[:-1])).any():  # apart in the lowest bits only
        order = np.lexsort((h, of))
        a, b = of[order], h[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted hashes of each text's distinct shingles."""
    w, size = word_hashes(texts)
    end = np.cumsum(size)
    start = end - size

    def hashed(at: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(at), n, np.uint64)
        for k in range(n):
            total = (total ^ w[at + k]) * _ODD[k % 8]
            total ^= total >> np.uint64(32)
        return mixed(total)

    of = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(len(w)) + words <= end[of]) if len(w) else np.zeros(0, np.int64)
    sets, hashes = [of[at]], [hashed(at, words)]
    for n in np.unique(size[(size > 0) & (size < words)]).tolist():
        few = np.flatnonzero(size == n)
        sets.append(few)
        hashes.append(hashed(start[few], n))
    of, h = _in_order(np.concatenate(sets), np.concatenate(hashes), len(size))
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(size)))]).astype(np.int64)


def fingerprints(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set; 0 for an empty one."""
    some = offsets[1:] > offsets[:-1]
    out = []
    for odd in (_ODD[4], _ODD[5]):
        f = np.zeros(len(some), np.uint64)
        if some.any():
            f[some] = np.add.reduceat(mixed(((h + np.uint64(3)) * _ODD[3]) ^ odd), offsets[:-1][some])
        out.append(f.view(np.int64))
    return tuple(out)


class Ranges:
    """Ranges of set sizes up to `most` for a threshold of `percent` in 100: smallest size, parts and spare parts (s) of each; parts are 0 where only equal sets link."""

    def __init__(self, percent: int, most: int):
        self.percent = percent
        low, parts, spare = [1], [], []
        while len(low) < 3 or low[-2] <= most:  # one range more than the largest set is in
            after = low[-1]
            for _ in range(2):
                after = after * 100 // percent + 1
            r = 2 * (after - 1) * (100 - percent) // (100 + percent)
            s = self._spare(low[-1], after - 1, r) if r else 0
            parts.append(r + 1 + s if r else 0)
            spare.append(s)
            low.append(after)
        self.low, self.parts, self.spare = (np.array(x, np.int64) for x in (low, parts, spare))

    def _spare(self, low: int, high: int, r: int) -> int:
        """The s with the fewest keys in all: more parts are more keys, fewer send more sets to another cut."""
        s = np.arange(1, 2 * r + 4)
        parts, keys = (r + 1 + s).astype(float), 0
        for n in np.geomspace(max(1, low * self.percent // 100), high, 6):
            empty = np.exp(-n / parts)
            spread = np.sqrt(np.maximum(parts * (empty - (1 + n / parts) * empty**2), 1e-6))
            again = 1 / (1 + np.exp(1.7 * (s + 0.5 - parts * empty) / spread))  # more than s parts are empty
            keys = keys + parts * (1 - empty) / (1 - np.minimum(again, 0.9))
        return int(s[np.argmin(keys)])

    def _first(self, size: np.ndarray):
        """(range, rows) of the sets that have parts in their own range, and in the next one."""
        own = np.searchsorted(self.low, size, "right") - 1
        for step in (0, 1):
            k = own + step
            there = (size > 0) & (self.parts[k] > 0)
            if step:  # a set that is too small for the next range has no partner there
                there &= size * 100 // self.percent >= self.low[k]
            yield k, np.flatnonzero(there)

    def _cut(self, h: np.ndarray, offsets: np.ndarray, k: np.ndarray, rows: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, set of each) of the parts that aren't empty, of the sets `rows`."""
        n = np.diff(offsets)[rows]
        row = np.repeat(rows, n)
        own = h[np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        if cut:  # other bits decide; in order of the parts
            own = mixed(own ^ _ODD[cut + 1])
            row, own = _in_order(row, own, len(offsets) - 1)
        part = ((own >> np.uint64(32)) * self.parts[k[row]].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        content, at = np.add.reduceat(mixed(own + np.uint64(1)), first), row[first]
        return mixed(content + mixed(k[at].astype(np.uint64) * _ODD[0] + part[first] * _ODD[1] + np.array([cut], np.uint64) * _ODD[6])), at

    def counted(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first cut: keys with the range in their lowest six bits, the set of each, and for each (set, range) a number and how many keys it has beyond r + 1."""
        size, out, sets, which, slack = np.diff(offsets), [], [], [], np.zeros(2 * (len(offsets) - 1), np.int64)
        for step, (k, rows) in enumerate(self._first(size)):
            if not len(rows):
                continue
            key, at = self._cut(h, offsets, k, rows, 0)
            out.append((key & ~np.uint64(63)) | (k[at] & 63).astype(np.uint64))
            sets.append(at)
            which.append(2 * at + step)
            slack[2 * rows + step] = np.bincount(at, minlength=len(size))[rows] - (self.parts[k[rows]] - self.spare[k[rows]])
        none = np.zeros(0, np.int64)
        return (np.concatenate(out), np.concatenate(sets), np.concatenate(which), slack) if out else (np.zeros(0, np.uint64), none, none, slack)

    def keys(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All keys, and the set of each, for sets of sorted hashes."""
        out, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, rows in self._first(np.diff(offsets)):
            for cut in range(CUTS):
                if not len(rows):
                    break
                key, at = self._cut(h, offsets, k, rows, cut)
                out.append(key)
                sets.append(at)
                full = np.bincount(at, minlength=len(offsets) - 1)[rows]
                rows = rows[self.parts[k[rows]] - full > self.spare[k[rows]]]
            if len(rows):  # as many empty parts in every cut
                out.append(mixed(k[rows].astype(np.uint64) * _ODD[2]))
                sets.append(rows)
        return np.concatenate(out), np.concatenate(sets)


def _slices(texts: pa.Array):
    """(first, end) of slices of SLICE rows and about SLICE_BYTES at most."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    a = 0
    upto = np.cumsum(size)
    while a < len(size):
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SLICE_BYTES, "right"))
        b = min(max(b, a + 1), a + SLICE)
        yield a, b
        a = b


def sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, f1, f2 (the set's fingerprints)."""
    ship(docs.sparkSession)

    def made(batches):
        for batch in batches:
            trim()
            for a, b in _slices(batch.column(1)):
                part = batch.slice(a, b - a)
                h, offsets = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), *map(pa.array, fingerprints(h, offsets))], ["doc_id", "n", "f1", "f2"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(made, "doc_id long, n long, f1 long, f2 long")


def counted(docs: DataFrame, words: int, ranges: Ranges) -> DataFrame:
    """key, node (a set's first fingerprint), w, slack: the first step's keys.

    A key that more than HOT sets of a slice hold is hot whatever others have: it
    is one row with their number and no node, and is taken off their slack.
    """
    ship(docs.sparkSession)

    def made(batches):
        for batch in batches:
            trim()
            for a, b in _slices(batch.column(0)):
                h, offsets = shingle_sets(batch.column(0).slice(a, b - a), words)
                nodes = fingerprints(h, offsets)[0]
                key, of, which, slack = ranges.counted(h, offsets)
                once = np.zeros(len(nodes), bool)
                once[np.unique(nodes, return_index=True)[1]] = True  # equal sets count once
                key, of, which = (x[once[of]] for x in (key, of, which))
                order = np.argsort(key)
                key, of, which = key[order], of[order], which[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(key)))
                hot = np.repeat(times > HOT, times)
                slack -= np.bincount(which[hot], minlength=len(slack))
                short = np.unique(np.flatnonzero(slack < 0) // 2)
                short = short[once[short]]
                rest, heads = ~hot, first[times > HOT]
                n = len(heads)
                keys = np.concatenate([key[rest], key[heads], mixed(nodes[short].view(np.uint64) ^ _ODD[7])])
                node = np.concatenate([nodes[of[rest]], np.zeros(n, np.int64), nodes[short]])
                w = np.concatenate([np.ones(rest.sum(), np.int64), times[times > HOT], np.full(len(short), HOT + 1)])
                left = np.concatenate([np.minimum(slack[which[rest]], 1 << 30), np.zeros(n, np.int64), np.full(len(short), -1)])
                null = np.zeros(len(keys), bool)
                null[rest.sum() : rest.sum() + n] = True
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node, mask=null), pa.array(w, pa.int32()), pa.array(left, pa.int32())], ["key", "node", "w", "slack"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("text").mapInArrow(made, "key long, node long, w int, slack int")


def keyed(docs: DataFrame, words: int, ranges: Ranges) -> DataFrame:
    """key, node: the second step's keys. Of a key that several sets of a slice hold only the smallest goes on under it; the others share a key of their own with that one."""
    ship(docs.sparkSession)

    def made(batches):
        for batch in batches:
            trim()
            for a, b in _slices(batch.column(0)):
                h, offsets = shingle_sets(batch.column(0).slice(a, b - a), words)
                node = fingerprints(h, offsets)[0]
                key, of = ranges.keys(h, offsets)
                node = node[of]
                order = np.argsort(key)
                key, node = key[order], node[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                first = np.flatnonzero(new)
                if len(first) < len(key):
                    low = np.minimum.reduceat(node, first)
                    other = np.repeat(low, np.diff(np.append(first, len(key))))
                    more = np.flatnonzero(node != other)
                    links = np.unique(np.stack([node[more], other[more]]), axis=1) if len(more) else np.zeros((2, 0), np.int64)
                    link_key = mixed(mixed(links[0].view(np.uint64) * _ODD[7]) + links[1].view(np.uint64) * _ODD[6])
                    key, node = np.concatenate([key[first], link_key, link_key]), np.concatenate([low, links[0], links[1]])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], ["key", "node"])

    return docs.select("text").mapInArrow(made, "key long, node long")


def candidates(docs: DataFrame, classes: DataFrame, words: int, ranges: Ranges) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b of the first step, links node, low of the second), of first fingerprints."""
    by_key = Window.partitionBy("key").orderBy("node")
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = counted(docs, words, ranges).withColumn("times", F.sum("w").over(whole))
    before = [F.when((F.col("times") <= HOT) & (F.col("node") != F.lag("node", i).over(by_key)), F.lag("node", i).over(by_key)) for i in range(1, HOT)]
    shared = shared.select("node", "times", F.filter(F.array(*before), lambda x: x.isNotNull()).alias("others"), F.col("key").bitwiseAND(63).cast("int").alias("k"), "slack")
    shared = written(shared.where(f"node IS NOT NULL AND (times > {HOT} OR size(others) > 0)"), "shingle-shared")
    pairs = shared.where(f"times <= {HOT}").select("node", F.explode("others").alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    hot = shared.where(f"times > {HOT}").groupBy("node", "k").agg(F.count(F.lit(1)).alias("times"), F.min("slack").alias("slack")).where("times > slack")
    again = _texts_of(docs, hot.select("node").distinct(), classes)
    links = keyed(again, words, ranges).withColumn("low", F.min("node").over(Window.partitionBy("key"))).where("node <> low").select("node", "low").distinct()
    return pairs, links


def _texts_of(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that stand for the classes of `nodes`; where an id has several texts, all of them."""
    ids = nodes.select(F.col("node").alias("f1")).join(classes, "f1").select(F.col("rep").alias("doc_id")).distinct()
    return docs.join(small(ids, "shingle-ids", IDS), "doc_id", "left_semi").where("text IS NOT NULL")


def counters(size: int) -> int:
    """How many counters a set of that size has: a power of two, for two to four shingles each."""
    return 1 << max(4, size.bit_length() - 2)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """The most that two sets with these counts can overlap; the longer vector is folded to the shorter one's counters."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = b.reshape(-1, len(a)).sum(axis=0, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def _of_nodes(docs: DataFrame, words: int, make, name: str) -> DataFrame:
    """node, n, `name` (binary): make(set) of each different set in `docs`."""

    def made(batches):
        for batch in batches:
            trim()
            for x, y in _slices(batch.column(0)):
                h, offsets = shingle_sets(batch.column(0).slice(x, y - x), words)
                parts = [make(h[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(h, offsets)[0]), pa.array(np.diff(offsets)), pa.array(parts, pa.binary())], ["node", "n", name])

    made_of = docs.select("text").mapInArrow(made, f"node long, n long, {name} binary")
    return made_of.groupBy("node", "n").agg(F.min(name).alias(name))


def _beside(pairs: DataFrame, things: DataFrame, name: str) -> DataFrame:
    """`pairs` a, b with the `things` of both."""
    for side in ("a", "b"):
        pairs = pairs.join(things.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col(name).alias(f"{side}_{name}")), side)
    return pairs.select("a", "b", "a_n", "b_n", f"a_{name}", f"b_{name}")


def linked_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs a, b those that link, as rep, root: by sizes, then by the bound, then on the sets."""
    sizes = classes.select(F.col("f1").alias("node"), "n")
    sized = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("x")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("y")), "b")
    pairs = written(sized.where(100 * F.least("x", "y") >= percent * F.greatest("x", "y")).select("a", "b").distinct(), "shingle-pairs")

    def nodes(of: DataFrame) -> DataFrame:
        return of.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def counts(own: np.ndarray) -> np.ndarray:
        n = counters(len(own))
        return np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.uint16)  # a set of under 2 ** 16 shingles a counter

    def overlap_of(x: bytes, y: bytes, kind: str, f) -> int:
        return f(np.frombuffer(x, kind), np.frombuffer(y, kind))

    def kept(kind: str, f):
        def keep(batches):
            for batch in batches:
                a_n, b_n = (batch.column(k).to_numpy() for k in (2, 3))
                both = np.fromiter((overlap_of(x.as_buffer(), y.as_buffer(), kind, f) for x, y in zip(batch.column(4), batch.column(5))), np.int64, batch.num_rows)
                good = np.flatnonzero(100 * both >= percent * (a_n + b_n - both))
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good)) for k in (0, 1)], ["a", "b"])

        return keep

    counted_sets = written(_of_nodes(_texts_of(docs, nodes(pairs), classes), words, counts, "counts"), "shingle-counts")
    pairs = written(_beside(pairs, counted_sets, "counts").mapInArrow(kept("<u2", bound), "a long, b long"), "shingle-bounded")
    whole = written(_of_nodes(_texts_of(docs, nodes(pairs), classes), words, lambda own: own, "hashes"), "shingle-hashes")
    pairs = _beside(pairs, whole, "hashes").mapInArrow(kept("<u8", overlap), "a long, b long")
    reps = classes.select("f1", "rep")
    pairs = pairs.join(reps.select(F.col("f1").alias("a"), F.col("rep").alias("root")), "a").join(reps.select(F.col("f1").alias("b"), "rep"), "b")
    return pairs.select("rep", "root")


class RTree:
    """Count vectors, packed in order of size and counts; two levels of nodes above the entries."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*counts.T[3::-1], sizes))
        self.counts, self.sizes, self.order = counts[order], sizes[order], order
        self.leaf = self._nodes(self.counts, self.sizes)
        self.top = self._nodes(*self.leaf)

    @staticmethod
    def _nodes(upper: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper corners and smallest sizes of nodes of LEAF children."""
        at = np.arange(0, len(upper), LEAF)
        return np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(low, at)

    def search(self, counts: np.ndarray, size: int, percent: int, wanted) -> np.ndarray:
        """Entries that may overlap enough; `wanted(entries)` tells which are to be looked at."""
        need = -(-size * percent // 100)
        # sizes that can link are neighbours in the tree
        first, last = np.searchsorted(self.sizes, need), np.searchsorted(self.sizes, size * 100 // percent, "right")

        def may(upper, low):
            return np.minimum(upper, counts).sum(axis=1, dtype=np.int32) * (100 + percent) >= percent * (size + np.maximum(low, need))

        def children(nodes, a: int, b: int):
            at = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            return at[(at >= a) & (at < b)]

        if first >= last:
            return self.order[:0]
        a, b = first // LEAF, (last - 1) // LEAF + 1
        c, d = a // LEAF, (b - 1) // LEAF + 1
        leaves = children(np.flatnonzero(may(self.top[0][c:d], self.top[1][c:d])) + c, a, b)
        leaves = leaves[may(self.leaf[0][leaves], self.leaf[1][leaves])]
        here = children(leaves, first, last)
        here = here[wanted(self.order[here])]
        return self.order[here[may(self.counts[here], self.sizes[here])]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _bit_rows(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray | None:
    """A row of bits per set over the shingles that more than one set has; None if they took more than BITS bytes."""
    order = np.sort(h)
    several = np.unique(order[1:][order[1:] == order[:-1]])
    del order
    wide = -(-len(several) // 64)
    if n * wide * 8 > BITS:
        return None
    rows = np.zeros((n, wide), np.uint64)
    if wide:
        column = np.searchsorted(several, h)
        column[column == len(several)] = 0
        kept = several[column] == h
        column, of = column[kept], of[kept]
        np.bitwise_or.at(rows.ravel(), of * wide + (column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return rows


def linked_groups(h: np.ndarray, offsets: np.ndarray, percent: int, root: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """For sets that aren't empty, the smallest index that each hangs together with.

    `root` has what is known already.  With `side` (0 or 1) two sets of side 0
    aren't compared; 2 marks a second side whose sets aren't compared either.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    root = np.arange(n) if root is None else root.copy()
    side = np.ones(n, np.int8) if side is None else side
    of = np.repeat(np.arange(n), sizes)

    def enough(i, j, both) -> np.ndarray:
        return 100 * both >= percent * (sizes[i] + sizes[j] - both)

    def pair(i: int, j: int) -> int:
        return overlap(h[offsets[i] : offsets[i + 1]], h[offsets[j] : offsets[j + 1]])

    def join(i: int, roots) -> None:
        every = np.unique(np.append(roots, root[i]))
        root[np.isin(root, every)] = every[0]

    if n <= 3:  # most groups
        for i in range(1, n):
            for j in range(i):
                if root[i] != root[j] and (side[i] != side[j] or side[i] == 1) and enough(i, j, pair(i, j)):
                    join(i, root[j])
        return root
    groups = min(512, counters(int(np.median(sizes))))
    counts = np.bincount(of * groups + (h & np.uint64(groups - 1)).astype(np.int64), minlength=n * groups).reshape(n, groups)
    counts = counts.astype(np.uint16 if counts.max() < 1 << 16 else np.int32)
    tree, bits = RTree(counts, sizes), _bit_rows(h, of, n)
    for i in range(1, n):
        near = np.sort(tree.search(counts[i], int(sizes[i]), percent, lambda e: (e < i) & (root[e] != root[i]) & ((side[e] != side[i]) | (side[i] == 1))))
        while len(near):
            some, near = near[:64], near[64:]
            both = np.bitwise_count(bits[some] & bits[i]).sum(axis=1, dtype=np.int64) if bits is not None else np.array([pair(i, j) for j in some.tolist()])
            found = some[enough(i, some, both)]
            if len(found):
                join(i, root[found])
                near = near[root[near] != root[i]]
    return root


#: Where a chunk's number has its range of sizes.
RANGE = 1 << 32


def _verified(members: DataFrame, words: int, percent: int) -> DataFrame:
    """`members`: grp, h, v (the two chunks), own, rep, label, n, f1, f2, text. Gives links rep, root.

    A chunk is compared within itself where it stands with the first one of its
    range.  A text that isn't the one that a class stands for (rows that repeat a
    doc_id may differ) is told by its fingerprints and passed over.
    """

    def joined(key, own, rep, label, h, offsets):
        _, h1, v1 = key
        known = np.unique(label, return_index=True, return_inverse=True)
        root = np.where(label == -1, np.arange(len(rep)), known[1][known[2]])
        if len(rep) < 2 or len(known[0]) == 1 and label[0] != -1:
            return rep[:0], rep[:0]
        inner = h1 // RANGE == v1 // RANGE and h1 % RANGE == 0
        side = np.where(own == v1, 1 if inner else 2, 0).astype(np.int8)
        found = linked_groups(h, offsets, percent, root, side)
        more = (found != root) & (root == np.arange(len(rep)))  # the others are known to hang together with these
        return rep[more], rep[found[more]]

    def verify(batches):
        held = None  # the rows of the last group so far: its key, and lists of own, rep, label, sets, sizes

        def done():
            own, rep, label, h, n = (np.concatenate(x) for x in held[1:])
            a, b = joined(held[0], own, rep, label, h, np.concatenate([[0], np.cumsum(n)]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["rep", "root"])

        for batch in batches:
            trim()
            for x, y in _slices(batch.column(9)):
                part = batch.slice(x, y - x)
                h, offsets = shingle_sets(part.column(9), words)
                f1, f2 = fingerprints(h, offsets)
                grp, h1, v1, own, rep, label, n, w1, w2 = (part.column(k).to_numpy() for k in range(9))
                right = (f1 == w1) & (f2 == w2) & (np.diff(offsets) == n)
                new = np.ones(len(grp), bool)
                new[1:] = (grp[1:] != grp[:-1]) | (h1[1:] != h1[:-1]) | (v1[1:] != v1[:-1])
                again = np.zeros(len(grp), bool)
                again[1:] = ~new[1:] & (rep[1:] == rep[:-1]) & (w1[1:] == w1[:-1]) & right[:-1]
                cut = np.append(np.flatnonzero(new), len(grp))
                for a, b in zip(cut.tolist(), cut[1:].tolist()):
                    key = (int(grp[a]), int(h1[a]), int(v1[a]))
                    if held and held[0] != key:
                        if held[1]:
                            yield done()
                        held = None
                    held = held or (key, [], [], [], [], [])
                    for i in (np.flatnonzero(right[a:b] & ~again[a:b]) + a).tolist():
                        for to, value in zip(held[1:], (own[i : i + 1], rep[i : i + 1], label[i : i + 1], h[offsets[i] : offsets[i + 1]], n[i : i + 1])):
                            to.append(value)
        if held and held[1]:
            yield done()

    rows = members.select("grp", "h", "v", "own", "rep", "label", "n", "f1", "f2", "text")
    return rows.repartition("grp", "h", "v").sortWithinPartitions("grp", "h", "v", "rep", "f1", "f2").mapInArrow(verify, "rep long, root long")


def _chunked(members: DataFrame, ranges: Ranges, chunk: int) -> DataFrame:
    """`members` (grp, rep, f1, n) with `pieces` (chunks of the group), k (range of sizes, 0 in groups of one chunk), at (chunk in the range), here, before, after (chunks of the range and its neighbours)."""
    low = F.array(*[F.lit(int(x)) for x in ranges.low])
    members = members.withColumn("size_range", (F.size(F.filter(low, lambda x: x <= F.col("n"))) - 1).cast("long"))
    size = lambda w: F.greatest(F.ceil(F.sum("c").over(w) / chunk), F.ceil(F.sum("s").over(w) / SHINGLES)).cast("long")
    # a row a group and range from here on
    per = members.groupBy("grp", "size_range").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    in_group = Window.partitionBy("grp")
    per = per.withColumn("pieces", size(in_group))
    per = per.withColumn("k", F.when(F.col("pieces") == 1, F.lit(0).cast("long")).otherwise(F.col("size_range")))
    own = per.withColumn("here", size(Window.partitionBy("grp", "k")))
    beside = in_group.orderBy("k")
    near = lambda d: F.coalesce(F.max(F.col("here")).over(beside.rangeBetween(d, d)), F.lit(0)).cast("long")
    parts = own.withColumn("before", near(-1)).withColumn("after", near(1)).select("grp", "size_range", "pieces", "k", "here", "before", "after")
    return members.join(small(parts, "shingle-parts"), ["grp", "size_range"]).drop("size_range").withColumn("at", F.pmod(F.xxhash64("rep", "f1"), F.col("here")))


def _turns(first: bool):
    """The pairs of chunks that a member takes part in: first those with the first chunk of a range, then all others."""
    k, at, here, before, after = (F.col(c) for c in ("k", "at", "here", "before", "after"))
    chunk = lambda r, i: r * F.lit(RANGE) + i
    own, none = chunk(k, at), F.array().cast("array<struct<h:bigint,v:bigint>>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    pair = lambda h, v: F.struct(h.alias("h"), v.alias("v"))
    if first:
        heads = F.concat(F.transform(upto(here), lambda i: pair(own, chunk(k, i))), F.when(before > 0, F.array(pair(chunk(k - 1, F.lit(0)), own))).otherwise(none), F.when(after > 0, F.array(pair(own, chunk(k + 1, F.lit(0))))).otherwise(none))
        pairs = F.when(at == 0, heads).otherwise(F.array(pair(chunk(k, F.lit(0)), own)))
    else:
        same = F.when(at > 0, F.transform(F.filter(upto(here), lambda i: (i > 0) & (i != at)), lambda i: pair(chunk(k, F.least(i, at)), chunk(k, F.greatest(i, at))))).otherwise(none)
        down = F.transform(F.filter(upto(before), lambda i: (i > 0) | (at > 0)), lambda i: pair(chunk(k - 1, i), own))
        up = F.transform(F.filter(upto(after), lambda i: (i > 0) | (at > 0)), lambda i: pair(own, chunk(k + 1, i)))
        pairs = F.concat(same, down, up)
    return F.explode(pairs).alias("t")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_sets = written(sets(docs, words), "shingle-sets")
    key = ["f1", "f2", "n"]
    good = all_sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(good.groupBy(*key).agg(F.min("doc_id").alias("rep")), "shingle-classes")

    # made once, so that all machines cut alike
    ranges = Ranges(percent, all_sets.agg(F.max("n").alias("n")).first().n or 0)
    pairs, shared = candidates(docs, classes, words, ranges)
    linked = linked_pairs(docs, classes, pairs, words, percent)
    groups = written(components(shared), "shingle-groups").select(F.col("node").alias("f1"), F.col("component").alias("grp"))
    members = small(_chunked(classes.join(groups, "f1"), ranges, chunk), "shingle-members")
    texts = _texts_of(docs, groups.select(F.col("f1").alias("node")), classes).join(members, F.col("doc_id") == F.col("rep")).drop("doc_id").withColumn("own", F.col("k") * F.lit(RANGE) + F.col("at"))
    texts = written(texts, "shingle-texts")

    what = ["own", "rep", "label", "n", "f1", "f2", "text"]
    rows = texts.withColumn("label", F.lit(-1).cast("long")).select("grp", *what, _turns(True)).select("grp", "t.*", *what)
    links = written(_verified(rows, words, percent).unionByName(linked), "shingle-links")
    # rows of one doc_id with several texts: their classes hang together
    several = small(good.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).where("a <> b").select("doc_id"), "shingle-several")
    same = good.join(several, "doc_id").join(classes, key).where("doc_id <> rep").select("rep", F.col("doc_id").alias("root"))
    links = written(links.unionByName(same), "shingle-links")
    of = written(components(links), "shingle-components")
    big = texts.where("pieces > 1").join(of.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    torn = small(big.groupBy("grp").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("grp"), "shingle-torn")
    if not torn.isEmpty():
        rows = big.join(torn, "grp").select("grp", *what, _turns(False)).select("grp", "t.*", *what)
        of = written(components(written(links.unionByName(_verified(rows, words, percent)), "shingle-links")), "shingle-components")

    named = classes.join(of.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(named, key).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = all_sets.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest of their component, columns as in `docs`; of rows that repeat a doc_id one stays, of null ids all."""
    found = written(near_duplicates(docs, words, percent), "shingle-found")
    gone_id, again_id = free_names(docs, "gone", "again")
    gone = small(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "shingle-gone", IDS)
    kept = docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
    again = small(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(again_id)), "shingle-again", IDS)
    once = kept.join(again, kept["doc_id"] == again[again_id], "left_anti")
    several = kept.join(again, kept["doc_id"] == again[again_id], "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(several)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id
"""
