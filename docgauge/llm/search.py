"""Ranked lexical search over an inverted index in shards, with variable block maxima.

Index.  A task cuts its documents into shards of about `SHARD` bytes of text.  A
shard's documents are numbered by their length, so that neighbours have similar
impacts, and each term has one row: the numbers of the documents that hold it and
its occurrences there.  One more row a shard, with a null term, has the documents'
ids and lengths.  Every term of every document is indexed, and a shard depends on
its own texts only, so a frequent term is long in no single place.

Blocks.  When a shard is searched, the postings of each term that is asked for are
cut into blocks.  A block bounds all documents it spans by its greatest impact;
the bound error of a document is what its own impact, 0 if it doesn't hold the
term, lacks to that.  Dynamic programming chooses the borders that make the sum of
all errors, and a price for each block, least (blocks of at most `LONGEST`): rare
terms end in blocks of single postings, frequent ones in long blocks.  All terms
advance together, a posting a step.

Search.  A document's bound is the sum of weight times block maximum over the
item's terms whose block spans it.  As in WAND, only documents whose bound reaches
the threshold, the k-th best score so far, can enter the result.  They are taken
best bound first, in rounds that grow eightfold; blocks without such a document are never
opened.  What is left when no bound reaches the threshold is skipped, so the
result is exact.  Each shard gives its k best an item, and those meet in a window
whose tasks first keep k rows each.

Items are looked up in blocks of about `TERMS` terms, which is all that reaches
the driver and is broadcast; each block scans the index once.  All scores are
64-bit integers.

Rules for odd rows: null and empty texts have no term, they are not counted and
never found, and as items find nothing; each row of `items` is an item of its own
and each row of `docs` a document of its own, repeated ids included; equal scores
go by ascending doc_id, null last; very long texts are a shard of their own;
empty tables give no rows; other columns are left unread, so names may clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.common import arrow_schema, ship, written
from docgauge.llm.tokens import gathered

#: Bytes of text of a shard; postings of the longest block; what a further block may cost, in mean impacts; terms of a block of items.
SHARD, LONGEST, PRICE, TERMS = 16 << 20, 64, 2.0, 1 << 16
#: Documents of the first round of a search.
FIRST = 64
INDEX = "shard long, term string, df int, docs array<int>, tfs array<int>, ids array<long>, sizes array<long>"

# ASCII letters (as small ones) and digits and all bytes of other characters belong to terms; the rest parts them
_TERM_BYTE = np.full(256, ord(" "), np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _TERM_BYTE[_c] = _c
_TERM_BYTE[65:91] = np.arange(97, 123)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different terms, the number of each occurrence's term, offsets of the texts' occurrences)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    lower = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(_TERM_BYTE[raw]))
    lists = pc.split_pattern(lower, " ")
    coded = pc.dictionary_encode(lists.values)
    codes, bounds = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py()
    there = codes != empty
    upto = np.concatenate([[0], np.cumsum(there)])
    codes = codes[there]
    terms = coded.dictionary
    if empty >= 0:
        codes = codes - (codes > empty)
        terms = pa.concat_arrays([terms.slice(0, empty), terms.slice(empty + 1)])
    return terms, codes, upto[bounds - bounds[0]]


def _lists(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def shard_rows(ids: pa.Array, texts: pa.Array, shard: int, schema: pa.Schema, most: int = 50_000):
    """The index rows of one shard."""
    terms, codes, offsets = terms_of(texts)
    sizes = np.diff(offsets)
    # by length, then by id, null last; documents without a term are left out
    order = np.lexsort((pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False), sizes))
    order = order[sizes[order] > 0]
    if not len(order):
        return
    number = np.full(len(sizes), -1, np.int64)
    number[order] = np.arange(len(order))
    key, tfs = np.unique(codes.astype(np.int64) * len(order) + np.repeat(number, sizes), return_counts=True)
    code, docs = np.divmod(key, len(order))
    ends = np.searchsorted(code, np.arange(len(terms) + 1))
    one = np.array([0, len(order)])
    none = lambda n, k: pa.nulls(n, k)
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), none(1, pa.string()), none(1, pa.int32()), none(1, pa.list_(pa.int32())), none(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(one, pa.int32()), ids.take(pa.array(order))), _lists(sizes[order], one, pa.int64())], names=schema.names).cast(schema)
    for a in range(0, len(terms), most):
        b = min(len(terms), a + most)
        x, y, n = ends[a], ends[b], b - a
        own = ends[a : b + 1] - x
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard), pa.int64()), terms.slice(a, n).cast(pa.string()), pa.array(np.diff(own), pa.int32()), _lists(docs[x:y], own, pa.int32()), _lists(tfs[x:y], own, pa.int32()), none(n, pa.list_(pa.int64())), none(n, pa.list_(pa.int64()))], names=schema.names).cast(schema)


def build_index(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """The index of `docs`, written to the shared folder: rows as `INDEX`."""
    ship(docs.sparkSession)
    schema = arrow_schema(INDEX)

    def build(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in gathered(batches, 1, shard_bytes):
            at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)) // (2 * shard_bytes)
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                yield from shard_rows(b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), part << 32 | k, schema)
                k += 1

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(plain.mapInArrow(build, INDEX), "search-index")


def block_starts(impact: np.ndarray, offsets: np.ndarray, docs: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> np.ndarray:
    """Where blocks begin, so that the sum of bound errors plus `price` mean impacts of its list for each block is least.

    List i is impact[offsets[i]:offsets[i+1]], of ascending docs; none is empty.
    Cost of the first j postings, plus their impacts: the least over all starts i
    of that of the first i, plus the greatest impact since times the documents
    spanned, plus the price.  The last `longest` starts stand in a ring.
    """
    size = np.diff(offsets)
    lists = np.argsort(-size, kind="stable")
    first, size = offsets[:-1][lists], size[lists]
    each = price * np.add.reduceat(impact.astype(np.float64), offsets[:-1])[lists] / size if len(size) else np.empty(0)
    cost, since, begun = (np.full((len(size), longest), x) for x in (np.inf, 0.0, 0.0))
    best = np.zeros(len(size))
    start = np.zeros(longest, np.int64)
    taken = np.empty(len(impact), np.int32)
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right").tolist() if len(size) else []
    for j, n in enumerate(alive):
        slot, at = j % longest, first[:n] + j
        doc = docs[at]
        start[slot] = j
        cost[:n, slot] = best[:n]
        begun[:n, slot] = doc
        since[:n, slot] = 0
        used = min(j + 1, longest)
        np.maximum(since[:n, :used], impact[at][:, None], out=since[:n, :used])
        every = (doc + 1)[:, None] - begun[:n, :used]
        every *= since[:n, :used]
        every += cost[:n, :used]
        pick = every.argmin(axis=1)
        best[:n] = every[np.arange(n), pick] + each[:n]
        taken[at] = j + 1 - start[pick]
    starts, left = [], size.copy()
    while (go := np.flatnonzero(left)).size:
        left[go] -= taken[first[go] + left[go] - 1]
        starts.append(first[go] + left[go])
    return np.sort(np.concatenate(starts)) if starts else np.empty(0, np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - upto + size, size)


class Shard:
    """A shard's postings of the terms asked for, in blocks. `terms`: ascending numbers; list i is docs[offsets[i]:offsets[i+1]]."""

    def __init__(self, terms: np.ndarray, offsets: np.ndarray, docs: np.ndarray, impact: np.ndarray, order: np.ndarray):
        self.terms, self.docs, self.impact, self.order, self.n = terms, docs, impact, order, len(order)
        start = block_starts(impact, offsets, docs)
        self.start, self.size = start, np.diff(start, append=len(docs))
        self.upto = np.searchsorted(start, offsets)
        self.first, self.stop = docs[start].astype(np.int64), docs[start + self.size - 1].astype(np.int64) + 1
        self.bound = np.maximum.reduceat(impact, start) if len(start) else impact
        #: Postings that were looked at, of those of all items' terms.
        self.opened = self.asked = 0

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the k best documents for an item: by score, then in `order`."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        there = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[there], weights[there]
        blocks = _ranges(self.upto[at], self.upto[at + 1] - self.upto[at])
        weight = np.repeat(weights, self.upto[at + 1] - self.upto[at])
        first, stop, size = self.first[blocks], self.stop[blocks], self.size[blocks]
        self.asked += int(size.sum())
        bound = np.zeros(self.n + 1, np.int64)
        np.add.at(bound, first, weight * self.bound[blocks])
        np.add.at(bound, stop, -weight * self.bound[blocks])
        bound = np.cumsum(bound[:-1])
        by_bound = np.argsort(-bound, kind="stable")
        by_bound = by_bound[: np.count_nonzero(bound > 0)]
        found, scores, least, done, step = np.empty(0, np.int64), np.empty(0, np.int64), 1, 0, FIRST
        while done < len(by_bound) and bound[by_bound[done]] >= least:
            take = by_bound[done : done + step]
            take = take[bound[take] >= least]
            live = np.zeros(self.n, bool)
            live[take] = True
            upto = np.concatenate([[0], np.cumsum(live)])
            opened = np.flatnonzero(upto[stop] > upto[first])
            where = _ranges(self.start[blocks[opened]], size[opened])
            self.opened += len(where)
            docs = self.docs[where]
            score = np.zeros(self.n, np.int64)
            np.add.at(score, docs, np.repeat(weight[opened], size[opened]) * self.impact[where])
            take = take[score[take] > 0]
            found, scores = np.concatenate([found, take]), np.concatenate([scores, score[take]])
            best = np.lexsort((self.order[found], -scores))[:k]
            found, scores = found[best], scores[best]
            if len(found) == k:
                least = int(scores[-1])
            done += step
            step *= 8
        return found, scores


def _block(items: DataFrame, spark) -> tuple[list, list[str], list[np.ndarray]]:
    """A block of items: item_ids, the different terms, and each item's numbers of terms."""
    rows = items.select("item_id", "terms").collect()
    terms = sorted({t for r in rows for t in r.terms})
    number = {t: i for i, t in enumerate(terms)}
    return [r.item_id for r in rows], terms, [np.array(sorted(number[t] for t in r.terms), np.int64) for r in rows]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (each once); items without a term are left out."""
    ship(items.sparkSession)

    def cut(batches):
        for b in batches:
            terms, codes, offsets = terms_of(b.column(1))
            sets = [np.unique(codes[x:y]) for x, y in zip(offsets, offsets[1:])]
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), terms.cast(pa.string()).take(pa.array(flat, pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["item_id", "terms"])

    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(cut, "item_id long, terms array<string>").where(F.size("terms") > 0)


def search(index: DataFrame, items: DataFrame, k: int = 10, k1: int = 8, b: int = 90, terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents. `k1` in tenths, `b` in hundredths; `terms`: of a block of items."""
    spark = index.sparkSession
    ship(spark)
    n, total = index.where("term IS NULL").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    asked = written(item_terms(items), "search-items")
    blocks = max(1, -(-(asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        part = _searched(index, _block(asked.where(F.col("block") == block), spark), block, n, total, k, k1, b)
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(index: DataFrame, block, number: int, n: int, total: int, k: int, k1: int, b: int) -> DataFrame:
    """Each shard's k best for the items of a block."""
    spark = index.sparkSession
    item_ids, terms, sets = block
    # at most the block's terms: its size is set by the caller
    wanted = F.broadcast(spark.createDataFrame(list(enumerate(terms)), "tid int, term string"))
    found = index.where("term IS NOT NULL").join(wanted, "term")
    df = dict(found.groupBy("tid").agg(F.sum("df")).collect())
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
    plan = spark.sparkContext.broadcast((sets, weights))
    columns = ["shard", "tid", "docs", "tfs", "ids", "sizes"]
    rows = index.where("term IS NULL").withColumn("tid", F.lit(-1)).select(*columns).unionByName(found.select(*columns))
    schema = arrow_schema(ddl := "item int, doc_id long, score long")

    def run(table: pa.Table) -> pa.Table:
        sets, weights = plan.value
        table = table.combine_chunks()
        tid = table["tid"].to_numpy()
        whole = int(np.flatnonzero(tid < 0)[0])
        one = lambda c: table[c].chunk(0).slice(whole, 1).flatten()
        ids, sizes = one("ids"), one("sizes").to_numpy()
        lists = np.argsort(tid, kind="stable")[1:]
        picked = table.select(["docs", "tfs"]).take(pa.array(lists)).combine_chunks()
        flat = lambda c: picked[c].chunk(0).flatten().to_numpy().astype(np.int64) if len(lists) else np.empty(0, np.int64)
        docs, tfs = flat("docs"), flat("tfs")
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(picked["docs"]).to_numpy())]).astype(np.int64) if len(lists) else np.zeros(1, np.int64)
        m = 100 - b + b * sizes * n // total
        impact = 1_000_000_000 * tfs // (1000 * tfs + k1 * m[docs])
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)))] = np.arange(len(ids))
        shard, got = Shard(tid[lists], offsets, docs, impact, order), []
        for item, own in enumerate(sets):
            numbers, scores = shard.best(own, weights[own], k)
            got.append((np.full(len(numbers), item), numbers, scores))
        item, numbers, scores = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, np.int64),) * 3
        return pa.Table.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(numbers, pa.int64())), pa.array(scores, pa.int64())], schema=schema)

    names = F.broadcast(spark.createDataFrame(list(enumerate(item_ids)), "item int, item_id long"))
    return rows.groupBy("shard").applyInArrow(run, ddl).join(names, "item").withColumn("block", F.lit(number))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    return search(build_index(docs), items, k)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, ts, len(ts) AS n FROM docs WHERE len(ts) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM sized) GROUP BY r, term),
dfs AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, nn),
items AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT DISTINCT q, item_id, term FROM (SELECT q, item_id, unnest(ts) AS term FROM items)),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN dfs USING (term) JOIN tfs USING (term) JOIN sized USING (r), totals GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM (SELECT q, item_id, r, doc_id, score FROM scored WHERE score > 0))
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
