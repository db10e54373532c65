"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c are at a squared distance of at most 2 - 2 c.  The
vectors are rotated by a fixed random rotation and cut into blocks of `WIDTH`
dimensions; a pair within the whole budget is within the block's share of it
(block width / dimensions) in at least one block.  Each block is range-joined:
some of its dimensions are cut into cells of four radii, a vector belongs to its
cell and visits the neighbouring cells that its radius reaches, and within a cell
block distances make the candidates, verified by the whole cosine in double
precision.  How many dimensions are cut is told by the cells' sizes, counted over
all vectors for each number: one more makes cells smaller and rows more.  A pair is counted in the first block that finds it only, so degrees
need no table of pairs.

Equal vectors of a label are one class with a count before the join, so a vector
that a third of all rows share is one row.  Cells of more than `CHUNK` rows are
cut into chunks, and each pair of chunks is a task of its own.

Rules for odd rows: a vector that is null, empty, zero, or holds null, NaN or
infinite components, or whose label or vec_id is null, links with nothing and
is its own component; vectors of different length never link; repeated rows are
vectors of their own, linked with each other; an empty table gives no rows;
other columns are left unread.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import ship, written
from docgauge.llm.components import components, smallest_labels

COSINE, WIDTH, CHUNK, SEED = 0.98, 8, 8000, 7
#: Rows of a chunk whose distances are held at once; so many compared pairs take the time of one row that is moved.
STRIP, PAIRS = 500, 2000
_SLACK = 1 + 1e-9


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> list[tuple[int, int]]:
    return [(a, min(d, a + WIDTH)) for a in range(0, d, WIDTH)]


def rotated(vectors: np.ndarray | list) -> np.ndarray:
    """Unit vectors of one length, rotated; each row's result depends on that row alone."""
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    r = rotation(x.shape[1])
    out = np.zeros_like(x)
    for k in range(x.shape[1]):
        out += x[:, k : k + 1] * r[:, k]
    return out


def cells(y: np.ndarray, a: int, b: int, budget: float, dims: int):
    """(row, cell, at home) for one block: each row's own cell and those that its radius reaches."""
    part = y[:, a : min(b, a + dims)]
    radius = np.sqrt(budget) * _SLACK
    width = 4 * radius
    low, own, high = (np.floor(x / width).astype(np.int64) for x in (part - radius, part, part + radius))
    rows, found = np.arange(len(y)), np.zeros((len(y), 0), np.int64)
    for k in range(part.shape[1]):
        n = high[rows, k] - low[rows, k] + 1
        up = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows, found = np.repeat(rows, n), np.repeat(found, n, axis=0)
        found = np.concatenate([found, (low[rows, k] + up)[:, None]], axis=1)
    return rows, found, (found == own[rows]).all(axis=1)


def _pairs(y: np.ndarray, ids: np.ndarray, home: np.ndarray, visit: np.ndarray, block: int, cosine: float):
    """(i, j) with id i < id j, row i at home and row j a visitor or at home, linked, and found by no earlier block."""
    d = y.shape[1]
    cuts, budget = blocks(d), 2 - 2 * cosine
    a, b = cuts[block]
    limit = np.array([budget * (q - p) / d for p, q in cuts]) * _SLACK + 1e-15
    h, v = np.flatnonzero(home), np.flatnonzero(visit)
    vb = y[v, a:b]
    v2 = (vb * vb).sum(axis=1)
    out = []
    for x in range(0, len(h), STRIP):
        some = h[x : x + STRIP]
        hb = y[some, a:b]
        near = (hb * hb).sum(axis=1)[:, None] + v2 - 2 * hb @ vb.T <= limit[block] + 1e-12
        near &= ids[some][:, None] < ids[v]
        at, to = np.nonzero(near)
        for k in range(0, len(at), 50_000):
            i, j = some[at[k : k + 50_000]], v[to[k : k + 50_000]]
            linked = (y[i] * y[j]).sum(axis=1) >= cosine
            i, j = i[linked], j[linked]
            gap = (y[i] - y[j]) ** 2
            by = np.stack([gap[:, p:q].sum(axis=1) for p, q in cuts], axis=1) <= limit
            first = by[:, block] & ~by[:, :block].any(axis=1)
            out.append((i[first], j[first]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 2


def _by_length(batch: pa.RecordBatch, column: int):
    """(dimensions, rows, their unit vectors rotated) for each length in a batch."""
    vectors = batch.column(column)
    flat, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    at = at - at[0]
    size = np.diff(at)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield d, rows, rotated(flat[at[rows][:, None] + np.arange(d)])


def cut_dimensions(classes: DataFrame, cosine: float = COSINE) -> int:
    """How many dimensions of a block are cut: the number for which pairs and rows together take least, by the sizes of all cells."""
    ship(classes.sparkSession)

    def sizes(batches):
        for b in batches:
            labels = b.column(0).to_pylist()
            for d, rows, y in _by_length(b, 1):
                for k, (p, q) in enumerate(blocks(d)):
                    width = 4 * np.sqrt((2 - 2 * cosine) * (q - p) / d) * _SLACK
                    own = np.floor(y[:, p:q] / width).astype(np.int64)
                    for dims in range(1, q - p + 1):
                        seen: dict[str, int] = {}
                        for i, c in zip(rows.tolist(), own[:, :dims].tolist()):
                            name = f"{labels[i]}/{d}/{k}/{c}"
                            seen[name] = seen.get(name, 0) + 1
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), dims, np.int32)), pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["dims", "cell", "n"])

    cells = classes.select("label", "embedding").mapInArrow(sizes, "dims int, cell string, n long").groupBy("dims", "cell").agg(F.sum("n").cast("double").alias("n"))
    # a vector visits 1.5 cells a dimension
    found = cells.groupBy("dims").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("rows")).collect()
    return min(((r.pairs / 2 + PAIRS * r.rows) * 1.5**r.dims, r.dims) for r in found)[1] if found else 2


def links(classes: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """`classes`: rep, n, label, embedding. Gives rep, more (vectors of other classes that it links with), root (another rep in reach, or itself)."""
    ship(classes.sparkSession)
    dims = cut_dimensions(classes, cosine)

    def placed(batches):
        for b in batches:
            reps, n, labels = (b.column(k) for k in range(3))
            for d, rows, y in _by_length(b, 3):
                for k, (p, q) in enumerate(blocks(d)):
                    at, cell, home = cells(y, p, q, (2 - 2 * cosine) * (q - p) / d, dims)
                    name = pa.array([f"{d}/{k}/" + ",".join(map(str, c)) for c in cell.tolist()])
                    take = pa.array(rows[at])
                    flat = pa.array(y[at].ravel())
                    yield pa.RecordBatch.from_arrays(
                        [labels.take(take), name, pa.array(np.full(len(at), k), pa.int32()), pa.array(home), reps.take(take), n.take(take), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * d, pa.int32()), flat)], ["label", "cell", "block", "home", "rep", "n", "y"]
                    )

    spread = written(classes.select("rep", "n", "label", "embedding").mapInArrow(placed, "label string, cell string, block int, home boolean, rep long, n long, y array<double>"), "vector-cells")
    sizes = spread.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("rows"))
    # a cell with one row has no pair
    sizes = sizes.where("rows > 1").select("label", "cell", F.ceil(F.col("rows") / chunk).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int")
    rows = spread.join(sizes, ["label", "cell"])
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    turns = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("h"), F.lit(0).alias("v"), F.col("home").alias("is_home"), F.lit(True).alias("is_visit")))).otherwise(
        F.concat(F.transform(every, lambda h: F.struct(h.alias("h"), own.alias("v"), F.lit(False).alias("is_home"), F.lit(True).alias("is_visit"))), F.when(F.col("home"), F.transform(every, lambda v: F.struct(own.alias("h"), v.alias("v"), F.lit(True).alias("is_home"), F.lit(False).alias("is_visit")))).otherwise(F.array().cast("array<struct<h:int,v:int,is_home:boolean,is_visit:boolean>>")))
    )
    rows = rows.withColumn("t", F.explode(turns)).select("label", "cell", "block", "rep", "n", "y", "t.*")

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        ids = g["rep"].to_numpy()
        i, j = _pairs(np.stack(g["y"].to_numpy()), ids, g["is_home"].to_numpy(), g["is_visit"].to_numpy(), int(g["block"].iloc[0]), cosine)
        if not len(i):
            return pd.DataFrame({"rep": [], "more": [], "root": []})
        names, at = np.unique(ids, return_inverse=True)
        n = g["n"].to_numpy()
        more = np.zeros(len(names), np.int64)
        np.add.at(more, at[i], n[j])
        np.add.at(more, at[j], n[i])
        root = names[smallest_labels(at[i], at[j], len(names))]
        some = more > 0
        return pd.DataFrame({"rep": names[some], "more": more[some], "root": root[some]})

    return rows.groupBy("label", "cell", "h", "v").applyInPandas(joined, "rep long, more long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd & some, F.lit(False))
    v = written(v.withColumn("h1", F.when(sound, F.xxhash64("embedding"))).withColumn("h2", F.when(sound, F.xxhash64(F.lit(1), F.reverse("embedding")))), "vectors")
    good, key = v.where("h1 IS NOT NULL"), ["label", "h1", "h2"]
    classes = written(good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "vector-classes")
    found = written(links(classes, cosine), "vector-links")
    degrees = found.groupBy("rep").agg(F.sum("more").alias("more"))
    of = components(found.select("rep", "root")).withColumnRenamed("node", "rep")
    classes = classes.select(*key, "rep", "n").join(degrees, "rep", "left").join(of, "rep", "left")
    classes = classes.select(*key, (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("vec_id", *key).join(classes, key).select("vec_id", "n_links", "component_id")
    alone = v.where("h1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x : x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x : x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.c),
k AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, k.component_id, v.vec_id = k.component_id AS kept FROM v JOIN k ON k.vec_id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) d ON d.a = v.vec_id
"""
