"""Connected components of a link table, by alternating large and small stars.

First each task contracts its own links to stars, `HELD` links at a time.  What is
left and fits into one such step (it is counted) is contracted once more and done.
Otherwise come the rounds: every round is a pre-aggregated minimum and an
equi-join, written to the shared folder, so no task or machine holds all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import ship, written


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Nodes 0..n-1 joined by links (a, b): each node's smallest reachable node."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
    return label


#: Links that a task contracts at once (16 bytes each).
HELD = 500_000


def _contracted(batches):
    """The links of a partition as stars, `HELD` at a time."""

    def stars(held):
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = nodes[smallest_labels(at[: len(u)], at[len(u) :], len(nodes))]
        more = label != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(label[more])], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= HELD:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """`links` has two columns of node numbers, neither null; gives node, component for all nodes in links: the smallest node that is reachable."""
    ship(links.sparkSession)
    u, v = links.columns
    links = links.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u <> v")
    links = written(links.mapInArrow(_contracted, "u long, v long"), "links")
    if links.count() <= HELD:
        links = written(links.coalesce(1).mapInArrow(_contracted, "u long, v long"), "links")
        return _labelled(links)
    links = written(links.distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join's two sides come from exchanges and a hub's rows can be split between tasks
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        links = written(small.distinct(), "links")
        last, mark = mark, _mark(links)
        if mark == last:
            break
    return _labelled(links)


def _labelled(links: DataFrame) -> DataFrame:
    """Stars u, v -> node, component, the centres included."""
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
