"""Sequential one-to-one matching of predicted to true boxes, per page.

A sweep gives the pairs that overlap, not the whole matrix (`pages.overlapping`);
each prediction in turn takes its best free one (`pages.greedy`).  Pages are
independent rows, so nothing is shuffled here; batches of pages are worked on at
once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.geometry import iou
from docgauge.functions.text import _c
from docgauge.operators import pages

MATCHES = "array<struct<p:int,g:int,iou:double>>"


def overlaps(pred, gt, clamp: bool = False) -> Column:
    """Arrays of boxes -> array (by prediction) of arrays of overlaps."""
    return F.transform(_c(pred), lambda p: F.transform(_c(gt), lambda g: iou(p, g, clamp)))


def overlapping(pred, gt, clamp: bool = False) -> Column:
    """The pairs that overlap, by prediction and true box: array of p, g, iou."""

    @F.arrow_udf(MATCHES)
    def pairs(p: pa.Array, g: pa.Array) -> pa.Array:
        page, i, j, value = pages.overlapping(p, g, clamp)
        order = np.lexsort((j, i, page))
        found = pa.StructArray.from_arrays([pa.array(i[order], pa.int32()), pa.array(j[order], pa.int32()), pa.array(value[order])], ["p", "g", "iou"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(page[order], np.arange(len(p) + 1)), pa.int32()), found)

    return pairs(_c(pred), _c(gt))


def greedy(pred, gt, at_least: float = 0.1, strict: bool = False, policy: str = "best", clamp: bool = False) -> Column:
    """Each prediction in turn takes a free true box: the best overlap (ties: the first), or with `first` the first that is good enough.

    It takes it if the overlap is at least (with `strict` above) `at_least`;
    otherwise the true box stays free.  Not for use within a lambda.
    """

    @F.arrow_udf(MATCHES)
    def matches(p: pa.Array, g: pa.Array) -> pa.Array:
        return pages.greedy(p, g, at_least, strict, policy, clamp)

    return matches(_c(pred), _c(gt))


def matched(table: DataFrame, pred: str, gt: str, **how) -> DataFrame:
    """A row per match: the page's other columns, p, g, iou."""
    rest = [c for c in table.columns if c not in (pred, gt)]
    return table.select(*rest, F.explode(greedy(pred, gt, **how)).alias("m")).select(*rest, "m.p", "m.g", "m.iou")
