"""Reading order and rank correlation over a page's arrays: expressions, and pairs counted by merging (`pages`)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.geometry import to_xyxy
from docgauge.functions.text import _c, let
from docgauge.operators import pages


def reading_order(boxes) -> Column:
    """Indices by (y1, x1) of the corners, ties by index."""
    keyed = F.transform(_c(boxes), lambda b, i: F.struct(to_xyxy(b)[1].alias("y"), to_xyxy(b)[0].alias("x"), i.cast("int").alias("i")))
    return F.transform(F.array_sort(keyed), lambda k: k["i"])


def ranks(order) -> Column:
    """The place of each index in an order of 0..n-1."""
    at = F.transform(_c(order), lambda v, i: F.struct(v.alias("v"), i.cast("int").alias("i")))
    return F.transform(F.array_sort(at), lambda x: x["i"])


COUNTS = "struct<c:bigint,d:bigint,ta:bigint,tb:bigint>"


def _pairs(a: Column, b: Column) -> Column:
    """Of all pairs i < j: concordant, discordant, ties in a, ties in b; by sorting and merging."""

    @F.arrow_udf(COUNTS)
    def counts(x: pa.Array, y: pa.Array) -> pa.Array:
        return pages.pair_counts(x, y)

    return counts(a, b)


#: What `visited` gives.
VISITED = f"struct<visits:array<int>,own:{COUNTS},ranked:{COUNTS}>"


def visited(pred, gt, order, at_least: float) -> Column:
    """True boxes as predictions in turn take them, and the counts for their order, in one Python step (`pages.visited`). Not for use within a lambda."""

    @F.arrow_udf(VISITED)
    def taken(p: pa.Array, g: pa.Array, o: pa.Array) -> pa.Array:
        return pages.visited(p, g, o, at_least)

    return taken(_c(pred), _c(gt), _c(order))


def tau_of(counts, n) -> Column:
    """Tau-b from counts of pairs of `n` places; fewer than two or a zero denominator give 0."""
    n = _c(n).cast("double")
    total = n * (n - 1) / 2
    value = let(F.struct(_c(counts).alias("k"), total.alias("n")), lambda v: F.coalesce(F.try_divide((v["k"]["c"] - v["k"]["d"]).cast("double"), F.sqrt((v["n"] - v["k"]["ta"]) * (v["n"] - v["k"]["tb"]))), F.lit(0.0)))
    return F.when(n < 2, 0.0).otherwise(value)


def kendall_tau_b(a, b) -> Column:
    """Ties count on each side; fewer than two, unequal lengths or a zero denominator give 0. Not for use within a lambda."""
    a, b = _c(a), _c(b)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(tau_of(_pairs(a, b), F.size(a)))


def kendall_gamma(a, b, few: float = 1.0) -> Column:
    """(concordant - discordant) / (concordant + discordant); `few` for fewer than two."""
    a, b = _c(a), _c(b)
    value = let(_pairs(a, b), lambda k: F.coalesce(F.try_divide((k["c"] - k["d"]).cast("double"), (k["c"] + k["d"]).cast("double")), F.lit(0.0)))
    return F.when(F.size(a) < 2, few).otherwise(value)
