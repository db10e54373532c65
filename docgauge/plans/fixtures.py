"""Tables derived from the test tables by the same whole-number arithmetic in Spark and SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: pairs of characters that a task compares, about: some 20 seconds where all are compared.
PAIRS = 1 << 31


def spread(df: DataFrame, pairs: Column | None = None) -> DataFrame:
    """`df` over all cores if its scan has fewer splits, before work that takes far more time a row than moving it; larger scans stay as they are.

    With `pairs`, a row's pairs to compare, the rows are dealt out over as many partitions as have about PAIRS each: a
    larger table has more tasks, not longer ones.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if pairs is not None:
        total = df.agg(F.sum(pairs)).first()[0] or 0
        return df.repartition(max(n, math.ceil(total / PAIRS)))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def squared(text: str) -> Column:
    """Pairs of characters of a text and one of its length."""
    return F.length(text).cast("double") ** 2


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, b (its index), l_partkey, l_suppkey, gt box; dx, dy; pred box or null, as xywh where the part's number is a multiple of 7."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    d = lambda x: x.cast("double")
    df = table(spark, sf_dir, "lineitem").withColumn("b", F.row_number().over(w) - 1).select(F.col("l_orderkey").alias("page"), "b", "l_partkey", "l_suppkey")
    x, y, wide = F.col("l_suppkey") % 50, F.col("b") * 20, 200 + F.col("l_partkey") % 100
    dx, dy = F.col("l_partkey") % 17 - 8, F.col("l_suppkey") % 25 - 12
    gt = F.array(d(x), d(y), d(x + wide), d(y + 30))
    moved = F.when(F.col("l_partkey") % 7 == 0, F.array(d(x + dx), d(y + dy), d(wide), F.lit(30.0))).otherwise(F.array(d(x + dx), d(y + dy), d(x + wide + dx), d(y + 30 + dy)))
    return df.select("page", "b", "l_partkey", "l_suppkey", gt.alias("gt"), F.when(F.col("l_partkey") % 11 != 0, moved).alias("pred"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page: arrays of boxes in order of b, without missing predictions, and of keys."""
    rows = F.array_sort(F.collect_list(F.struct("b", "gt", "pred", "l_partkey", "l_suppkey")))
    df = blocks(spark, sf_dir).groupBy("page").agg(rows.alias("r"))
    return df.select("page", F.transform("r", lambda r: r["gt"]).alias("gt"), F.transform(F.filter("r", lambda r: r["pred"].isNotNull()), lambda r: r["pred"]).alias("pred"), F.col("r").alias("rows"))


TYPES = ("capitalization", "spelling", "grammar", "punctuation", "structural", "unknown")

#: SQL for the same: blk, then gt and pr (pr.i: index among the page's predictions; corners c1..c4 by the automatic rule).
SQL = """blk AS (
  SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS b, l_partkey, l_suppkey FROM lineitem),
gt AS (SELECT page, b AS g, l_partkey, l_suppkey, CAST(l_suppkey % 50 AS DOUBLE) AS g1, CAST(20 * b AS DOUBLE) AS g2, CAST(l_suppkey % 50 + 200 + l_partkey % 100 AS DOUBLE) AS g3, CAST(20 * b + 30 AS DOUBLE) AS g4 FROM blk),
raw AS (
  SELECT page, b, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY page ORDER BY b) - 1 AS INTEGER) AS i,
         CAST(l_suppkey % 50 + l_partkey % 17 - 8 AS DOUBLE) AS r1, CAST(20 * b + l_suppkey % 25 - 12 AS DOUBLE) AS r2,
         CAST(CASE WHEN l_partkey % 7 = 0 THEN 200 + l_partkey % 100 ELSE l_suppkey % 50 + 200 + l_partkey % 100 + l_partkey % 17 - 8 END AS DOUBLE) AS r3,
         CAST(CASE WHEN l_partkey % 7 = 0 THEN 30 ELSE 20 * b + 30 + l_suppkey % 25 - 12 END AS DOUBLE) AS r4
  FROM blk WHERE l_partkey % 11 <> 0),
pr AS (SELECT page, b, i, l_partkey, l_suppkey, r1 AS c1, r2 AS c2, CASE WHEN r3 < r1 OR r4 < r2 THEN r1 + r3 ELSE r3 END AS c3, CASE WHEN r3 < r1 OR r4 < r2 THEN r2 + r4 ELSE r4 END AS c4 FROM raw)"""


def iou_sql(a: str, b: str, x: str = "c", y: str = "g") -> str:
    """IoU of {a}.{x}1..4 and {b}.{y}1..4."""
    p, q = [f"{a}.{x}{k}" for k in (1, 2, 3, 4)], [f"{b}.{y}{k}" for k in (1, 2, 3, 4)]
    inter = f"(greatest(0.0::DOUBLE, least({p[2]}, {q[2]}) - greatest({p[0]}, {q[0]})) * greatest(0.0::DOUBLE, least({p[3]}, {q[3]}) - greatest({p[1]}, {q[1]})))"
    union = f"(({p[2]} - {p[0]}) * ({p[3]} - {p[1]}) + ({q[2]} - {q[0]}) * ({q[3]} - {q[1]}) - {inter})"
    return f"CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0::DOUBLE END"


def greedy_sql(preds: str, truths: str, test: str, order: str = "iou DESC, g", raw: bool = False) -> str:
    """CTEs cand, np, st and m: the sequential match of {preds}(page, i, c1..c4) with {truths}(page, g, g1..g4)."""
    return f"""cand AS (SELECT * FROM (SELECT p.page, p.i, t.g, {iou_sql('p', 't')} AS iou FROM {preds} p JOIN {truths} t ON p.page = t.page) x WHERE iou > 0 AND {test}),
np AS (SELECT page, max(i) AS last FROM {preds} GROUP BY page),
st AS (
  SELECT page, -1 AS i, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS g, CAST(NULL AS DOUBLE) AS iou FROM np
  UNION ALL
  SELECT s.page, s.i + 1, CASE WHEN c.g IS NULL THEN s.used ELSE list_append(s.used, c.g) END, c.g, c.iou
  FROM st s JOIN np ON np.page = s.page AND s.i < np.last
  LEFT JOIN LATERAL (SELECT c0.g, c0.iou FROM cand c0 WHERE c0.page = s.page AND c0.i = s.i + 1 AND NOT list_contains(s.used, c0.g) ORDER BY {order} LIMIT 1) c ON true),
m AS (SELECT page, i, g, iou FROM st WHERE g IS NOT NULL)"""
