"""Rows at places of groups' orders against sorting in Python: heavy ties, one hot group, brackets of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from docgauge.operators import places, prep

PICKS = {"best": (lambda n: 0, 0), "worst": (lambda n: n - 1, 1), "median": (lambda n: n // 2, 2), "lower": (lambda n: n // 4, 5), "upper": (lambda n: 3 * n // 4, 5)}


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = []
    for g, own in groups.items():
        own.sort(key=lambda r: (1.0 if r[1] is None else r[1], r[2]))
        out += [(g, own[at(len(own))][2], pick) for pick, (at, least) in PICKS.items() if len(own) > least]
    return sorted(map(repr, out))


def table(spread, n=3000):
    draw = random.Random(spread)
    groups = ["hot"] * 20 + ["a", "b", None, *range(6)]
    value = {"ties": lambda: draw.choice([0.5, 0.5, 0.5, 1.5, None]), "one": lambda: 2.0, "wide": lambda: draw.expovariate(1) ** 9 - draw.random(), "outlier": lambda: draw.choice([1e300, 1.0 + draw.random() * 1e-9, -1e300])}[spread]
    seqs = list(range(n))
    draw.shuffle(seqs)
    return [(None if (g := draw.choice(groups)) is None else str(g), value(), s) for s in seqs]


@pytest.mark.parametrize("spread,ranked", [("ties", 400), ("one", 100), ("wide", 60), ("outlier", 300), ("wide", places.RANKED)])
def test_picks(spark, spread, ranked):
    rows = table(spread)
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "source string, cer double, seq long, place string, held int").repartition(4)
    got = prep.representative(df, "cer", "seq", ["source"], ranked)
    assert got.columns == [*df.columns, "pick"]
    assert sorted(repr((r.source, r.seq, r.pick)) for r in got.collect()) == brute(rows)


def test_whole_table_few_rows_and_none(spark):
    rows = [("x", float(i % 3), i) for i in range(50)]
    df = spark.createDataFrame(rows, "source string, cer double, seq long")
    assert sorted(repr(("x", r.seq, r.pick)) for r in prep.representative(df, "cer", "seq", None, 5).collect()) == brute(rows)
    assert [r.pick for r in prep.representative(df.limit(1), "cer", "seq").collect()] == ["best"]
    assert prep.representative(df.limit(0), "cer", "seq").count() == 0
    named = df.withColumn("seq", F.concat(F.lit("s"), F.lpad(F.col("seq").cast("string"), 3, "0")))
    assert sorted(repr(("x", int(r.seq[1:]), r.pick)) for r in prep.representative(named, "cer", "seq", ["source"], 5).collect()) == brute(rows)


def test_plan_has_no_window_over_rows(spark):
    df = spark.createDataFrame(table("wide", 300), "source string, cer double, seq long")
    plan = prep.representative(df, "cer", "seq", ["source"])._jdf.queryExecution().optimizedPlan().toString()
    # every window stands above an aggregate that counts values
    assert "Window" in plan and all("Aggregate" in part for part in plan.split("Window [")[1:])


def test_cut_points_beyond_doubles(spark):
    """Long values that fall together as doubles are still told apart."""
    base = 1 << 60
    df = spark.createDataFrame([(base + k, k % 7) for k in range(31)], "big long, small long").repartition(3)
    got = prep.cut_points(df, "big", "small").first()
    assert (got.big_low, got.big_high) == (base + 10, base + 20) and (got.small_low, got.small_high) == (sorted(k % 7 for k in range(31))[10], sorted(k % 7 for k in range(31))[20])
