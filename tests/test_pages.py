"""Matches and counted pairs against brute force; large pages."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgauge.operators import matching, ordering, pages

BOXES = pa.list_(pa.list_(pa.float64()))


def box(draw):
    x, y = draw.randint(0, 12), draw.randint(0, 12)
    whole = [float(x), float(y), float(x + draw.randint(-1, 6)), float(y + draw.randint(-1, 6))]
    return draw.choice([whole] * 9 + [[1.0, 2.0], [0.0, 0.0, None, 3.0], None])


def overlap(a, b, clamp):
    if a is None or b is None or len(a) != 4 or len(b) != 4 or None in a or None in b:
        return 0
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda x: max(0, (x[2] - x[0]) * (x[3] - x[1])) if clamp else (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - both
    return both / union if union > 0 else 0


def by_hand(ps, gs, least, strict, policy, clamp):
    used, out = set(), []
    for i, p in enumerate(ps or []):
        good = [(v, j) for j, g in enumerate(gs or []) if (v := overlap(p, g, clamp)) > 0 and (v > least if strict else v >= least) and j not in used]
        if good:
            v, j = min(good, key=lambda x: (-x[0], x[1]) if policy == "best" else x[1])
            used.add(j)
            out.append({"p": i, "g": j, "iou": v})
    return out


@pytest.mark.parametrize("how", [(0.1, False, "best", False), (0.05, True, "best", True), (0.3, False, "first", False)])
def test_greedy_equals_turns_by_hand(how):
    draw = random.Random(str(how))
    for _ in range(150):
        sides = [[draw.choice([None, [], *([box(draw) for _ in range(draw.randint(1, 9))] for _ in range(6))]) for _ in range(6)] for _ in range(2)]
        assert pages.greedy(*(pa.array(s, BOXES) for s in sides), *how).to_pylist() == [by_hand(p, g, *how) for p, g in zip(*sides)]


def test_pairs_are_counted_with_ties_and_nulls():
    draw = random.Random(4)
    for _ in range(200):
        a = [draw.choice([None, [], *([draw.choice([None, *range(6)]) for _ in range(draw.randint(1, 9))] for _ in range(5))]) for _ in range(5)]
        b = [[draw.choice([None, *range(6)]) for _ in range(len(x or []) if draw.random() < 0.8 else draw.randint(0, 9))] for x in a]
        got = pages.pair_counts(pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))).to_pylist()
        for x, y, found in zip(a, b, got):
            x, want = x or [], {"c": 0, "d": 0, "ta": 0, "tb": 0}
            for j in range(min(len(x), len(y))):
                for i in range(j):
                    if None not in (x[i], x[j], y[i], y[j]):
                        s = (x[i] - x[j]) * (y[i] - y[j])
                        want["c"] += s > 0
                        want["d"] += s < 0
            for n, z in (("ta", x), ("tb", y)):
                want[n] = sum(z[i] is not None and z[i] == z[j] for j in range(len(z)) for i in range(j))
            assert found == want


def test_a_page_of_many_blocks(spark):
    """20,000 ranks and 10,000 boxes on a page, in seconds and with the result of definitions."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 20_000).tolist(), rng.integers(0, 9000, 20_000).tolist()
    corner = rng.integers(0, 3000, (10_000, 2)).astype(float)
    truth = np.concatenate([corner, corner + 30], axis=1)
    table = spark.createDataFrame(pa.table({"a": pa.array([a]), "b": pa.array([b]), "p": pa.array([(truth + rng.integers(-5, 6, (10_000, 1))).tolist()]), "g": pa.array([truth.tolist()])}))
    began = time.process_time()
    row = table.select(ordering.kendall_tau_b("a", "b").alias("tau"), ordering.kendall_gamma("a", "b").alias("gamma"), matching.greedy("p", "g").alias("m")).first()
    assert time.process_time() - began < 20
    x, y = np.array(a), np.array(b)
    c = d = 0
    for i in range(1, len(x)):
        s = np.sign(x[:i] - x[i]) * np.sign(y[:i] - y[i])
        c, d = c + int((s > 0).sum()), d + int((s < 0).sum())
    ties = lambda z: int((np.bincount(z) * (np.bincount(z) - 1) // 2).sum())
    n = len(x) * (len(x) - 1) // 2
    assert row.tau == pytest.approx((c - d) / ((n - ties(x)) * (n - ties(y))) ** 0.5) and row.gamma == pytest.approx((c - d) / (c + d))
    assert len(row.m) > 9000 and len({m.g for m in row.m}) == len(row.m) and min(m.iou for m in row.m) >= 0.1


def test_overlapping_pairs_only(spark):
    table = spark.createDataFrame([(1, [[0.0, 0.0, 2.0, 2.0], [5.0, 5.0, 6.0, 6.0]], [[1.0, 1.0, 3.0, 3.0], [0.0, 0.0, 2.0, 2.0]]), (2, None, [[0.0, 0.0, 1.0, 1.0]]), (3, [], [])], "k int, p array<array<double>>, g array<array<double>>")
    got = {r.k: [(m.p, m.g, round(m.iou, 6)) for m in r.m] for r in table.select("k", matching.overlapping("p", "g").alias("m")).collect()}
    assert got == {1: [(0, 0, round(1 / 7, 6)), (0, 1, 1.0)], 2: [], 3: []}
    assert table.select(F.explode(matching.greedy("p", "g")).alias("m")).count() == 1
