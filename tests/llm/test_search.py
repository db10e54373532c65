"""Ranked search against brute force in plain Python and its SQL; block borders against all partitions."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docgauge.llm import queries, search
from test_operators import BASE, SCHEMA, rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = [(1, BASE), (2, "fox AND the Über ünïcödé-zzz"), (2, "quick"), (3, None), (4, ""), (5, " ., "), (6, "neverthere"), (7, "the the the"), (None, "word brown"), (8, "ab1 c2"), (8, "ab1 c2")]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k=10, k1=8, b=90):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total, df = len(held), sum(x for *_, x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        terms, scored = set(TERM.findall(lower(text))), []
        for d, c, size in held:
            m = 100 - b + (b * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + k1 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def drawn(n, seed=5):
    """Documents of a skewed vocabulary, with long ones, ties and repeats."""
    draw = random.Random(seed)
    words = ["the", "and", *(f"w{i}" for i in range(300)), "über", "fox", "ab1", "c2"]
    odds = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(draw.choices(words, odds, k=draw.choice([1, 3, 20, 20, 200]))) + draw.choice(["", ".", " Fox!"]) for _ in range(n)]
    return [(draw.choice([i, i, i, i // 2]), draw.choice([t, t, texts[0]])) for i, t in enumerate(texts)]


def same(frame, want):
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want))


def test_terms():
    texts = ["It's Über-2x", None, "", " .,", "a" * 70_000 + "B", "\x7fé\x00é", "AΣ 中文"]
    for array in (pa.array(texts), pa.array(["gone", *texts]).slice(1), pa.array(texts, pa.large_string())):
        terms, codes, offsets = search.terms_of(array)
        assert [[terms[i].as_py() for i in codes[a:b].tolist()] for a, b in itertools.pairwise(offsets.tolist())] == [TERM.findall(lower(t)) for t in texts]
        assert len(set(terms.to_pylist())) == len(terms)
    assert search.terms_of(pa.array([], pa.string()))[2].tolist() == [0]


def test_block_borders_are_the_best():
    draw = random.Random(2)
    for _ in range(60):
        lists = [[draw.randint(1, 9) for _ in range(draw.randint(1, 9))] for _ in range(draw.randint(1, 5))]
        held = [sorted(draw.sample(range(30), len(y))) for y in lists]
        longest, price = draw.randint(1, 5), draw.choice([0.3, 1.0, 4.0])
        offsets = np.cumsum([0, *map(len, lists)])
        starts = search.block_starts(np.array([x for y in lists for x in y]), offsets, np.array([d for h in held for d in h]), longest, price)
        for y, h, a, b in zip(lists, held, offsets, offsets[1:]):
            own, each = sorted(s - a for s in starts if a <= s < b), price * sum(y) / len(y)
            cost = lambda cuts: sum(each + max(y[i:j]) * (h[j - 1] + 1 - h[i]) for i, j in itertools.pairwise([*cuts, len(y)]))
            fits = lambda cuts: all(j - i <= longest for i, j in itertools.pairwise([*cuts, len(y)]))
            assert own[0] == 0 and fits(own)
            assert cost(own) == pytest.approx(min(cost([0, *c]) for n in range(len(y)) for c in itertools.combinations(range(1, len(y)), n) if fits([0, *c])))


def test_skipping_leaves_the_result_alone():
    """One shard, k smaller than the number of documents: much is never opened, the best are the same."""
    draw, n = np.random.default_rng(3), 20_000
    docs = [np.sort(draw.choice(n, size, replace=False)) for size in (15_000, 4_000, 300, 12, 1)]
    offsets = np.cumsum([0, *map(len, docs)])
    impact = (np.linspace(9, 1, n)[np.concatenate(docs)] * draw.integers(90, 110, offsets[-1])).astype(np.int64)
    shard = search.Shard(np.arange(5), offsets, np.concatenate(docs), impact, draw.permutation(n))
    weights = np.array([1, 3, 90, 400, 700])
    numbers, scores = shard.best(np.arange(5), weights, 10)
    total = np.zeros(n, np.int64)
    np.add.at(total, np.concatenate(docs), impact * np.repeat(weights, np.diff(offsets)))
    best = np.lexsort((shard.order, -total))[:10]
    assert numbers.tolist() == best.tolist() and scores.tolist() == total[best].tolist()
    assert shard.opened < shard.asked / 4


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    docs = [(r[0], r[1]) for r in rows()] + drawn(150)
    spark.createDataFrame([(d, t, None, "a", 1, k, "t", None) for k, (d, t) in enumerate(docs)], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op11_ranked_search(spark, str(tmp_path))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    same(got, brute(docs, ITEMS))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    same(got, [tuple(None if x is None or x != x else x for x in r) for r in con.execute(search.SQL).fetchall()])


def test_shards_and_blocks_of_items(spark):
    """Many small shards, a block of items for every few terms, other constants, clashing names."""
    docs = drawn(400, 8)
    table = spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in docs], "doc_id long, text string, shard int, rank int, term string, score int").repartition(2)
    items = spark.createDataFrame([(i, t, 7) for i, t in ITEMS], "item_id long, text string, block int")
    index = search.build_index(table, shard_bytes=2000)
    assert index.where("term IS NULL").count() > 4
    same(search.search(index, items, k=3, k1=12, b=40, terms=4), brute(docs, ITEMS, 3, 12, 40))


def test_empty_tables(spark):
    docs = spark.createDataFrame(drawn(5), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked_search(docs.limit(0), items).count() == 0
    assert search.ranked_search(docs, items.limit(0)).count() == 0
    assert search.ranked_search(docs.withColumn("text", docs.text.substr(1, 0)), items).count() == 0
