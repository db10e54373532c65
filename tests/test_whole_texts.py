"""Queries over whole tables and whole texts, against brute force: what their SQL doesn't cover."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docgauge.plans import catalogue

WORDS = "elle, the Größe à naïve 北京市 Ελλάδα élevée level 😀 ácute".split()


def line(k, n):
    return " ".join(WORDS[(k * k + i * (k + 3)) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    """The folder of a table of texts with characters beyond ASCII, and its rows."""
    rows = [(k, t, ("user", "assistant")[t], f"{line(k, 5 + 7 * k)}\n{line(t, 3)} ") for k in range(4) for t in range(2)]
    rows += [(9, 0, "user", "plain level"), (9, 1, "user", ""), (9, 2, "assistant", " \u2003 "), (9, 3, "system", "é")]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j + 1] + 1, row[j] + 1)
    return row[-1]


def rate(pred, gt):
    return distance(pred, gt) / len(gt) if gt else float(bool(pred))


def noisy(text):
    return text.translate(str.maketrans("el", "c1"))


def plain(text):
    return re.sub(r"\s+", " ", text).strip()


def test_character_rates_of_any_text(spark, conversations):
    d, rows = conversations
    got = {(r.conv_id, r.turn): r.cer for r in catalogue.QUERIES["cer_by_turn"](spark, d).collect()}
    assert got == {(c, t): pytest.approx(rate(noisy(x), x), abs=1e-6) for c, t, _, x in rows}
    by_role = {}
    for _, _, role, x in rows:
        by_role.setdefault(role, []).append(rate(noisy(plain(x)), plain(x)))
    found = {r.role: (r.mean_cer, r.n) for r in catalogue.QUERIES["cer_normalized"](spark, d).collect()}
    assert found == {k: (pytest.approx(sum(v) / len(v), abs=1e-6), len(v)) for k, v in by_role.items()}


def test_word_rates_of_any_text(spark, conversations):
    d, rows = conversations
    got = {(r.conv_id, r.turn): r.wer for r in catalogue.QUERIES["wer_normalized"](spark, d).collect()}
    assert got == {(c, t): pytest.approx(rate(noisy(x).split(), x.split()), abs=1e-6) for c, t, _, x in rows}


def test_word_rates_of_long_texts(spark, tmp_path):
    rows = [(k, 0, "user", " ".join(["go up"] * 20 + [line(k, n)] + [f"w{i}" for i in range(n)])) for k, n in enumerate((1, 150, 400))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.wer for r in catalogue.QUERIES["wer_normalized"](spark, str(tmp_path)).collect()}
    assert got == {c: pytest.approx(rate(noisy(x).split(), x.split()), abs=1e-6) for c, _, _, x in rows}
    assert min(got.values()) > 0  # the first 40 words have no error


def test_signatures_of_whole_texts(spark, tmp_path):
    texts = ["a", "one two", "characters many more words", "Hello there, this is long", "my dear", "incomprehensible of course", "two", "thanks for Name: Bo", "bye"]
    rows = [(c, t, "user", texts[(c + t) % len(texts)]) for c in range(9) for t in range(3 + c % 4)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    last = {c: max(t for d, t, *_ in rows if d == c) for c, *_ in rows}
    want = set()
    for c, t, _, x in rows:
        x = f"Name: {x}" if t % 2 == 0 else x
        if not (t == last[c] and "Name:" in x or len(x.split()) <= 2 and t * 900 > 0.85 * 3542):
            want.add((c, t))
    assert {tuple(r) for r in catalogue.QUERIES["signature_filter"](spark, str(tmp_path)).collect()} == want


def test_distance_is_exact(spark):
    from docgauge.functions import text as T

    rng = random.Random(5)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    rows = [("", ""), ("a", ""), ("", "a"), (None, "a"), ("a", None), ("abc", "bca"), ("aab", "abb"), ("ab", "ba")]
    for letters in ("ab", "abcdefgh", "aé一\U0001f600 "):
        for _ in range(150):
            a = word(letters, 12)
            rows += [(a, word(letters, 12)), (a, "".join(rng.choice(letters) for _ in a)), (a, a.replace("a", "x"))]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(~T.distance("a", "b").eqNullSafe(F.levenshtein("a", "b"))).count() == 0


@pytest.mark.parametrize("name,tasks", [("cer_by_turn", 23), ("cer_normalized", 23), ("wer_normalized", 6)])
def test_larger_tables_have_more_tasks(spark, sf, name, tasks, monkeypatch):
    """The pairs of characters that a task compares are bounded, whatever the table's splits."""
    from docgauge.plans import fixtures

    texts = fixtures.table(spark, sf, "conversations")
    total = texts.agg(F.sum(F.length("text").cast("double") ** 2)).first()[0]
    monkeypatch.setattr(fixtures, "PAIRS", total / 23, raising=False)
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert [int(n) for n in re.findall(r"Repartition (\d+)", plan)] == [tasks]
