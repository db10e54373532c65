"""Fill-in-middle against regular expressions, its SQL and the exact way back."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgauge.llm import infilling, queries
from test_operators import SCHEMA, rows

UNITS = {"chars": "(?s).", "words": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "lines": "(?s)[^\n]*\n|[^\n]+"}
MORE = [(20, "holds <S> itself"), (21, "<P"), (22, "<<PP>>"), (23, "a\n\nb\r\n"), (24, "é" * 50_000 + "\n" + "w " * 50_000), *((k, "one two\nthree ü 中 4") for k in range(100, 160))]


@pytest.mark.parametrize("unit", UNITS)
def test_places_follow_from_sparse_events(unit):
    scanner = infilling.Scanner(unit)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(["a", "é", " ", "\n", "\t", "<P>", "<", "S>", "中", "bc", "\x00", " "]), max_size=15).map("".join))
    def check(text):
        units = re.findall(UNITS[unit], text)
        events = scanner.events(text)
        assert events.units == len(units) and events.sentinel == any(s in text for s in infilling.SENTINELS)
        assert [events.place(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
        for doc_id in (1, 2, 3):
            out = infilling.infill(text, doc_id, scanner)
            assert infilling.restored(out.output, out.form) == text

    check()


def test_events_are_sparse():
    text = "x" * 100_000
    assert len(infilling.Scanner("chars").events(text + "<P>" + text).at) == 2
    assert len(infilling.Scanner("words").events(text + " " + text).at) == 3


def test_sentinels_must_not_overlap():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("xy", "yz", "<M>")):
        with pytest.raises(ValueError):
            infilling.Scanner("chars", bad)


def brute(doc_id, text):
    """By the contract's words."""
    text = text or ""
    n, digits = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", a, b - a, sha(out), sha(text)


def table(spark):
    return spark.createDataFrame([*rows(), *((k, t, None, "a", len(t), 0, "t", None) for k, t in MORE)], SCHEMA)


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    docs = table(spark).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_fill_in_middle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    found = sorted(map(repr, map(tuple, got.collect())))
    assert found == sorted(repr((d, *brute(d, t))) for d, t in docs.select("doc_id", "text").collect())
    assert len({r.form for r in got.collect()}) == 3
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = [tuple(None if x != x else x for x in r) for r in con.execute(infilling.SQL).fetchall()]
    assert found == sorted(map(repr, want))


def test_parts_words_and_clashing_names(spark):
    docs = table(spark).toDF("doc_id", "text", "form", "prefix", "n", "output", "middle", "suffix")
    for r in infilling.fill_in_middle(docs, "words", ("[a]", "[b]", "[c]"), rate=100, spm_rate=50, seed=7).collect():
        if r.form == "plain":
            assert r.prefix is None and not r.output or any(s in r.output for s in ("[a]", "[b]", "[c]"))
        else:
            whole = r.prefix + r.middle + r.suffix
            assert r.n == len(re.findall(UNITS["words"], whole)) and infilling.restored(r.output, r.form, ("[a]", "[b]", "[c]")) == whole
            for part in (r.prefix, r.prefix + r.middle):  # cuts fall between units
                assert not part or not r.suffix or part == whole or (part[-1] in infilling.WHITE) != (whole[len(part)] in infilling.WHITE)
    assert infilling.fill_in_middle(docs.limit(0)).count() == 0
