"""The pipeline's stages on a small table, each against what it should keep."""

import corpus_pipeline

from test_operators import SCHEMA, brute_components, rows


def test_stages(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = docs.collect()
        assert docs.columns == columns or name == "packing"
    texts = lambda n: {r.doc_id: r.text for r in seen[n]}
    assert not {4, 5, 6, 13} & set(texts("language")) and {1, 2, 3, 11, 12} <= set(texts("language"))
    left = [(r.doc_id, r.text) for r in seen["language"]]
    assert set(texts("near_duplicates")) - {None} == {d for d, (_, c) in brute_components(left, 5, 80).items() if c == d}
    assert "[SECRET]" in texts("secrets")[11] and "abcd12345678" not in texts("secrets")[11] and texts("secrets")[1] == texts("near_duplicates")[1]
    assert set(texts("mixing")) <= set(texts("secrets"))
    assert len({(r.sequence_id, r.offset) for r in seen["packing"]}) == len(seen["packing"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    """Further columns under names that stages use inside, a text of 100,000 words with thousands of secrets, repeated and null ids."""
    names = ("words", "epochs", "mix_key", "mix_bucket", "copy", "part", "key", "shingles", "component_id", "block", "spans", "lang_pred", "score_", "size")
    secret = "of the password = Zk3xQ9wLm2Vt8Rb5Yn7Hs4 and so on "
    long = " ".join(f"w{k % 977}" for k in range(60_000)) + " " + secret * 4000 + "ende"
    kinds = ("many words of the one kind that stand here", "the quick brown fox jumps over the lazy dog again", "le chat de la maison est sur la table avec un livre")
    own = [(k, f"{kinds[k % 3]} {k} {k * 7} {k * 13}", ("en", "en", "fr")[k % 3], f"s{k % 2}") for k in range(30)]
    own += [(30, long, "en", "s0"), (31, None, "en", "s0"), (32, " ", None, None), (None, "without an id but with words", "en", "s1"), (5, "the same id twice and other words", "en", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *range(len(names))) for r in own], schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns and all([r[n] for n in names] == list(range(len(names))) for r in seen[name])
    # language: null texts and those without a letter go, and nothing else
    key = lambda r: (r.doc_id is None, r.doc_id, r.text)
    assert sorted(map(key, seen["language"])) == sorted((d is None, d, t) for d, t, *_ in own if t and t.strip())
    # secrets: every one of the long text
    kept = next(r for r in seen["secrets"] if r.doc_id == 30)
    assert "Zk3xQ9wLm2" not in kept.text and kept.text.count("[SECRET]") >= 4000 and kept.n_chars == len(kept.text) and kept.text.startswith(long[:200_000])
    # mixing: a source's documents as often as planned, whole, and no others
    before = {key(r) for r in seen["secrets"]}
    assert {key(r) for r in seen["mixing"]} <= before
    size = lambda rows, s: sum(len(r.text.split()) for r in rows if r.source == s)
    total = sum(size(seen["secrets"], s) for s in ("s0", "s1", None))
    assert sum(size(seen["mixing"], s) for s in ("s0", "s1", None)) <= 2 * total
    # packing: the pieces of each document are its ids, cut at 2048, and no sequence is overfull or has a gap
    from test_operators import crc, ids_of

    want = []
    for r in seen["mixing"]:
        x = ids_of("byte_bpe_50k.json", r.text, 0)
        first = len(x) - (-(-len(x) // 2048) - 1) * 2048
        at = [0, *range(first, len(x), 2048)]
        want += [(repr(r.doc_id), k, a, (b - a), crc(x[a:b])) for k, (a, b) in enumerate(zip(at, [*at[1:], len(x)]))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in seen["packing"]) == sorted(want)
    ends = {}
    for r in sorted(seen["packing"], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
