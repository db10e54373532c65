"""Byte-level BPE against the library, and decoding against Python's own."""

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgauge.llm import merges, queries
from docgauge.llm.tokens import tokenizer_path
from test_operators import SCHEMA, rows

PATH = tokenizer_path(merges.VOCABULARY)
RANKS = merges.ranks_of(PATH)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("states,pairs", [(merges.MOST_STATES, merges.MOST_PAIRS), (40, 30)])
def test_transducer_equals_merging(library, states, pairs):
    made, draw, pieces = merges.Transducer(RANKS, states, pairs), random.Random(states), list(RANKS)
    for k in range(4000):
        piece = b"".join(draw.choices(pieces, k=draw.randint(1, 6))) if k % 2 else bytes(draw.choices(b"abcest in\n\xc3\xa9", k=draw.randint(1, 60)))
        want = library._core_bpe.encode_single_piece(piece)
        assert made.encode(piece) == want
        assert made.encode(piece, window=max(map(len, pieces)) * 2 + 2) == want


def test_tokens_leave_while_the_input_goes_on(library):
    made = merges.Transducer(RANKS)
    for piece in (b"a" * 200_000, b"ab" * 70_000, " é".encode() * 50_000):
        assert made.encode(piece) == library._core_bpe.encode_single_piece(piece)
    assert len(made.last) < 5_000


def test_every_token_and_a_vocabulary_without_merges():
    made = merges.Transducer(RANKS)
    assert all(made.encode(b) == [t] for b, t in RANKS.items())
    bare = merges.Transducer({bytes([b]): b for b in range(256)})
    assert bare.encode(b"abc") == [97, 98, 99]
    # "abc" has no merge that leads to it from "ab": the library takes a whole match as its token, but never merges to it
    odd = merges.Transducer({**{bytes([b]): b for b in range(256)}, b"bc": 256, b"ab": 257, b"cd": 258, b"abcd": 259})
    assert odd.encode(b"abcd") == [259] and odd.encode(b"abcde")[-1] == 101
    with pytest.raises(ValueError):
        merges.Transducer({b"a": 0})


def test_vocabularies_out_of_order():
    """Ranks that don't rise along the merges: neighbours still decide."""
    import tiktoken

    draw = random.Random(9)
    for _ in range(60):
        words = {bytes([b]) for b in range(256)} | {bytes(draw.choices(b"abc", k=draw.randint(2, 4))) for _ in range(12)}
        more = sorted(w for w in words if len(w) > 1)
        draw.shuffle(more)
        ranks = {**{bytes([b]): b for b in range(256)}, **{w: 256 + k for k, w in enumerate(more)}}
        made, lib = merges.Transducer(ranks), tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(60):
            piece = bytes(draw.choices(b"abcd", k=draw.randint(1, 20)))
            assert made.encode(piece) == lib._core_bpe.encode_single_piece(piece), (piece, more)


def test_encoder_equals_the_library(library):
    encoder = merges.Encoder(PATH, most=200)
    words = st.sampled_from(["the", "Fox,", "it's", "IT'S", "don’t", "é", "é", "\xa0", "  ", "\n", "\t ", "\x1c", "İ", "中文", "42", "...", "<|endoftext|>", " a-b", "　", "​", "\x85", "", "🙂"])

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(st.lists(words, max_size=14).map("".join), st.lists(words, max_size=14).map(" ".join), st.text(max_size=25)), min_size=1, max_size=5))
    def check(texts):
        ids, at = encoder.encode(pa.array([*texts, None]))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t), t
        assert at[-1] == at[-2]

    check()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=12).map(str.encode), st.binary(max_size=12), st.lists(st.sampled_from([b"\xe0\x80", b"\xf0\x9f", b"\x99\x82", b"\xed\xa0", b"a", b"\xc3", b"\xa9"]), max_size=6).map(b"".join)), st.integers(1, 4))
def test_utf8_comes_out_whole(data, step):
    stream, out = merges.Utf8Stream(), []
    for i in range(0, len(data), step):
        out.append(stream.feed(data[i : i + step]))
        assert len(stream.held) < 4
    assert "".join([*out, stream.finish()]) == data.decode("utf-8", "replace")


def more_rows():
    return [*rows(), (30, "word" * 200_000 + " " * 50_000 + "é\n" * 30_000, "en", "a", 1, 1, "t", None)]


def test_query_equals_brute_force(spark, library, tmp_path):
    spark.createDataFrame(more_rows(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = queries.op13_byte_bpe(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    want = []
    for d, t, *_ in more_rows():
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_there_and_back(spark):
    docs = spark.createDataFrame(more_rows(), SCHEMA).toDF("doc_id", "text", "ids", "n_tokens", "ids_sha256", "x", "y", "z")
    ids = merges.encode(docs)
    back = merges.decode(ids)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((r.doc_id, r.text or "")) for r in docs.select("doc_id", "text").collect())
    half = spark.createDataFrame([(1, RANKS[b"\xc3"]), (2, RANKS[b"a"])], "doc_id long, id int").select("doc_id", F.array("id").alias("ids"))
    assert sorted((r.doc_id, r.text) for r in merges.decode(half).collect()) == [(1, "�"), (2, "a")]
    assert merges.encode(docs.limit(0)).count() == 0 and merges.decode(ids.limit(0)).count() == 0
