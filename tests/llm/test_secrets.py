"""The field of secrets: what it must leave alone, what it must find, and very long texts."""

import random
import string
import time

import duckdb
import pytest

from docgauge.llm import ordinary, secrets

LEFT_ALONE = ["https://example.com/2024/03/15/story", "https://example.com/articles/2024/03/15/how-to-bake-bread?id=12345", "ISBN-978-3-16-148410-0", "/usr/lib/python3.13/site-packages/numpy"]
LEFT_ALONE += ["DE89370400440532013000", "+1-555-010-99-88-77", "123e4567-e89b-12d3-a456-426614174000", "numpy-2.1.3-cp313-cp313-manylinux_2_17_x86_64.whl", "IMG_20240315_123456.jpg", "2024-03-15T12:34:56.789Z"]
LEFT_ALONE += ["jane.doe42@mail.example.org", "ip-10-0-12-7.eu-west-1.compute.internal", "HttpRequestHandlerFactory2", "10.1000/science.2024.123456", "4111111111111111", "ORD-20240315-00042", "max_number_of_retries_3", "3.141592653589793238"]
_B62 = string.ascii_letters + string.digits


def drawn(draw):
    some = lambda n, of=_B62: "".join(draw.choices(of, k=n))
    return {"plain": some(24), "ghp": "ghp_" + some(36), "sk": "sk-" + some(48), "base64": some(43, _B62 + "+/") + "=", "hex": some(30, "0123456789abcdef"), "slack": f"xoxb-{some(12, string.digits)}-{some(24)}", "glpat": "glpat-" + some(20), "jwt": f"eyJ{some(30)}.{some(60)}.{some(43)}", "lower": some(24, string.ascii_lowercase + string.digits)}


@pytest.fixture(scope="module")
def texts():
    got = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id LIMIT 3620").fetchall()]
    return got[:3500], [" ".join(t.split(" ")[:200]) for t in got[3500:]]


def fitted(texts, kinds=tuple(ordinary.KINDS)):
    some = [t for k, t in enumerate(texts) if secrets.base_spans(t) or k % 8 == 0]
    return secrets.Tagger(secrets.fit(sorted({(tuple(a), tuple(b), tuple(c)) for t in some for a, b, c in secrets.windows(t, kinds)})))


def share(tagger, texts, make, n=100):
    """Of n texts with make(k) in them, how many have a span of the field that meets it."""
    draw, hit = random.Random(7), 0
    for k, t in enumerate(texts[:n]):
        words, x = t.split(" "), make(k)
        at = draw.randrange(len(words) + 1)
        a = len("".join(w + " " for w in words[:at]))
        hit += any(s < a + len(x) and a < e for s, e in tagger.spans([" ".join([*words[:at], x, *words[at:]])])[0])
    return hit / n


def test_precision_and_recall_by_kind(texts):
    tagger, draw = fitted(texts[0]), random.Random(3)
    for token in LEFT_ALONE:
        assert share(tagger, texts[1], lambda _: token) <= 0.01, token
    # drawn tokens: the 1 % aimed at holds over all kinds; identifiers and versions with long joined words come near 2 %
    marked = {kind: share(tagger, texts[1], lambda _: ordinary.ordinary(draw, (kind,))) for kind in ordinary.KINDS}
    assert max(marked.values()) <= 0.05 and sum(marked.values()) <= 0.01 * len(marked), marked
    assert sum(kind == 3 for found in tagger.all_spans(texts[1]) for _, kind, _ in found) <= 2
    found = {kind: share(tagger, texts[1], lambda _: drawn(draw)[kind]) for kind in drawn(draw)}
    assert min(found.values()) >= 0.8 and sum(found.values()) >= 0.93 * len(found), found


def test_kinds_that_were_never_drawn(texts):
    out = ("address", "path", "account", "uuid")
    tagger, draw = fitted(texts[0], tuple(k for k in ordinary.KINDS if k not in out)), random.Random(4)
    for kind in out:
        # measured: one UUID in ten is marked where none was ever drawn; the field that is used has seen them
        assert share(tagger, texts[1], lambda _: ordinary.ordinary(draw, (kind,))) <= (0.2 if kind == "uuid" else 0.05), kind


def test_windows_of_a_text_with_very_many_secrets():
    """A hundred thousand secrets in 8 MB: seconds, as each list is walked once."""
    draw = random.Random(1)
    text = " ".join(f"of the {draw.choice(['password', 'token'])} = {''.join(draw.choices(_B62, k=20))} and so on" for _ in range(100_000))
    began = time.process_time()
    got = secrets.windows(text)
    assert time.process_time() - began < 60 and 0 < len(got) <= secrets.PER_DOC * (1 + 2 * len(secrets.ALPHABETS) + secrets.PER_SECRET) + 1
    assert len(secrets.base_spans(text)) == 100_000


def test_covered_tokens_equal_brute_force():
    draw = random.Random(2)
    for _ in range(300):
        tokens, at = [], 0
        for _ in range(draw.randint(0, 12)):
            at += draw.randint(0, 2)
            n = draw.randint(1, 4)
            tokens.append(("x" * n, at, at + n))
            at += n
        spans = sorted((a, a + draw.randint(1, 9)) for a in (draw.randint(0, 30) for _ in range(draw.randint(0, 5))))
        assert secrets._covered(tokens, spans) == [any(a < y and x < b for x, y in spans) for _, a, b in tokens]
