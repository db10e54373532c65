"""Files of directly addressable codes: documents in any order, and how much of a file is read for them."""

import os

import numpy as np
import pytest

from docgauge.llm import token_files


@pytest.mark.parametrize("top", [200, 50_000, 1 << 22])
def test_documents_in_any_order(tmp_path, top):
    draw = np.random.default_rng(top)
    sizes = np.concatenate([draw.integers(0, 60, 900), [0, 1, 9000], draw.integers(0, 60, 300)])
    ids = draw.integers(0, top, sizes.sum()).astype("<u4")
    ids[draw.random(len(ids)) < 0.5] %= 256
    starts = np.concatenate([[0], np.cumsum(sizes)])
    doc_ids = [None, *range(len(sizes) - 1)]
    uri = str(tmp_path / "a.dac")
    token_files.write_segment(uri, doc_ids, starts, ids)
    size = os.path.getsize(uri)
    for ahead in (0, 64, 1 << 20):
        with token_files.Segment(uri, ahead) as s:
            assert s.doc_ids == doc_ids and s.n == len(ids) and s.starts.tolist() == starts.tolist()
            for i in draw.permutation(len(sizes))[:400].tolist() + [902, 0, len(sizes) - 1]:
                assert s.document(i).tolist() == ids[starts[i] : starts[i + 1]].tolist()
    # one document: its own codes, and a block of bits on each level
    with token_files.Segment(uri, 0) as s:
        opened = s.bytes_read
        for i in (5, 700, 902):
            before = s.bytes_read
            s.document(i)
            assert s.bytes_read - before <= len(s.ranks) * (sizes[i] * 9 // 8 + token_files.BLOCK // 8 + 2)
        assert opened < 12 * 8 + 9 * len(sizes) + 8 * len(sizes) + 2000 + size // 50
    # all in turn: each byte about once
    with token_files.Segment(uri, 4096) as s:
        assert np.concatenate([s.document(i) for i in range(len(sizes))]).tolist() == ids.tolist()
        assert s.bytes_read <= 1.3 * size


def test_damaged_and_empty(tmp_path):
    token_files.write_segment(str(tmp_path / "e.dac"), [7], np.array([0, 0]), np.zeros(0, "<u4"))
    with token_files.Segment(str(tmp_path / "e.dac")) as s:
        assert s.document(0).tolist() == []
    (tmp_path / "x.dac").write_bytes(b"something else")
    with pytest.raises(ValueError):
        token_files.Segment(str(tmp_path / "x.dac"))
