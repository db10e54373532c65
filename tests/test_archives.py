"""Archives as rows, documents of any number of images, overlays."""

import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgauge.sources import archives, images, overlays, readers, sinks

FILES = {f"dir/{k}.xml": bytes([k]) * (k * 700) for k in range(12)} | {"long/" + "n" * 180 + ".xml": b"long name", "empty": b""}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    with zipfile.ZipFile(at / "a.zip", "w") as z:
        z.mkdir("dir")
        for k, (n, c) in enumerate(FILES.items()):
            z.writestr(n, c, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    for name, mode in (("b.tar", "w"), ("c.tar.gz", "w:gz")):
        with tarfile.open(at / name, mode) as t:
            for n, c in FILES.items():
                info = tarfile.TarInfo(n)
                info.size = len(c)
                t.addfile(info, io.BytesIO(c))
    (at / "readme.txt").write_text("no archive")
    return at


@pytest.mark.parametrize("run", [1, 3000, archives.RUN])
def test_members_across_runs(spark, folder, run):
    df = archives.members(spark, str(folder), run)
    assert df.rdd.getNumPartitions() == {1: 27, 3000: df.rdd.getNumPartitions(), archives.RUN: 3}[run]
    got = df.collect()
    for name in ("a.zip", "b.tar", "c.tar.gz"):
        own = {r.member: bytes(r.content) for r in got if r.archive.endswith(name)}
        assert own == FILES
    assert len(got) == 3 * len(FILES) and all(r.error is None and r.size == len(r.content) for r in got)
    assert archives.members(spark, str(folder / "b.tar")).count() == len(FILES)


def test_damaged_members(spark, folder, tmp_path):
    raw = bytearray((folder / "a.zip").read_bytes())
    at = raw.index(b"\x04" * 2000)
    raw[at] = 9  # a stored member's byte
    (tmp_path / "a.zip").write_bytes(raw)
    (tmp_path / "b.tar").write_bytes((folder / "b.tar").read_bytes()[: 20 * 512])
    (tmp_path / "c.tgz").write_bytes((folder / "c.tar.gz").read_bytes()[:150])
    (tmp_path / "d.zip").write_bytes(b"nothing")
    got = archives.members(spark, str(tmp_path)).collect()
    a = {r.member: r for r in got if r.archive.endswith("a.zip")}
    assert len(a) == len(FILES) and [n for n, r in a.items() if r.error] == ["dir/4.xml"] and a["dir/4.xml"].content is None
    assert any(r.error for r in got if r.archive.endswith("b.tar")) and any(r.error for r in got if r.archive.endswith("c.tgz"))
    assert [(r.member, r.content) for r in got if r.archive.endswith("d.zip")] == [(None, None)]
    (tmp_path / "none").mkdir()
    assert archives.members(spark, str(tmp_path / "none")).count() == 0


def test_documents_of_any_size(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "c 1").otherwise("d/2").alias("candidate"), F.concat(F.lit('a"'), F.lpad(F.col("id").cast("string"), 5, "0")).alias("image"), (F.col("id") / 4).alias("iou"), F.lit(None).cast("string").alias("note"))
    summary = spark.createDataFrame([("c 1", 2, None), ("d/2", 1, "x"), ("none", 0, None)], "candidate string, n int, why string")
    for as_map in (False, True):
        done = sinks.save_documents(summary, rows.repartition(5), str(tmp_path / f"out{as_map}"), as_map=as_map).collect()
        assert {r.candidate: r.n for r in done} == {"c 1": 2000, "d/2": 1000, "none": 0}
        for r in done:
            doc = json.loads(open(r.path).read())
            ids = [k for k in range(3000) if r.candidate == ("c 1" if k % 3 else "d/2")]
            assert doc["summary"]["n"] == {"c 1": 2, "d/2": 1, "none": 0}[r.candidate] and "why" in doc["summary"]
            want = {f'a"{k:05}': {"iou": k / 4, "note": None} for k in ids}
            if as_map:
                assert doc["per_image"] == want and list(doc["per_image"]) == list(want)
            else:
                assert doc["images"] == [{"image": i, **m} for i, m in want.items()]


def test_documents_are_read_in_splits(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("c").alias("candidate"), F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("image"), F.lit('{"summary": "a",\n]}').alias("text"))
    summary = spark.createDataFrame([("c", 3, "n"), ("none", 0, "m")], "candidate string, n long, name string")
    sinks.save_documents(summary, rows, str(tmp_path / "out")).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20000)
    try:
        read = readers.document_images(spark, str(tmp_path / "out/*.json"), "struct<n:long,name:string>", "struct<image:string,text:string>")
        sizes = [sum(1 for _ in p) for p in read.select("image.image").rdd.glom().collect()]
        got = read.select("summary.*", "image.*").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert max(sizes) < 1000 and sorted((r.n, r.name, r.image, r.text) for r in got) == [(3, "n", f"i{k:05}", '{"summary": "a",\n]}') for k in range(4000)]


def test_outlines_and_labels():
    p = np.zeros((30, 40, 3), np.uint8)
    overlays.outline(p, (5, 6, 14, 15), (9, 8, 7), 2)
    want = np.zeros((30, 40), bool)
    want[6:16, 5:15] = True
    want[8:14, 7:13] = False
    assert (p.any(axis=2) == want).all() and (p[want] == (9, 8, 7)).all()
    q = np.zeros((30, 40, 3), np.uint8)
    overlays.outline(q, (5, 6, 3, 4), (1, 1, 1), 1)  # x, y, width, height
    assert q[6, 5].any() and q[10, 8].any() and not q[8, 6].any() and q.sum() == 3 * (4 * 5 - 2 * 3)
    for odd in ((-5, -5, 100, 100), (50, 50, 60, 60), (3, 3, 3, 3)):
        overlays.outline(q, odd, (1, 1, 1), 3)
    r = np.zeros((12, 20, 3), np.uint8)
    overlays.label(r, 1, 1, "17", (5, 5, 5), 1)
    assert ["".join(".#"[int(v > 0)] for v in row[1:8]) for row in r[1:6, :, 0]] == [".#..###", "##....#", ".#....#", ".#....#", "###...#"]
    overlays.label(r, 15, -2, "8GT", (5, 5, 5), 2)


def test_overlays(spark):
    raw = images.to_png(np.full((60, 50), 7, np.uint8))
    rows = spark.createDataFrame([("a", bytearray(raw), [[5.0, 20.0, 30.0, 40.0], [1.0], None], [[8.0, 22.0, 20.0, 30.0]]), ("b", bytearray(b"x"), [], None)], "image string, content binary, gt array<array<double>>, pred array<array<double>>")
    got = {r.image: r for r in overlays.overlays(rows).collect()}
    p = images.pixels(bytes(got["a"].content))
    assert p.shape == (60, 50, 3) and p[20, 5].tolist() == [0, 200, 0] and p[22, 8].tolist() == [255, 40, 40] and p[50, 45].tolist() == [7, 7, 7] and p[4:14, 7:30, 1].max() == 200
    assert got["b"].content is None and got["b"].error
    wide = {r.image: r for r in overlays.overlays(rows, side_by_side=True).collect()}["a"]
    q = images.pixels(bytes(wide.content))
    assert (wide.width, wide.height) == (170, 100) and (q[:60, :50] == 7).all() and q[20, 65].tolist() == [0, 200, 0] and q[22, 128].tolist() == [255, 40, 40] and q[80, 10].tolist() == [30, 30, 30]
