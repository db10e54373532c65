"""Whole evaluations, preparation of true pages, images, readers and connectors, against values worked out by hand."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgauge.operators import connectors, evaluation, prep
from docgauge.sources import images, readers, sinks

BLOCKS = "array<struct<bbox:array<double>,text:string>>"


def test_layout_of_pages(spark):
    box = lambda x, t="a": ([float(x), 0.0, float(x) + 10, 10.0], t)
    pages = spark.createDataFrame([("a.png", [box(0, "x" * 90), box(20)], 1.0), ("b.png", [box(0)], 2.5), ("c.png", [], 4.0), ("d.png", None, 8.0)], f"image string, blocks {BLOCKS}, stage1_latency double")
    truth = spark.createDataFrame([("a.png", [box(0), box(20)], [0, 1], 1), ("a.png", [box(50)], [0], 0), ("b.png", [box(100)], [0], 0), ("d.png", [box(0)], [0], 0)], f"image string, blocks {BLOCKS}, reading_order array<int>, seq int")
    summary, rows = evaluation.layout_eval(pages, truth, "m")
    s = summary.first()
    assert (s.candidate, s.mean_bbox_iou, s.mean_kendall_tau, s.mean_latency_s, s.images_with_bbox_matches, s.images_with_tau, s.total_images) == ("m_bbox", 1.0, 1.0, round(11.5 / 4, 2), 1, 1, 4)
    got = {r.image: r for r in rows.collect()}
    assert set(got) == {"a.png", "b.png", "d.png"} and got["a.png"].sample_blocks[0].text == "x" * 80 and got["b.png"].bbox_recall == 0 and got["d.png"].num_pred_blocks == 0
    assert evaluation.summary_text(summary).first().text.startswith("M BBOX + READING ORDER RESULTS\n  Mean Bbox IoU:     1.000  (1/4 images)")
    none, _ = evaluation.layout_eval(pages.where("image = 'b.png'"), truth, "m")
    assert none.first().mean_bbox_iou == 0 and "(0/1 images)" in evaluation.summary_text(none).first().text
    first, _ = evaluation.layout_eval(pages, truth, "m", limit=1)
    assert first.first().total_images == 1 and first.first().mean_latency_s == 1
    moved, _ = evaluation.layout_eval(pages.where("image = 'b.png'"), truth, "m", normalizer=lambda b: F.transform(b, lambda x, i: F.when(i % 2 == 0, x + 100).otherwise(x)))
    assert moved.first().mean_bbox_iou == 1


def test_figures_of_candidates(spark):
    e = lambda t, x: [(t, [0.0, 0.0, 10.0, float(x)])]
    kind = "array<struct<type:string,bbox:array<double>>>"
    preds = [("c", 0, "a.png", "the cat", 1.0, [0, 1], e("spelling", 10), 0.5, 7), ("c", 0, "b.png", "x", 3.0, [1, 0], e("grammar", 10), 1.5, 9), ("d", 0, "z.png", "q", 2.0, None, None, None, 1)]
    preds = spark.createDataFrame(preds, f"candidate string, run int, image string, text string, latency double, reading_order array<int>, errors {kind}, stage1_latency double, vram_mb int")
    truth = spark.createDataFrame([("a", "the dog", [0, 1], e("spelling", 10)), ("b.png", "x", [0, 1], e("spelling", 100))], f"image string, text string, reading_order array<int>, errors {kind}")
    got = {r.candidate: r for r in evaluation.run_candidates(preds, truth, notes="n").collect()}
    c, d = got["c"], got["d"]
    assert (c.n, c.n_scored, c.latency_avg, c.stage1_latency_avg, c.vram_peak_mb, c.notes) == (2, 2, 2.0, 1.0, 9, "n")
    assert c.cer == pytest.approx(3 / 7 / 2) and c.wer == 0.25 and c.reading_order_tau == 0 and c.error_detection_f1 == 0.5
    assert c.bounding_box_iou == pytest.approx((1 + 0.1) / 2)  # an overlap of 0.1 is a match
    assert [x.image for x in c.sample_outputs] == ["a.png", "b.png"]
    assert (d.n_scored, d.cer, d.reading_order_tau, d.error_detection_f1, d.stage1_latency_avg) == (0, 0, 0, 0, 0)
    last = {r.candidate: r.stage1_latency_avg for r in evaluation.run_candidates(preds, truth, last_only=True).collect()}
    assert last["c"] == 1.5
    assert json.loads(sinks.result_json(evaluation.run_candidates(preds, truth)).where("candidate = 'd'").first().json)["cer"] == 0


def test_true_pages_of_images(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    line = lambda t, y, attrs='width="10" height="10"': f'<line text="{t}"><word><cmp x="50" y="{y}" {attrs}/></word></line>'
    (tmp_path / "x" / "a.xml").write_text(f'<form height="1000"><handwritten-part>{line("one two three", 100)}{line("Name: A B C", 200)}</handwritten-part></form>')
    (tmp_path / "x" / "y" / "b.xml").write_text(f'<form height="1000">{line("all lines", 30)}</form>')
    (tmp_path / "x" / "y" / "note.txt").write_text("no form")
    flat, deep = readers.forms(spark, str(tmp_path / "x")), readers.forms(spark, str(tmp_path / "x"), recursive=True)
    assert {r.image for r in flat.collect()} == {"a"} and {r.image for r in deep.collect()} == {"a", "b"}
    pics = spark.createDataFrame([("a.png", 300, 400), ("b.jpg", 300, 400), ("c.png", 300, 400)], "image string, width int, height int")
    crops = spark.createDataFrame([("a.png", [45, 95, 60, 110])], "image string, crop_bbox array<int>")
    got = {r.image: r for r in prep.truth_entries(pics, deep, crops, handwritten=True).collect()}
    assert got["a.png"].text == "one two three" and got["a.png"].blocks[0].bbox == [25, 25, 35, 35] and got["a.png"].reading_order == [0] and got["a.png"]._source == "handwritten-part"
    assert got["b.jpg"].text == "all lines" and got["b.jpg"]._note is None
    assert (got["c.png"].text, got["c.png"].blocks, got["c.png"].errors, got["c.png"]._note) == ("", [], [], prep.UNANNOTATED)
    assert prep.truth_entries(pics, deep).where("image = 'a.png'").first().text == "one two three\nName: A B C"
    crop = prep.crop_rows(pics, deep, signatures=True).collect()
    assert [(r.image, r.crop_bbox, r.cropped_size, r.num_lines, r.filtered_signatures) for r in crop] == [("a.png", [50, 100, 60, 210], [50, 150], 2, False)]


def test_other_preparation(spark):
    row = spark.createDataFrame([("a", "p", None, 3, 1.5)], "image string, path string, text_density double, estimated_lines int, contrast double")
    assert prep.curated(row).first().text_density == 0
    assert [r.mode for r in prep.both_modes(row, "both").collect()] == ["handwriting", "fullform"] and prep.both_modes(row, "fullform").count() == 1
    with pytest.raises(ValueError):
        prep.both_modes(row, "other")
    two = row.select(F.struct(F.lit(1).alias("a"), F.lit("l").alias("b")).alias("x"), F.struct(F.lit(2).alias("a"), F.lit(None).cast("string").alias("b")).alias("y"))
    assert tuple(two.select(prep.merged(F.col("x"), F.col("y"), ["a", "b"]).alias("m")).first().m) == (2, "l")
    truth = spark.createDataFrame([("a", 2), ("a", 1)], "image string, seq int")
    assert prep.truth_of(truth, "a", "seq").first().seq == 1 and prep.truth_of(truth, "b").count() == 0


def filtered(p, kinds):
    """A PNG file whose rows have the given filter types."""
    h, w, step = p.shape
    rows, above = b"", np.zeros(w * step, np.int32)
    for y in range(h):
        line, kind = p[y].ravel().astype(np.int32), kinds[y % len(kinds)]
        left = np.concatenate([np.zeros(step, np.int32), line[:-step]])
        corner = np.concatenate([np.zeros(step, np.int32), above[:-step]])
        q = left + above - corner
        a, b, c = abs(q - left), abs(q - above), abs(q - corner)
        guess = [0 * line, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][kind]
        rows += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[step], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_from_bytes(spark, tmp_path):
    rng = np.random.default_rng(1)
    for step in (1, 2, 3, 4):
        p = rng.integers(0, 256, (11, 7, step)).astype(np.uint8)
        assert (images.pixels(filtered(p, [0, 1, 2, 3, 4])) == p).all() and (images.pixels(images.to_png(p)) == p).all()
    assert images.grey(np.array([[[255, 255, 255], [255, 0, 0], [0, 0, 0]]], np.uint8)).tolist() == [[255, 76, 0]]
    p = np.full((50, 30), 255, np.uint8)
    p[10:13, 5:25] = 0
    (tmp_path / "a.png").write_bytes(images.to_png(p))
    (tmp_path / "b.png").write_bytes(b"not an image")
    files = readers.images(spark, str(tmp_path), content=True)
    got = {r.image: r for r in images.manifest(files).collect()}
    a = got["a.png"]
    assert (a.width, a.height, a.aspect_ratio, a.text_density, a.estimated_lines, a.error) == (30, 50, 0.6, 0.04, 3, None) and len(a.sha256) == 16
    assert got["b.png"].error and got["b.png"].width is None
    cut = images.cropped(files.withColumn("crop_bbox", F.array(F.lit(5), F.lit(10), F.lit(25), F.lit(13))), pad=2)
    out = {r.image: r for r in cut.collect()}
    assert (out["a.png"].width, out["a.png"].height) == (24, 7) and (images.pixels(out["a.png"].content)[2:5, 2:22] == 0).all() and out["b.png"].content is None and out["b.png"].error
    saved = images.save_files(cut, str(tmp_path / "out")).collect()
    assert [r.image for r in saved] == ["a.png"] and images.pixels((tmp_path / "out" / "a.png").read_bytes()).shape == (7, 24, 1) and len(list((tmp_path / "out").iterdir())) == 1


def test_readers_of_truth_and_manifests(spark, tmp_path):
    page = {"image": "a.png", "text": "t", "reading_order": [0], "blocks": [{"bbox": [1, 2, 3, 4], "text": "t", "confidence": 1.0}], "errors": [{"type": "spelling", "bbox": [1, 2, 3, 4], "description": "d"}]}
    (tmp_path / "truth.json").write_text(json.dumps([page, {"image": "b.png", "text": ""}]))
    (tmp_path / "template.json").write_text("# How to\n# fill in\n" + json.dumps([page], indent=1))
    for got in (readers.truth(spark, str(tmp_path / "truth.json")).where("image = 'a.png'").first(), readers.template(spark, str(tmp_path / "template.json")).first()):
        assert (got.image, got.text, got.reading_order, got.blocks[0].bbox, got.errors[0].type) == ("a.png", "t", [0], [1, 2, 3, 4], "spelling")
    (tmp_path / "m.json").write_text(json.dumps([{"image": "a", "path": "p/a", "width": 3, "text_density": 0.5}, {"image": "b", "path": "p/b", "error": "broken"}]))
    assert [(r.image, r.width, r.error) for r in readers.manifest(spark, str(tmp_path / "m.json")).orderBy("image").collect()] == [("a", 3, None), ("b", None, "broken")]
    (tmp_path / "c.json").write_text(json.dumps([{"image": "a", "path": "p", "text_density": 0.3, "estimated_lines": 7, "writer_prefix": "a01"}]))
    row = readers.curated(spark, str(tmp_path / "c.json")).first()
    assert (row.writer_prefix, row.contrast) == ("a01", None)
    (tmp_path / "h.json").write_text(json.dumps([{"image": "a", "crop_bbox": [1, 2, 3, 4], "original_size": [9, 9], "num_lines": 2, "filtered_signatures": True}]))
    assert readers.crops(spark, str(tmp_path / "h.json")).first().crop_bbox == [1, 2, 3, 4]
    (tmp_path / "r.json").write_text(json.dumps({"candidate": "c", "images": [{"image": "a", "cer": 0.5}, {"image": "b"}]}))
    (tmp_path / "q.json").write_text("not json")
    assert {(r.candidate, r.image, r.cer) for r in readers.result_images(spark, [str(tmp_path / "r.json"), str(tmp_path / "q.json")]).collect()} == {("c", "a", 0.5), ("c", "b", None)}


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("DG_PROJECT", "from-env")
    spark.conf.set("docgauge.dg_region", "from-session")
    assert readers.settings(spark, dg_project="x", dg_region="y", dg_other="z") == {"dg_project": "from-env", "dg_region": "from-session", "dg_other": "z"}


def test_reports_as_files(spark, tmp_path):
    summary = spark.createDataFrame([("c", 0.5, 2), ("d", 0.25, 1)], "candidate string, mean_iou double, pages long")
    rows = spark.createDataFrame([("c", "b.png", 0.4), ("c", "a.png", 0.6), ("d", "a.png", 0.25)], "candidate string, image string, iou double")
    report = {r.candidate: r for r in sinks.layout_report(summary, rows).collect()}
    assert report["c"].summary.mean_iou == 0.5 and [x.image for x in report["c"].images] == ["a.png", "b.png"]
    assert {r.candidate: r.per_image["a.png"].iou for r in sinks.details_by_image(rows).collect()} == {"c": 0.6, "d": 0.25}
    sinks.save_report(summary, rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/summary")).count() == 2 and spark.read.json(str(tmp_path / "report/images")).where("candidate = 'c'").count() == 2
    sinks.save_json(rows, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 3


def test_warm_up_health_and_failing_candidates(spark, tmp_path):
    pages = spark.createDataFrame([("b",), ("a",), ("c",)], "image string").coalesce(1)
    log = str(tmp_path / "calls")

    def fn(page):
        with open(log, "a") as f:
            f.write(page["image"])
        return {"text": page["image"]}

    def unreachable():
        raise ConnectionError("down")

    out = connectors.infer(pages, fn, "c", warmup=2, limit=2).collect()
    assert sorted(r.text for r in out) == ["a", "b"] and len(open(log).read()) == 4
    ill = connectors.infer(pages, fn, "c", healthy=unreachable, warmup=1).collect()
    assert {r._note for r in ill} == {"ConnectionError: down"} and len(ill) == 3 and len(open(log).read()) == 4
    connectors.candidate("broken")(unreachable)
    connectors.candidate("sound")(lambda: lambda page: {"text": "ok"})
    try:
        got = {(r.candidate, r.text, r._note) for r in connectors.infer_all(pages, ["broken", "sound"]).collect()}
    finally:
        connectors.REGISTRY.clear()
    assert got == {("broken", "", "ConnectionError: down"), ("sound", "ok", None)}
    with pytest.raises(KeyError):
        connectors.infer_all(pages, ["unknown"])


def test_environment(spark, monkeypatch):
    monkeypatch.setenv("DG_KEY", "k")
    connectors.guard("DG_KEY", "module:json")
    with pytest.raises(RuntimeError, match="DG_NONE, module:no_such_module"):
        connectors.guard("DG_NONE", "DG_KEY", "module:no_such_module")
    rows = connectors.environment(spark, {"fine": (lambda: "3.13", "error"), "slow": (lambda: 1 / 0, "warning")})
    assert {(r.name, r.passed, r.severity) for r in rows.collect()} == {("fine", True, "error"), ("slow", False, "warning")}
    s = evaluation.checked(rows, ~F.col("passed"), F.col("severity") == "error").first()
    assert (s.errors, s.warnings, s.passed) == (0, 1, True)


@pytest.mark.parametrize("ranked", [200_000, 5])
def test_cut_points_in_rounds(spark, monkeypatch, ranked):
    monkeypatch.setattr(prep, "RANKED", ranked)
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 10_000, 3001), np.where(rng.random(3001) < 0.4, 7, rng.integers(0, 9, 3001))
    df = spark.createDataFrame([(int(x), None if y == 8 else float(y)) for x, y in zip(a, b)], "a long, b double").repartition(4)
    got = prep.cut_points(df, "a", "b").first()
    zeros = np.where(b == 8, 0, b)
    assert (got.a_low, got.a_high, got.b_low, got.b_high) == (np.sort(a)[1000], np.sort(a)[2000], np.sort(zeros)[1000], np.sort(zeros)[2000])
    assert dict(prep.cut_points(df, "a", "b").dtypes) == {"a_low": "bigint", "a_high": "bigint", "b_low": "double", "b_high": "double"}
    none = prep.cut_points(df.limit(0), "a", "b").first()
    assert none.a_low is None and none.b_high is None


@pytest.mark.parametrize("name", ["layout_eval_images", "layout_report"])
def test_one_python_step_a_page(spark, sf, name):
    """Matches and the order's counts take one Python process a task, not one after another."""
    from docgauge.plans import catalogue

    assert str(catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
