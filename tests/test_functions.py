"""Operators against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from docgauge.functions import geometry as G
from docgauge.functions import parsers as P
from docgauge.functions import text as T
from docgauge.operators import connectors, matching, ordering, prep, scoring
from docgauge.sources import readers, sinks


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(*columns):
        row = one.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
        return list(row) if len(columns) > 1 else row[0]

    return get


def arr(xs):
    return F.array(*[arr(x) if isinstance(x, list) else F.lit(x) for x in xs])


def boxes(bs):
    return F.array(*[F.array(*[F.lit(float(x)) for x in b]) for b in bs]) if bs else F.array().cast("array<array<double>>")


def test_character_and_word_error_rates(value):
    pairs = [("abc", "abc", 0), ("", "", 0), ("x", "", 1), ("", "abc", 1), ("aaaa", "b", 4), ("über", "uber", 0.25)]
    assert value(*[T.cer(F.lit(a), F.lit(b)) for a, b, _ in pairs]) == [x for _, _, x in pairs]
    assert value(T.cer_normalized(F.lit("a\n b\r"), F.lit("a b")), T.cer_normalized(F.lit("a\u00a0b"), F.lit("a b"))) == [0, 0]
    assert value(T.normalize_text(F.lit(" a\u2003\x1cb\n\n")), T.wer(F.lit("the cat sat"), F.lit("the dog sat down")), T.wer(F.lit(" "), F.lit(""))) == ["a b", 0.5, 0]


def test_text_helpers(value):
    assert value(T.mime_type(F.lit("a/b.JPG")), T.mime_type(F.lit("x")), T.stem(F.lit("d/a.b.png")), T.file_name(F.lit("d/a.png"))) == ["image/jpeg", "image/png", "a.b", "a.png"]
    seg = F.array(F.struct(F.lit(None).cast("int").alias("start_index"), F.lit(2).alias("end_index")), F.struct(F.lit(4).alias("start_index"), F.lit(0).alias("end_index")))
    assert value(T.text_anchor(F.lit("abcdef"), seg)) == "abef"


def test_boxes(value):
    b = lambda *x: arr([float(v) for v in x])
    assert value(G.to_xyxy(b(100, 100, 50, 20)), G.to_xyxy(b(0, 0, 5, 5)), G.to_xyxy(b(1, 2)), G.to_xyxy(b(1, 2, 3, 4), "xywh")) == [[100, 100, 150, 120], [0, 0, 5, 5], [0, 0, 0, 0], [1, 2, 4, 6]]
    got = value(G.iou(b(0, 0, 10, 10), b(5, 0, 15, 10)), G.iou(b(0, 0, 1, 1), b(0, 0, 1, 1)), G.iou(b(0, 0, 1, 1), b(2, 2, 3, 3)), G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)), G.iou(F.array().cast("array<double>"), b(0, 0, 1, 1)))
    assert got == [pytest.approx(1 / 3), 1, 0, 0, 0]
    assert value(G.flat_quad(b(3.9, 1, 9, 2, 9, 8.5, -1.7, 8)), G.parse_box(F.lit("[1, 2.9, 3, 4]")), G.parse_box(F.lit("[1, x, 3, 4]")), G.bins(F.lit(500), F.lit(1), F.lit(999), F.lit(0), F.lit(1000), F.lit(10))) == [[-1, 1, 9, 8], [1, 2, 3, 4], [0, 0, 0, 0], [500, 0, 1000, 0]]
    assert value(G.padded_crop(b(5, 5, 100, 100), F.lit(110), F.lit(110)), G.crop_offset(b(50, 60, 70, 80), b(30, 10, 1, 1)), G.union_box(boxes([]))) == [[0, 0, 110, 110], [40, 60, 60, 80], [0, 0, 0, 0]]


def test_greedy_matching(value):
    g = lambda p, t, **k: [(m["p"], m["g"]) for m in value(matching.greedy(boxes(p), boxes(t), **k))]
    assert g([[0, 0, 10, 10]], [[0, 0, 10, 10], [0, 0, 10, 10]]) == [(0, 0)]
    # the first prediction takes the box that the second needs
    assert g([[0, 0, 10, 12], [0, 0, 10, 10]], [[0, 0, 10, 10]]) == [(0, 0)]
    assert g([[0, 0, 10, 1]], [[0, 0, 10, 10]], strict=True) == [] and g([[0, 0, 10, 1]], [[0, 0, 10, 10]]) == [(0, 0)]
    assert g([[0, 0, 10, 10]], [[0, 0, 10, 6], [0, 0, 10, 10]], at_least=0.5, policy="first") == [(0, 0)]
    assert g([], [[0, 0, 1, 1]]) == [] and g([[0, 0, 1, 1]], []) == []


def test_rank_correlation(value):
    t = lambda a, b: ordering.kendall_tau_b(arr(a), arr(b))
    assert value(t([0, 1, 2], [0, 1, 2]), t([0, 1, 2], [2, 1, 0]), t([0], [0]), t([0, 0, 1], [0, 1, 2])) == [1, -1, 0, pytest.approx(2 / math.sqrt(6))]
    assert value(ordering.kendall_gamma(arr([1]), arr([1])), ordering.kendall_gamma(arr([0, 1, 2]), arr([0, 2, 1]))) == [1, pytest.approx(1 / 3)]
    assert value(ordering.reading_order(boxes([[5, 9, 6, 10], [5, 0, 6, 1], [1, 9, 2, 10]]))) == [1, 2, 0]


def test_error_scores(value):
    e = lambda xs: F.array(*[F.struct(F.lit(t).alias("type"), boxes([b])[0].alias("bbox")) for t, b in xs]) if xs else F.array().cast("array<struct<type:string,bbox:array<double>>>")
    box = [0, 0, 9, 9]
    assert value(scoring.error_f1(e([]), e([])), scoring.error_f1(e([("spelling", box), ("grammar", box)]), e([("spelling", box)])), scoring.error_f1(e([("unknown", box)]), e([]))) == [0, 0.5, 0]
    none = F.array().cast(matching.MATCHES)
    assert value(scoring.block_metrics(none, F.lit(0), F.lit(0)), scoring.block_metrics(none, F.lit(0), F.lit(2)))[0]["mean_iou"] == 1
    m = value(scoring.error_metrics(none, F.lit(0), F.lit(2)))
    assert (m["mean_iou"], m["recall"], m["precision"]) == (0, 1, 0)


def test_doctags(value):
    raw = "1>5>9>9>Bare\n<text>1>900>3>4>two\n7>7>7>7>inside</text>\n<table>0>1>2>3> </table>\n2>2>3>3>x<title>1>1>2>2>t</title>"
    got = value(P.doctag_blocks(F.lit(raw), F.lit(999), F.lit(999)))
    assert [(b["type"], b["text"], b["bbox"][:2]) for b in got] == [("title", "t", [1, 1]), ("header", "x<title>1>1>2>2>t</title>", [2, 2]), ("header", "Bare", [1, 5]), ("text", "two\n7>7>7>7>inside", [1, 900])]
    # marks of the private-use area are text; a line goes on across the blocks in it
    odd = "\ue000\n1>2>3>4>a\ue000<text>5>6>7>8>b</text> c <list>1>1>1>1>d\n9>9>9>9>e</list> f\n3>1>3>4>g\n<text>2>2>2>2>h</text>\n\n4>1>3>4>i"
    got = value(P.doctag_blocks(F.lit(odd), F.lit(999), F.lit(999)))
    assert [(b["type"], b["text"]) for b in got] == [("list", "d\n9>9>9>9>e"), ("header", "g"), ("header", "i"), ("header", "a\ue000<text>5>6>7>8>b</text> c <list>1>1>1>1>d"), ("text", "h"), ("text", "b")]
    assert value(P.doctag_text(P.doctag_blocks(F.lit("none"), F.lit(9), F.lit(9)), F.lit("none"))) == "none"


def test_model_output_parsers(value):
    assert value(P.chat_cleanup(F.lit("user\nOCR with format: assistant\nSentence Database \nA04-039 \nHello\n user")), P.chat_cleanup(F.lit("assistant\n Hi "))) == ["Hello", "Hi"]
    assert value(P.fenced_json(F.lit("a ```json\n{}\n``` b")), P.fenced_json(F.lit("a ```\n[1]\n``` b")), P.fenced_json(F.lit(" {} "))) == ["{}", "[1]", "{}"]
    assert value(P.listed_errors(F.lit("not json"))) == []
    placed = value(P.placed_errors(P.listed_errors(F.lit('{"errors":[{"block_index":-1},{"type":"spelling","block_index":0},{"block_index":1}]}')), F.array(F.struct(boxes([[1, 2, 3, 4]])[0].alias("bbox")))))
    assert [(p["type"], p["bbox"]) for p in placed] == [("unknown", [0, 0, 0, 0]), ("spelling", [1, 2, 3, 4]), ("unknown", [0, 0, 0, 0])]
    doc = '{"res":{"parsing_res_list":[{"block_bbox":[1,2,3,4],"block_content":"a"},{"block_bbox":"[5, 6, 7, 8]","block_content":"b"},{"block_content":"c"},{"block_content":""}]}}'
    assert [(b["bbox"], b["text"]) for b in value(P.document_blocks(F.lit(doc)))] == [([1, 2, 3, 4], "a"), ([5, 6, 7, 8], "b"), ([0, 0, 0, 0], "c")]
    assert value(F.size(P.document_blocks(F.lit(doc), require_box=True)), P.document_text(F.lit("{}"), F.lit(""), F.lit("plain"))) == [2, "plain"]
    assert [b["text"] for b in value(P.line_blocks(F.lit(" a \n\n b")))] == ["a", "b"]


def test_truth_by_name_or_stem(spark):
    preds = spark.createDataFrame([("c", "d/x.png", "p", 1.0), ("c", "y.png", "q", 2.0), ("c", "z.png", "r", 3.0)], "candidate string, image string, text string, latency double")
    truth = spark.createDataFrame([("x.png", "old", 0), ("x.png", "p", 1), ("y", "", 2)], "image string, text string, seq int")
    got = lambda how: {r.image: r.gt_text for r in scoring.with_truth(preds, truth, how, seq="seq").collect()}
    assert got("skip") == {"d/x.png": "p", "y.png": ""} and got("empty")["z.png"] is None and got("text") == {"d/x.png": "p"}
    row = scoring.evaluate(preds, truth.drop("seq").where("text <> 'old'"), "empty").first()
    assert (row.n, row.n_scored, row.latency_std, row.throughput_ppm) == (3, 3, 1.0, 30.0) and row.cer == pytest.approx(2 / 3)


def test_forms_and_truth(spark, tmp_path):
    cmp = lambda x, y, w, h: f'<cmp x="{x}" y="{y}" width="{w}" height="{h}"/>'
    (tmp_path / "a01.xml").write_text(
        f'<form id="a01" height="1000"><machine-printed-part><line text="print"/></machine-printed-part><handwritten-part><line text="second"><word id="w" text="second">{cmp(5, 200, 10, 10)}{cmp(1, 190, 2, 5)}</word></line>'
        f'<line text="first one here"><word>{cmp(7, 20, 30, 10)}</word></line><line text=""/><line text="no boxes at all"/><line text="Name: Jo Fo Ba"><word>{cmp(1, 300, 5, 5)}</word></line></handwritten-part></form>'
    )
    forms = readers.forms(spark, str(tmp_path))
    lines = prep.form_lines(forms)
    assert {r.text: r.bbox for r in lines.collect()}["second"] == [1, 190, 15, 210]
    assert lines.count() == 4 and prep.form_lines(forms, need_boxes=True).count() == 3
    kept = prep.drop_signatures(lines.withColumn("y1", F.col("bbox")[1]), "image")
    page = prep.truth_pages(kept.drop("y1")).first()
    assert page.text.split("\n") == ["no boxes at all", "first one here", "second"] and page.reading_order == [0, 1, 2]


def test_features_runs_and_picks(spark):
    pixels = spark.range(40).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"), F.when(F.col("id") >= 20, 0).otherwise(255).alias("value"), F.lit("i").alias("image"))
    assert [(r.y1, r.y2) for r in prep.runs(prep.row_profile(pixels, ["image"], "y", "value"), ["image"], "y", "dark", 3).collect()] == [(5, 10)]
    f = prep.image_features(pixels, ["image"]).first()
    assert (f.text_density, f.contrast) == (0.5, 127.5)
    picks = prep.representative(spark.range(8).select((F.col("id") / 10).alias("cer"), "id"), "cer", "id").collect()
    assert {r.pick: r.id for r in picks} == {"best": 0, "worst": 7, "median": 4, "lower": 2, "upper": 6}


def test_results_round_trip_and_connector(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"candidate_name": "a", "model": "m", "timestamp": "2026-01-02T03:04:05+00:00", "notes": "x"}')
    (tmp_path / "r/b.json").write_text('{"candidate_name": "b", "model_version": "v", "timestamp": "2026-01-02 03:04:05"}')
    got = {r.candidate_name: (r.model_version, str(r.at)) for r in readers.results(spark, str(tmp_path / "r")).collect()}
    assert got == {"a": ("m", "2026-01-02 03:04:05"), "b": ("v", "2026-01-02 03:04:05")}
    sinks.save_results(readers.results(spark, str(tmp_path / "r")).select("candidate_name", "notes"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "i").mkdir()
    for n in ("b.PNG", "a.jpg", "c.txt", "ground_truth.png"):
        (tmp_path / "i" / n).write_bytes(b"x")
    assert [r.image for r in readers.images(spark, str(tmp_path / "i")).orderBy("path").collect()] == ["a.jpg", "b.PNG", "ground_truth.png"]
    assert [r.image for r in readers.inventory(spark, str(tmp_path / "i")).collect()] == ["a.jpg"]

    def fn(page):
        if page["image"] == "b":
            raise ValueError("no")
        return {"text": "t", "blocks": [{"bbox": [1, 2, 3, 4], "text": "t"}]}

    out = connectors.parsed(connectors.infer(spark.createDataFrame([("a",), ("b",)], "image string"), fn, "c", runs=2)).collect()
    assert len(out) == 4 and {r.image: (r.text, r._note, len(r.blocks)) for r in out} == {"a": ("t", None, 1), "b": ("", "ValueError: no", 0)}


def test_region_parsers(spark):
    df = spark.sql("""SELECT array(array(3D, 1D, 9D, 2D, 9D, 8.5D, 2D, 8D), array(0D, 0D, 1D, 0D, 1D, 1D, 0D, 1D)) q, array('a') t,
      named_struct('text', array(' w ', ' '), 'left', array(1, 2), 'top', array(3, 4), 'width', array(5, 6), 'height', array(7, 8), 'conf', array(95, -1)) w,
      array(named_struct('left', 0.1D, 'upper', 0.2D, 'right', 0.5D, 'lower', 0.999D, 'text', 'n', 'confidence', 0.5D)) r,
      '{"text":"hello world","pages":[{"dimension":{"width":100,"height":50},"blocks":[{"layout":{"confidence":0.9,"text_anchor":{"text_segments":[{"start_index":6}]},"bounding_poly":{"normalized_vertices":[{"x":0.1,"y":0.2},{"x":0.5,"y":0.9}]}}},{"layout":{"confidence":0.1}}]}]}' d""")
    row = df.select(P.quad_blocks("q", "t").alias("q"), P.word_blocks("w").alias("w"), P.scaled_blocks("r", F.lit(100), F.lit(10)).alias("r"), P.cloud_blocks("d").alias("d")).first()
    plain = lambda bs: [(b["bbox"], b["text"], b["confidence"]) for b in bs]
    assert plain(row.q) == [([2, 1, 9, 8], "a", 1.0)] and plain(row.w) == [([1, 3, 6, 10], "w", 0.95)] and plain(row.r) == [([10, 2, 50, 9], "n", 0.5)]
    assert plain(row.d) == [([10, 10, 50, 45], "world", 0.9), ([0, 0, 0, 0], "", 0.1)]


def test_patient_calls():
    waits, said = [], iter(["quota", "503", "other", None])

    def fn(page):
        if (x := next(said)) is not None:
            raise RuntimeError(x)
        return {"text": "ok"}

    assert connectors.patient(fn, sleep=waits.append)({}) == {"text": "ok"} and waits == [30, 2, 4]

    def never(page):
        raise RuntimeError("x")

    assert connectors.patient(never, attempts=2, sleep=waits.append)({})["_note"] == "RuntimeError: x"


def test_registered_candidates(spark):
    connectors.candidate("upper")(lambda: lambda page: {"text": page["image"].upper()})
    try:
        got = connectors.infer_all(spark.createDataFrame([("a",)], "image string")).collect()
    finally:
        connectors.REGISTRY.clear()
    assert [(r.candidate, r.text) for r in got] == [("upper", "A")]
