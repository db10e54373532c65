"""Whole evaluations in one call: a candidate's run against the truth, and a layout report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.geometry import corners
from docgauge.functions.text import cer, cer_normalized, let, wer, wer_normalized
from docgauge.operators.matching import greedy
from docgauge.operators.ordering import kendall_tau_b
from docgauge.operators.scoring import EMPTY_BOXES, block_metrics, error_f1, error_metrics, latency_summary, mean_or_zero, order_metrics, with_truth


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def _boxes(errors: str) -> Column:
    return F.transform(errors, lambda e: e["bbox"])


def _stage(preds: DataFrame, stage: str, last_only: bool, order: str) -> DataFrame:
    """Mean of a stage's latency per candidate: over all pages that have it, or over the last page of each run."""
    rows = preds.where(F.col(stage).isNotNull()) if not last_only else preds.groupBy("candidate", "run").agg(F.max_by(stage, order).alias(stage)).where(F.col(stage).isNotNull())
    return rows.groupBy("candidate").agg(F.avg(stage).alias(f"{stage}_avg"))


def samples(preds: DataFrame, n: int = 3, order: tuple[str, ...] = ("run", "image"), by: str = "candidate") -> DataFrame:
    """The first `n` pages of each candidate by `order`."""
    w = Window.partitionBy(by).orderBy(*order)
    return preds.withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= n)


def run_candidates(preds: DataFrame, truth: DataFrame, missing: str = "skip", normalized: bool = True, last_only: bool = False, notes: str = "") -> DataFrame:
    """One row per candidate with all its figures.

    `preds`: candidate, run, image, text, latency and, where known, blocks' reading_order, errors, stage1_latency,
    stage2_latency, vram_mb; `truth`: image, text and, where known, reading_order, errors.  Accuracy is over pages with
    truth; order and errors are scored where both sides have them; the overlap of errors counts only pages with a match;
    what nothing tells is 0.
    """
    pages = with_truth(preds, truth, missing)
    gt = F.coalesce("gt_text", F.lit(""))
    c, w = (cer_normalized, wer_normalized) if normalized else (cer, wer)
    own = lambda n: f"gt_{n}" if n in preds.columns else n
    scores = [mean_or_zero(c(F.col("text"), gt)).alias("cer"), mean_or_zero(w(F.col("text"), gt)).alias("wer"), F.count(F.lit(1)).alias("n_scored")]
    if _has(preds, "reading_order") and _has(truth, "reading_order"):
        scores.append(mean_or_zero(F.when(F.col("reading_order").isNotNull() & F.col(own("reading_order")).isNotNull(), kendall_tau_b("reading_order", own("reading_order")))).alias("reading_order_tau"))
    if _has(preds, "errors") and _has(truth, "errors"):
        both = F.col("errors").isNotNull() & F.col(own("errors")).isNotNull()
        scores.append(mean_or_zero(F.when(both, error_f1("errors", own("errors")))).alias("error_detection_f1"))
        p, g = _boxes("errors"), _boxes(own("errors"))
        overlap = error_metrics(greedy(p, g), F.size(g), F.size(p))
        scores.append(mean_or_zero(F.when(both, let(overlap, lambda m: F.when(m["matched"] > 0, m["mean_iou"])))).alias("bounding_box_iou"))
    out = latency_summary(preds, ["candidate"]).join(pages.groupBy("candidate").agg(*scores), "candidate", "left")
    for stage in ("stage1_latency", "stage2_latency"):
        if _has(preds, stage):
            out = out.join(_stage(preds, stage, last_only, "image"), "candidate", "left")
    if _has(preds, "vram_mb"):
        out = out.join(preds.groupBy("candidate").agg(F.max("vram_mb").alias("vram_peak_mb")), "candidate", "left")
    first = samples(preds).groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "image", "text"))), lambda s: F.struct(s["image"].alias("image"), s["text"].alias("text"))).alias("sample_outputs"))
    out = out.join(first, "candidate", "left")
    figures = ["cer", "wer", "reading_order_tau", "error_detection_f1", "bounding_box_iou", "stage1_latency_avg", "stage2_latency_avg", "vram_peak_mb", "n_scored"]
    known = [F.coalesce(F.col(f), F.lit(0)).alias(f) if f in out.columns else F.lit(0.0).alias(f) for f in figures]
    return out.select("candidate", "latency_avg", "latency_std", "latency_max", "throughput_ppm", "n", *known, "sample_outputs", F.lit(notes).alias("notes"))


def first_images(pages: DataFrame, limit: int = 0, image: str = "image") -> DataFrame:
    """The first `limit` pages by name; 0 takes all."""
    return pages.orderBy(image).limit(limit) if limit else pages


def layout_eval(pages: DataFrame, truth: DataFrame, candidate: str, normalizer: Callable[[Column], Column] | None = None, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(summary, images) of one candidate's layout against the truth with exactly the same image name.

    `pages`: image, blocks (structs with bbox and text), stage1_latency; `truth`: image, blocks, reading_order and, where
    an image repeats, seq (the last counts).  Pages without truth have no row in `images` and count among total_images;
    the mean latency is that of scored pages over all images.
    """
    pages = first_images(pages, limit)
    cols = [F.col("blocks").alias("gt_blocks"), F.col("reading_order").alias("gt_order")]
    seq = F.col("seq") if "seq" in truth.columns else F.struct("blocks", "reading_order")
    gt = truth.groupBy("image").agg(F.max_by(F.struct(*cols), seq).alias("t")).select("image", "t.*", F.lit(True).alias("known"))
    j = pages.join(gt, "image", "left")
    as_boxes = lambda c: F.coalesce(F.transform(c, lambda b: b["bbox"]), F.array().cast(EMPTY_BOXES))
    pred = as_boxes("blocks")
    pred = F.transform(pred, normalizer) if normalizer else pred
    j = j.select("image", "blocks", "known", F.coalesce("stage1_latency", F.lit(0.0)).alias("latency"), corners(pred).alias("p"), corners(as_boxes("gt_blocks")).alias("g"), "gt_order")
    b = F.when(F.col("known"), block_metrics(greedy("p", "g"), F.size("g"), F.size("p")))
    o = F.when(F.col("known"), order_metrics("p", "g", "gt_order"))
    scored = j.withColumn("b", b).withColumn("o", o)
    n = F.count(F.lit(1))
    share = lambda total, k: F.round(F.coalesce(F.try_divide(total, k.cast("double")), F.lit(0.0)), 4)
    some, two = F.col("b.matched") > 0, F.col("o.matched_blocks") >= 2
    summary = scored.agg(
        share(F.sum(F.when(some, F.col("b.mean_iou"))), F.count_if(some)).alias("mean_bbox_iou"), share(F.sum(F.when(two, F.col("o.kendall_tau"))), F.count_if(two)).alias("mean_kendall_tau"),
        F.round(F.try_divide(F.coalesce(F.sum(F.when(F.col("known"), F.col("latency"))), F.lit(0.0)), n.cast("double")), 2).alias("mean_latency_s"), F.count_if(some).alias("images_with_bbox_matches"), F.count_if(two).alias("images_with_tau"), n.alias("total_images"),
    )
    r4 = lambda c: F.round(c, 4)
    shown = F.transform(F.slice(F.coalesce("blocks", F.array().cast(dict(pages.dtypes)["blocks"])), 1, 3), lambda x: F.struct(x["bbox"].alias("bbox"), F.left(F.coalesce(x["text"], F.lit("")), F.lit(80)).alias("text")))
    images = scored.where("known").select(
        "image", F.size("p").alias("num_pred_blocks"), F.size("g").alias("num_gt_blocks"), r4("b.mean_iou").alias("bbox_mean_iou"), r4("b.recall").alias("bbox_recall"), r4("b.precision").alias("bbox_precision"),
        r4("o.kendall_tau").alias("reading_order_tau"), F.col("o.matched_blocks").alias("reading_order_matched"), F.round("latency", 2).alias("latency_s"), shown.alias("sample_blocks"),
    )
    named = F.lit(f"{candidate}_bbox").alias("candidate")
    return summary.select(named, "*"), images.select(named, "*")


def summary_text(summary: DataFrame) -> DataFrame:
    """The lines that a console shows for a layout summary; means over nothing are 0."""
    text = F.concat_ws(
        "\n", F.concat(F.upper(F.regexp_replace("candidate", "_bbox$", "")), F.lit(" BBOX + READING ORDER RESULTS")), F.format_string("  Mean Bbox IoU:     %.3f  (%d/%d images)", "mean_bbox_iou", "images_with_bbox_matches", "total_images"),
        F.format_string("  Mean Kendall's tau:  %.3f  (%d/%d images)", "mean_kendall_tau", "images_with_tau", "total_images"), F.format_string("  Mean Latency:      %.2fs", "mean_latency_s"),
    )
    return summary.select("candidate", text.alias("text"))


def checked(rows: DataFrame, failed: Column, severe: Column) -> DataFrame:
    """Of checks the number that failed as errors and as warnings, and whether none failed as an error."""
    return rows.agg(F.count_if(failed & severe).alias("errors"), F.count_if(failed & ~severe).alias("warnings"), F.coalesce(F.bool_and(~(failed & severe)), F.lit(True)).alias("passed"))
