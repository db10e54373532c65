"""Scores per page and their aggregates per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.parsers import ERROR_TYPES
from docgauge.functions.text import _c, cer, cer_normalized, let, wer, wer_normalized
from docgauge.functions.geometry import corners, to_xyxy
from docgauge.operators.matching import greedy
from docgauge.operators.ordering import reading_order, tau_of, visited

EMPTY_BOXES = "array<array<double>>"


def mean_or_zero(x) -> Column:
    return F.coalesce(F.avg(_c(x)), F.lit(0.0))


def latency_summary(df: DataFrame, by: list[str], latency: str = "latency") -> DataFrame:
    """Mean, sample deviation (0 for one), maximum and pages a minute."""
    mean = F.avg(latency)
    return df.groupBy(*by).agg(mean.alias("latency_avg"), F.coalesce(F.stddev_samp(latency), F.lit(0.0)).alias("latency_std"), F.coalesce(F.max(latency), F.lit(0.0)).alias("latency_max"), F.when(mean > 0, 60 / mean).otherwise(0.0).alias("throughput_ppm"), F.count(F.lit(1)).alias("n"))


def stage_latency(df: DataFrame, by: list[str], run: str, order: str, stage: str, last_only: bool = False) -> DataFrame:
    """Mean latency of a stage; with `last_only` over the last image of each run alone."""
    if last_only:
        df = df.groupBy(*by, run).agg(F.max_by(F.coalesce(stage, F.lit(0.0)), order).alias(stage))
    return df.groupBy(*by).agg(F.avg(F.coalesce(stage, F.lit(0.0))).alias("stage_avg"))


def block_metrics(matches, n_gt, n_pred) -> Column:
    """mean_iou, matched, total_gt, total_pred, recall, precision of a page."""
    return let(_c(matches), lambda m: _block_metrics(m, _c(n_gt), _c(n_pred)))


def _block_metrics(m: Column, g: Column, p: Column) -> Column:
    n = F.size(m)
    total = F.aggregate(m, F.lit(0.0), lambda acc, x: acc + x["iou"])
    share = lambda d: F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))
    return F.struct(
        F.when(g == 0, F.when(p == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.try_divide(total, n.cast("double")), F.lit(0.0))).alias("mean_iou"),
        n.alias("matched"), g.alias("total_gt"), p.alias("total_pred"), share(g).alias("recall"), share(p).alias("precision"),
    )


def error_metrics(matches, n_gt, n_pred) -> Column:
    """As block_metrics but, without true errors, recall 1 and precision 0."""
    return let(block_metrics(matches, n_gt, n_pred), lambda m: _error_metrics(m, n_gt))


def _error_metrics(m: Column, n_gt) -> Column:
    return F.struct(m["mean_iou"].alias("mean_iou"), m["matched"].alias("matched"), F.when(_c(n_gt) == 0, 1.0).otherwise(m["recall"]).alias("recall"), F.when(_c(n_gt) == 0, 0.0).otherwise(m["precision"]).alias("precision"))


def _of_kind(errors: Column, kind: str) -> Column:
    """Boxes of the errors of one type."""
    return F.transform(F.filter(errors, lambda e: e["type"] == kind), lambda e: e["bbox"])


def error_f1(pred, gt, at_least: float = 0.5) -> Column:
    """Macro F1 over the known error types that either side has; each prediction takes the first free true error that overlaps enough. Arrays of structs of type and bbox."""
    pred, gt = _c(pred), _c(gt)
    none = F.array().cast("array<double>")
    scores = none
    for kind in ERROR_TYPES:
        p, g = _of_kind(pred, kind), _of_kind(gt, kind)
        n = F.size(p) + F.size(g)
        scores = F.concat(scores, F.when(n > 0, F.array(2.0 * F.size(greedy(p, g, at_least, policy="first")) / n)).otherwise(none))
    return let(scores, lambda s: F.coalesce(F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), F.size(s).cast("double")), F.lit(0.0)))


def order_metrics(pred, gt, gt_order=None, at_least: float = 0.05) -> Column:
    """kendall_tau, matched_blocks, total_gt_blocks: predictions in reading order take true boxes (overlap above `at_least`); their order is compared with the true ranks."""
    pred = _c(pred)
    seen = F.transform(reading_order(pred), lambda i: to_xyxy(F.get(pred, i)))
    order = F.lit(None).cast("array<int>") if gt_order is None else _c(gt_order)
    return let(visited(seen, corners(gt), order, at_least), lambda v: _order_metrics(v, F.size(_c(gt)), F.lit(False) if gt_order is None else F.size(order) == F.size(_c(gt))))


def _order_metrics(v: Column, n_gt: Column, known: Column) -> Column:
    n = F.size(v["visits"])
    return F.struct(F.when(known, tau_of(v["ranked"], n)).otherwise(tau_of(v["own"], n)).alias("kendall_tau"), n.alias("matched_blocks"), n_gt.alias("total_gt_blocks"))


def with_truth(preds: DataFrame, truth: DataFrame, missing: str = "skip", key: str = "image", seq: str | None = None) -> DataFrame:
    """Predictions with the truth of the same file name, else of the same stem (suffix dropped). Of several the last by `seq` counts, without it the largest of their rows.

    `missing`: `skip` drops pages without truth, `empty` keeps them with null
    columns of the truth (an empty text scores as such), `text` also drops an
    empty true text.
    """
    from docgauge.functions.text import file_name, stem

    cols = [c for c in truth.columns if c not in (key, seq)]
    order = F.struct(seq, *cols) if seq else F.struct(*cols)
    last = truth.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*cols), order).alias("__t"))
    name = preds.withColumn("__name", file_name(key)).withColumn("__stem", stem(key))
    by_name = last.select(F.col("__key").alias("__name"), F.col("__t").alias("__t1"))
    stems = truth.groupBy(stem(key).alias("__stem")).agg(F.max_by(F.struct(*cols), order).alias("__t2"))
    out = name.join(by_name, "__name", "left").join(stems, "__stem", "left").withColumn("__t", F.coalesce("__t1", "__t2"))
    if missing in ("skip", "text"):
        out = out.where("__t IS NOT NULL")
    taken = {c.lower() for c in preds.columns}
    out = out.select(*preds.columns, *[F.col("__t")[c].alias(f"gt_{c}" if c.lower() in taken else c) for c in cols])
    return out.where(F.coalesce(F.col("gt_text" if "text" in preds.columns else "text"), F.lit("")) != "") if missing == "text" else out


def evaluate(preds: DataFrame, truth: DataFrame, missing: str = "skip", normalized: bool = True) -> DataFrame:
    """One row per candidate: error rates over pages with truth, latency over all. `preds`: candidate, image, text, latency; `truth`: image, text."""
    pages = with_truth(preds, truth, missing)
    gt = F.coalesce("gt_text", F.lit(""))
    c, w = (cer_normalized, wer_normalized) if normalized else (cer, wer)
    accuracy = pages.groupBy("candidate").agg(mean_or_zero(c(F.col("text"), gt)).alias("cer"), mean_or_zero(w(F.col("text"), gt)).alias("wer"), F.count(F.lit(1)).alias("n_scored"))
    out = latency_summary(preds, ["candidate"]).join(accuracy, "candidate", "left")
    return out.select("candidate", "latency_avg", "latency_std", "latency_max", "throughput_ppm", "n", F.coalesce("cer", F.lit(0.0)).alias("cer"), F.coalesce("wer", F.lit(0.0)).alias("wer"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"))


def layout_pages(pages: DataFrame, pred: str = "pred", gt: str = "gt", order: str | None = None) -> DataFrame:
    """Per page: block and order metrics, flat."""
    rest = [c for c in pages.columns if c not in (pred, gt, order)]
    boxes = (corners(F.coalesce(c, F.array().cast(EMPTY_BOXES))).alias(n) for c, n in ((pred, "__p"), (gt, "__g")))
    p, g = F.col("__p"), F.col("__g")
    scored = pages.select(*rest, *([order] if order else []), *boxes).select(*rest, block_metrics(greedy(p, g), F.size(g), F.size(p)).alias("b"), order_metrics(p, g, order).alias("o"))
    return scored.select(*rest, "b.*", "o.kendall_tau", "o.matched_blocks", "o.total_gt_blocks")


def layout_summary(scored: DataFrame, by: list[str] | None = None, all_pages: bool = False) -> DataFrame:
    """Mean overlap over pages with a match, mean tau over pages with two; or both over all pages."""
    over = lambda test, x: F.col(x) if all_pages else F.when(test, F.col(x))
    return scored.groupBy(*(by or [])).agg(
        mean_or_zero(over(F.col("matched") > 0, "mean_iou")).alias("mean_iou"), mean_or_zero(over(F.col("matched_blocks") >= 2, "kendall_tau")).alias("mean_tau"),
        mean_or_zero("recall").alias("mean_recall"), mean_or_zero("precision").alias("mean_precision"),
        F.count_if(F.col("matched") > 0).alias("iou_pages"), F.count_if(F.col("matched_blocks") >= 2).alias("tau_pages"), F.count(F.lit(1)).alias("pages"),
    )
