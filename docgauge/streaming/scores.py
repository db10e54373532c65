"""The same scores over a stream of predictions; the truth is a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.functions.text import cer_normalized
from docgauge.operators.scoring import with_truth


def scored(predictions: DataFrame, truth: DataFrame, missing: str = "skip") -> DataFrame:
    """Each prediction with its character error rate, as it arrives."""
    pages = with_truth(predictions, truth, missing)
    return pages.withColumn("cer", cer_normalized(F.col("text"), F.coalesce("gt_text", F.lit(""))))


def windowed(predictions: DataFrame, truth: DataFrame, at: str = "at", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean error rate and latency per candidate and window of event time; rows later than `late` are left out, and a window is given out once it is over."""
    pages = scored(predictions.withWatermark(at, late), truth)
    return pages.groupBy(F.window(at, width), "candidate").agg(F.avg("cer").alias("cer"), F.avg("latency").alias("latency_avg"), F.count(F.lit(1)).alias("n"))
