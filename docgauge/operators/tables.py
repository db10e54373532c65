"""Tables that are set aside: written to the folder that all machines share, so that plans stay short and nothing runs twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of the context on one machine, and a cluster is refused."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all machines share")
        root = sc._set_aside_dir = getattr(sc, "_set_aside_dir", None) or "file://" + tempfile.mkdtemp(prefix="docgauge-")
    return root.rstrip("/")


def set_aside(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
