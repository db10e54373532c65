"""What the operators of this subpackage share: the folder that all machines see, written tables, whole files in that folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of up to so many rows are broadcast, after they have been counted; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset the context gets a temporary one on one machine (tests), and a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all machines share")
        # the setting can't be changed in a running session: the context keeps the folder
        root = spark.sparkContext._docgauge_dir = getattr(spark.sparkContext, "_docgauge_dir", None) or "file://" + tempfile.mkdtemp(prefix="docgauge-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it has ended, unless the session sets it: what comes next reads the written table.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read again: nothing upstream runs twice, and lost executors take nothing along."""
    path = shared_dir(df.sparkSession, name)
    if not df.sparkSession.conf.get(CLEANUP_SETTING, None):
        df.sparkSession.conf.set(CLEANUP_SETTING, "true")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS, merge: bool = False) -> DataFrame:
    """`df`, written; marked for broadcast if it is counted to have `rows` rows at most, with `merge` for a sort-merge join if it has more."""
    from pyspark.sql import functions as F

    df = written(df, name)
    if df.count() <= rows:
        return F.broadcast(df)
    return df.hint("merge") if merge else df


def distinct_sample(df: DataFrame, by: str, text: str, share, sample: int, name: str) -> DataFrame:
    """`by`, `text`: at most `sample` different texts for each value of `by`, those of least hash.

    `share` (a column) is what part of the rows is looked at: by hash, ahead of the
    exact cut, so no more than that is sorted; copies are joined in each task
    before they are moved, so a text that many rows hold is one.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    drawn = df.select(F.col(by).alias("by"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    drawn = drawn.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < share * 1_000_000)
    drawn = written(drawn.groupBy("by", "h").agg(F.min("text").alias("text")), name)
    least = drawn.select("by", "h").withColumn("at", F.row_number().over(Window.partitionBy("by").orderBy(F.xxhash64("h"), "h"))).where(F.col("at") <= sample)
    # `sample` rows for each value
    return drawn.join(F.broadcast(least.select("by", "h")), ["by", "h"], "left_semi").select(F.col("by").alias(by), F.col("text").alias(text))


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers stay while their executor does other work."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)


_held: dict[str, object] = {}


def sole_cache(name: str, clear) -> None:
    """Told by a Python worker that is about to fill a large cache: what other operators left in the same worker is dropped."""
    others = [x for x in _held if x != name]
    for other in others:
        _held.pop(other)()
    if others:
        import gc

        gc.collect()
        trim()
    _held[name] = clear


#: Bytes of an Arrow batch, unless the session sets its own: rows differ in length by a factor of a hundred thousand.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20


def ship(spark: SparkSession) -> None:
    """Puts this package on the executors' path, and bounds the bytes of the batches that Python workers get."""
    sc = spark.sparkContext
    if not spark.conf.get(BATCH_SETTING, None):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if getattr(sc, "_docgauge_shipped", False):
        return
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    to = tempfile.mkdtemp(prefix="docgauge-")
    sc.addPyFile(shutil.make_archive(f"{to}/docgauge", "zip", here, "docgauge"))
    sc._docgauge_shipped = True


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string; on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def file_system(uri: str):
    """(file system, path) of a URI; any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def make_dir(uri: str) -> str:
    store, path = file_system(uri)
    store.create_dir(path, recursive=True)
    return uri


class WholeFile:
    """A file that appears under its name only when complete, so a task that is lost or run twice leaves no half file."""

    def __init__(self, uri: str):
        self.store, self.path = file_system(uri)
        self.uri, self.temp = uri, f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.out = self.store.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.store.move(self.temp, self.path)
        else:
            self.store.delete_file(self.temp)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
