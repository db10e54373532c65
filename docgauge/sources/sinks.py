"""Writers of results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_results(df: DataFrame, path: str, by: str = "candidate_name") -> None:
    """JSON, a folder per candidate, replacing what is there."""
    df.withColumn("__by", F.col(by)).repartition("__by").write.mode("overwrite").partitionBy("__by").json(path)


def layout_report(summary: DataFrame, images: DataFrame, by: str = "candidate") -> DataFrame:
    """One row per candidate: summary and its images, in order. All of a candidate's images are in one row: for few of them; `save_documents` takes any number."""
    rest = [c for c in images.columns if c != by]
    rows = images.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("images"))
    return summary.select(by, F.struct(*[c for c in summary.columns if c != by]).alias("summary")).join(rows, by, "left")


def details_by_image(images: DataFrame, by: str = "candidate", image: str = "image") -> DataFrame:
    """One row per candidate: a map from image to its metrics, in one row: for few images; `save_documents` takes any number."""
    rest = [c for c in images.columns if c not in (by, image)]
    return images.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(image), F.struct(*rest)))).alias("per_image"))


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def result_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object, fields without a value included; times and other types as text."""
    return df.select(*[c for c, kind in df.dtypes if c in ("candidate", "candidate_name")], F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if kind in ("timestamp", "date") else F.col(c) for c, kind in df.dtypes]), {"ignoreNullFields": "false"}).alias(name))


def save_report(summary: DataFrame, images: DataFrame, path: str, by: str = "candidate") -> None:
    """A layout report as two folders of JSON, summary and images, in folders by candidate: no candidate's images are one row."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    images.repartition(by, F.pmod(F.xxhash64("image"), F.lit(64))).sortWithinPartitions(by, "image").write.mode("overwrite").partitionBy(by).json(f"{path}/images")


def save_documents(summary: DataFrame, images: DataFrame, folder: str, by: str = "candidate", image: str = "image", as_map: bool = False) -> DataFrame:
    """One JSON document per row of `summary`: {"summary": {...}, "images": [...]}, or with `as_map` {..., "per_image": {image: {...}}}, in order of images.

    However many images a candidate has, none of its rows is gathered: they are
    sorted by ranges into parts of lines, and a task per candidate copies the
    parts, a few megabytes at a time, into the document, which appears under its name
    only when complete.  Gives candidate, path, n; names follow from the candidate.
    """
    import uuid

    spark = images.sparkSession
    folder = folder.rstrip("/") if "://" in folder else "file://" + folder.rstrip("/")
    parts = f"{folder}/_parts-{uuid.uuid4().hex}"
    place = F.sha2(F.coalesce(F.col(by).cast("string"), F.lit("")), 256)
    rest = [c for c in images.columns if c != by and not (as_map and c == image)]
    row = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    name = F.substring(F.to_json(F.struct(F.coalesce(F.col(image).cast("string"), F.lit("")).alias("i"))), F.lit(6), F.length(F.to_json(F.struct(F.coalesce(F.col(image).cast("string"), F.lit("")).alias("i")))) - 6)
    lines = images.select(place.alias("place"), F.col(image).alias("at"), (F.concat(name, F.lit(": "), row) if as_map else row).alias("value"))
    lines.repartitionByRange("place", "at").sortWithinPartitions("place", "at").select("place", "value").write.partitionBy("place").option("lineSep", ",\n").text(parts)
    heads = summary.select(F.col(by).cast("string").alias("candidate"), place.alias("place"), F.to_json(F.struct(*[c for c in summary.columns if c != by]), {"ignoreNullFields": "false"}).alias("summary"))

    def join(batches):
        import re

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for candidate, own, head in zip(*(c.to_pylist() for c in b.columns)):
                store, root = fs.FileSystem.from_uri(folder)
                _, here = fs.FileSystem.from_uri(f"{parts}/place={own}")
                files = sorted(f.path for f in store.get_file_info(fs.FileSelector(here, allow_not_found=True)) if f.base_name.startswith("part-"))
                path, n = f"{root}/{re.sub('[^A-Za-z0-9._-]', '_', candidate or '')}-{own[:8]}.json", 0
                part = f"{path}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(part) as out:
                    out.write(f'{{"summary": {head}, '.encode() + (b'"per_image": {' if as_map else b'"images": ['))
                    last = b""  # two bytes stay back: the last row has no comma after it
                    for f in files:
                        with store.open_input_stream(f) as raw:
                            while block := raw.read(1 << 22):
                                n += block.count(b"\n")
                                block = (last or b"\n") + block
                                out.write(block[:-2])
                                last = block[-2:]
                    out.write(b"\n}}\n" if as_map else b"\n]}\n")
                store.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([candidate], pa.string()), pa.array([path]), pa.array([n], pa.int64())], ["candidate", "path", "n"])

    return heads.repartition(spark.sparkContext.defaultParallelism, "place").mapInArrow(join, "candidate string, path string, n long")
