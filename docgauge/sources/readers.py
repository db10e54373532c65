"""Readers, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions.text import file_name, stem

BLOCK = "struct<bbox:array<double>,text:string,confidence:double,reading_order:int,reading_order_rank:int,type:string,class:string>"
ERROR = "struct<type:string,bbox:array<double>,description:string>"
TRUTH = f"image string, text string, reading_order array<int>, blocks array<{BLOCK}>, errors array<{ERROR}>, _source string, _note string"
PREDICTION = f"candidate string, run int, image string, text string, blocks array<{BLOCK}>, reading_order array<int>, errors array<{ERROR}>, stage1_latency double, stage2_latency double, feedback string, _note string"
MANIFEST = "image string, path string, sha256 string, width int, height int, aspect_ratio double, text_density double, contrast double, estimated_lines int, writer_prefix string, error string"
CROPS = "image string, cropped string, crop_bbox array<int>, original_size array<int>, cropped_size array<int>, num_lines int, filtered_signatures boolean"
RESULT = (
    "candidate_name string, model_version string, model string, timestamp string, gpu_name string, vram_total_mb int, latency_total_avg double, latency_total_std double, latency_stage1_avg double, latency_stage2_avg double, "
    "character_error_rate double, word_error_rate double, reading_order_tau double, error_detection_f1 double, bounding_box_iou double, vram_peak_mb int, throughput_ppm double, ease_of_deployment int, api_stability int, sample_outputs array<string>, notes string"
)
_CMP = "struct<_x:int,_y:int,_width:int,_height:int>"
_LINE = f"struct<_text:string,word:array<struct<_id:string,_text:string,cmp:array<{_CMP}>>>>"
FORM = f"_id string, _height int, `handwritten-part` struct<line:array<{_LINE}>>, line array<{_LINE}>"


def images(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Images of a folder, not below it, suffix in any case; path, length and, if asked for, content."""
    df = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(jpe?g|png)$"))
    return df.select("path", file_name("path").alias("image"), "length", *(["content"] if content else []))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Images with lower-case suffixes but truth and manifest files, by suffix (jpg, jpeg, png) and name."""
    df = images(spark, path).withColumn("kind", F.array_position(F.array(F.lit("jpg"), F.lit("jpeg"), F.lit("png")), F.regexp_extract("image", r"\.([^.]+)$", 1)))
    return df.where((F.col("kind") > 0) & ~F.col("image").contains("ground_truth") & ~F.col("image").contains("manifest")).orderBy("kind", "image")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, or one object, per file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def document_images(spark: SparkSession, path: str, summary: str, image: str) -> DataFrame:
    """summary and image (structs of these types) of documents as `sinks.save_documents` writes them: a line an image, so that a document of any size is read in splits and never is a row."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.col("value").startswith('{"summary": ')  # rows have no space there
    heads = lines.where(head).select("path", F.from_json(F.concat("value", F.lit("]}")), f"struct<summary:{summary}>")["summary"].alias("summary"))
    rows = lines.where(F.col("value").startswith("{") & ~head).select("path", F.from_json(F.regexp_replace("value", ",$", ""), image).alias("image"))
    return rows.join(F.broadcast(heads), "path").select("summary", "image")  # a head for each document


def truth(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, TRUTH)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, PREDICTION)


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result files of all known shapes, as the superset of their fields; both time formats as a timestamp."""
    df = json_rows(spark, path, RESULT)
    return df.withColumn("at", F.coalesce(F.try_to_timestamp("timestamp"), F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")))).withColumn("model_version", F.coalesce("model_version", "model"))


def result_images(spark: SparkSession, path: str, image: str = "struct<image:string,text:string,cer:double,wer:double,latency_s:double>") -> DataFrame:
    """The per-image rows of result files; files without any, or that can't be read, give none."""
    return json_rows(spark, path, f"candidate string, images array<{image}>").where("images IS NOT NULL").select("candidate", F.explode("images").alias("i")).select("candidate", "i.*")


CURATED = "image string, path string, text_density double, estimated_lines int, contrast double, writer_prefix string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a data set: an image and its features, or an error, a row."""
    return json_rows(spark, path, MANIFEST)


def curated(spark: SparkSession, path: str) -> DataFrame:
    """A curated manifest in either form: with the writer's prefix, or with the contrast."""
    return json_rows(spark, path, CURATED)


def crops(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of cropped pages."""
    return json_rows(spark, path, CROPS)


def template(spark: SparkSession, path: str) -> DataFrame:
    """True pages from JSON files that may begin with lines of # comments, a file a row of `wholetext`."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?m)^#.*$", "").alias("json"))
    return text.select(F.explode(F.from_json("json", f"array<struct<{_colons(TRUTH)}>>")).alias("t")).select("t.*")


def _colons(schema: str) -> str:
    """`a int, b array<..>` as the fields of a struct type."""
    depth, fields, at = 0, [], 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            fields.append(schema[at:i].strip())
            at = i + 1
    return ",".join(f.replace(" ", ":", 1) for f in fields)


def superset(*frames: DataFrame, schema: str = RESULT) -> DataFrame:
    """Results of different shapes as rows of the superset of their fields; a model without version gives its name as the version."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    shaped = [f.select(*[(F.col(x.name) if x.name in f.columns else F.lit(None)).cast(x.dataType).alias(x.name) for x in fields]) for f in frames]
    out = shaped[0]
    for f in shaped[1:]:
        out = out.unionByName(f)
    return out.withColumn("model_version", F.coalesce("model_version", "model")) if {"model_version", "model"} <= set(out.columns) else out


def settings(spark: SparkSession, prefix: str = "docgauge.", **defaults: str) -> dict[str, str]:
    """Settings by name: the session's (`prefix` and name), else the environment's (name in capitals), else the default."""
    import os

    return {k: spark.conf.get(prefix + k, None) or os.environ.get(k.upper()) or v for k, v in defaults.items()}


def forms(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Forms in XML, one row each, with `recursive` also from folders below; `image` is the file's stem; of several files with a stem the first path counts."""
    df = spark.read.format("xml").option("rowTag", "form").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.xml").schema(FORM).load(path).withColumn("path", F.input_file_name())
    return df.withColumn("image", stem("path")).groupBy("image").agg(F.min_by(F.struct(*df.columns), "path").alias("f")).select("image", "f.*")
