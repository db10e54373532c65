"""Queries whose way leads through files: what Spark derives from the tables is written to the shared folder and read again by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.operators import connectors, evaluation, prep
from docgauge.operators.tables import shared_folder
from docgauge.plans.catalogue import query
from docgauge.plans.fixtures import table
from docgauge.sources import images, readers, sinks


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _chunks(rows: DataFrame, key, head: str = "", size: int = 1000) -> DataFrame:
    """JSON arrays of about `size` rows each, a file each; `head` before them."""
    packed = rows.select(F.floor(key / size).alias("part"), F.to_json(F.struct(*rows.columns)).alias("j")).groupBy("part").agg(F.collect_list("j").alias("js"))
    return packed.select(F.concat(F.lit(head + "["), F.array_join("js", ",\n"), F.lit("]")).alias("value"))


def _save(text: DataFrame, path: str) -> str:
    text.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _pages(spark, d) -> DataFrame:
    """Documents as true pages."""
    k = F.col("doc_id")
    block = F.struct(F.array(*[(k % m).cast("double") for m in (7, 11, 13, 17)]).alias("bbox"), F.col("lang").alias("text"), ((k % 10) / 10).alias("confidence"))
    error = F.struct(F.lit("spelling").alias("type"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), (k % 5).cast("double")).alias("bbox"), F.lit("d").alias("description"))
    return table(spark, d, "documents").select(F.concat(F.lit("d"), k.cast("string"), F.lit(".png")).alias("image"), "text", F.array(F.lit(0), (k % 3).cast("int")).alias("reading_order"), F.array_repeat(block, (k % 4).cast("int")).alias("blocks"), F.when(k % 2 == 0, F.array(error)).alias("errors"), k.alias("k"))


def _flat(t: DataFrame) -> DataFrame:
    return t.select("image", F.sha2("text", 256).alias("sha"), F.col("reading_order")[1].alias("second"), F.size("blocks").alias("n"), F.get("blocks", F.lit(0))["bbox"][3].alias("y2"), F.get("errors", F.lit(0))["bbox"][3].alias("e4"))


_TRUTH_SQL = """SELECT 'd' || doc_id || '.png' AS image, sha256(text) AS sha, CAST(doc_id % 3 AS INTEGER) AS second, CAST(doc_id % 4 AS INTEGER) AS n,
CASE WHEN doc_id % 4 > 0 THEN (doc_id % 17)::DOUBLE END AS y2, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5)::DOUBLE END AS e4 FROM documents"""


@query(_TRUTH_SQL)
def truth_files(spark, d):
    """True pages written as JSON arrays and read again."""
    return _flat(readers.truth(spark, _save(_chunks(_pages(spark, d), F.col("k")), _folder(spark, "truth"))))


@query(_TRUTH_SQL)
def template_files(spark, d):
    """The same from templates that begin with lines of comments."""
    return _flat(readers.template(spark, _save(_chunks(_pages(spark, d), F.col("k"), "# How to fill in\n# [an array] follows\n"), _folder(spark, "template"))))


@query("""SELECT 'd' || doc_id AS image, source AS path, CAST(n_chars AS INTEGER) AS width, CASE WHEN doc_id % 9 = 0 THEN 'broken' END AS error, doc_id % 100 / 4.0::DOUBLE AS contrast,
CASE WHEN doc_id % 2 = 0 THEN lang END AS writer_prefix, CAST(doc_id % 31 AS INTEGER) AS num_lines, CAST(doc_id % 7 AS INTEGER) AS crop_x2 FROM documents""")
def manifest_files(spark, d):
    """A manifest, a curated one and one of crops, each written and read by its reader, joined by image."""
    k = F.col("doc_id")
    t = table(spark, d, "documents")
    image = F.concat(F.lit("d"), k.cast("string")).alias("image")
    whole = t.select(image, F.col("source").alias("path"), F.col("n_chars").cast("int").alias("width"), F.when(k % 9 == 0, "broken").alias("error"), k.alias("k"))
    curated = t.select(image, F.col("source").alias("path"), ((k % 100) / 4.0).alias("contrast"), F.when(k % 2 == 0, F.col("lang")).alias("writer_prefix"), k.alias("k"))
    crops = t.select(image, F.array(F.lit(0), F.lit(0), (k % 7).cast("int"), F.lit(9)).alias("crop_bbox"), (k % 31).cast("int").alias("num_lines"), k.alias("k"))
    m, c, h = (read(spark, _save(_chunks(x, F.col("k")), _folder(spark, "manifest"))) for read, x in ((readers.manifest, whole), (readers.curated, curated), (readers.crops, crops)))
    return m.select("image", "path", "width", "error").join(c.select("image", "contrast", "writer_prefix"), "image").join(h.select("image", "num_lines", F.col("crop_bbox")[2].alias("crop_x2")), "image")


@query("""SELECT n_name AS candidate_name, CASE WHEN n_nationkey % 2 = 0 THEN 'v' || n_regionkey ELSE 'm' || n_regionkey END AS model_version, n_nationkey / 8.0::DOUBLE AS character_error_rate,
CAST(epoch(make_timestamp(2026, 1 + n_nationkey % 12, 3, 4, 5, 6)) AS BIGINT) AS at FROM nation""")
def result_files(spark, d):
    """Results of both shapes and both forms of time, a folder per candidate, read as the superset of their fields."""
    k = F.col("n_nationkey")
    month = F.lpad((k % 12 + 1).cast("string"), 2, "0")
    at = F.concat(F.lit("2026-"), month, F.when(k % 2 == 0, "-03 04:05:06").otherwise("-03T04:05:06+00:00"))
    even = table(spark, d, "nation").select(F.col("n_name").alias("candidate_name"), F.when(k % 2 == 0, F.concat(F.lit("v"), F.col("n_regionkey").cast("string"))).alias("model_version"), F.when(k % 2 == 1, F.concat(F.lit("m"), F.col("n_regionkey").cast("string"))).alias("model"), (k / 8.0).alias("character_error_rate"), at.alias("timestamp"))
    path = _folder(spark, "results")
    sinks.save_results(even, path)
    return readers.results(spark, f"{path}/*").select("candidate_name", "model_version", "character_error_rate", F.unix_seconds("at").alias("at"))


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'c 1' ELSE 'd/2' END AS candidate, 'i' || event_id AS image, value AS cer, event_type AS text FROM events""")
def report_documents(spark, d):
    """A document of any number of images for each candidate, written by ordered parts and read again."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select(F.when(k % 3 == 0, "c 1").otherwise("d/2").alias("candidate"), F.concat(F.lit("i"), k.cast("string")).alias("image"), F.col("value").alias("cer"), F.col("event_type").alias("text"))
    path = _folder(spark, "reports")
    sinks.save_documents(rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.first("candidate").alias("name")), rows, path).collect()  # a row a candidate
    read = readers.document_images(spark, f"{path}/*.json", "struct<n:long,name:string>", "struct<image:string,cer:double,text:string>")
    return read.select(F.col("summary.name").alias("candidate"), "image.*")


def _suffixed(spark, d) -> DataFrame:
    """The pages' numbers as files with several suffixes; some are no images, or no data."""
    k = F.col("page_id")
    suffix = F.element_at(F.array(*map(F.lit, (".png", ".PNG", ".jpg", ".txt", ".jpeg"))), (k % 5 + 1).cast("int"))
    name = F.concat(F.when(k % 7 == 0, "ground_truth_").otherwise(""), F.lit("p"), k.cast("string"), suffix)
    return table(spark, d, "pages").select(name.alias("image"), F.encode(F.coalesce("url", F.lit("")), "UTF-8").alias("content"))


_NAMES_SQL = "SELECT CASE WHEN page_id % 7 = 0 THEN 'ground_truth_' ELSE '' END || 'p' || page_id || ['.png', '.PNG', '.jpg', '.txt', '.jpeg'][1 + page_id % 5] AS image, strlen(coalesce(url, '')) AS length, page_id FROM pages"


@query(f"SELECT image, length FROM ({_NAMES_SQL}) WHERE page_id % 5 <> 3")
def image_scan(spark, d):
    """Images of a folder, suffixes in any case."""
    path = _folder(spark, "scan")
    images.save_files(_suffixed(spark, d), path).write.format("noop").mode("overwrite").save()
    return readers.images(spark, path).select("image", "length")


@query(f"SELECT image, CAST(CASE page_id % 5 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS INTEGER) AS kind FROM ({_NAMES_SQL}) WHERE page_id % 5 NOT IN (1, 3) AND page_id % 7 <> 0")
def image_inventory(spark, d):
    """The same folder's images with lower-case suffixes, without files of truth."""
    path = _folder(spark, "inventory")
    images.save_files(_suffixed(spark, d), path).write.format("noop").mode("overwrite").save()
    return readers.inventory(spark, path).select("image", F.col("kind").cast("int").alias("kind"))


@query("""SELECT 'c' || conv_id AS image, count(*) AS n, max(turn) AS last, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(turn * 10 + 20) AS BIGINT) AS bottom FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def form_files(spark, d):
    """Conversations as forms in XML, a line a turn, in folders by conversation; found below the folder by their stems."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;"))
    y = (F.col("turn") * 10).cast("string")
    line = F.concat(F.lit('<line text="'), esc(F.col("text")), F.lit('"><word id="w" text="x"><cmp x="1" y="'), y, F.lit('" width="30" height="20"/></word></line>'))
    xml = table(spark, d, "conversations").where("trim(text) <> ''").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("ls"))
    files = xml.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".xml")).alias("image"), F.encode(F.concat(F.lit('<?xml version="1.0"?><form id="f" height="900"><handwritten-part>'), F.col("ls"), F.lit("</handwritten-part></form>")), "UTF-8").alias("content"))
    path = _folder(spark, "forms")
    images.save_files(files, f"{path}/below").write.format("noop").mode("overwrite").save()
    lines = prep.form_lines(readers.forms(spark, path, recursive=True))
    return lines.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.max("idx").cast("long").alias("last"), F.sum(F.length("text")).alias("chars"), F.max(F.col("bbox")[3]).cast("long").alias("bottom"))


@query("""SELECT url AS image, CAST(r AS INTEGER) AS run, CASE WHEN page_id % 7 = 3 THEN '' ELSE upper(url) END AS text, CASE WHEN page_id % 7 = 3 THEN 'ValueError: ' || page_id END AS note, CASE WHEN page_id % 7 = 3 THEN 0 ELSE 1 END AS n_blocks
FROM (SELECT page_id, coalesce(url, '') AS url FROM pages), range(2) k(r)""")
def inference_rows(spark, d):
    """A function of a page over all pages, twice, after a warm-up, with calls bounded over the cluster; pages that fail say why and stop nothing."""

    def fn(page):
        if page["page_id"] % 7 == 3:
            raise ValueError(str(page["page_id"]))
        return {"text": page["image"].upper(), "blocks": [{"bbox": [0, 0, 1, 1], "text": "t", "confidence": 1.0}]}

    p = table(spark, d, "pages").select(F.coalesce("url", F.lit("")).alias("image"), "page_id")
    done = connectors.infer(p, fn, "c", runs=2, warmup=3, healthy=lambda: None, calls=connectors.Calls(workers=4, at_once=2))
    return connectors.parsed(done).select("image", "run", "text", F.col("_note").alias("note"), F.size("blocks").alias("n_blocks"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY lpad(doc_id::VARCHAR, 12, '0') LIMIT 25")
def first_images(spark, d):
    """The first pages by name, before anything is asked of a model."""
    t = table(spark, d, "documents").select("doc_id", "n_chars", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("image"))
    return evaluation.first_images(t, 25).select("doc_id", "n_chars")


@query("SELECT source AS image, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE source = 'src1' AND r = 1")
def truth_of_an_image(spark, d):
    """The first true page of an image."""
    t = table(spark, d, "documents").select(F.col("source").alias("image"), "doc_id", "n_chars")
    return prep.truth_of(t, "src1", "doc_id")


@query(r"""WITH s AS (SELECT event_type AS candidate, avg(value) / 200 AS iou, sum(value) / 10000000 AS tau, max(value) AS lat, count(*) FILTER (value > 50) AS a, count(*) FILTER (value > 20) AS b, count(*) AS n FROM events GROUP BY event_type)
SELECT candidate, upper(candidate) || ' BBOX + READING ORDER RESULTS' || chr(10) || printf('  Mean Bbox IoU:     %.3f  (%d/%d images)', round(iou, 3), a, n) || chr(10) || printf('  Mean Kendall''s tau:  %.3f  (%d/%d images)', round(tau, 3), b, n) || chr(10) || printf('  Mean Latency:      %.2fs', round(lat, 2)) AS text FROM s""")
def summary_lines(spark, d):
    """What a console shows of each candidate's figures."""
    v = F.col("value")
    s = table(spark, d, "events").groupBy(F.concat("event_type", F.lit("_bbox")).alias("candidate")).agg(F.round(F.avg(v) / 200, 3).alias("mean_bbox_iou"), F.round(F.sum(v) / 10000000, 3).alias("mean_kendall_tau"), F.round(F.max(v), 2).alias("mean_latency_s"), F.count_if(v > 50).alias("images_with_bbox_matches"), F.count_if(v > 20).alias("images_with_tau"), F.count(F.lit(1)).alias("total_images"))
    return evaluation.summary_text(s).select(F.regexp_replace("candidate", "_bbox$", "").alias("candidate"), "text")


@query("""SELECT c_mktsegment AS candidate, '{"candidate":"' || c_mktsegment || '","n":' || count(*) || ',"note":null}' AS json FROM customer GROUP BY c_mktsegment""")
def result_objects(spark, d):
    """A row as one JSON object, fields without a value included."""
    return sinks.result_json(table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("candidate")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("note")))
