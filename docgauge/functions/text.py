"""Text metrics as column expressions: normalisation, edit distances, error rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(v) with `value` worked out once: what stands several times in an expression would be worked out as often."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def normalize_text(text) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(text), SPACE, " "))


def words(text) -> Column:
    return F.filter(F.split(_c(text), SPACE), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text))


def _rate(distance: Column, pred_n: Column, gt_n: Column) -> Column:
    return F.when(gt_n == 0, F.when(pred_n > 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(distance.cast("double"), gt_n.cast("double")))


def distance(a, b) -> Column:
    """Levenshtein distance. Texts of one length are at most as far apart as they have places that differ, and at least
    as far as one's characters exceed the other's; where both say the same, the table of all pairs of characters is spared."""
    return let(F.struct(_c(a).alias("a"), _c(b).alias("b")), lambda v: _distance(v["a"], v["b"]))


def _distance(a: Column, b: Column) -> Column:
    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda n, x: n + f(x))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    most = total(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), lambda x: x)
    least = total(F.array_distinct(F.split(b, "")), lambda c: F.greatest(F.lit(0), count(b, c) - count(a, c)))
    within = let(F.struct(most.alias("most"), least.alias("least")), lambda d: F.when(d["most"] == d["least"], d["most"]).otherwise(F.levenshtein(a, b)))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), within).otherwise(F.levenshtein(a, b))


def cer(pred, gt) -> Column:
    """Character error rate: Levenshtein distance by length of the truth; may exceed 1. An empty truth gives 1, or 0 for an empty prediction."""
    pred, gt = _c(pred), _c(gt)
    return _rate(distance(pred, gt), F.length(pred), F.length(gt))


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word lists: each distinct word becomes one code point beyond the basic plane, then the built-in distance runs on strings."""
    return let(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("known")), lambda v: _coded_distance(v["a"], v["b"], v["known"]))


def _coded_distance(a: Column, b: Column, known: Column) -> Column:
    as_text = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 65536), 8, "0")), "UTF-32")), "")
    return F.levenshtein(as_text(a), as_text(b))


def wer(pred, gt) -> Column:
    return let(F.struct(words(pred).alias("p"), words(gt).alias("g")), lambda v: _rate(word_distance(v["p"], v["g"]), F.size(v["p"]), F.size(v["g"])))


def cer_normalized(pred, gt) -> Column:
    return let(F.struct(normalize_text(pred).alias("p"), normalize_text(gt).alias("g")), lambda v: cer(v["p"], v["g"]))


def wer_normalized(pred, gt) -> Column:
    return wer(normalize_text(pred), normalize_text(gt))


def text_anchor(text, segments) -> Column:
    """Slices of `text` put together; segments are structs of start_index and end_index, null or 0 for the text's start and end."""
    text = _c(text)
    end = lambda s: F.when(F.coalesce(s["end_index"], F.lit(0)) == 0, F.length(text)).otherwise(s["end_index"].cast("int"))
    start = lambda s: F.coalesce(s["start_index"], F.lit(0)).cast("int")
    return F.array_join(F.transform(_c(segments), lambda s: F.substring(text, start(s) + 1, F.greatest(end(s) - start(s), F.lit(0)))), "")


#: Suffixes and their types; anything else is image/png.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "bmp": "image/bmp", "tiff": "image/tiff"}


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))


def mime_type(path) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("image/png"))


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def sha_prefix(data, n: int = 16) -> Column:
    return F.left(F.sha2(_c(data), 256), F.lit(n))


def data_uri(content, mime: str = "image/png") -> Column:
    """Base64 without the line ends that the function puts in."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(_c(content)), "\r\n", ""))
