"""Dataset preparation: form lines, stratified samples, representative picks, text-line runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.geometry import union_box
from docgauge.functions.text import _c, word_count
from docgauge.operators import places


def signature_line(text, is_last, y1, height, default_height: int = 3542) -> Column:
    """A signature: the last line naming a person, or two words at most in the lowest 15 %."""
    return (_c(is_last) & _c(text).contains("Name:")) | ((word_count(text) <= 2) & (_c(y1) > 0.85 * F.coalesce(_c(height), F.lit(default_height))))


def drop_signatures(lines: DataFrame, page: str = "page", idx: str = "idx", text: str = "text", y1: str = "y1", height: str = "height") -> DataFrame:
    """`is_last` is told from all lines of a page, before any is dropped."""
    last = F.col(idx) == F.max(idx).over(Window.partitionBy(page))
    return lines.withColumn("__last", last).where(~signature_line(text, F.col("__last"), y1, F.col(height))).drop("__last")


def form_lines(forms: DataFrame, need_boxes: bool = False, strict_boxes: bool = True) -> DataFrame:
    """Lines of forms as `sources.read_forms` gives them: image, height, idx, text, bbox.

    Lines without text go. `need_boxes` drops lines without components and takes
    only handwriting; else those have zeros, and a form without a handwritten
    part gives all its lines.  `strict_boxes` skips components that lack an
    attribute; else what is missing is 0.
    """
    hw, own = F.col("handwritten-part")["line"], F.col("line")
    lines = forms.select("image", F.col("_height").alias("height"), F.posexplode(hw if need_boxes else F.coalesce(hw, own)).alias("idx", "l"))
    parts = F.flatten(F.transform(F.coalesce(F.col("l")["word"], F.array().cast(lines.schema["l"].dataType["word"].dataType)), lambda w: w["cmp"]))
    names = ("_x", "_y", "_width", "_height")
    if strict_boxes:
        parts = F.filter(parts, lambda p: F.lit(True) & p["_x"].isNotNull() & p["_y"].isNotNull() & p["_width"].isNotNull() & p["_height"].isNotNull())
    at = lambda p, n: F.coalesce(p[n], F.lit(0)).cast("double")
    boxes = F.transform(F.coalesce(parts, F.array().cast("array<struct<" + ",".join(f"{n}:int" for n in names) + ">>")), lambda p: F.array(at(p, "_x"), at(p, "_y"), at(p, "_x") + at(p, "_width"), at(p, "_y") + at(p, "_height")))
    out = lines.select("image", "height", "idx", F.col("l")["_text"].alias("text"), union_box(boxes).alias("bbox"), F.size(boxes).alias("n_parts")).where("coalesce(text, '') <> ''")
    return (out.where("n_parts > 0") if need_boxes else out).drop("n_parts")


def truth_pages(lines: DataFrame) -> DataFrame:
    """Lines -> true pages: blocks by (y1, x1), their ranks, and the text in that order."""
    order = F.array_sort(F.collect_list(F.struct(F.col("bbox")[1].alias("y"), F.col("bbox")[0].alias("x"), "idx", "text", "bbox")))
    return lines.groupBy("image").agg(order.alias("b")).select("image", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), F.transform("b", lambda x: F.struct(x["bbox"].alias("bbox"), x["text"].alias("text"), F.lit(1.0).alias("confidence"))).alias("blocks"), F.transform("b", lambda _, i: i.cast("int")).alias("reading_order"))


#: Values between two brackets that are ranked as they are.
RANKED = 200_000


def cut_points(df: DataFrame, *features: str) -> DataFrame:
    """One row: the order statistics at n // 3 and 2 n // 3 of each feature (null: 0), exact.

    Approximate quantiles bracket each place and counts tell how many values lie
    below the bracket; while it holds more than `RANKED` different rows and gets
    narrower, quantiles of its own values bracket it again.  Each round is one
    scan for all places, and only the last brackets' values are ranked in order.
    """
    x = {f: F.coalesce(F.col(f), F.lit(0)) for f in features}
    first = df.agg(F.count(F.lit(1)).alias("n"), *[c for f in features for c in (F.min(x[f]).alias(f"{f}_lo"), F.max(x[f]).alias(f"{f}_hi"))]).first()
    n = first.n
    if not n:
        return df.sparkSession.createDataFrame([[None] * 2 * len(features)], ", ".join(f"{f}_{s} {kind}" for f, kind in df.select(*[x[f].alias(f) for f in features]).dtypes for s in ("low", "high")))
    # each place: lowest and highest value that it can have, rows below, rows within
    at = {(f, side): (p, first[f"{f}_lo"], first[f"{f}_hi"], 0, n) for f in features for side, p in (("low", n // 3), ("high", 2 * n // 3))}
    while wide := [k for k, (_, lo, hi, _, held) in at.items() if held > RANKED and lo < hi]:
        within = {k: F.when(x[k[0]].between(at[k][1], at[k][2]), x[k[0]]) for k in wide}
        share = {k: (at[k][0] - at[k][3]) / at[k][4] for k in wide}
        near = df.agg(*[F.percentile_approx(within[k], [max(0.0, share[k] - 0.001), min(1.0, share[k] + 0.001)], 10_000).alias(f"{k[0]}_{k[1]}") for k in wide]).first()
        held = df.agg(*[c for k in wide for q in [near[f"{k[0]}_{k[1]}"]] for c in (F.count_if(x[k[0]] < q[0]).alias(f"{k[0]}_{k[1]}_a"), F.count_if(x[k[0]] <= q[1]).alias(f"{k[0]}_{k[1]}_b"))]).first()
        narrower = False
        for k in wide:
            (p, lo, hi, _, _), q, a, b = at[k], near[f"{k[0]}_{k[1]}"], held[f"{k[0]}_{k[1]}_a"], held[f"{k[0]}_{k[1]}_b"]
            if a <= p < b and (q[0], q[1]) != (lo, hi):
                at[k], narrower = (p, q[0], q[1], a, b - a), True
        if not narrower:
            break
    # what the brackets of a feature hold is ranked in the feature's own type, a scan for each feature
    out = None
    for f in features:
        own = [(i, side, *at[(f, side)]) for i, side in enumerate(("low", "high"))]
        held = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), x[f].alias("x"), x[f].between(lo, hi).alias("held")) for i, _, _, lo, hi, _, _ in own]), lambda v: v["held"])
        ranked = df.select(F.explode(held).alias("v")).groupBy("v.i", "v.x").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(Window.partitionBy("i").orderBy("x")))
        due = F.element_at(F.array(*[F.lit(p - below) for _, _, p, _, _, below, _ in own]), F.col("i") + 1)
        one = ranked.where(F.col("upto") > due).agg(*[F.min(F.when(F.col("i") == i, F.col("x"))).alias(f"{f}_{side}") for i, side, *_ in own])
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


def bucket(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """`features`: column -> letter. Adds `bucket`, as in dH_lM_cL: H from the high cut on, else L up to the low one, else M."""
    cuts = cut_points(df, *features)
    parts = [F.concat(F.lit(letter), F.when(F.coalesce(F.col(f), F.lit(0)) >= F.col(f"{f}_high"), "H").when(F.coalesce(F.col(f), F.lit(0)) <= F.col(f"{f}_low"), "L").otherwise("M")) for f, letter in features.items()]
    return df.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.concat_ws("_", *parts)).drop(*cuts.columns)


def diverse_sample(df: DataFrame, features: dict[str, str], target: int, key: Column) -> DataFrame:
    """One row of each bucket, in order of buckets, then others until `target`; `key` (unique) orders within a bucket and the fill."""
    if df.count() <= target:
        return df
    b = bucket(df, features).withColumn("__key", key)
    first = b.groupBy("bucket").agg(F.min("__key").alias("__key")).orderBy("bucket").limit(target)
    rest = b.join(first.select("__key"), "__key", "left_anti").orderBy("__key").limit(max(0, target))
    chosen = first.select("__key", F.lit(0).alias("__o"), F.col("bucket").alias("__b")).unionByName(rest.select("__key", F.lit(1).alias("__o"), F.lit("").alias("__b"))).orderBy("__o", "__b", "__key").limit(target)
    return b.join(chosen.select("__key"), "__key").drop("__key", "bucket")


def representative(df: DataFrame, score: str, seq: str, by: list[str] | None = None, ranked: int = places.RANKED) -> DataFrame:
    """Best, worst, median and, of more than five, the quartiles by `score` (null: 1), ties by `seq`; the same row may come twice. Adds `pick`.

    No group is sorted: brackets of counted values close in on the places of all
    groups (`places`).
    """

    def wanted(n: Column) -> Column:
        return F.array(*[F.struct(F.lit(name).alias("pick"), place.cast("long").alias("i"), (n > least).alias("there")) for name, place, least in (("best", F.lit(0), 0), ("worst", n - 1, 1), ("median", F.floor(n / 2), 2), ("lower", F.floor(n / 4), 5), ("upper", F.floor(3 * n / 4), 5))])

    return places.at_places(df, by or [], F.coalesce(F.col(score).cast("double"), F.lit(1.0)), seq, wanted, ranked)


def runs(profile: DataFrame, by: list[str], y: str, dark: str, least: int = 12) -> DataFrame:
    """Maximal runs of consecutive rows with `dark`: y1, y2 (exclusive), those of at least `least` rows."""
    w = Window.partitionBy(*by).orderBy(y)
    lit = profile.where(F.coalesce(F.col(dark), F.lit(False))).withColumn("__run", F.col(y) - F.row_number().over(w))
    out = lit.groupBy(*by, "__run").agg(F.min(y).alias("y1"), (F.max(y) + 1).alias("y2")).drop("__run")
    return out.where(F.col("y2") - F.col("y1") >= least)


def row_profile(pixels: DataFrame, by: list[str], y: str, value: str, gap: float = 0.95) -> DataFrame:
    """Rows of an image with more than (1 - gap) dark pixels."""
    return pixels.groupBy(*by, y).agg((F.count_if(F.col(value) < 128) > F.count(F.lit(1)) * (1 - gap)).alias("dark"))


def image_features(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Pixels (x, y, value) -> text_density, contrast (population deviation), estimated_lines."""
    whole = pixels.groupBy(*by).agg(F.avg((F.col("value") < 128).cast("double")).alias("text_density"), F.stddev_pop("value").alias("contrast"), (F.max("y") + 1).alias("height"))
    rows = pixels.groupBy(*by, "y").agg(F.avg((F.col("value") < 128).cast("double")).alias("r"))
    limit = rows.groupBy(*by).agg((F.avg("r") + 0.5 * F.stddev_pop("r")).alias("limit"))
    lines = rows.join(limit, by).groupBy(*by).agg(F.count_if(F.col("r") > F.col("limit")).alias("k"))
    return whole.join(lines, by).withColumn("estimated_lines", F.greatest(F.lit(1), F.floor(F.try_divide(F.col("k").cast("double"), F.col("height") * 0.02))).cast("int")).drop("k", "height")


#: Fixed value: what a page without a form says.
UNANNOTATED = "Ground truth not yet annotated. Populate text, blocks, reading_order manually."


def kept_lines(forms: DataFrame, signatures: bool = True, need_boxes: bool = False, strict_boxes: bool = True) -> DataFrame:
    """Lines of forms, without signatures unless `signatures`: whether a line is the last is told from all lines of the form that have text."""
    lines = form_lines(forms, need_boxes, strict_boxes)
    return lines if signatures else drop_signatures(lines.withColumn("y1", F.col("bbox")[1]), "image").drop("y1")


def truth_entries(images: DataFrame, forms: DataFrame, crops: DataFrame | None = None, handwritten: bool = False) -> DataFrame:
    """A true page for every image: that of the form with the image's stem, else an empty one with a note.

    `images`: image; `crops` (image, crop_bbox) moves boxes into the coordinates of the padded crop; `handwritten` drops
    signatures.  A left join by stem: forms and images are each scanned once.
    """
    from docgauge.functions.geometry import crop_offset
    from docgauge.functions.text import stem

    pages = truth_pages(kept_lines(forms, signatures=not handwritten)).withColumnsRenamed({"image": "__stem", "text": "__text", "blocks": "__blocks", "reading_order": "__order"})
    known = forms.select(F.col("image").alias("__stem"), F.lit(True).alias("__known"))
    out = images.select("image", stem("image").alias("__stem")).join(known, "__stem", "left").join(pages, "__stem", "left")
    if crops is not None:
        own = crops.groupBy("image").agg(F.max("crop_bbox").alias("__crop"))  # one crop an image
        out = out.join(own, "image", "left").withColumn("__blocks", F.transform("__blocks", lambda b: F.struct(crop_offset(b["bbox"], F.col("__crop")).alias("bbox"), b["text"].alias("text"), b["confidence"].alias("confidence"))))
    kind = dict(out.dtypes)["__blocks"]
    source = F.when(F.col("__known"), F.lit("handwritten-part" if handwritten else "iam-xml"))
    return out.select(
        "image", F.coalesce("__text", F.lit("")).alias("text"), F.coalesce("__blocks", F.array().cast(kind)).alias("blocks"), F.coalesce("__order", F.array().cast("array<int>")).alias("reading_order"),
        F.array().cast("array<struct<type:string,bbox:array<double>,description:string>>").alias("errors"), source.alias("_source"), F.when(F.col("__known").isNull(), F.lit(UNANNOTATED)).alias("_note"),
    )


def crop_rows(images: DataFrame, forms: DataFrame, signatures: bool = False, pad: int = 20) -> DataFrame:
    """Per image (image, width, height) the box around its handwritten lines, the sizes before and after cropping with `pad`, and its number of lines; images without form or boxes have none."""
    from docgauge.functions.geometry import padded_crop
    from docgauge.functions.text import stem

    lines = kept_lines(forms, signatures, need_boxes=True)
    side = lambda k, f: f(F.col("bbox")[k])
    boxes = lines.groupBy(F.col("image").alias("__stem")).agg(F.array(side(0, F.min), side(1, F.min), side(2, F.max), side(3, F.max)).alias("crop_bbox"), F.count(F.lit(1)).cast("int").alias("num_lines"))
    out = images.withColumn("__stem", stem("image")).join(boxes, "__stem").withColumn("__c", padded_crop("crop_bbox", F.col("width"), F.col("height"), pad))
    c = F.col("__c")
    size = lambda a, b: F.array(a.cast("int"), b.cast("int"))
    return out.select("image", F.transform("crop_bbox", lambda x: x.cast("int")).alias("crop_bbox"), size(F.col("width"), F.col("height")).alias("original_size"), size(c[2] - c[0], c[3] - c[1]).alias("cropped_size"), "num_lines", F.lit(not signatures).alias("filtered_signatures"))


def curated(manifest: DataFrame) -> DataFrame:
    """A manifest's rows as the curated one has them: features that are missing are 0."""
    return manifest.select("image", "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("text_density", "estimated_lines", "contrast")])


def both_modes(pages: DataFrame, mode: str) -> DataFrame:
    """Pages with the mode that each is run in; `both` runs each twice."""
    modes = {"both": ("handwriting", "fullform"), "handwriting": ("handwriting",), "fullform": ("fullform",)}
    if mode not in modes:
        raise ValueError(f"mode {mode!r} is none of {', '.join(modes)}")
    return pages.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes[mode]])))


def merged(left: Column, right: Column, fields: list[str]) -> Column:
    """A struct of `fields`: those of `right`, where it has them, over those of `left` (arrays, strings and numbers alike)."""
    return F.struct(*[F.coalesce(right[f], left[f]).alias(f) for f in fields])


def truth_of(truth: DataFrame, image: str, seq: str | None = None) -> DataFrame:
    """The first row of the truth for an image by `seq` (without it by the row itself), or none."""
    return truth.where(F.col("image") == image).orderBy(*([seq] if seq else truth.columns)).limit(1)
