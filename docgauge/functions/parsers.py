"""Parsers of model outputs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.geometry import bins, flat_quad, nested_quad, parse_box, scaled_ltrb, vertices
from docgauge.functions.text import _c, let, text_anchor

TRIM = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

#: Block tags, literal chat prefixes, error types, and the patterns of tagged blocks, bare lines, a chat's task
#: line, a page's header, a form's id and a trailing role.
TAGS = ("text", "table", "code", "formula", "chart", "figure", "caption", "list", "header", "footer", "section", "title")
PREFIXES = ("OCR with format: assistant\n", "OCR with format:\n", "OCR: assistant\n", "OCR:\n", "assistant\n")
ERROR_TYPES = ("capitalization", "spelling", "grammar", "punctuation", "structural")
TAGGED = rf"(?s)<({'|'.join(TAGS)})>\s*(\d+)>(\d+)>(\d+)>(\d+)>(.*?)</\1>"
BARE = r"^(\d+)>(\d+)>(\d+)>(\d+)>(.+)$"
TASK_LINE = r"(?s)\A.*?OCR(?:\s+with\s+format)?:?\s*(?:assistant\s*)?\n"
PAGE_HEADER = r"\ASentence Database\s*\n"
FORM_ID = r"\A[A-Ka-k]\d{2}-\d{3}[a-z]?\s*\n"
LAST_ROLE = r"(?i)\n\s*(?:assistant|user|system)\s*\z"


def strip(text) -> Column:
    return F.regexp_replace(_c(text), TRIM, "")


def line_blocks(text) -> Column:
    """Lines that aren't blank, as blocks with no place and confidence 1."""
    lines = F.filter(F.transform(F.split(_c(text), "\n"), strip), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.array(*[F.lit(0.0)] * 4).alias("bbox"), x.alias("text"), F.lit(1.0).alias("confidence")))


def zipped(*columns: str) -> Column:
    """Parallel lists as an array of structs, cut to the shortest."""
    n = F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    return F.slice(F.arrays_zip(*columns), F.lit(1), F.greatest(n, F.lit(0)))


def first_text(*texts) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(_c(t), F.lit("")) for t in texts], F.lit(""))


PARSED_SCHEMA = "struct<res:struct<parsing_res_list:array<struct<block_bbox:string,block_content:string>>>,parsing_res_list:array<struct<block_bbox:string,block_content:string>>>"


def document_blocks(result_json, require_box: bool = False) -> Column:
    """Blocks of a document-parse result in JSON: those with text; with `require_box` also with a box."""
    j = F.from_json(_c(result_json), PARSED_SCHEMA)
    items = F.coalesce(j["res"]["parsing_res_list"], j["parsing_res_list"], F.array().cast("array<struct<block_bbox:string,block_content:string>>"))
    kept = F.filter(items, lambda x: (F.coalesce(x["block_content"], F.lit("")) != "") & (F.coalesce(x["block_bbox"], F.lit("")) != "" if require_box else F.lit(True)))
    return F.transform(kept, lambda x: F.struct(parse_box(F.coalesce(x["block_bbox"], F.lit(""))).alias("bbox"), x["block_content"].alias("text")))


def document_text(result_json, markdown=None, plain=None) -> Column:
    """The blocks' texts, else the markdown, else the plain text."""
    blocks = F.array_join(F.transform(document_blocks(result_json), lambda b: b["text"]), " ")
    return strip(first_text(blocks, *[x for x in (markdown, plain) if x is not None]))


def _outer_lines(text: Column) -> Column:
    """The lines that start in no tagged block, to their ends, which may lie in one.

    Tagged blocks and what lies between them are walked in turn, with the line
    that is open, or null where the open line started in a block.
    """
    between = F.split(text, TAGGED, -1)
    inside = F.concat(F.regexp_extract_all(text, F.lit(TAGGED), F.lit(0)), F.array(F.lit("")))
    none = F.array().cast("array<string>")

    def add(acc, cur):
        return F.struct(cur.alias("cur"), acc["lines"].alias("lines"))

    def walk(acc, z, first):
        def outside(parts):
            open_ = F.when(first, parts[0]).otherwise(F.concat(acc["cur"], parts[0]))  # null stays null
            ended = F.concat(F.when(open_.isNull(), none).otherwise(F.array(open_)), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
            return F.when(F.size(parts) == 1, add(acc, open_)).otherwise(F.struct(F.element_at(parts, -1).alias("cur"), F.concat(acc["lines"], ended).alias("lines")))

        def block(st, parts):
            cur = F.when((st["cur"] == "") & (parts[0] != ""), F.lit(None).cast("string")).otherwise(F.concat(st["cur"], parts[0]))
            return F.when(F.size(parts) == 1, F.struct(cur.alias("cur"), st["lines"].alias("lines"))).otherwise(F.struct(F.lit(None).cast("string").alias("cur"), F.concat(st["lines"], F.when(cur.isNull(), none).otherwise(F.array(cur))).alias("lines")))

        return let(outside(F.split(z["a"], "\n", -1)), lambda st: block(st, F.split(z["b"], "\n", -1)))

    steps = F.transform(F.arrays_zip(between.alias("a"), inside.alias("b")), lambda z, i: F.struct(z["a"].alias("a"), z["b"].alias("b"), (i == 0).alias("first")))
    start = F.struct(F.lit(None).cast("string").alias("cur"), none.alias("lines"))
    return F.aggregate(steps, start, lambda acc, z: walk(acc, z, z["first"]), lambda acc: F.concat(acc["lines"], F.when(acc["cur"].isNull(), none).otherwise(F.array(acc["cur"]))))


def doctag_blocks(text, width, height) -> Column:
    """Tagged blocks, and bare coordinate lines that start in none, ordered by (y1, x1). A bare line never crosses a newline."""
    t = _c(text)
    got = [F.regexp_extract_all(t, F.lit(TAGGED), F.lit(k)) for k in range(1, 7)]
    tagged = F.transform(F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(got)]), lambda z: F.struct(bins(z["g1"], z["g2"], z["g3"], z["g4"], _c(width), _c(height)).alias("bbox"), strip(z["g5"]).alias("text"), F.lit(1.0).alias("confidence"), z["g0"].alias("type")))
    part = lambda x, k: F.regexp_extract(x, BARE, k)
    bare = F.transform(F.filter(_outer_lines(t), lambda x: x.rlike(BARE)), lambda x: F.struct(bins(part(x, 1), part(x, 2), part(x, 3), part(x, 4), _c(width), _c(height)).alias("bbox"), strip(part(x, 5)).alias("text"), F.lit(1.0).alias("confidence"), F.lit("header").alias("type")))
    blocks = F.filter(F.concat(tagged, bare), lambda b: b["text"] != "")
    keyed = F.transform(blocks, lambda b, i: F.struct(b["bbox"][1].alias("y"), b["bbox"][0].alias("x"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed, lambda p, q: F.when(p["y"] < q["y"], -1).when(p["y"] > q["y"], 1).when(p["x"] < q["x"], -1).when(p["x"] > q["x"], 1).otherwise(p["i"] - q["i"])), lambda k: k["b"])


def doctag_text(blocks, raw) -> Column:
    b = _c(blocks)
    return F.when(F.size(b) > 0, F.array_join(F.transform(b, lambda x: x["text"]), "\n")).otherwise(_c(raw))


def chat_cleanup(text) -> Column:
    """A chat model's transcription without its template: up to the first task line, else a literal prefix; page header, form id, trailing role."""
    raw = _c(text)
    cut = F.regexp_replace(raw, TASK_LINE, "")
    literal = raw
    chain = None
    for p in PREFIXES:
        then = strip(F.substring(raw, F.lit(len(p) + 1), F.length(raw)))
        chain = F.when(raw.startswith(p), then) if chain is None else chain.when(raw.startswith(p), then)
    out = F.when(cut != raw, cut).otherwise(chain.otherwise(literal))
    out = F.regexp_replace(out, PAGE_HEADER, "")
    out = F.regexp_replace(out, FORM_ID, "")
    return strip(F.regexp_replace(out, LAST_ROLE, ""))


ERRORS_SCHEMA = "struct<errors:array<struct<type:string,block_index:int,description:string>>>"


def fenced_json(text) -> Column:
    """What stands in a ```json fence, else in the first fence, else the text itself."""
    t = _c(text)
    return strip(F.when(t.contains("```json"), F.split_part(F.split_part(t, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1))).when(t.contains("```"), F.split_part(t, F.lit("```"), F.lit(2))).otherwise(t))


def listed_errors(text) -> Column:
    """The errors that a model lists in JSON; none where it can't be read."""
    return F.coalesce(F.from_json(fenced_json(text), ERRORS_SCHEMA)["errors"], F.array().cast("array<struct<type:string,block_index:int,description:string>>"))


def placed_errors(errors, blocks) -> Column:
    """Errors with the box of the block that they name; zeros for an index out of range."""
    b = _c(blocks)
    return F.transform(
        _c(errors),
        lambda e: F.struct(F.coalesce(e["type"], F.lit("unknown")).alias("type"), F.when(e["block_index"].between(0, F.size(b) - 1), F.get(b, e["block_index"])["bbox"]).otherwise(F.array(*[F.lit(0.0)] * 4)).alias("bbox"), F.coalesce(e["description"], F.lit("")).alias("description")),
    )


def chat_content(response) -> Column:
    return F.get_json_object(_c(response), "$.choices[0].message.content")


def prompt_blocks(blocks) -> Column:
    """The blocks as JSON for a prompt: index, bbox, text."""
    return F.to_json(F.transform(_c(blocks), lambda b, i: F.struct(i.alias("index"), b["bbox"].alias("bbox"), b["text"].alias("text"))))


def _block(bbox: Column, text: Column, confidence: Column) -> Column:
    return F.struct(bbox.alias("bbox"), text.alias("text"), confidence.cast("double").alias("confidence"))


def quad_blocks(quads, labels) -> Column:
    """Flat quads beside their labels (the shorter list ends both)."""
    q, t = _c(quads), _c(labels)
    n = F.least(F.size(q), F.size(t))
    return F.transform(F.slice(F.arrays_zip(q.alias("q"), t.alias("t")), F.lit(1), n), lambda z: _block(flat_quad(z["q"]), z["t"], F.lit(1.0)))


def nested_quad_blocks(regions) -> Column:
    """Structs of quad (4 x 2), text, confidence."""
    return F.transform(_c(regions), lambda r: _block(nested_quad(r["quad"]), r["text"], r["confidence"]))


def scaled_blocks(regions, width, height) -> Column:
    """Structs of left, upper, right, lower in 0..1, text, confidence."""
    return F.transform(_c(regions), lambda r: _block(scaled_ltrb(r["left"], r["upper"], r["right"], r["lower"], width, height), r["text"], r["confidence"]))


def word_blocks(words) -> Column:
    """A struct of parallel lists text, left, top, width, height, conf (in hundredths); blank words go."""
    w = _c(words)
    rows = F.transform(w["text"], lambda t, i: F.struct(strip(t).alias("t"), *[F.get(w[n], i).cast("double").alias(n) for n in ("left", "top", "width", "height", "conf")]))
    kept = F.filter(rows, lambda r: r["t"] != "")
    return F.transform(kept, lambda r: _block(F.array(r["left"], r["top"], r["left"] + r["width"], r["top"] + r["height"]), r["t"], r["conf"] / 100))


#: A cloud service's document: its text, and per page its size and blocks placed in the text and on the page.
CLOUD_SCHEMA = (
    "struct<text:string,pages:array<struct<dimension:struct<width:double,height:double>,blocks:array<struct<layout:struct<confidence:double,text_anchor:struct<text_segments:array<struct<start_index:int,end_index:int>>>,"
    "bounding_poly:struct<normalized_vertices:array<struct<x:double,y:double>>>>>>>>>"
)


def cloud_blocks(document_json) -> Column:
    """Blocks of all pages in order: text by anchors, stripped; boxes in pixels."""
    d = F.from_json(_c(document_json), CLOUD_SCHEMA)
    none = F.array().cast("array<struct<start_index:int,end_index:int>>")
    points = F.array().cast("array<struct<x:double,y:double>>")

    def one(b, p):
        at = b["layout"]
        return _block(vertices(F.coalesce(at["bounding_poly"]["normalized_vertices"], points), p["dimension"]["width"], p["dimension"]["height"]), strip(text_anchor(d["text"], F.coalesce(at["text_anchor"]["text_segments"], none))), at["confidence"])

    return F.flatten(F.transform(d["pages"], lambda p: F.transform(p["blocks"], lambda b: one(b, p))))
