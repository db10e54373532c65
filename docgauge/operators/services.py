"""Connectors to services: a document service and a chat model over HTTP for pages, a chat model for writing errors, and two stages as one candidate.

A connector is a function of a page (a dict with image and content, or with text
and blocks) for `connectors.infer`; it runs in Python workers.  `send` posts a
JSON body and gives the parsed answer, so another transport can stand in.
"""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_PLACE = [0, 0, 0, 0]
ERRORS_PROMPT = """Find the writing errors in this transcription. Answer with a JSON object that has a list "errors"; each error has "type" ({types}), "block_index" (from 0) and "description".

Transcription:
{text}

Blocks:
{blocks}"""


def posting(url: str, timeout: float = 300, headers: dict[str, str] | None = None) -> Callable[[dict], dict]:
    """A transport: the body as JSON to `url`."""

    def send(body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())

    return send


def reachable(url: str, timeout: float = 5) -> Callable[[], None]:
    """For `infer(healthy=...)`: raises where the service's health address doesn't answer."""

    def ask() -> None:
        urllib.request.urlopen(url, timeout=timeout).close()

    return ask


def _said(answer: dict) -> str:
    return answer["choices"][0]["message"]["content"]


def page_reader(send: Callable[[dict], dict], prompt: str, mime: str = "image/png", **options) -> Callable[[dict], dict]:
    """A page's image to a chat model; its lines become blocks without a place. `options` go into the request."""

    def read(page: dict) -> dict:
        uri = f"data:{mime};base64,{base64.b64encode(page['content']).decode()}"
        parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": uri}}]
        began = time.perf_counter()
        text = _said(send({"messages": [{"role": "user", "content": parts}], **options})).strip()
        took = time.perf_counter() - began
        lines = [line.strip() for line in text.split("\n")]
        return {"text": text, "blocks": [{"bbox": NO_PLACE, "text": x, "confidence": 1.0} for x in lines if x], "stage1_latency": took}

    return read


def _in_fence(text: str) -> str:
    """What a ```json fence holds, else the first fence, else the text."""
    found = re.search(r"```json(.*?)(?:```|\Z)", text, re.S) or re.search(r"```(.*?)(?:```|\Z)", text, re.S)
    return found[1] if found else text


def errors_of(text: str, blocks: list[dict]) -> list[dict]:
    """The errors that an answer lists, placed by the block that they name; none where it can't be read."""
    try:
        answer = json.loads(_in_fence(text))
    except json.JSONDecodeError:
        return []
    listed = answer.get("errors") if isinstance(answer, dict) else None
    out = []
    for e in listed if isinstance(listed, list) else []:
        if not isinstance(e, dict):
            continue
        k, kind, said = e.get("block_index", -1), e.get("type", "unknown"), e.get("description", "")
        known = isinstance(k, int) and not isinstance(k, bool) and 0 <= k < len(blocks)
        out.append({"type": kind if isinstance(kind, str) else "unknown", "bbox": blocks[k]["bbox"] if known else NO_PLACE, "description": said if isinstance(said, str) else ""})
    return out


def error_finder(send: Callable[[dict], dict], prompt: str = ERRORS_PROMPT, **options) -> Callable[[dict], dict]:
    """A page's text and blocks to a chat model that lists writing errors. Wrap it in `connectors.patient` for rate and retries."""
    from docgauge.functions.parsers import ERROR_TYPES

    def find(page: dict) -> dict:
        blocks = page.get("blocks") or []
        listed = json.dumps([{"index": i, "bbox": list(b["bbox"]), "text": b["text"]} for i, b in enumerate(blocks)])
        asked = prompt.format(types=", ".join(ERROR_TYPES), text=page.get("text", ""), blocks=listed)
        began = time.perf_counter()
        text = _said(send({"messages": [{"role": "user", "content": asked}], **options}))
        return {"errors": errors_of(text, blocks), "stage2_latency": time.perf_counter() - began}

    return find


def _named(record: dict, name: str, default=None):
    """A field under its name with underscores or in one word with capitals: services use both."""
    first, *more = name.split("_")
    return record.get(name, record.get(first + "".join(x.capitalize() for x in more), default))


def document_blocks(document: dict, first_page: int = 0) -> list[dict]:
    """A service's document: blocks of all pages with their page, text by anchors, box and confidence."""
    text, out = document.get("text") or "", []
    for number, page in enumerate(document.get("pages") or [], first_page):
        size = _named(page, "dimension") or _named(page, "image") or {}
        for block in page.get("blocks") or []:
            layout = block.get("layout") or {}
            parts = _named(_named(layout, "text_anchor") or {}, "text_segments") or []
            corners = _named(_named(layout, "bounding_poly") or {}, "normalized_vertices") or []
            xs, ys = ([int(v.get(k, 0.0) * size.get(side, 0)) for v in corners] for k, side in (("x", "width"), ("y", "height")))
            box = [min(xs), min(ys), max(xs), max(ys)] if corners else NO_PLACE
            said = "".join(text[int(_named(p, "start_index") or 0) : int(_named(p, "end_index") or 0)] for p in parts)
            out.append({"page": number, "bbox": box, "text": said.strip(), "confidence": layout.get("confidence", 0.0)})
    return out


def document_reader(send: Callable[[dict], dict], mime: str = "image/png", pages_at_once: int = 15) -> Callable[[dict], dict]:
    """A file's bytes to a document service; files of many pages are asked for in runs of `pages_at_once`, until a run comes back short.

    Each block tells its page; `document_pages` makes a row of each.
    """

    def read(page: dict) -> dict:
        content, texts, blocks, first = base64.b64encode(page["content"]).decode(), [], [], 0
        began = time.perf_counter()
        while True:
            body = {"rawDocument": {"content": content, "mimeType": mime}}
            if not mime.startswith("image/") or first:
                body["processOptions"] = {"individualPageSelector": {"pages": list(range(first + 1, first + pages_at_once + 1))}}
            document = send(body).get("document") or {}
            texts.append(document.get("text") or "")
            blocks += document_blocks(document, first)
            got = len(document.get("pages") or [])
            first += got
            if got < pages_at_once or mime.startswith("image/"):
                return {"text": "".join(texts), "blocks": blocks, "stage1_latency": time.perf_counter() - began}

    return read


def document_pages(inferred: DataFrame) -> DataFrame:
    """What `connectors.infer` made with a `document_reader`: a row per page with blocks, in order: candidate, run, image, page, text, blocks."""
    kind = "array<struct<page:int,bbox:array<double>,text:string,confidence:double>>"
    by_page = inferred.select("candidate", "run", "image", F.posexplode(F.from_json("blocks", kind)).alias("at", "b"))
    # the blocks of a page are what one answer held
    rows = by_page.groupBy("candidate", "run", "image", F.col("b.page").alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", F.struct("b.bbox", "b.text", "b.confidence").alias("b")))).alias("r"))
    blocks = F.transform("r", lambda x: x["b"])
    return rows.select("candidate", "run", "image", "page", F.array_join(F.transform(blocks, lambda b: b["text"]), "\n").alias("text"), blocks.alias("blocks"))


def two_stages(read: Callable[[dict], dict], judge: Callable[[dict], dict]) -> Callable[[dict], dict]:
    """One candidate of two: what the second finds is laid over what the first read."""

    def run(page: dict) -> dict:
        first = read(page)
        return {**first, **judge({**page, **first})}

    run.paced = getattr(read, "paced", False) or getattr(judge, "paced", False)
    return run
