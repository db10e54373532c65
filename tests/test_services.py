"""Connectors against a server on this machine."""

import base64
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest

from docgauge.operators import connectors, services


@pytest.fixture(scope="module")
def server():
    class Model(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/health" else 404)
            self.end_headers()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked = body["messages"][0]["content"]
            if isinstance(asked, str):
                said = 'Here:\n```json\n{"errors": [{"type": "spelling", "block_index": 1, "description": "d"}, {"block_index": 9}, {"block_index": null}]}\n```'
            else:
                said = f" {asked[0]['text']} {asked[1]['image_url']['url']}\n\n second line \n"
            answer = json.dumps({"choices": [{"message": {"content": said}}], "seen": body.get("temperature")}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_two_stages_over_http(spark, server):
    read = services.page_reader(services.posting(f"{server}/v1/chat"), "Read.", temperature=0.0)
    fn = services.two_stages(read, connectors.patient(services.error_finder(services.posting(f"{server}/v1/chat")), attempts=2, sleep=lambda s: None))
    pages = spark.createDataFrame([("a.png", bytearray(b"\x01\x02"))], "image string, content binary")
    row = connectors.parsed(connectors.infer(pages, fn, "c", healthy=services.reachable(f"{server}/health"))).first()
    assert row.text == "Read. data:image/png;base64,AQI=\n\n second line" and [b.text for b in row.blocks] == ["Read. data:image/png;base64,AQI=", "second line"]
    assert [(e.type, e.bbox) for e in row.errors] == [("spelling", [0, 0, 0, 0]), ("unknown", [0, 0, 0, 0]), ("unknown", [0, 0, 0, 0])]
    assert row._note is None and row.stage1_latency > 0 and row.stage2_latency > 0
    down = connectors.infer(pages, fn, "c", healthy=services.reachable(f"{server}/nothing")).first()
    assert "404" in down._note


def test_errors_of_answers():
    blocks = [{"bbox": [1, 2, 3, 4], "text": "t"}]
    assert services.errors_of('```\n{"errors": [{"type": "grammar", "block_index": 0}]}\n``` x', blocks) == [{"type": "grammar", "bbox": [1, 2, 3, 4], "description": ""}]
    assert services.errors_of("no json", blocks) == services.errors_of("[1]", blocks) == [] and services.errors_of('{"errors": [{"block_index": -1}]}', blocks)[0]["bbox"] == [0, 0, 0, 0]


@pytest.mark.parametrize("answer", ['{"errors": null}', '{"errors": 3}', '{"errors": {}}', '{"errors": "x"}', "null", "3", '"x"', "", "```json", '{"other": 1}'])
def test_odd_answers_give_no_errors(answer):
    assert services.errors_of(answer, [{"bbox": [1, 2, 3, 4], "text": "t"}]) == []


def test_odd_entries_of_answers():
    got = services.errors_of('{"errors": ["x", null, 4, {"type": 5, "block_index": true, "description": null}, {"type": "spelling", "block_index": 0.0}]}', [{"bbox": [1, 2, 3, 4], "text": "t"}] * 2)
    assert got == [{"type": "unknown", "bbox": [0, 0, 0, 0], "description": ""}, {"type": "spelling", "bbox": [0, 0, 0, 0], "description": ""}]


class Counting:
    """A server that tells when each call came and how many were under way at most; `fails` first answers of each page are 503."""

    def __init__(self, takes=0.0, fails=0):
        self.times, self.now, self.most, self.seen, lock = [], 0, 0, {}, threading.Lock()
        me = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with lock:
                    me.times.append(time.perf_counter())
                    me.now += 1
                    me.most = max(me.most, me.now)
                    me.seen[body["page"]] = me.seen.get(body["page"], 0) + 1
                    bad = me.seen[body["page"]] <= fails
                time.sleep(takes)
                with lock:
                    me.now -= 1
                self.send_response(503 if bad else 200)
                self.end_headers()
                self.wfile.write(json.dumps({"text": body["page"]}).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


def asking(url):
    send = services.posting(url)
    return lambda page: {**send({"page": page["image"]}), "stage2_latency": 0.0}


def test_rate_of_the_whole_cluster(spark):
    """Four workers, retries included: never more calls than the rate allows."""
    at = Counting(fails=1)
    pages = spark.createDataFrame([(f"{k:02}.png",) for k in range(24)], "image string").repartition(7)
    fn = connectors.patient(asking(at.url), attempts=3, sleep=lambda s: time.sleep(min(s, 0.01)))
    got = connectors.infer(pages, fn, "c", calls=connectors.Calls(per_minute=600, workers=4)).collect()
    assert sorted(r.text for r in got) == [f"{k:02}.png" for k in range(24)] and all(r._note is None for r in got) and len(at.times) == 48
    times = sorted(at.times)
    # 10 a second: a worker's calls are 0.4 s apart, so any second holds at most three of each
    assert max(sum(t <= u < t + 1 for u in times) for t in times) <= 12 and times[-1] - times[0] >= 0.85 * 47 / 10
    assert all(r.worker_mb > 1 and r.vram_mb is None for r in got)


def test_calls_at_once_stay_in_order(spark):
    slow = Counting(takes=0.25)
    pages = spark.createDataFrame([(f"{k:02}.png",) for k in range(24)], "image string").coalesce(1)
    got = connectors.infer(pages, asking(slow.url), "c", calls=connectors.Calls(at_once=8)).collect()
    assert [r.text for r in got] == [r.image for r in got] and slow.most <= 8
    # one after the other they would take 6 s
    assert max(slow.times) - min(slow.times) < 3 and all(r.latency >= 0.25 for r in got)


def test_latency_counts_retries_but_not_the_rate():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    def fn(page, n=[0]):
        n[0] += 1
        now[0] += 2.0
        if n[0] % 3:
            raise RuntimeError("503")
        return {"errors": [], "stage2_latency": 2.0}

    fn_ = connectors.patient(fn, per_minute=6, sleep=sleep, clock=lambda: now[0])
    assert fn_({})["stage2_latency"] == 20 + 2 and now[0] == 22  # attempts at 0, 10 and 20
    assert fn_({})["stage2_latency"] == 22 and now[0] == 52  # a wait of 8 until its turn counts for nothing
    assert fn_.paced and services.two_stages(lambda p: {}, fn_).paced


def test_document_service(spark):
    """From bytes to blocks: an image, and a file of seven pages asked for by threes."""

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            raw = base64.b64decode(body["rawDocument"]["content"]).decode().split("|")
            wanted = body.get("processOptions", {}).get("individualPageSelector", {}).get("pages", range(1, len(raw) + 1))
            chosen, text, pages = [raw[k - 1] for k in wanted if k <= len(raw)], "", []
            for said in chosen:
                anchor = {"textSegments": [{"startIndex": str(len(text)), "endIndex": str(len(text) + len(said))}] if text else [{"endIndex": str(len(said))}]}
                text += said
                poly = {"normalizedVertices": [{"x": 0.25}, {"x": 0.75, "y": 0.5}]}
                pages.append({"dimension": {"width": 200, "height": 80}, "blocks": [{"layout": {"textAnchor": anchor, "boundingPoly": poly, "confidence": 0.5}}, {"layout": {}}]})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"document": {"text": text, "pages": pages}}).encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    send = services.posting(f"http://127.0.0.1:{s.server_port}")
    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"p1|p2|p3|p4|p5|p6|p7"))], "image string, content binary")
    one = connectors.parsed(connectors.infer(files.where("image = 'a'"), services.document_reader(send), "d")).first()
    assert one.text == "one" and [(b.bbox, b.text, b.confidence) for b in one.blocks] == [([50, 0, 150, 40], "one", 0.5), ([0, 0, 0, 0], "", 0)]
    rows = services.document_pages(connectors.infer(files, services.document_reader(send, "application/pdf", 3), "d")).orderBy("image", "page").collect()
    assert [(r.image, r.page, r.text.strip(), len(r.blocks)) for r in rows] == [("a", 0, "one", 2), *(("b", k, f"p{k + 1}", 2) for k in range(7))]
    s.shutdown()
