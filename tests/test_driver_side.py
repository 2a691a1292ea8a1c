import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from corpuslens.operations import Operations
from corpuslens.sources import providers as pv


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            if self.path == "/redirect":
                self.send_response(302)
                self.send_header("location", "/ok")
                self.end_headers()
                return
            status = {"/busy": 429, "/gone": 404}.get(self.path, 200)
            answer = b"x" * (pv.MOST_BYTES + 5) if self.path == "/big" else b"nonsense" if self.path == "/text" else json.dumps({"got": body}).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_post(server):
    assert pv.post(server + "/ok", {"a": 1}) == {"got": {"a": 1}}
    for path, code in {"/busy": "E_PROVIDER_BUSY", "/gone": "E_PROVIDER_NOT_FOUND", "/redirect": "E_PROVIDER_REDIRECT", "/big": "E_PROVIDER_TOO_LARGE", "/text": "E_PROVIDER_ANSWER"}.items():
        with pytest.raises(pv.ProviderError) as e:
            pv.post(server + path, {})
        assert e.value.code == code
    for url in ("http://example.org/x", "ftp://127.0.0.1/x"):
        with pytest.raises(pv.ProviderError):
            pv.post(url, {})


def test_judge_batches_halve():
    sizes = []

    def judge(batch):
        sizes.append(len(batch))
        if len(batch) > 2:
            raise pv.ProviderError("E_PROVIDER_TOO_LARGE")
        return [{"id": c["id"]} for c in batch]

    out = pv.judged_in_batches([{"id": i} for i in range(10)], judge)
    assert [o["id"] for o in out] == list(range(10)) and max(sizes) == 8 and sizes.count(2) == 5
    assert pv.judged_in_batches([{"id": 1}], lambda b: []) == [None]


def test_support():
    assert pv.supported("q", "c", ["e"], lambda *_: "supported", True) == "supported"
    assert pv.supported("q", "c", ["e"], lambda *_: "supported", False) == "unknown" and pv.supported("q", "c", ["e"], None, True) == "unknown"
    with pytest.raises(pv.ProviderError):
        pv.supported("q", "c", ["e" * 4_001], lambda *_: "supported", True)


def test_operations(spark):
    ops = Operations(spark)
    o = ops.start(lambda: spark.range(10).count())
    assert o.wait(60) == "done" and ops.get(o.id).result == 10
    bad = ops.start(lambda: 1 / 0)
    assert bad.wait(10) == "failed" and isinstance(bad.error, ZeroDivisionError)
    slow = ops.start(lambda: time.sleep(1) or 1)
    assert slow.wait(0.05) == "running"
    slow.cancel()
    assert slow.state == "cancelled"
    late = Operations(spark, deadline=0.1).start(lambda: time.sleep(1))
    time.sleep(0.2)
    assert late.wait(1) == "expired"
    with pytest.raises(KeyError):
        ops.get("x")
