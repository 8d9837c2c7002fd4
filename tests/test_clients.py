"""The chat client against a local server: refusals, slow and broken answers, retries, order, concurrency and rate."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomwright.operators import clients, inference


class Server(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    lock, calls, busy, most, starts, keys = threading.Lock(), {}, 0, 0, [], set()

    def log_message(self, *_):
        pass

    def answer(self, status, body, **headers):
        raw = body.encode()
        self.send_response(status)
        for k, v in {"Content-Length": len(raw), **headers}.items():
            self.send_header(k.replace("_", "-"), str(v))
        self.end_headers()
        self.wfile.write(raw)

    def do_POST(self):  # noqa: N802
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
        with Server.lock:
            n = Server.calls[asked] = Server.calls.get(asked, 0) + 1
            Server.busy += 1
            Server.most = max(Server.most, Server.busy)
            Server.starts.append(time.monotonic())
            Server.keys.add(self.headers.get("Authorization"))
        kind = asked.split()[0]
        if kind == "slow":
            time.sleep(0.2)
        said = json.dumps({"choices": [{"message": {"content": json.dumps({"asked": asked}, ensure_ascii=False)}}], "usage": {"total_tokens": len(asked), "share": 0.5, "flag": True}}, ensure_ascii=False)
        with Server.lock:
            Server.busy -= 1
        if kind == "busy" and n == 1:
            self.answer(429, "later", Retry_After=0.3)
        elif kind == "down" and n < 3:
            self.answer(503, "down")
        elif kind == "never":
            self.answer(400, "bad request")
        elif kind == "junk":
            self.answer(200, "{")
        elif kind == "none":
            self.answer(200, '{"choices": []}')
        elif kind == "blank":
            self.answer(200, '{"choices": [{"message": {"content": " "}}]}')
        elif kind == "late":
            time.sleep(1.5)
            self.answer(200, said)
        else:
            self.answer(200, said)


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/"
    server.shutdown()


def run(spark, url, prompts, **options):
    Server.calls, Server.most, Server.starts = {}, 0, []
    steps = spark.createDataFrame([(k, p, "think") for k, p in enumerate(prompts)], "k long, prompt string, thought string").coalesce(1)
    return inference.complete(steps, clients.ChatClient(url, timeout=1.0), json.loads, "m", "s", **options).collect()


def test_statuses_and_retries(spark, url):
    nap = lambda s: time.sleep(min(s, 0.3))
    got = {r["prompt"]: r for r in run(spark, url, ["fine é", "busy", "down", "never", "junk", "none", "blank", "late"], tries=3, workers=4, sleep=nap)}
    assert {p: (r["status"], r["attempts"]) for p, r in got.items()} == {
        "fine é": ("success", 1), "busy": ("success", 2), "down": ("success", 3), "never": ("error", 3), "junk": ("error", 3), "none": ("error", 3), "blank": ("error", 3), "late": ("error", 3),
    }
    assert json.loads(got["fine é"]["answer"]) == {"asked": "fine é"} and got["fine é"]["usage"] == {"total_tokens": 6}
    assert "400: bad request" in got["never"]["error"] and "without choices" in got["none"]["error"] and "empty message" in got["blank"]["error"] and "imeout" in got["late"]["error"]


def test_concurrency_is_bounded_and_order_kept(spark, url):
    prompts = [f"slow {k}" if k % 2 else f"fine {k}" for k in range(48)]
    got = run(spark, url, prompts, workers=6)
    assert [r["prompt"] for r in got] == prompts and all(r["status"] == "success" for r in got)
    assert 1 < Server.most <= 6 and set(Server.calls.values()) == {1}


def test_rate_of_a_partition(spark, url):
    run(spark, url, [f"fine {k}" for k in range(21)], workers=8, rate=20.0, burst=3)
    assert Server.starts[-1] - Server.starts[0] >= 17 / 20.0


def test_token_bucket():
    now, slept = [0.0], []
    bucket = clients.TokenBucket(10.0, 2, lambda: now[0], slept.append)
    for _ in range(4):
        bucket.take()
    assert slept == pytest.approx([0.1, 0.2])
    now[0] = 5.0
    bucket.take()
    bucket.take()
    assert len(slept) == 2
    with pytest.raises(ValueError):
        clients.TokenBucket(0.0)


def test_the_key_is_read_in_the_worker(url, monkeypatch):
    import pickle

    client = pickle.loads(pickle.dumps(clients.ChatClient(url, "SOME_KEY")))
    with pytest.raises(KeyError):
        client({"messages": [{}, {"content": "fine"}]})
    monkeypatch.setenv("SOME_KEY", "k1")
    assert b"k1" not in pickle.dumps(client)
    client({"messages": [{}, {"content": "fine"}]})
    assert "Bearer k1" in Server.keys


def test_a_wait_that_a_server_asks_for():
    slept = []
    inference.call(lambda p: (_ for _ in ()).throw(clients.Refused(429, "", 20.0)), {}, json.loads, 2, slept.append)
    assert slept == [20.0]
