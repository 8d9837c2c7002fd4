"""A client of chat-completion servers for model calls inside tasks, and a rate limit."""

from __future__ import annotations

import http.client
import json
import os
import threading
import time
from collections.abc import Callable
from urllib.parse import urlsplit

#: The longest wait that a server's Retry-After may ask for.
LONGEST_WAIT = 60.0


class Refused(Exception):
    """An answer that isn't 200; wait: seconds that the server asks for."""

    def __init__(self, status: int, told: str, wait: float):
        super().__init__(f"{status}: {told}")
        self.status, self.wait = status, wait


class ChatClient:
    """Posts payloads to `<base_url>/chat/completions`; each thread keeps its connection.

    The key is read in the worker from the environment variable that key_variable names, so it is in no plan and no task. An answer
    without choices or with a blank message is an error, as is a status other than 200; usage counts are passed on.
    """

    def __init__(self, base_url: str, key_variable: str | None = None, timeout: float = 120.0):
        self.base_url, self.key_variable, self.timeout = base_url.rstrip("/"), key_variable, timeout
        self.mine = threading.local()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "mine"}

    def __setstate__(self, state):
        self.__dict__ |= state | {"mine": threading.local()}

    def _post(self, body: bytes) -> tuple[int, str, bytes]:
        url = urlsplit(self.base_url)
        headers = {"Content-Type": "application/json"}
        if self.key_variable is not None:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        if getattr(self.mine, "connection", None) is None:
            kind = http.client.HTTPSConnection if url.scheme == "https" else http.client.HTTPConnection
            self.mine.connection = kind(url.netloc, timeout=self.timeout)
        try:
            self.mine.connection.request("POST", f"{url.path}/chat/completions", body, headers)
            r = self.mine.connection.getresponse()
            return r.status, r.headers.get("Retry-After") or "", r.read()
        except Exception:
            self.mine.connection.close()
            self.mine.connection = None
            raise

    def __call__(self, payload: dict) -> tuple[str, dict]:
        status, after, body = self._post(json.dumps(payload, ensure_ascii=False).encode())
        if status != 200:
            seconds = float(after) if after.replace(".", "", 1).isdigit() else 0.0
            raise Refused(status, body[:200].decode(errors="replace"), min(seconds, LONGEST_WAIT))
        answer = json.loads(body)
        first = next(iter(answer.get("choices") or ()), None)
        if first is None:
            raise ValueError("an answer without choices")
        content = (first.get("message") or {}).get("content")
        if not isinstance(content, str) or not content.strip():
            raise ValueError("an answer with an empty message")
        return content, answer.get("usage") or {}


class TokenBucket:
    """At most `rate` starts a second over time, and `burst` at once. Each task has its own: a cluster's rate is that times its running tasks."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or burst < 1:
            raise ValueError("a rate limit needs a positive rate and burst")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.lock, self.due = threading.Lock(), None

    def take(self) -> None:
        """Wait for a turn; turns are given in the order of asking."""
        with self.lock:
            now = self.clock()
            # `due` is when the bucket would be full again; it may lie `burst` turns ahead
            self.due = max(now, self.due if self.due is not None else now) + 1 / self.rate
            wait = self.due - self.burst / self.rate - now
        if wait > 0:
            self.sleep(wait)
