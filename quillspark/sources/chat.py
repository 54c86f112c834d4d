"""A chat client over HTTP for :mod:`quillspark.operators.summaries`; picklable, a call is one POST."""

from __future__ import annotations

import importlib
import json
import os
import urllib.request
from dataclasses import dataclass


def _post(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.status, r.read()


@dataclass(frozen=True)
class ChatClient:
    """``complete(system, user)`` asks a chat-completions endpoint and returns the first answer's text.

    The key is read from the environment variable ``key_env`` of the task that calls, so it
    is in no plan; ``post`` names another transport as ``module:function``.
    """

    endpoint: str
    model: str
    key_env: str | None = None
    temperature: float = 0.0
    max_tokens: int = 1200
    timeout: float = 120.0
    post: str | None = None

    def complete(self, system: str, user: str) -> str:
        headers = {"Content-Type": "application/json"}
        key = os.environ.get(self.key_env or "")
        if key:
            headers["Authorization"] = f"Bearer {key}"
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}).encode()
        post = _post
        if self.post:
            module, _, name = self.post.partition(":")
            post = getattr(importlib.import_module(module), name)
        status, answer = post(self.endpoint.rstrip("/") + "/chat/completions", headers, body, self.timeout)
        if status != 200:
            raise OSError(f"status {status}")
        choices = json.loads(answer).get("choices") or [{}]
        return ((choices[0].get("message") or {}).get("content") or "").strip()
