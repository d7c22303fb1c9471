"""Asks a running server from Python."""

from __future__ import annotations

import json
import urllib.request
from pathlib import Path
from typing import Any


def ask(server: str, input_data: str | Path, query: str | None = None, schema: Any = None, timeout: float = 300) -> dict:
    """The result of one page, address or HTML file."""
    return _post(f"{server.rstrip('/')}/process", _request(input_data, query, schema), timeout)


def ask_many(server: str, inputs: list[str | Path], query: str | None = None, schema: Any = None, timeout: float = 300) -> list[dict]:
    """Results in the order of the inputs, one request for all of them."""
    return _post(f"{server.rstrip('/')}/process_batch", [_request(x, query, schema) for x in inputs], timeout)


def _request(input_data: str | Path, query: str | None, schema: Any) -> dict:
    text = input_data.read_text(encoding="utf-8") if isinstance(input_data, Path) else input_data
    return {"input_data": text} | ({"query": query} if query else {}) | ({"schema_model": schema} if schema else {})


def _post(url: str, body: Any, timeout: float) -> Any:
    sent = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(sent, timeout=timeout) as r:
        return json.load(r)
