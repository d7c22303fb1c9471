"""The HTTP front."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest

from quarry.server import serve


def test_server(spark):
    server = serve(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(base + path, data)) as r:
            return json.load(r)

    page = "<html><head><title>T</title></head><body><h1>Big Lamp</h1><p>x</p></body></html>"
    assert call("/health") == {"status": "ok"}
    one = call("/process", {"input_data": page, "schema_model": '{"heading": "string"}'})
    assert one["prediction"]["heading"] == "Big Lamp" and one["status"] == "success" and one["xpaths"]["heading"]
    many = call("/process_batch", [{"id": "b", "input_data": page, "query": "Heading?"}, {"id": "a", "input_data": ""}])
    assert [m["id"] for m in many] == ["b", "a"] and many[0]["prediction"] == "Big Lamp" and many[1]["status"] == "failed"
    assert call("/process_batch", []) == []
    from quarry import client

    assert client.ask(base, page, "Heading?")["prediction"] == "Big Lamp"
    same = client.ask_many(base, [page, page, ""], schema={"heading": "string"})
    assert [m["status"] for m in same] == ["success", "success", "failed"] and same[0]["id"] != same[1]["id"]
    for path, body, code in (("/process", [1], 422), ("/nowhere", {}, 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            call(path, body)
        assert e.value.code == code
    server.shutdown()
