"""A thin HTTP front: GET /health, POST /process (one request), POST /process_batch (a list), answered by the pipeline.

``python -m quarry.server`` listens on QUARRY_HOST and QUARRY_PORT. A request has input_data and query or schema_model; answers come in the order of the requests.
"""

from __future__ import annotations

import json
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sources
from .plans import Pipeline


def process(spark: SparkSession, pipeline: Pipeline, requests: list[dict]) -> list[dict]:
    """Results of requests, in their order. The list is one HTTP body, so it is small."""
    if not requests:
        return []
    samples = sources.fetch(sources.dicts(spark, requests))
    got = pipeline.run_in_order(samples).withColumn("prediction", F.coalesce("prediction", F.lit("{}"))).collect()
    return [{"id": r["id"], "prediction": json.loads(r["prediction"]), "xpaths": json.loads(r["xpaths"]) if r["xpaths"] else None, "status": r["status"], "error": r["error"]} for r in got]


def serve(spark: SparkSession, pipeline: Pipeline | None = None, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""
    pipeline = pipeline or Pipeline()

    class Handler(BaseHTTPRequestHandler):
        def _say(self, code: int, body) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            up = spark.sparkContext._jsc is not None
            self._say((200 if up else 503) if self.path == "/health" else 404, {"status": "ok" if up else "down"})

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                if self.path == "/process_batch" and isinstance(body, list) and all(isinstance(x, dict) for x in body):
                    self._say(200, process(spark, pipeline, body))
                elif self.path == "/process" and isinstance(body, dict):
                    self._say(200, process(spark, pipeline, [body])[0])
                else:
                    self._say(422 if self.path in ("/process", "/process_batch") else 404, {"detail": "not a request"})
            except ValueError as e:
                self._say(422, {"detail": str(e)})
            except Exception as e:
                self._say(500, {"detail": str(e)})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


if __name__ == "__main__":
    from .runtime import from_environment, log_to

    log_to(os.environ.get("QUARRY_LOG"))
    serve(SparkSession.builder.appName("quarry").getOrCreate(), from_environment(), host=os.environ.get("QUARRY_HOST", "127.0.0.1"), port=int(os.environ.get("QUARRY_PORT", "8000"))).serve_forever()
