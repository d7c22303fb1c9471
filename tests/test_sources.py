"""Inputs, results, streaming and the registered queries."""

from __future__ import annotations

import http.server
import os
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry import queries, sources, streaming
from quarry.plans import Pipeline

SMALL = "/root/testdata/sf0.001"


def test_literals_and_dicts(spark):
    got = sources.literals(spark, ["<p>x</p>", " http://a.b"], schema={"a": 1}).collect()
    assert [r["is_content_url"] for r in got] == [False, True] and got[0]["schema_model"] == '{"a": 1}' and got[0]["id"] != got[1]["id"]
    rows = sources.dicts(spark, [{"id": 7, "input_data": "<p>"}, {}]).collect()
    twice = sources.dicts(spark, [{"input_data": "<p>"}, {"input_data": "<p>"}]).collect()
    assert twice[0]["id"] != twice[1]["id"] and [r["ord"] for r in twice] == [0, 1]
    sample = sources.dicts(spark, [{"id": "s", "content": "http://not.asked", "is_content_url": False}]).first()
    assert sample["is_content_url"] is False and sample["content"] == "http://not.asked"
    assert rows[0]["id"] == "7" and rows[1]["content"] == "" and rows[1]["is_content_url"] is False and rows[1]["status"] == "pending"


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é</p>", encoding="utf-8")
    (tmp_path / "b.HTM").write_text("http://not.an.address")
    (tmp_path / "c.txt").write_text("no")
    got = sources.html_files(spark, str(tmp_path), "q").collect()
    assert sorted(r["content"] for r in got) == ["<p>é</p>", "http://not.an.address"] and not any(r["is_content_url"] for r in got)
    with pytest.raises(ValueError):
        sources.html_files(spark, str(tmp_path / "c.txt"))
    site = tmp_path / "site.com"
    site.mkdir()
    (site / "d.html").write_text("<p>d</p>")
    assert sources.html_files(spark, str(site)).count() == sources.html_files(spark, str(site / "d.html")).count() == 1


class _Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        ok = self.path == "/ok"
        self.send_response(200 if ok else 404)
        self.end_headers()
        self.wfile.write(b"<p>here</p>")

    def log_message(self, *a):
        pass


def test_fetch(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    df = sources.literals(spark, [f"{base}/ok", f"{base}/gone", "<b>kept</b>"], "q")
    got = {r["content"]: r["fetch_error"] for r in sources.fetch(df, 2).collect()}
    assert got["<p>here</p>"] is None and got["<b>kept</b>"] is None and got[""].startswith("[FETCH_ERROR]")
    inline = [r["content"] for r in sources.fetch(df, inline_errors=True).collect()]
    server.shutdown()
    assert any(c.startswith("[FETCH_ERROR]") for c in inline)


def test_results_written(spark, tmp_path):
    df = Pipeline().run(sources.literals(spark, "<html><body><h1>T</h1></body></html>", "What?").select("id", "content", "query", "schema_model"))
    sources.write_results(df, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    pages.limit(6).repartition(3).write.parquet(str(tmp_path / "in"))
    run = streaming.extract_stream(streaming.read_pages(spark, str(tmp_path / "in"), files_per_trigger=1), Pipeline(), '{"title": "s", "heading": "s"}', str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    df, want = queries.queries()[name](spark, SMALL), duck.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs_whole(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.where(F.col("status") == "success").count() == 50


def test_storage(spark):
    from quarry import storage

    with storage.scope():
        df = storage.written(spark.range(5).toDF("k"), "numbers")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))
    df = storage.written(spark.range(5).toDF("k"), "numbers")
    path = df.inputFiles()[0].removeprefix("file://")
    storage.drop(df)
    assert not os.path.exists(path)


def test_runtime(tmp_path, monkeypatch):
    import random

    from quarry import runtime

    runtime.seed(3)
    one = random.random()
    runtime.seed(3)
    assert random.random() == one
    runtime.log_to(str(tmp_path / "log")).info("here")
    assert "here" in (tmp_path / "log").read_text()
    runtime.log_to()
    monkeypatch.setenv("QUARRY_CLIENT", "remote")
    monkeypatch.setenv("QUARRY_URL", "http://x")
    assert runtime.from_environment().factory().url == "http://x"
    monkeypatch.setenv("QUARRY_CLIENT", "none")
    with pytest.raises(ValueError):
        runtime.from_environment()
