"""Hand-derived results of the document operators, and their behaviour over DataFrames."""

from __future__ import annotations

import json
import sys
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry import queries
from quarry.functions import dom
from quarry.operators import batches, clients, grounding, udfs
from quarry.operators import html_ops as H
from quarry.plans import Pipeline, Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

PAGE = (
    "<!DOCTYPE html><html><head><title>Shop</title></head><body><nav><ul><li>Home</li><li>Cart</li></ul></nav>"
    '<div class="x"><h1>Lamp 300</h1><p class="d">A good lamp.</p><table><tr><th>K</th><th>V</th></tr><tr><td>Weight</td><td>2kg</td></tr><tr><td>Price</td><td>$49</td></tr></table>'
    '<div class="r"><h2>Reviews</h2><div class="one">Fine light</div></div></div><footer>(c) Shop</footer></body></html>'
)


def test_nodes():
    got = [(n["id"], n["xpath"], n["type"]) for n in H.nodes(PAGE)]
    assert got == [
        (0, "/html/head/title", "text"), (1, "/html/body/nav/ul", "atomic"), (2, "/html/body/div/h1", "text"), (3, "/html/body/div/p", "text"), (4, "/html/body/div/table", "atomic"),
        (5, "/html/body/div/div/h2", "text"), (6, "/html/body/div/div/div", "text"), (7, "/html/body/footer", "text"),
    ]
    assert [n["content"] for n in H.nodes(PAGE)][2:4] == ["<h1>Lamp 300</h1>", "<p>A good lamp.</p>"]


def test_nodes_edge_cases():
    assert H.nodes(None) == H.nodes(" ") == []
    assert [n["content"] for n in H.nodes("<div>a<p>bc</p>d e</div>")] == ["<p>bc</p>", "d e"]
    assert [n["type"] for n in H.nodes("<html><body><ul></ul></body></html>")] == ["atomic"]
    layout = "<html><body><table><tr><td>only one row</td></tr></table></body></html>"
    assert [(n["xpath"], n["content"]) for n in H.nodes(layout)] == [("/html/body/table/tr/td", "only one row")]
    assert [n["content"] for n in H.nodes("<html><body>one<br>two <b onclick=x>three</b></body></html>")] == ["one two <b>three</b>"]


@pytest.mark.parametrize("gone", ["<script>x</script>", "<style>x</style>", "<svg><p>x</p></svg>", '<p hidden>x</p>', '<p aria-hidden="true">x</p>', '<p style="display: none">x</p>', '<p style="opacity:0.5">x</p>', "<!--x-->"])
def test_clean_removes(gone):
    out = H.clean(f"<html><body><p>a</p>{gone}<p>b</p></body></html>")
    assert "x" not in out and "a" in out and "b" in out


def test_clean_rules():
    assert H.clean(None) == H.clean("  ") == ""
    assert H.structural_clean('<p onclick="x" class="k">a</p>') == '<p class="k">a</p>'
    assert H.structural_clean("<p>a<!--x-->b</p>") == "<p>ab</p>"
    assert H.structural_clean("<p>a<!--x-->b</p>", drop_tail=True) == "<p>a</p>"
    assert "<header>" in H.clean("<html><body><header>h</header><p>x</p></body></html>")


def test_leaves():
    assert [x["text"] for x in H.visible_leaves("<div><p>Same</p><p>Same</p>tail<script>no</script></div>")] == ["Same", "tail"]
    assert H.visible_leaves("<div><p>Same</p>tail</div>")[1]["xpath"].endswith("/div")
    assert [x["text"] for x in H.visible_leaves("<div>a<!--c-->b<i>cc</i></div>", min_length=2)] == ["cc"]
    assert H.visible_leaves("") == []


def test_index_and_grounding():
    index = H.search_index(PAGE)
    assert [e["ord"] for e in index] == list(range(len(index)))
    m = grounding.match("$49", index)
    assert (m["text"], m["score"]) == ("$49", 1.0) and m["xpath"].endswith("/td[2]")
    assert grounding.match("Lamp", index)["text"] == "Lamp 300"
    assert grounding.closest(PAGE, "2kg")["text"] == "2kg"
    values, paths = grounding.ground({"a": ["Fine light", None], "b": {"c": "Nokia"}}, index)
    assert values == {"a": ["Fine light", None], "b": {"c": None}} and paths["a"][1] is None and paths["b"]["c"] is None


def test_postprocess_branches():
    req = '{"price": "string"}'
    assert grounding.postprocess("", PAGE, req, True) == ('""', None, None)
    assert grounding.postprocess('{"answer": "49"}', PAGE, "How much?", True) == ('"49"', None, None)
    p, x, e = grounding.postprocess('{"price": "$49"}', PAGE, req, True)
    assert json.loads(p) == {"price": "$49"} and json.loads(x)["price"].endswith("td[2]") and e is None
    assert "__error__" in json.loads(grounding.postprocess('{"price": 1}', "", req, True)[0])
    assert "__error__" in json.loads(grounding.postprocess("[1, 2]", PAGE, req, True)[0])
    assert json.loads(grounding.postprocess('{"price": 1}', None, req, False)[0]) == {"price": 1}


def test_chunks():
    long = "<html><body>" + "".join(f"<p class='abcdefgh'>word{i} and more words here</p>" for i in range(200)) + "</body></html>"
    parts = H.chunk(long, 200)
    assert len(parts) > 3 and all("<body>" in p for p in parts) and 'class="abcde"' in parts[0]
    assert [w for p in parts for w in p.split() if "word" in w] != [] and sum(p.count("more words") for p in parts) == 200
    assert H.chunk("", 10) == [] and H.chunk("<p>x</p>", 100) == ["<p>x</p>"]


def test_rebuild():
    assert H.rebuild([("/html/body/p[2]", "x"), ("nope", "y")]) == "<html><head></head><body><p></p><p>x</p></body></html>"
    assert H.rebuild([("/html/body/a:b", "x")]) == "<html><head></head><body><a_b>x</a_b></body></html>"
    both = H.rebuild([("/html/body/p", "<b>x</b>"), ("/html/body/p", "y")])
    assert "<p><b>x</b>y</p>" in both
    kept = [[n for n in H.nodes(PAGE) if n["xpath"].endswith("h1")]]
    assert "Lamp 300" in H.merge(kept, PAGE) and "Reviews" not in H.merge(kept, PAGE)
    assert "Reviews" in H.merge([[]], PAGE) and "Reviews" in H.merge(None, PAGE)


def test_skeleton():
    chosen = [n for n in H.nodes(PAGE) if n["xpath"] == "/html/body/div/h1"]
    out = H.skeleton(PAGE, chosen)
    assert "Lamp 300" in out and "Reviews" not in out and H.skeleton(PAGE, []) == ""


class Flaky:
    def call(self, prompt, adapter=None, **options):
        if "bad" in prompt:
            raise RuntimeError("no")
        return prompt.upper()


def test_call_batch():
    seen = []
    assert clients.call_batch(Flaky(), ["a", "bad", "c"], callback=lambda i, r, e: seen.append((i, r, e is None))) == ["A", None, "C"]
    assert sorted(seen) == [(0, "A", True), (1, None, False), (2, "C", True)]
    assert clients.call_batch(Flaky(), list("abcde"), chunk_size=2) == list("ABCDE") and clients.call_batch(Flaky(), []) == []
    with pytest.raises(RuntimeError):
        clients.call_batch(Flaky(), ["bad"], raise_on_error=True)


def test_retries_and_options():
    tries = []

    @clients.with_retries(3, sleep=lambda s: None)
    def f():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError
        return "ok"

    assert f() == "ok" and len(tries) == 3
    assert clients.generation_options({"t": 0, "n": 5}, {"t": 1}, {"n": None}) == {"t": 1, "n": 5}
    assert clients.length_buckets([10, 500, 12, 11], 2) == [[0, 3], [2], [1]]


def _samples(spark, pages, requests):
    return spark.createDataFrame([(str(i), p, None if r.startswith("{") else r, r if r.startswith("{") else None) for i, (p, r) in enumerate(zip(pages, requests))], "id string, content string, query string, schema_model string")


class Failing(clients.HeuristicClient):
    def call(self, prompt, adapter=None, **options):
        if "FAIL" in prompt and adapter != "pruner":
            raise RuntimeError("no answer")
        return super().call(prompt, adapter, **options)


@pytest.mark.parametrize("parts", [1, 4])
def test_pipeline_rows_fail_alone(spark, parts):
    pages = [PAGE.replace("Lamp", f"Lamp{i}") for i in range(6)] + ["", PAGE.replace("Lamp", "FAIL"), None]
    schema = '{"heading": "string"}'
    df = _samples(spark, pages, [schema] * 5 + ["What heading?"] + [schema] * 3).repartition(parts)
    got = {r["id"]: r for r in Pipeline(factory=Failing).run(df).collect()}
    assert len(got) == 9
    assert json.loads(got["0"]["prediction"])["heading"] == "Lamp0 300" and "/h1" in json.loads(got["0"]["xpaths"])["heading"]
    assert json.loads(got["5"]["prediction"]) == "Lamp5 300" and got["5"]["xpaths"] is None
    assert got["6"]["status"] == got["7"]["status"] == got["8"]["status"] == "failed" and got["6"]["error"] and got["7"]["error"].endswith("Status.FAILED")


def test_pipeline_options(spark):
    df = _samples(spark, [PAGE], ['{"a": 1}'])
    off = Pipeline(prune_on=False, postprocess_on=False, settings=Settings(disable_chunking=True)).run(df).first()
    assert off["status"] == "success" and off["xpaths"] is None


def test_udfs_over_nulls(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "k int, html string")
    got = {r["k"]: r for r in df.select("k", udfs.clean_html("html").alias("c"), F.size(udfs.dom_nodes("html")).alias("n"), F.size(udfs.visible_leaves("html")).alias("l"), F.size(udfs.search_index("html")).alias("s")).collect()}
    assert got[1]["n"] == 8 and got[2]["c"] == "" and got[2]["n"] == got[3]["s"] == 0


MALFORMED = ["<p>a<![x[ b]]></p>", "</>", "<a '" * 3000, '<a x="' * 2001, '<a x=">"' * 2000, "<!--" * 500, "<![CDATA[" * 500, "<", "<b", "</b", "<p class='x>open</p><p>next</p>", "<b>" * 3000 + "x", "\x00<\x00>", "&#xFFFFFFFF;&#0;&bogus;"]


@pytest.mark.parametrize("page", MALFORMED)
def test_malformed_pages_raise_nothing(page):
    for f in (H.clean, H.structural_clean, H.nodes, H.visible_leaves, H.search_index, H.chunk):
        f(page)
    H.skeleton(page, [{"xpath": "/html"}])


def test_malformed_pages_keep_their_text():
    assert H.clean("<p>a<![x[ b]]></p>") == "<p>a</p>" and H.clean("</>") == "" and H.nodes("</>") == []
    assert "next" in H.clean("<p class='x>open</p><p>next</p>")
    assert H.clean("<div><svg/><p>x</p></div>").count("x") == 1
    assert dom.to_string(dom.parse("1 < 2 <b>x</b>", nested=True)) == "1 &lt; 2 <b>x</b>"
    assert dom.parse("<title>a<b>&amp;</title><p>", nested=True).elements()[0].text_content() == "a<b>&"


CUT_OFF = '<html><head><title>A&amp;B &copy; C&amp</title></head><body><h1>A&amp;B &copy; C&amp</h1><p><a href="?a=1&copy=2&amp;b=3">x &#65 &notit;</a></p></body></html>'


def test_references_end_in_a_semicolon():
    assert [x["text"] for x in H.visible_leaves(CUT_OFF)] == ["A&B \xa9 C&amp", "x A &notit;"]
    assert [n["content"] for n in H.nodes(CUT_OFF)] == ["A&B \xa9 C&amp", "<h1>A&amp;B \xa9 C&amp;amp</h1>", '<p><a href="?a=1&amp;copy=2&amp;b=3">x A &amp;notit;</a></p>']
    assert grounding.closest(CUT_OFF, "A&B \xa9 C&amp") == {"text": "A&B \xa9 C&amp", "xpath": "/html/body/h1", "sub_index": 0, "score": 1.0, "found": True}
    assert H.skeleton(CUT_OFF, [{"xpath": "/html/body/h1"}]) == "<html><body><h1>A&amp;B \xa9 C&amp;amp</h1></body></html>"


def test_clean_leaves_bare_ampersands():
    page = "<html><head><title>a&amp</title></head><body><p>b&am</p><p>&copy; c &amp; d & e&</p><p>f&<!--x-->amp; g&<svg></svg>#65 &bogus; &lt;</p></body></html>"
    kept = "<html><head><title>a&amp</title></head><body><p>b&am</p><p>\xa9 c &amp; d & e&</p><p>f&amp;amp; g&amp;#65 &bogus; &lt;</p></body></html>"
    assert H.clean(page) == H.structural_clean(page) == H.clean(kept) == kept
    assert dom.from_string(kept).text_content() == "a&ampb&am\xa9 c & d & e&f&amp; g&#65 &bogus; <"


def test_time_grows_with_length():
    for page in ("<a '" * 250_000, '<a x="' * 150_001, "<b>" * 20_000 + "<hr>" * 20_000 + "</i>" * 20_000, "<div>" * 20_000 + "word " * 2_000):
        began = time.time()
        H.clean(page)
        H.nodes(page)
        H.visible_leaves(page)
        H.search_index(page)
        assert time.time() - began < 10


def test_failing_rows_are_null():
    def f(x):
        return 1 // x

    assert udfs._each(f, pd.Series([1, 0, -1])).tolist() == [1, None, -1]


def test_failures_are_no_results(spark, tmp_path, monkeypatch):
    """A page that an operator fails on differs from one where nothing is found, and is not left out."""
    pages = [(1, "<html><body><h1>Lamp</h1></body></html>"), (2, "<html><body><h1>BROKEN</h1></body></html>"), (3, "<html><body></body></html>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))

    def failing(f):
        def run(html, *more):
            if "BROKEN" in html:
                raise ValueError("broken")
            return f(html, *more)

        return run

    for name, f in (("dom_nodes", H.nodes), ("visible_leaves", H.visible_leaves), ("search_index", H.search_index), ("match_value", grounding.closest)):
        monkeypatch.setattr(udfs, name, udfs.arrow_udf(udfs.MATCH if name == "match_value" else f"array<{ {'dom_nodes': udfs.NODE, 'visible_leaves': udfs.LEAF, 'search_index': udfs.ENTRY}[name] }>")(failing(f)))
    got = {r["page_id"]: tuple(r)[1:] for r in queries.match_value(spark, str(tmp_path)).collect()}
    assert got == {1: ("Lamp", "/html/body/h1", 0, 1.0, True), 2: (None,) * 5, 3: (None, None, None, 0.0, False)}
    for name in ("dom_nodes", "visible_leaves", "search_index"):
        rows = [tuple(r) for r in getattr(queries, name)(spark, str(tmp_path)).collect()]
        assert [r[0] for r in rows if r[0] != 1] == [2] and set(next(r for r in rows if r[0] == 2)[1:]) == {None}
    got = {r["page_id"]: r["skeleton"] for r in queries.skeleton_pages(spark, str(tmp_path)).collect()}
    assert got == {1: "<html><body><h1>Lamp</h1></body></html>", 2: None, 3: ""}


def test_chunks_that_fail_have_an_error(spark, monkeypatch):
    def fail(chunks):
        raise ValueError("broken")

    monkeypatch.setattr(udfs, "chunk_nodes", udfs.arrow_udf(f"array<struct<nodes: array<{udfs.NODE}>>>")(fail))
    row = Pipeline().run(_samples(spark, [PAGE], ['{"heading": "s"}'])).first()
    assert row["status"] == "failed" and "nodes" in row["error"]


def test_udfs_work_in_slices(spark):
    """A worker holds the results of a slice, not those of an Arrow batch."""
    kind = to_arrow_type(T._parse_datatype_string(f"array<{udfs.ENTRY}>"))
    pages = [PAGE] * 1000 + [f"<p>{'word ' * 100_000}</p>"] * 3 + [None, "", PAGE]
    parts = list(udfs.search_index.sliced(iter([(pa.array(pages),), (pa.array([], pa.string()),)]), kind))
    assert sum(map(len, parts)) == len(pages) and max(map(len, parts)) <= udfs.SLICE_ROWS
    assert all(len(p) == 1 or sum(len(e["chunk"]) for r in p.to_pylist() for e in r) < 10 * udfs.SLICE_CHARS for p in parts)
    assert [r for p in parts for r in p.to_pylist()] == [H.search_index(p) for p in pages]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string").coalesce(1).withColumn("n", F.size(udfs.search_index("html")))
    assert {r["k"]: r["n"] for r in df.select("k", "n").collect()} == {k: len(H.search_index(p)) for k, p in enumerate(pages)}


def test_pipeline_isolates_malformed_pages(spark):
    schema = '{"heading": "string"}'
    df = _samples(spark, [PAGE, *MALFORMED, "", None, PAGE], [schema] * (len(MALFORMED) + 4)).repartition(3)
    got = {int(r["id"]): r for r in Pipeline().run(df).collect()}
    assert len(got) == len(MALFORMED) + 4
    assert json.loads(got[0]["prediction"]) == json.loads(got[max(got)]["prediction"]) == {"heading": "Lamp 300", "title": "Shop"}
    assert got[2]["status"] == got[max(got) - 1]["status"] == got[max(got) - 2]["status"] == "failed" and "nothing is left" in got[2]["error"]


def test_prune_without_chunks(spark):
    df = _samples(spark, [PAGE, PAGE.replace("Lamp", "BROKEN")], ['{"heading": "s"}'] * 2)
    real = Pipeline().preprocess(df)
    broken = real.withColumn("chunks", F.when(F.col("content").contains("BROKEN"), F.lit(None)).otherwise(F.col("chunks")))
    got = {r["id"]: r for r in Pipeline.results(Pipeline().postprocess(Pipeline().extract(Pipeline().prune(broken)))).collect()}
    assert got["0"]["status"] == got["1"]["status"] == "success"


class Batch:
    """A batch client that fails whole where a prompt is bad."""

    def call_many(self, prompts, adapter=None, **options):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [f"{p}:{options.get('temperature')}" for p in prompts]


def test_batch_clients_fail_by_slot():
    seen = []
    assert clients.call_batch(Batch(), ["a", "bad", "c"], callback=lambda i, r, e: seen.append((i, r, e is None)), temperature=1) == ["a:1", None, "c:1"]
    assert seen == [(0, "a:1", True), (1, None, False), (2, "c:1", True)]
    assert clients.call_batch(Batch(), list("abcde"), chunk_size=2) == [f"{x}:None" for x in "abcde"]
    with pytest.raises(RuntimeError):
        clients.call_batch(Batch(), ["bad"], raise_on_error=True)


class Telling:
    def call(self, prompt, adapter=None, **options):
        return "[]" if adapter == "pruner" else json.dumps({"answer": f"{adapter} {options['temperature']} {options['max_tokens']}"})


def test_options_by_stage_and_own_stages(spark):
    df = _samples(spark, [PAGE], ["What?"])
    p = Pipeline.from_config({"options": {"qa": {"max_tokens": 9}}, "max_tokens": 300}, Telling)
    assert p.settings.max_tokens == 300 and json.loads(p.run(df).first()["prediction"]) == "qa 1.0 9"
    own = Pipeline(replaced={"prune": lambda d: d.withColumn("current_html", F.lit("<h1>mine</h1>"))})
    assert json.loads(own.run(df).first()["prediction"]) == "mine"
    assert clients.shared(Telling) is clients.shared(Telling)


def test_ordinals_and_batches(spark):
    df = spark.createDataFrame([(i, [5, 5, 900, 7, 5][i % 5] if i % 7 else 5) for i in range(200)], "k long, n long").repartition(5)
    got = {r["k"]: r["batch"] for r in batches.length_batches(df, "n", "k").collect()}
    order = sorted(range(200), key=lambda i: ([5, 5, 900, 7, 5][i % 5] if i % 7 else 5, i))
    lengths = [([5, 5, 900, 7, 5][i % 5] if i % 7 else 5) for i in order]
    want, at = {}, 0
    for group in clients.length_buckets(lengths):
        want |= {order[j]: at for j in group}
        at += len(group)
    assert got == want
    empty = df.where("k < 0")
    assert batches.with_ordinal(empty, "k").count() == batches.length_batches(empty, "n", "k").count() == 0
    nulls = spark.createDataFrame([(None,), (1,), (None,)], "k long")
    assert sorted(r["ordinal"] for r in batches.with_ordinal(nulls, "k").collect()) == [0, 1, 2]
