"""Exact values of scalar functions, and properties."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import dom, jsonrepair
from quarry.functions import exprs as X
from quarry.operators import grounding


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def test_common_prefix(spark):
    d = "/html/body/div[1]"
    got = one(spark, *[X.common_prefix(a) for a in (arr(d + "/p[1]", d + "/p[2]", d + "/span"), arr("/a/b", "/c/d"), arr("/a/b/c"), arr(), arr(None, "", "a/b", "/a/c"))])
    assert got == (d, "/", "/a/b/c", "/", "/a")


def test_relative_path(spark):
    p = lambda a, b: X.relative_path(F.lit(a).cast("string"), F.lit(b))
    assert one(spark, p("/html/body/p", "/html/body"), p("/a", "/a"), p("/a/b", "/"), p(None, "/a"), p("/x/y", "/a"), p("/abc", "/a")) == ("/p", "/", "/a/b", "/", "/x/y", "/bc")


def test_text_forms(spark):
    assert one(spark, X.escape_quotes(F.lit("it's")), X.escape_quotes(F.lit(None).cast("string"))) == ("it\\'s", "")
    assert one(spark, X.display_text(F.lit("  a   b\n\tc ")), X.display_text(F.lit(None).cast("string"))) == ("a b c", "")
    assert one(spark, X.match_text(F.lit("Héllo,  World! it's")), X.match_text(F.lit(None).cast("string"))) == ("héllo world it s", "")


def test_requests(spark):
    c = lambda t: X.is_schema(F.lit(t).cast("string"))
    assert one(spark, *[c(t) for t in ('{"a": 1}', "[1]", "dict_keys(['a'])", "a: b, c: d", "What is it?", None, "")]) == (True, True, True, True, False, False, False)
    q, s = F.lit("").cast("string"), F.lit("{}")
    assert one(spark, X.effective_request(q, s), X.effective_request(F.lit("q"), s), X.effective_request(q, F.lit(None).cast("string"))) == ("{}", "q", None)
    assert one(spark, *[X.is_url(F.lit(t).cast("string")) for t in ("  https://x", "HTTP://x", "<p>http://x", None)]) == (True, False, False, False)


def test_chosen_indices(spark):
    c = lambda t: X.chosen_indices(F.lit(t).cast("string"))
    assert one(spark, *[c(t) for t in (None, "", "keep [2, 0,\n1]", "[]", "no list", "[a]", "[1, True]", "[3] [4]", "[1,]")]) == (None, None, [2, 0, 1], [], [], [], [1, 1], [3], [1])
    nodes = arr("a", "b", "c")
    pick = lambda *i: X.select_nodes(nodes, F.array(*[F.lit(x) for x in i]))
    assert one(spark, pick(2, 0, 2), pick(-1, 9), X.select_nodes(nodes, F.lit(None).cast("array<int>"))) == (["c", "a", "c"], [], ["a", "b", "c"])


def test_fill_prompt_keeps_slots_in_values(spark):
    assert one(spark, X.fill_prompt("{{x}} {query}|{content}", F.lit("{content}"), F.lit("{query}"))) == ("{x} {content}|{query}",)
    assert one(spark, X.fill_prompt("{query}", F.lit(None).cast("string"), F.lit(""))) == ("None",)


def test_listing(spark):
    node = lambda p, c: F.struct(F.lit(p).alias("xpath"), F.lit(c).alias("content"))
    got = one(spark, X.node_listing(F.array(node("/a/b/c", "it's"), node("/a/b", "t"))))[0]
    assert got == "The entire chunk is under: '/a/b'\n0 ('/c', 'it\\'s')\n1 ('/', 't')"


def test_fold_is_no_maximum(monkeypatch):
    from quarry.operators import grounding

    def kept(*entries):
        chunks = [f"{'w v u'[: 2 * o - 1]} {'x' * i}" for i, (_, o) in enumerate(entries)]
        scores = {c: s for c, (s, _) in zip(chunks, entries)}
        monkeypatch.setattr(grounding, "similarity", lambda c, _: scores[c])
        monkeypatch.setattr(grounding, "_most", lambda c, _: 1.0)
        index = [{"chunk": c, "norm_chunk": c, "norm_tokens": c.split(), "xpath": str(i), "sub_index": 0} for i, c in enumerate(chunks)]
        return int(grounding.match("w v u", index)["xpath"])

    assert [kept((0.5, 2), (0.9, 1)), kept((0.9, 1), (0.5, 2)), kept((0.5, 1), (0.5, 1))] == [0, 0, 1]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('say ```json\n{"a": [1, 2]}\n``` ok', {"a": [1, 2]}), ('x {"a": "b"} y', {"a": "b"}), ('{name: "test"', {"name": "test"}), ("{'a': 'b', c: True, d: None,}", {"a": "b", "c": True, "d": None}),
        ('{"a": [1, 2', {"a": [1, 2]}), ("no json", "no json"), (None, {}), ({"k": 1}, {"k": 1}),
    ],
)
def test_json(text, want):
    assert jsonrepair.extract(text) == want


def test_json_spread():
    assert jsonrepair.extract('{"b": "x", "n": 1, "a": "y"}', spread=True) == "xy"
    assert jsonrepair.extract("[1]", spread=True) == "[1]"


@given(st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=8), lambda s: st.lists(s, max_size=3) | st.dictionaries(st.text(max_size=4), s, max_size=3), max_leaves=8))
@settings(max_examples=60, deadline=None)
def test_valid_json_is_unchanged(value):
    assert jsonrepair.repair(json.dumps(value)) == value


@given(st.text(alphabet='{}[]",:ab1 \'\\\n', max_size=40))
@settings(max_examples=150, deadline=None)
def test_damage_never_raises_but_value_errors(text):
    jsonrepair.extract(text)


def test_deep_nesting():
    deep = '{"a": ' + "[" * 5000
    assert jsonrepair.extract(deep) == deep


def test_match_rules():
    entry = lambda c, x: {"chunk": c, "xpath": x, "sub_index": 0, "norm_chunk": c.lower(), "norm_tokens": c.lower().split()}
    idx = [entry("red shoe", "/a"), entry("red shoe", "/b"), entry("blue", "/c")]
    assert grounding.match("red shoe", idx)["xpath"] == "/b"
    assert grounding.match("Nokia", idx) == grounding.NOT_FOUND
    assert grounding.match("!!", idx)["found"] is False


def test_tree():
    assert dom.to_string(dom.from_string("<p>a<p>b")) == "<div><p>a</p><p>b</p></div>"
    assert dom.to_string(dom.parse("<p>a<p>b", nested=True)) == "<p>a<p>b</p></p>"
    page = dom.from_string("<!doctype html><title>t</title><p>x<br>y")
    assert dom.to_string(page) == "<html><head><title>t</title></head><body><p>x<br>y</p></body></html>"
    deep = "<div>" * 3000 + "x"
    assert dom.from_string(deep).text_content() == "x"
