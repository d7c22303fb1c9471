"""The registered queries of the extraction operators and their DuckDB SQL, each over its whole table.

Queries whose input isn't pages run an operator's expression on stand-in data: they check the expression, not extraction quality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import batches, udfs
from .plans import Pipeline

SCHEMA_REQUEST = '{"title": "string", "heading": "string"}'
_QUESTION = "What is the heading of this page?"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Every page: even ids ask with a schema, odd ones with a question."""
    even = F.col("page_id") % 2 == 0
    return _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("content"), F.when(~even, F.lit(_QUESTION)).alias("query"), F.when(even, F.lit(SCHEMA_REQUEST)).alias("schema_model"))


def scan_pages_url_flag(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", X.is_url(F.col("url")).alias("url_is_url"), X.is_url(F.col("html")).alias("html_is_url"))


def broadcast_request(spark: SparkSession, d: str) -> DataFrame:
    query = F.when(F.col("page_id") % 2 == 1, F.lit(_QUESTION)).otherwise(F.lit(""))
    return _t(spark, d, "pages").select("page_id", X.effective_request(query, F.lit(SCHEMA_REQUEST)).alias("request"))


def normalize_for_match(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", X.match_text(F.col("text")).alias("norm"))


def normalize_display(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", X.display_text(F.col("text")).alias("shown"))


def schema_classifier(spark: SparkSession, d: str) -> DataFrame:
    said = _t(spark, d, "conversations").select(F.lit("conversation").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("request"))
    docs = _t(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("request"))
    props = _t(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("request"))
    return said.unionAll(docs).unionAll(props).select("kind", "id", X.is_schema(F.col("request")).alias("is_schema"))


def route_adapter(spark: SparkSession, d: str) -> DataFrame:
    response = F.when(F.col("turn") % 5 == 4, F.lit(None).cast("string")).otherwise(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", X.adapter(F.col("text")).alias("adapter"), X.answer_status(response).alias("status"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", "^https?://[^/]*(/[^?#]*)", 1)
    return _t(spark, d, "pages").select("page_id", path.alias("path"), F.regexp_extract("url", "^https?://[^/]*/([^/?#]*)", 1).alias("section"))


def xpath_common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Of all places of links on each page, the part they share."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return _t(spark, d, "pages").select("page_id", X.common_prefix(F.concat(links, F.array(F.regexp_extract("url", "^https?://[^/]*(/[^?#]*)", 1)))).alias("prefix"))


def xpath_relative(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", X.relative_path(F.col("path"), F.concat(F.lit("/"), F.col("section"))).alias("relative"))


def escape_and_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each page that lists all its links: their places and texts."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">[^<]*</a>'), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    nodes = F.zip_with(links, texts, lambda x, t: F.struct(x.alias("xpath"), F.concat(F.lit("it's "), t).alias("content")))
    prompt = X.fill_prompt("Q {query}\n{content}", F.lit("which {content}?"), X.node_listing(nodes))
    return _t(spark, d, "pages").select("page_id", X.chat_suffix(prompt).alias("prompt"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    k, w = F.col("doc_id"), F.col("n_chars") % 7
    listed = F.concat(F.lit("Keep: ["), w.cast("string"), F.lit(", "), (k % 5).cast("string"), F.lit(", -1, 99] as asked"))
    said = F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 == 1, F.lit("none of them")).when(k % 6 == 2, F.lit("[one, 2]")).when(k % 6 == 3, F.lit("[]")).otherwise(listed)
    return _t(spark, d, "documents").select("doc_id", F.split(F.col("lang"), "").alias("letters"), said.alias("response"))


def parse_indices(spark: SparkSession, d: str) -> DataFrame:
    got = X.chosen_indices(F.col("response"))
    return _responses(spark, d).select("doc_id", got.isNull().alias("keep_all"), F.array_join(F.transform(got, lambda i: i.cast("string")), ",").alias("indices"))


def select_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The words of each document that a response chooses, in its order."""
    words = F.split(X.display_text(F.col("text")), " ")
    both = _responses(spark, d).join(_t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return both.select("doc_id", F.array_join(X.select_nodes(words, X.chosen_indices(F.col("response"))), "|").alias("kept"))


def regroup(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that are kept of all chunks of a document: here lines are chunks, words their nodes, and each answer asks for the second and the first."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.split(x, " "))
    asked = F.transform(lines, lambda x: F.when(F.size(x) > 2, F.lit("[1, 0]")).otherwise(F.lit("none")))
    return _t(spark, d, "documents").select("doc_id", F.array_join(X.kept_nodes(lines, asked), " ").alias("kept"))


def micro_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = batches.with_ordinal(_t(spark, d, "documents").select("doc_id"), "doc_id")
    return rows.select("doc_id", batches.micro_batch(F.col("ordinal"), 4).alias("batch"))


def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Batches of prompts by length, over the whole table: at most 8, none much longer than the batch's longest."""
    rows = _t(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))
    return batches.length_batches(rows, "n_chars", "doc_id").select("doc_id", "batch")


def json_spread(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('Here: ```json\n{"b": "'), F.col("event_type"), F.lit('", "n": 1, "a": "'), F.col("user_id").cast("string"), F.lit('"}\n``` done'))
    return _t(spark, d, "events").select("event_id", udfs.spread_json(text).alias("spread"))


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("{kind: '"), F.col("event_type"), F.lit("', id: "), F.col("event_id").cast("string"))
    return _t(spark, d, "events").select("event_id", udfs.repair_json(text).alias("repaired"))


def result_envelope(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    status = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "success").otherwise("failed")
    pred = F.when(F.col("toxic") == 1, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('"}')))
    return docs.select("doc_id", "lang").join(labels, "doc_id", "left").select("doc_id", X.result_prediction(pred).alias("prediction"), status.alias("status"), X.result_error(status).alias("error"))


def clean_html(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", udfs.clean_html("html").alias("clean"))


def dom_nodes(spark: SparkSession, d: str) -> DataFrame:
    return udfs.exploded(_t(spark, d, "pages"), udfs.dom_nodes("html"), "page_id").select("page_id", "item.*")


def visible_leaves(spark: SparkSession, d: str) -> DataFrame:
    return udfs.exploded(_t(spark, d, "pages"), udfs.visible_leaves("html"), "page_id").select("page_id", "pos", "item.xpath", "item.text")


def chunk_html(spark: SparkSession, d: str) -> DataFrame:
    got = _t(spark, d, "pages").select("page_id", udfs.chunks(F.col("html"), 1000).alias("c"))
    return got.select("page_id", "c.error", F.explode_outer("c.chunks").alias("k")).select("page_id", "k.chunk_ord", "k.content", "error")


def search_index(spark: SparkSession, d: str) -> DataFrame:
    return udfs.exploded(_t(spark, d, "pages"), udfs.search_index("html"), "page_id").select("page_id", "item.*")


def match_value(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)
    for name, char in (("&quot;", '"'), ("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&amp;", "&")):
        title = F.replace(title, F.lit(name), F.lit(char))
    return _t(spark, d, "pages").select("page_id", udfs.match_value("html", title).alias("m")).select("page_id", "m.*")


def prune_pages(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline()
    return p.prune(p.preprocess(_samples(spark, d))).select("id", "current_html", "stage_error")


def answer_pages(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline()
    return p.extract(p.prune(p.preprocess(_samples(spark, d)))).select("id", "adapter", "response", "status")


def skeleton_pages(spark: SparkSession, d: str) -> DataFrame:
    nodes = F.filter(udfs.dom_nodes(udfs.structural_clean("html")), lambda n: n["xpath"].endswith("/h1"))
    return _t(spark, d, "pages").select("page_id", udfs.rebuild_skeleton("html", nodes).alias("skeleton"))


def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    """All four stages over every page."""
    return Pipeline().run(_samples(spark, d))


QUERIES = [
    extract_pages, scan_pages_url_flag, broadcast_request, normalize_for_match, normalize_display, schema_classifier, route_adapter, xpath_common_prefix, xpath_relative,
    escape_and_prompt, parse_indices, select_nodes, regroup, micro_batch, length_buckets, json_spread, json_repair, result_envelope,
    clean_html, dom_nodes, visible_leaves, chunk_html, search_index, match_value, prune_pages, answer_pages, skeleton_pages,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


# DuckDB

_SP = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))"


def _match(x: str) -> str:
    return _collapse(f"lower(regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}_\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'))")


def _schema(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '^{_SP}+|{_SP}+$', '', 'g')"
    return f"(starts_with({t}, 'dict_keys(') OR regexp_full_match({t}, '(?s)\\{{.*\\}}') OR regexp_full_match({t}, '(?s)\\[.*\\]') OR length({t}) - length(replace({t}, ':', '')) >= 2)"


_PATHS = "paths AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) AS path, regexp_extract(url, '^https?://[^/]*/([^/?#]*)', 1) AS section FROM pages)"
_LINKS = r"""links AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS href, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS said, regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) AS path FROM pages)"""


def _shared(paths: str) -> str:
    """The longest common beginning, by steps, of a list of paths that begin with a slash."""
    steps = f"list_transform({paths}, lambda x: string_split(substr(x, 2), '/'))"
    upto = f"len(list_filter(range(1, len({steps}[1]) + 1), lambda k: len(list_filter({steps}, lambda y: list_slice(y, 1, k) <> list_slice({steps}[1], 1, k))) = 0))"
    return f"'/' || array_to_string(list_slice({steps}[1], 1, {upto}), '/')"


def _decoded(x: str) -> str:
    for name, char in (("&quot;", '"'), ("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _json(x: str) -> str:
    return f"""('"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"')"""


# The pages of the test tables have one layout: links in a list, an advert, an article of a heading and paragraphs, some of which have unclosed bold
# text before a line break, and a footer. For pages of that layout SQL can say what the operators find.
_PIECES = f"""
cut AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:title|style|script|a|div|h1|p|b|br|footer)(?: [^>]*)?>(?:var t="</p>";)?[^<]*')) AS t, generate_subscripts(regexp_extract_all(html, '<(?:title|style|script|a|div|h1|p|b|br|footer)(?: [^>]*)?>(?:var t="</p>";)?[^<]*'), 1) AS i FROM pages),
named AS (SELECT page_id, i, regexp_extract(t, '^<([a-z0-9]+)', 1) AS tag, {_decoded("regexp_replace(t, '^<[^>]*>', '')")} AS raw, {_collapse(_decoded("regexp_replace(t, '^<[^>]*>', '')"))} AS text FROM cut),
counted AS (SELECT *, count(*) FILTER (tag = 'p') OVER (PARTITION BY page_id ORDER BY i) AS p, count(*) FILTER (tag = 'p') OVER (PARTITION BY page_id) AS ps,
  count(*) FILTER (tag = 'a') OVER (PARTITION BY page_id ORDER BY i) AS a, count(*) FILTER (tag = 'a') OVER (PARTITION BY page_id) AS links, lead(tag) OVER (PARTITION BY page_id ORDER BY i) AS next_tag FROM named),
pieces AS (SELECT page_id, i, tag, raw, text, next_tag, links, CASE tag WHEN 'title' THEN '/html/head/title' WHEN 'style' THEN '/html/head/style' WHEN 'script' THEN '/html/head/script' WHEN 'div' THEN '/html/body/div'
  WHEN 'h1' THEN '/html/body/article/h1' WHEN 'footer' THEN '/html/body/footer' WHEN 'a' THEN '/html/body/nav/ul/li' || CASE WHEN links > 1 THEN '[' || a || ']' ELSE '' END || '/a'
  ELSE '/html/body/article/p' || CASE WHEN ps > 1 THEN '[' || p || ']' ELSE '' END || CASE WHEN tag = 'p' THEN '' ELSE '/b' END END AS xpath FROM counted)"""
_INNER = _escaped("regexp_replace(" + _decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)") + f", '{_SP}+', ' ', 'g')")
_HEADS = f"""heads AS (SELECT page_id, page_id % 2 = 0 AS schema, {_collapse(_decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS t, {_escaped(_collapse(_decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")))} AS e, {_INNER} AS inner_h FROM pages)"""

_SAID = """said AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 'none' WHEN doc_id % 6 = 2 THEN 'none' WHEN doc_id % 6 = 3 THEN 'none' ELSE 'list' END AS kind, n_chars % 7 AS a, doc_id % 5 AS b FROM documents)"""


def oracle_sql() -> dict[str, str]:
    q = lambda s: s.replace("'", "''")
    return {
        "scan_pages_url_flag": f"SELECT page_id, coalesce(regexp_matches(url, '^{_SP}*https?://'), false) AS url_is_url, coalesce(regexp_matches(html, '^{_SP}*https?://'), false) AS html_is_url FROM pages",
        "broadcast_request": f"SELECT page_id, CASE WHEN page_id % 2 = 1 THEN '{q(_QUESTION)}' ELSE '{q(SCHEMA_REQUEST)}' END AS request FROM pages",
        "normalize_for_match": f"SELECT doc_id, {_match('text')} AS norm FROM documents",
        "normalize_display": f"SELECT doc_id, {_collapse('coalesce(text, chr(32))')} AS shown FROM documents",
        "schema_classifier": f"SELECT kind, id, {_schema('request')} AS is_schema FROM (SELECT 'conversation' AS kind, conv_id * 1000 + turn AS id, text AS request FROM conversations UNION ALL SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'event', event_id, props FROM events)",
        "route_adapter": f"SELECT conv_id, turn, CASE WHEN {_schema('text')} THEN 'schema' ELSE 'qa' END AS adapter, CASE WHEN turn % 5 = 4 OR text IS NULL THEN 'failed' ELSE 'success' END AS status FROM conversations",
        "xpath_common_prefix": f"WITH {_LINKS} SELECT page_id, {_shared("list_filter(list_concat(href, [path]), lambda x: x <> '')")} AS prefix FROM links",
        "xpath_relative": f"WITH {_PATHS} SELECT page_id, CASE WHEN coalesce(path, '') = '' THEN '/' WHEN section = '' THEN path WHEN path = '/' || section THEN '/' WHEN starts_with(path, '/' || section) THEN CASE WHEN substr(path, length(section) + 2, 1) = '/' THEN '' ELSE '/' END || substr(path, length(section) + 2) ELSE path END AS relative FROM paths",
        "escape_and_prompt": f"""
WITH {_LINKS}, shared AS (SELECT page_id, href, said, CASE WHEN len(list_filter(href, lambda x: x <> '')) = 0 THEN '/' ELSE {_shared("list_filter(href, lambda x: x <> '')")} END AS prefix FROM links), q AS (SELECT page_id, prefix, list_transform(list_zip(href, said, range(len(href))), lambda z: 
  z[3] || ' (''' || replace(CASE WHEN z[1] = '' OR z[1] = prefix THEN '/' WHEN prefix = '/' THEN z[1] WHEN starts_with(z[1], prefix) THEN CASE WHEN substr(z[1], length(prefix) + 1, 1) = '/' THEN '' ELSE '/' END || substr(z[1], length(prefix) + 1) ELSE z[1] END, '''', '\\''') || ''', ''it\\''s ' || replace(z[2], '''', '\\''') || ''')') AS lines FROM shared)
SELECT page_id, 'Q which {{content}}?' || chr(10) || 'The entire chunk is under: ''' || replace(prefix, '''', '\\''') || '''' || CASE WHEN len(lines) > 0 THEN chr(10) ELSE '' END || array_to_string(lines, chr(10)) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS prompt FROM q""",
        "parse_indices": f"WITH {_SAID} SELECT doc_id, kind IS NULL AS keep_all, CASE kind WHEN 'list' THEN a || ',' || b || ',-1,99' WHEN 'none' THEN '' END AS indices FROM said",
        "select_nodes": f"""
WITH {_SAID}, w AS (SELECT doc_id, string_split({_collapse("coalesce(text, chr(32))")}, ' ') AS words FROM documents)
SELECT doc_id, CASE kind WHEN 'list' THEN array_to_string(list_transform(list_filter([a::BIGINT, b::BIGINT, 99], lambda i: i < len(words)), lambda i: words[i + 1]), '|') WHEN 'none' THEN '' ELSE array_to_string(words, '|') END AS kept FROM said JOIN w USING (doc_id)""",
        "regroup": """
WITH lines AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: string_split(x, ' ')) AS chunks FROM documents)
SELECT doc_id, array_to_string(flatten(list_transform(list_filter(chunks, lambda c: len(c) > 2), lambda c: [c[2], c[1]])), ' ') AS kept FROM lines""",
        "micro_batch": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch FROM documents",
        "length_buckets": """
WITH o AS (SELECT doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY coalesce(n_chars, 0), doc_id) - 1 AS i FROM documents), j AS (SELECT *, CASE WHEN n > 1.3 * lag(n) OVER (ORDER BY i) + 50 THEN i END AS jump FROM o),
s AS (SELECT doc_id, i, coalesce(max(jump) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS start FROM j) SELECT doc_id, start + (i - start) // 8 * 8 AS batch FROM s""",
        "json_spread": "SELECT event_id, event_type || user_id AS spread FROM events",
        "json_repair": "SELECT event_id, '{\"kind\": \"' || event_type || '\", \"id\": ' || event_id || '}' AS repaired FROM events",
        "result_envelope": """
SELECT d.doc_id, CASE WHEN toxic = 1 OR d.doc_id % 3 = 0 OR lang IS NULL THEN '{}' ELSE '{"lang":"' || lang || '"}' END AS prediction,
  CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN quality IS NULL THEN 'Encountered error/pending status: Status.PENDING' WHEN quality = 1 THEN NULL ELSE 'Encountered error/pending status: Status.FAILED' END AS error
FROM documents d LEFT JOIN labels USING (doc_id)""",
        "visible_leaves": f"""
WITH {_PIECES}, once AS (SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY i) AS nth FROM pieces WHERE text <> '' AND tag NOT IN ('title', 'style', 'script'))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, xpath, text FROM once WHERE nth = 1""",
        "dom_nodes": f"""
WITH {_PIECES}, menu AS (SELECT page_id, min(i) AS i, string_agg('<li><a href="' || {_escaped("regexp_extract(t, 'href=.([^>]*).>', 1)")} || '">' || {_escaped(_decoded("regexp_replace(t, '^<[^>]*>', '')"))} || '</a></li>', '' ORDER BY i) AS items FROM cut WHERE starts_with(t, '<a ') GROUP BY page_id),
nodes AS (
  SELECT page_id, i, xpath, CASE WHEN tag IN ('title', 'style', 'script') THEN text ELSE {_collapse(f"""'<' || tag || '>' || {_escaped("raw")} || '</' || tag || '>'""")} END AS content, 'text' AS type FROM pieces WHERE tag NOT IN ('a', 'b', 'br') AND NOT (tag = 'p' AND next_tag = 'b')
  UNION ALL SELECT page_id, i, '/html/body/nav/ul', {_collapse("'<ul>' || items || '</ul>'")}, 'atomic' FROM menu
  UNION ALL SELECT page_id, i, regexp_replace(xpath, '/b$', ''), {_collapse(f"""'<p><b>' || {_escaped("raw")} || '<br></b></p>'""")}, 'text' FROM pieces WHERE tag = 'b')
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS id, xpath, content, type FROM nodes""",
        # the index closes nothing by implication: what follows unclosed bold text lies within it
        "match_value": f"""
WITH {_PIECES}, deep AS (SELECT *, count(*) FILTER (tag = 'b') OVER (PARTITION BY page_id ORDER BY i) AS level FROM pieces WHERE tag IN ('p', 'b')),
ps AS (SELECT *, row_number() OVER (PARTITION BY page_id, level ORDER BY i) AS nth, count(*) OVER (PARTITION BY page_id, level) AS many FROM deep WHERE tag = 'p'),
steps AS (SELECT page_id, level, '/p' || CASE WHEN max(many) > 1 THEN '[' || max(many) || ']' ELSE '' END || '/b' AS step FROM ps GROUP BY page_id, level),
levels AS (SELECT l.page_id, l.level, coalesce(string_agg(s.step, '' ORDER BY s.level), '') AS prefix FROM (SELECT DISTINCT page_id, level FROM deep) l LEFT JOIN steps s ON s.page_id = l.page_id AND s.level < l.level GROUP BY l.page_id, l.level),
placed AS (
  SELECT page_id, i, text, xpath FROM pieces WHERE tag IN ('title', 'h1', 'a', 'div', 'footer')
  UNION ALL SELECT page_id, i, text, '/html/body/article' || prefix || '/p' || CASE WHEN many > 1 THEN '[' || nth || ']' ELSE '' END FROM ps JOIN levels USING (page_id, level)
  UNION ALL SELECT page_id, i, text, '/html/body/article' || prefix FROM deep JOIN levels USING (page_id, level) WHERE tag = 'b'),
same AS (SELECT p.page_id, p.xpath, p.text, row_number() OVER (PARTITION BY p.page_id ORDER BY i DESC) AS nth FROM placed p JOIN (SELECT page_id, text FROM pieces WHERE tag = 'h1') h ON h.page_id = p.page_id AND h.text = p.text)
SELECT page_id, text, xpath, CAST(0 AS INTEGER) AS sub_index, CAST(1.0 AS DOUBLE) AS score, true AS found FROM same WHERE nth = 1""",
        "clean_html": f"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!DOCTYPE html>|<meta [^>]*>|<style>[^<]*</style>|<script>var t="</p>";[^<]*</script>|<!--[^>]*-->', '', 'g'), '<([a-z0-9]+) [^>]*>', '<\\1>', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '<br>(<p>|</article>)', '<br></b></p>\\1', 'g') AS h FROM a), c AS (SELECT page_id, regexp_replace(h, '(</body>)?(</html>)?\\s*$', '</body></html>') AS h FROM b)
SELECT page_id, replace(replace(replace(h, '&quot;', '"'), '&copy;', '\xa9'), '&middot;', '\xb7') AS clean FROM c""",
        "skeleton_pages": f"""SELECT page_id, '<html lang="' || regexp_extract(html, '<html lang="([^"]*)"', 1) || '"><body><article><h1>' || {_escaped(_decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} || '</h1></article></body></html>' AS skeleton FROM pages""",
        "prune_pages": f"WITH {_HEADS} SELECT CAST(page_id AS VARCHAR) AS id, '<html><head><title>' || e || '</title></head><body><h1><h1>' || inner_h || '</h1></h1></body></html>' AS current_html, CAST(NULL AS VARCHAR) AS stage_error FROM heads",
        "answer_pages": f"""
WITH {_HEADS} SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN schema THEN 'schema' ELSE 'qa' END AS adapter, 'success' AS status,
  CASE WHEN schema THEN '```json' || chr(10) || '{{"title": ' || {_json("e")} || ', "heading": ' || {_json("e")} || '}}' || chr(10) || '```' ELSE '{{"answer": ' || {_json("e")} || '}}' END AS response FROM heads""",
        "extract_pages": f"""
WITH {_HEADS} SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN schema THEN '{{"title": ' || {_json("t")} || ', "heading": ' || {_json("t")} || '}}' ELSE {_json("e")} END AS prediction,
  CASE WHEN schema THEN '{{"title": "/html/body/h1/h1", "heading": "/html/body/h1/h1"}}' END AS xpaths, 'success' AS status, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS grounding_error FROM heads""",
    }
