"""Native Column expressions: Catalyst sees through all of these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[^\\p{L}\\p{N}_\\s]"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once: inside higher-order functions nothing else is shared."""
    return F.element_at(F.transform(F.array(value), f), 1)


def collapse_space(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "(?U)[\\s\\x1c-\\x1f]+", " "))


def display_text(c: Column) -> Column:
    """Text for display: null is empty, every run of space characters one space."""
    return collapse_space(_blank(c))


def match_text(c: Column) -> Column:
    """Text for matching: punctuation to spaces, lower case, spaces collapsed."""
    return collapse_space(F.lower(F.regexp_replace(_blank(c), f"(?U){_WORD}", " ")))


def is_url(c: Column) -> Column:
    """Whether an input, ignoring leading white space, names a web address."""
    return F.coalesce(c.rlike("(?U)^[\\s\\x1c-\\x1f]*https?://"), F.lit(False))


def common_prefix(paths: Column) -> Column:
    """Longest common prefix, by steps, of an array of slash paths; empty and null ones don't count, none gives '/'."""
    used = F.filter(paths, lambda p: p.isNotNull() & (p != ""))

    def shared(steps: Column) -> Column:
        first = F.try_element_at(steps, F.lit(1))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, first, lambda a, s: F.slice(a, 1, _agreeing(a, s))), "/"))

    steps = F.transform(used, lambda p: F.split(F.when(p.startswith("/"), F.substr(p, F.lit(2))).otherwise(p), "/", -1))
    return _let(steps, lambda x: F.when(F.size(x) == 0, F.lit("/")).otherwise(shared(x)))


def _agreeing(a: Column, b: Column) -> Column:
    """How many leading items two arrays share."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(s: Column, p: Column) -> Column:
        on = s["on"] & F.coalesce(p.getField("x") == p.getField("y"), F.lit(False))
        return F.struct((s["n"] + F.when(on, 1).otherwise(0)).alias("n"), on.alias("on"))

    return F.aggregate(pairs, state, step)["n"]


def relative_path(p: Column, prefix: Column) -> Column:
    """A path without a prefix, by characters; '/' for null, empty and equal ones."""
    rest = F.substr(p, F.length(prefix) + 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(p.isNull() | (p == ""), F.lit("/")).when(prefix.isNull() | prefix.isin("", "/"), p).when(p == prefix, F.lit("/")).when(F.startswith(p, prefix), rest).otherwise(p)


def escape_quotes(c: Column) -> Column:
    return F.replace(_blank(c), F.lit("'"), F.lit("\\'"))


def node_listing(nodes: Column) -> Column:
    """The numbered list of (path, text) pairs that a filter prompt shows; nodes is an array of structs with xpath and content."""

    def listing(prefix: Column) -> Column:
        def line(n: Column, i: Column) -> Column:
            rel = escape_quotes(relative_path(n["xpath"], prefix))
            rel = F.when(rel.startswith("/"), rel).otherwise(F.concat(F.lit("/"), rel))
            return F.concat(i.cast("string"), F.lit(" ('"), rel, F.lit("', '"), escape_quotes(n["content"]), F.lit("')"))

        head = F.concat(F.lit("The entire chunk is under: '"), escape_quotes(prefix), F.lit("'"))
        return F.array_join(F.concat(F.array(head), F.transform(nodes, line)), "\n")

    return _let(common_prefix(F.transform(nodes, lambda n: n["xpath"])), listing)


def fill_prompt(template: str, query: Column, content: Column) -> Column:
    """A template with {query} and {content}; neither value is searched for the other's slot. Doubled braces become single ones."""
    parts: list[Column] = []
    rest = template
    while rest:
        cuts = [(rest.index(s), s) for s in ("{query}", "{content}", "{{", "}}") if s in rest]
        if not cuts:
            parts.append(F.lit(rest))
            break
        at, slot = min(cuts)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append({"{query}": F.coalesce(query, F.lit("None")), "{content}": _blank(content), "{{": F.lit("{"), "}}": F.lit("}")}[slot])
        rest = rest[at + len(slot) :]
    return F.concat(*parts) if parts else F.lit("")


def chat_suffix(prompt: Column, thinking: bool = False) -> Column:
    """The end-of-turn marks of a chat model, with an empty think block unless it may think."""
    return F.concat(prompt, F.lit("<|im_end|>\n<|im_start|>assistant\n" + ("" if thinking else "<think>\n\n</think>\n\n")))


def chosen_indices(response: Column) -> Column:
    """Integers of the first [...] of a response; null (keep all) without a response, empty (keep none) if there is no list of integers."""
    inner = F.regexp_extract(response, "(?s)\\[(.*?)\\]", 1)
    has = response.rlike("(?s)\\[.*?\\]")
    items = F.transform(F.split(F.regexp_replace(inner, ",\\s*$", ""), ","), lambda t: F.trim(F.regexp_replace(t, "(?U)\\s+", " ")))
    number = lambda t: F.when(t == "True", 1).when(t == "False", 0).when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("int"))
    none = F.array().cast("array<int>")
    listed = _let(F.transform(items, number), lambda x: F.when(has & ~F.exists(x, lambda n: n.isNull()), x).otherwise(none))
    return F.when(response.isNull() | (response == ""), F.lit(None).cast("array<int>")).otherwise(listed)


def select_nodes(nodes: Column, indices: Column) -> Column:
    """nodes[i] for each index in range, in the order asked, repeats kept; null indices keep all nodes."""

    def pick(chosen: Column) -> Column:
        inside = F.filter(chosen, lambda i: (i >= 0) & (i < F.size(nodes)))
        return F.when(chosen.isNull(), nodes).otherwise(F.transform(inside, lambda i: F.try_element_at(nodes, i + 1)))

    return _let(indices, pick)


def kept_nodes(nodes: Column, responses: Column) -> Column:
    """The chosen nodes of all chunks of a document, in the order of the chunks; both arrays have an item for each chunk."""
    return F.flatten(F.zip_with(nodes, responses, lambda n, r: select_nodes(n, chosen_indices(r))))


def effective_request(query: Column, schema: Column) -> Column:
    """The query, or where it is missing or empty the schema."""
    return F.coalesce(F.nullif(query, F.lit("")), F.nullif(schema, F.lit("")))


def is_schema(c: Column) -> Column:
    """Whether a request is a schema: an object or array in text, a dict_keys(...) text, or anything with two colons."""
    t = F.regexp_replace(_blank(c), "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")
    return t.startswith("dict_keys(") | t.rlike("(?s)^\\{.*\\}$") | t.rlike("(?s)^\\[.*\\]$") | (F.regexp_count(t, F.lit(":")) >= 2)


def adapter(request: Column) -> Column:
    return F.when(is_schema(request), F.lit("schema")).otherwise(F.lit("qa"))


def answer_status(response: Column) -> Column:
    """Success unless there is no response; an empty one is a success."""
    return F.when(response.isNotNull(), F.lit("success")).otherwise(F.lit("failed"))


def result_prediction(prediction: Column) -> Column:
    return F.when(prediction.isNull() | prediction.isin("", "null"), F.lit("{}")).otherwise(prediction)


def result_error(status: Column) -> Column:
    return F.when(status == "success", F.lit(None).cast("string")).otherwise(F.concat(F.lit("Encountered error/pending status: Status."), F.upper(status)))
