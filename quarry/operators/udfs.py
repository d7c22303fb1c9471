"""Arrow UDF faces of the document operators.

An Arrow batch holds up to 10,000 documents, whose nodes or index are many times as large: batches are worked on and given back in slices of at most SLICE_ROWS
rows and, but for single documents, SLICE_CHARS characters, so that what a worker holds doesn't grow with the table.
A row that an operator fails on gives null and no other row is touched; the pipeline's stages say why in ``stage_error``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import grounding, html_ops

SLICE_ROWS = 64
SLICE_CHARS = 1 << 18


def _slices(columns: tuple[pa.Array, ...]) -> Iterator[list[list]]:
    """The values of a batch's columns, a slice at a time."""
    for at in range(0, len(columns[0]), SLICE_ROWS):
        values = [c.slice(at, SLICE_ROWS).to_pylist() for c in columns]
        begin = chars = 0
        for i, row in enumerate(zip(*values)):
            size = sum(_chars(x) for x in row)
            if i > begin and chars + size > SLICE_CHARS:
                yield [v[begin:i] for v in values]
                begin, chars = i, 0
            chars += size
        yield [v[begin:] for v in values]


def _chars(x) -> int:
    if isinstance(x, (list, dict)):
        return sum(map(_chars, x.values() if isinstance(x, dict) else x))
    return len(x) if isinstance(x, str) else 0


def arrow_udf(returns: str) -> Callable:
    """An Arrow UDF of a function of one row's values. It is made when it is first applied: modules are imported where no session is."""

    def around(f: Callable) -> Callable[..., Column]:
        def sliced(batches: Iterator[tuple[pa.Array, ...]], kind: pa.DataType) -> Iterator[pa.Array]:
            for columns in batches:
                for values in _slices(columns):
                    yield pa.array(_each(f, *values).tolist(), kind)

        @functools.cache
        def made(many: bool):
            kind = to_arrow_type(T._parse_datatype_string(returns))

            def of_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                return sliced(((b,) for b in batches), kind)

            def of_many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                return sliced(batches, kind)

            return F.arrow_udf(of_many if many else of_one, returns)

        @functools.wraps(f)
        def apply(*columns) -> Column:
            return made(len(columns) > 1)(*columns)

        apply.sliced = sliced
        return apply

    return around


def _each(f: Callable, *columns: pd.Series | list) -> pd.Series:
    out = pd.Series([None] * len(columns[0]), dtype="object")
    for i, x in enumerate(zip(*columns)):
        try:
            out.iat[i] = f(*x)
        except Exception:  # null is the result of a row that can't be worked on
            out.iat[i] = None
    return out


NODE = "struct<id: int, xpath: string, content: string, type: string>"
LEAF = "struct<xpath: string, text: string>"
ENTRY = "struct<ord: int, xpath: string, chunk: string, norm_chunk: string, norm_tokens: array<string>, sub_index: int>"
MATCH = "struct<text: string, xpath: string, sub_index: int, score: double, found: boolean>"


@arrow_udf("string")
def clean_html(html: str | None) -> str:
    return html_ops.clean(html)


@arrow_udf("string")
def structural_clean(html: str | None) -> str:
    return html_ops.structural_clean(html)


@arrow_udf(f"array<{NODE}>")
def dom_nodes(html: str | None) -> list[dict]:
    return html_ops.nodes(html)


@arrow_udf(f"array<struct<nodes: array<{NODE}>>>")
def chunk_nodes(chunks: list[str] | None) -> list[dict]:
    """The nodes of each chunk of a document."""
    return [{"nodes": html_ops.nodes(c)} for c in chunks or []]


@arrow_udf(f"array<{LEAF}>")
def visible_leaves(html: str | None) -> list[dict]:
    return html_ops.visible_leaves(html)


@arrow_udf(f"array<{ENTRY}>")
def search_index(html: str | None) -> list[dict]:
    return html_ops.search_index(html)


@arrow_udf("string")
def rebuild_skeleton(html: str | None, chosen: list[dict] | None) -> str | None:
    """Null where the nodes are: what chose them failed, which isn't the same as nothing chosen."""
    if chosen is None:
        return None
    return html_ops.skeleton(html, chosen) if html else ""


@arrow_udf(MATCH)
def match_value(html: str | None, value: str | None) -> dict:
    """A value that isn't found has found false and score 0; null, without any of these, is a row that failed."""
    return grounding.closest(html or "", value or "")


@arrow_udf("struct<prediction: string, xpaths: string, error: string>")
def ground_answer(response: str | None, content: str | None, request: str | None, exact: bool) -> dict:
    return dict(zip(("prediction", "xpaths", "error"), grounding.postprocess(response, content, request, bool(exact))))


@arrow_udf("string")
def repair_json(response: str | None) -> str:
    import json

    from ..functions import jsonrepair

    return json.dumps(jsonrepair.extract(response), ensure_ascii=False)


@arrow_udf("string")
def spread_json(response: str | None) -> str:
    from ..functions import jsonrepair

    return "" if response is None else jsonrepair.extract(response, spread=True)


def exploded(df: DataFrame, items: Column, *names: str) -> DataFrame:
    """A row per item, pos and item, besides the named columns. A row that the operator failed on stays as one whose item and pos are null; one without items has none."""
    found = df.select(*names, items.alias("_items"))
    failed = F.col("_items").isNull()
    every = F.when(failed, F.array(F.lit(None).cast(found.schema["_items"].dataType.elementType))).otherwise(F.col("_items"))
    return found.select(*names, failed.alias("_failed"), F.posexplode(every).alias("_pos", "item")).select(*names, F.when(~F.col("_failed"), F.col("_pos")).alias("pos"), "item")


def chunks(html: Column, max_tokens: int = 1000, attr_cutoff: int = 5, disable: bool = False) -> Column:
    """Struct of the clean document, its chunks and, where there are none, why."""

    @arrow_udf("struct<clean: string, chunks: array<struct<chunk_ord: int, content: string>>, error: string>")
    def run(page: str | None) -> dict:
        try:
            text = html_ops.clean(page)
            parts = [] if not text else [text] if disable else html_ops.chunk(text, max_tokens, attr_cutoff)
            return {"clean": text, "chunks": [{"chunk_ord": i + 1, "content": p} for i, p in enumerate(parts)], "error": None if parts else "nothing is left of the page after cleaning"}
        except Exception as e:  # a bad page is reported in its own row
            return {"clean": "", "chunks": [], "error": f"{type(e).__name__}: {e}"}

    return run(html)
