"""Chat formatting: conversations rendered by a compiled template, with a loss mask over generations.

The production template writes ``### role: text</turn>`` and a newline for each turn; assistants' texts are generations. Control strings inside roles and
texts get a backslash (and so does every backslash), so what is written can be read back to the same turns.

Defined results: turns are ordered by turn, then role, then text, null first; repeated rows are turns of their own; null roles and
texts are empty; rows of a null conversation id form one conversation; texts of any length are rendered whole; an empty table gives an empty result; other columns are not read.
A conversation is rendered whole in one task, since it is one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import compile_template, unescape

TEMPLATE = (
    "{%- for m in messages -%}{{ '### ' + (m.role | escape('###', '</turn>', ':')) + ': ' }}"
    "{%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape('###', '</turn>') }}{% endgeneration %}"
    "{%- else -%}{{ m.text | escape('###', '</turn>') }}{%- endif -%}{{ '</turn>' + '\\n' }}{%- endfor -%}"
)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text that the production template wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the rows of each conversation as one sorted array."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _messages(turns: list[dict]) -> list[dict]:
    # array_sort puts nulls last within a struct's fields; order by hand so that null comes first, as documented
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in (t["turn"], t["role"], t["text"]))
    return [{"role": t["role"] or "", "text": t["text"] or ""} for t in sorted(turns, key=key)]


def format_conversations(rows: DataFrame, template: str = TEMPLATE, **columns: str) -> DataFrame:
    """(conv_id, formatted, spans): the rendered text and the start and end, in code points, of each generation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for b in batches:
            done = [render(messages=_messages(t)) for t in b.column(1).to_pylist()]
            spans = pa.array([[{"start": s, "end": e} for s, e in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), spans], ["conv_id", "formatted", "spans"])

    source = conversations(rows, **columns)
    id_type = source.schema["conv_id"].dataType.simpleString()
    return source.mapInArrow(run, f"conv_id {id_type}, formatted string, spans array<struct<start: long, end: long>>")


def chat_digest(rows: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation: turns, text under the loss mask, and their digests."""
    formatted = format_conversations(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    id_type = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
