"""Quality rules: repetition found with a suffix array.

A document's words are suffix-sorted by prefix doubling (many documents of a chunk at once, each
closed by a word of its own so that no repeat crosses a document). Neighbouring suffixes give the
longest common prefixes; a maximal run of them at or above a length is an interval whose prefix is
a maximal repeated substring. The spans of all repeats of at least ``min_repeat`` words are united;
a document is rejected if they cover more than ``max_covered`` per cent of its words, or if its longest
repeat exceeds ``max_longest`` per cent of them.

Defined results: null or white-space-only text has no words (all counts 0, base_failed); a text of any length is measured whole; repeated
rows are judged each on its own; an empty table gives an empty result; other columns are never
looked at (``filter_quality`` hands all of them through unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk

MIN_WORDS = 50
MAX_REPEAT_WORDS_PCT = 50
MIN_REPEAT = 6
MAX_COVERED_PCT = 25
MAX_LONGEST_PCT = 15

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_words long, longest_repeat long"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_array(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``key`` by prefix doubling, and the rank arrays of lengths 1, 2, 4, ...

    The last value must be unique. Only suffixes that still share their rank are sorted again, so
    text without long repeats costs about two sorts.
    """
    n = len(key)
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    head = np.ones(n, bool)
    head[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(head)
    rank = np.empty(n, np.int32)
    rank[sa] = np.repeat(at, np.diff(np.append(at, n))).astype(np.int32)
    levels, h = [rank.copy()], 1
    alone = head.copy()
    alone[:-1] &= head[1:]
    open_ = np.flatnonzero(~alone)  # places in sa of suffixes that share their rank
    while len(open_):
        pos = sa[open_]
        pair = rank[pos].astype(np.int64) * (n + 1) + rank[np.minimum(pos + h, n - 1)]
        order = np.argsort(pair, kind="stable")
        pos, pair = pos[order], pair[order]
        sa[open_] = pos
        head = np.ones(len(pos), bool)
        head[1:] = pair[1:] != pair[:-1]
        at = np.flatnonzero(head)
        rank[pos] = np.repeat(open_[at], np.diff(np.append(at, len(pos)))).astype(np.int32)
        levels.append(rank.copy())
        alone = head.copy()
        alone[:-1] &= head[1:]
        open_, h = open_[~alone], 2 * h
    return sa, levels


def neighbours_lcp(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[i]: words that suffixes sa[i - 1] and sa[i] have in common; lcp[0] is 0."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1 if n > 1 else np.zeros(0, np.int64)
    a, b, got = sa[at - 1], sa[at], np.zeros(len(at), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        r = levels[j]
        same = r[np.minimum(a + got, n - 1)] == r[np.minimum(b + got, n - 1)]
        got += same * (1 << j)
    lcp[at] = got
    return lcp


def longest_repeats(word: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each word, the length of the longest run beginning there that occurs again in its document."""
    n = len(word)
    if n == 0:
        return np.zeros(0, np.int64)
    place = np.arange(n) + doc  # one closing word after each document before it
    key = np.empty(n + n_docs, np.uint64)
    key[place] = tk.mix(word + tk.mix(doc.astype(np.uint64) + np.uint64(1)))
    ends = np.searchsorted(doc, np.arange(n_docs), "right") + np.arange(n_docs)
    code = np.empty(n + n_docs, np.int64)
    # any order of the keys will do; closing words get codes that nothing else has
    code[place] = (key[place] >> np.uint64(1)).astype(np.int64)
    code[ends] = -1 - np.arange(n_docs)
    sa, levels = suffix_array(code)
    lcp = neighbours_lcp(sa, levels)
    best = np.zeros(n + n_docs, np.int64)
    best[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return best[place]


def measure(chunk: tk.Chunk, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All figures of the documents of a chunk."""
    nd, buf = len(chunk), chunk.buf
    s, e, doc = chunk.words()
    n = len(s)
    prefix = chunk.prefix()
    count = np.bincount(doc, minlength=nd)
    rho = longest_repeats(tk.span_hash(prefix, s, e), doc, nd)
    three = tk.cover(np.flatnonzero(rho >= 3), 3, n)
    at = np.flatnonzero(rho >= min_repeat)
    covered = tk.cover(at, rho[at], n)
    longest = np.zeros(nd, np.int64)
    np.maximum.at(longest, doc, rho)
    # lines: between documents' ends and newlines
    nl = np.flatnonzero(buf == 10)
    ls = np.sort(np.concatenate([chunk.off[:-1], nl + 1])) if nd else np.zeros(0, np.int64)
    ld = np.zeros(0, np.int64)
    if nd:
        # a line belongs to the document of the newline before it (a document's first line: to itself)
        owner = np.concatenate([np.arange(nd), chunk.doc_of(nl)])
        starts = np.concatenate([chunk.off[:-1], nl + 1])
        order = np.lexsort((np.arange(len(starts)), starts, owner))
        ls, ld = starts[order], owner[order]
        end = np.concatenate([nl, chunk.off[1:]])
        eowner = np.concatenate([chunk.doc_of(nl), np.arange(nd)])
        le = end[np.lexsort((np.arange(len(end)), end, eowner))]
        words_in = np.searchsorted(s, le) - np.searchsorted(s, ls)
        use = words_in > 0
        key = tk.mix(tk.span_hash(prefix, ls[use], le[use]) + tk.mix(ld[use].astype(np.uint64) + np.uint64(7)))
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[first] = False
        dup = np.bincount(ld[use][again], minlength=nd)
    else:
        dup = np.zeros(0, np.int64)
    return {
        "n_words": count,
        "word_chars": chunk.per_doc(tk.code_points(buf) & ~tk.SPACE[buf]),
        "n_symbols": chunk.per_doc(_SYMBOL[buf]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(doc[three], minlength=nd),
        "covered_words": np.bincount(doc[covered], minlength=nd),
        "longest_repeat": longest,
    }


def judge(m: dict[str, np.ndarray], max_covered: int = MAX_COVERED_PCT, max_longest: int = MAX_LONGEST_PCT) -> dict[str, np.ndarray]:
    n = m["n_words"]
    failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_WORDS_PCT * n)
    bad = (100 * m["covered_words"] > max_covered * n) | ((m["longest_repeat"] >= MIN_REPEAT) & (100 * m["longest_repeat"] > max_longest * n))
    return m | {"base_failed": failed, "kept": ~failed & ~bad}


def judged(column: pa.Array | pa.ChunkedArray) -> dict[str, np.ndarray]:
    parts = [judge(measure(c)) for c in tk.chunks(tk.strings(column))]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, bool if k in ("base_failed", "kept") else np.int64) for k in names}


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and all figures and verdicts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = judged(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v) for v in m.values())], [id_col, *m])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(judged(b.column(at))["kept"]))

    return docs.mapInArrow(run, docs.schema)
