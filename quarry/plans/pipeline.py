"""Requests to grounded results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators import clients, html_ops, udfs
from . import prompts


@dataclass(frozen=True)
class Settings:
    max_tokens: int = 1000
    attr_cutoff: int = 5
    disable_chunking: bool = False
    exact: bool = True
    pruner_prompt: str = prompts.PRUNER
    qa_prompt: str = prompts.QA
    schema_prompt: str = prompts.SCHEMA
    workers: int = 8
    #: What each kind of call is asked with; the client's own defaults hold for what isn't here.
    options: dict[str, dict[str, Any]] = field(
        default_factory=lambda: {"pruner": {"temperature": 0.0, "max_tokens": 512}, "qa": {"temperature": 1.0, "max_tokens": 512}, "schema": {"temperature": 0.0, "max_tokens": 512}}
    )


def called(df: DataFrame, prompt: Column, adapter: Column, out: str, factory: Callable[[], clients.Client], workers: int = 8, options: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """df with a column of responses to ``prompt``, a string or an array of strings; null where a call failed or there is no prompt.

    A map over Arrow batches rather than a UDF: Catalyst then neither runs a model twice nor moves the call. At most one batch of calls per adapter and
    Arrow batch; one client per Python worker, whatever the stage. options: by adapter.
    """
    names = df.columns
    sent = df.select(*names, prompt.alias("_prompt"), adapter.alias("_adapter"))
    many = isinstance(sent.schema["_prompt"].dataType, T.ArrayType)
    kind = pa.list_(pa.string()) if many else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = clients.shared(factory)
        for b in batches:
            prompts_, adapters = b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            flat = [(i, p, a) for i, (ps, a) in enumerate(zip(prompts_, adapters)) for p in (ps or [] if many else [ps]) if p is not None]
            said: list = [None] * len(flat)
            for name in sorted({a or "" for _, _, a in flat}):
                at = [k for k, x in enumerate(flat) if (x[2] or "") == name]
                for k, r in zip(at, clients.call_batch(client, [flat[k][1] for k in at], workers, adapter=name or None, **(options or {}).get(name, {}))):
                    said[k] = r
            got: list = [[] if many else None for _ in prompts_]
            for (i, _, _), r in zip(flat, said):
                if many:
                    got[i].append(r)
                else:
                    got[i] = r
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(got, kind)], [*names, out])

    return sent.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, sent.schema["_prompt"].dataType)]))


STAGES = ("preprocess", "prune", "extract", "postprocess")


@dataclass(frozen=True)
class Pipeline:
    """Samples have id, content, query and schema_model; other columns stay. One document stays one row throughout, so nothing is shuffled.

    A row that a stage fails on says why in stage_error, is answered as far as the stages behind can, and touches no other row.
    ``replaced`` has stages of one's own, DataFrame to DataFrame, by their names in STAGES.
    """

    factory: Callable[[], clients.Client] = clients.HeuristicClient
    settings: Settings = Settings()
    prune_on: bool = True
    postprocess_on: bool = True
    replaced: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: dict[str, Any] | None = None, factory: Callable[[], clients.Client] = clients.HeuristicClient) -> Pipeline:
        """One client for all stages. config: any fields of Settings, and options by stage on top of the defaults."""
        config = dict(config or {})
        options = {k: v | config.get("options", {}).get(k, {}) for k, v in Settings().options.items()}
        return cls(factory, Settings(**(config | {"options": options})))

    def preprocess(self, df: DataFrame) -> DataFrame:
        """Adds clean_html, chunks, request and stage_error."""
        s = self.settings
        got = df.withColumn("_c", udfs.chunks(F.col("content"), s.max_tokens, s.attr_cutoff, s.disable_chunking))
        before = F.col("fetch_error") if "fetch_error" in df.columns else F.lit(None).cast("string")
        request = X.effective_request(F.col("query"), F.col("schema_model"))
        return got.select(*df.columns, F.col("_c.clean").alias("clean_html"), F.col("_c.chunks").alias("chunks"), request.alias("request"), F.coalesce(before, F.col("_c.error")).alias("stage_error"))

    def prune(self, df: DataFrame) -> DataFrame:
        """Asks for each chunk which nodes matter and rebuilds a document from those, current_html; the clean page where none does.

        content, clean_html and chunks end here, so that no later stage moves them.
        """
        s = self.settings
        if not self.prune_on:
            return df.withColumn("current_html", F.col("clean_html")).drop("content", "clean_html", "chunks")
        with_nodes = df.drop("content").withColumn("nodes", _chunk_nodes(F.col("chunks"))).drop("chunks")
        failed = F.when(F.col("nodes").isNull(), F.lit("the page's chunks could not be split into nodes"))
        with_nodes = with_nodes.withColumn("stage_error", F.coalesce("stage_error", failed))
        prompts_ = F.transform("nodes", lambda n: X.fill_prompt(s.pruner_prompt, F.col("request"), X.node_listing(n)))
        told = called(with_nodes, prompts_, F.lit("pruner"), "responses", self.factory, s.workers, s.options)
        return _merged(told.withColumn("kept", X.kept_nodes(F.col("nodes"), F.col("responses"))).drop("responses", "nodes"))

    def extract(self, df: DataFrame) -> DataFrame:
        s = self.settings
        name = X.adapter(F.col("request"))
        prompt = F.when(name == "schema", X.fill_prompt(s.schema_prompt, F.col("request"), F.col("current_html"))).otherwise(X.fill_prompt(s.qa_prompt, F.col("request"), F.col("current_html")))
        usable = F.when(F.col("stage_error").isNull(), prompt)
        got = called(df.withColumn("adapter", name), usable, F.col("adapter"), "response", self.factory, s.workers, s.options)
        return got.withColumn("status", X.answer_status(F.col("response")))

    def postprocess(self, df: DataFrame) -> DataFrame:
        if not self.postprocess_on:
            return df.withColumn("prediction", F.col("response")).withColumn("xpaths", F.lit(None).cast("string")).withColumn("grounding_error", F.lit(None).cast("string"))
        got = df.withColumn("_g", udfs.ground_answer("response", "current_html", "request", F.lit(self.settings.exact)))
        return got.select(*df.columns, F.col("_g.prediction").alias("prediction"), F.col("_g.xpaths").alias("xpaths"), F.col("_g.error").alias("grounding_error"))

    @staticmethod
    def results(df: DataFrame) -> DataFrame:
        """The result of each sample; ord, the place in the input, where samples have one."""
        message = F.coalesce(F.when(F.col("status") != "success", F.col("stage_error")), X.result_error(F.col("status")))
        empty = F.col("prediction").isNull() | F.col("prediction").isin("", '""', "null", "{}")
        place = ["ord"] if "ord" in df.columns else []
        return df.select("id", F.when(empty, F.lit("{}")).otherwise(F.col("prediction")).alias("prediction"), "xpaths", "status", message.alias("error"), "grounding_error", *place)

    def run(self, df: DataFrame) -> DataFrame:
        for name in STAGES:
            df = df.transform(self.replaced.get(name) or getattr(self, name))
        return df.transform(self.results)

    def run_in_order(self, df: DataFrame) -> DataFrame:
        """run() of samples that have ord, such as lists and batches, sorted by it."""
        return self.run(df).orderBy("ord")


def _merged(df: DataFrame) -> DataFrame:
    """df with current_html instead of kept and clean_html. A map over Arrow batches: a UDF over the selection's lambda functions isn't always pulled out of a projection."""
    names = [c for c in df.columns if c not in ("kept", "clean_html", "stage_error")]
    sent = df.select(*names, "stage_error", "kept", "clean_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(names)
            docs, errors = [], []
            for error, kept, page in zip(*(b.column(n + i).to_pylist() for i in range(3))):
                try:
                    docs.append(html_ops.merge(None if kept is None else [kept], page))
                except Exception as e:  # a bad page is reported in its own row
                    docs.append("")
                    error = error or f"{type(e).__name__}: {e}"
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(errors, pa.string()), pa.array(docs, pa.string())], [*names, "stage_error", "current_html"])

    kinds = [df.schema[c] for c in names]
    return sent.mapInArrow(run, T.StructType([*kinds, T.StructField("stage_error", T.StringType()), T.StructField("current_html", T.StringType())]))


def _chunk_nodes(chunks: Column) -> Column:
    return F.transform(udfs.chunk_nodes(F.transform(chunks, lambda c: c["content"])), lambda c: c["nodes"])
