"""Where pages come from and where results go."""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..plans.schemas import REQUEST, schema_text

AGENT = "Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0"


def literals(spark: SparkSession, inputs: list[str] | str, query: str | None = None, schema=None) -> DataFrame:
    """Pages or addresses given as text; one request for all of them."""
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    return _listed(spark, [(None, x, query, schema_text(schema)) for x in inputs])


def dicts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Requests as mappings with id, input_data, query, schema (or schema_model). A sample, a mapping with content instead, is taken as it is."""
    text = lambda x: None if x is None else str(x)
    return _listed(spark, [(text(r.get("id")), r.get("input_data", r.get("content", "")), r.get("query"), schema_text(r.get("schema", r.get("schema_model"))), r.get("is_content_url")) for r in rows])


def _listed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Samples of a list on the driver, with their places in it as ord."""
    full = [(*r, *[None] * (5 - len(r)), i) for i, r in enumerate(rows)]
    return requests_of(spark.createDataFrame(full, T.StructType([*REQUEST.fields, T.StructField("is_content_url", T.BooleanType()), T.StructField("ord", T.LongType())])))


def requests_of(df: DataFrame) -> DataFrame:
    """Samples of a request table; rows without an id get one from what they hold, the same on every run.

    Equal requests are told apart by ord, the place of a row, where the table has it; without it equal rows without ids have equal ids and equal results.
    """
    place = [F.col("ord").cast("string")] if "ord" in df.columns else []
    made = F.sha2(F.concat_ws("\x01", F.coalesce("input_data", F.lit("")), F.coalesce("query", F.lit("")), F.coalesce("schema_model", F.lit("")), *place), 256)
    content = F.coalesce("input_data", F.lit(""))
    url = F.coalesce("is_content_url", X.is_url(content)) if "is_content_url" in df.columns else X.is_url(content)
    return df.select(F.coalesce("id", made).alias("id"), content.alias("content"), url.alias("is_content_url"), "query", "schema_model", F.lit("pending").alias("status"), *(["ord"] if place else []))


def html_files(spark: SparkSession, path: str, query: str | None = None, schema=None) -> DataFrame:
    """Every .html or .htm file below a folder, or one file; a file with another suffix is refused. Never taken for an address."""
    if _is_file(spark, path) and not path.lower().endswith((".html", ".htm")):
        raise ValueError(f"not an HTML file: {path}")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[hH][tT][mM]*").format("binaryFile").load(path)
    return files.where(F.lower("path").rlike("\\.html?$")).select(
        F.col("path").alias("id"), F.decode("content", "UTF-8").alias("content"), F.lit(False).alias("is_content_url"), F.lit(query).alias("query"), F.lit(schema_text(schema)).alias("schema_model"), F.lit("pending").alias("status")
    )


def _is_file(spark: SparkSession, path: str) -> bool:
    """Asks the file system that the path belongs to; patterns of paths are no files."""
    if "://" not in path and os.path.exists(path):
        return os.path.isfile(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return not set(path) & set("*?[{") and files.exists(at) and files.getFileStatus(at).isFile()


def fetch_one(url: str, timeout: float = 15) -> tuple[str | None, str | None]:
    """(page, error) of an address."""
    import requests

    try:
        got = requests.get(url.strip(), timeout=timeout, headers={"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml"})
        got.raise_for_status()
        return got.text, None
    except Exception as e:
        return None, f"[FETCH_ERROR] {e}"


def fetch(df: DataFrame, partitions: int | None = None, workers: int = 8, timeout: float = 15, inline_errors: bool = False) -> DataFrame:
    """Replaces addresses by their pages, a pool of threads per partition; failures go to fetch_error (inline_errors: also into content, as older callers expect)."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("fetch_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                b = b.copy()
                b["fetch_error"] = None
                at = b.index[b["is_content_url"].fillna(False).astype(bool)]
                for i, (page, error) in zip(at, pool.map(lambda u: fetch_one(u, timeout), b.loc[at, "content"])):
                    b.at[i, "content"] = page if page is not None else error if inline_errors else ""
                    b.at[i, "fetch_error"] = error
                    b.at[i, "is_content_url"] = False
                yield b[[*names, "fetch_error"]]

    return (df.repartition(partitions) if partitions else df).mapInPandas(run, schema)


def write_results(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Results in a file format of Spark's; its commit protocol makes the write all or nothing."""
    results.write.mode(mode).format(fmt).save(path)
