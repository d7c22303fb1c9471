"""The same stateless stages over a growing folder of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import Pipeline


def read_pages(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def extract_stream(pages: DataFrame, pipeline: Pipeline, request: str, out: str, checkpoint: str) -> StreamingQuery:
    """Extracts from every page that arrives and appends the results; restarts where the checkpoint says. Stages keep no state, so no watermark is needed."""
    samples = pages.select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("content"), F.lit(None).cast("string").alias("query"), F.lit(request).alias("schema_model"))
    return pipeline.run(samples).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
