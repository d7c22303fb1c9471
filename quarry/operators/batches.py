"""Ordinals and batches over whole tables (W4, L4), without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage


def with_ordinal(df: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """df with the 0-based place of each row in the order of the keys; rows with equal keys follow one another in any order.

    Rows are split into ranges of the keys, which is written once so that it doesn't change if a task runs again; ranges are numbered
    one by one, and a row a range with the counts comes to the driver. An empty table gives an empty one.
    """
    part, spark = "_range", df.sparkSession
    # more ranges than tasks: a range is as large as a task's sort
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = storage.written(df.repartitionByRange(n, *keys).withColumn(part, F.spark_partition_id()), "ranges")
    counts = {r[part]: r["n"] for r in cut.groupBy(part).agg(F.count("*").alias("n")).collect()}
    before, at = [(-1, 0)], 0
    for p in sorted(counts):
        before.append((p, at))
        at += counts[p]
    offsets = F.broadcast(spark.createDataFrame(before, f"{part} int, _before long"))  # a row a range
    place = F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1
    return cut.join(offsets, part).withColumn(name, place + F.col("_before")).drop(part, "_before")


def micro_batch(ordinal: Column, size: int) -> Column:
    """Batch number of a 0-based ordinal."""
    return F.floor(ordinal / size).cast("long")


def length_batches(df: DataFrame, length: str, *ties: str, size: int = 8, slack: float = 1.3, extra: int = 50) -> DataFrame:
    """df with ``batch``, the ordinal of a batch's first row: by rising length, at most ``size`` rows, none much longer than the batch's longest.

    In rising order the longest so far is the row before, so a batch ends where a length jumps, or is full. A jump multiplies the length by
    ``slack`` at least, so there are at most log(longest) / log(slack) of them: these come to the driver.
    """
    rows = storage.written(with_ordinal(df, length, *ties), "ordinals")
    # a jump is between two lengths that follow one another among all that occur
    lengths = rows.groupBy(length).agg(F.min("ordinal").alias("first"))
    before = F.lag(length).over(Window.orderBy(length))  # distinct lengths, not rows
    jumps = lengths.withColumn("_before", before).where(F.col(length) > F.lit(slack) * F.col("_before") + F.lit(extra)).select("first")
    starts = sorted([0, *[r[0] for r in jumps.collect()]])
    start = F.array_max(F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= F.col("ordinal")))
    return rows.withColumn("batch", start + F.floor((F.col("ordinal") - start) / size) * size).drop("ordinal")
