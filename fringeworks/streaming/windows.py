"""Streams: the same functions take batches. Late rows go by the watermark; state is bounded by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(rows: DataFrame, time: str, length: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by fixed intervals of time: keys, start, end."""
    g = rows.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(*aggregates)
    return g.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in g.columns if c not in ("window", *keys)])


def sessions(rows: DataFrame, time: str, gap: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by runs of rows without a gap in time: keys, start, end; a chunk ends with a jump."""
    g = rows.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return g.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in g.columns if c not in ("session_window", *keys)])


def solved(stream: DataFrame, solve: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Solves each micro-batch of whole chunks and appends it under its batch number, so that a batch run again overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        solve(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running(rows: DataFrame, time: str, length: str, late: str, keys: list[str], path: str, checkpoint: str, **aggregates: Column) -> StreamingQuery:
    """Aggregates by fixed intervals of time, kept in the state store from one micro-batch to the next: each batch leaves the current values of the groups that it changed, under its number. A row
    whose interval ended before the watermark (the latest time of earlier batches less late) is dropped; until then rows may come in any order."""
    g = tumbling(rows, time, length, late, keys, F.count(F.lit(1)).alias("n"), *[a.alias(c) for c, a in aggregates.items()])

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return g.writeStream.foreachBatch(one).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What running() has come to: the last values of each group."""
    rows = spark.read.parquet(path)
    own = [c for c in rows.columns if c not in ("batch", "start", "end", *keys)]
    return rows.groupBy(*keys, "start", "end").agg(F.max_by(F.struct(*own), "batch").alias("x")).select(*keys, "start", "end", "x.*")


def dropped(query: StreamingQuery, counted: DataFrame) -> int:
    """How many rows of a finished running() came too late: those that it read less those that were counted (n)."""
    return sum(p["numInputRows"] for p in query.recentProgress) - (counted.agg(F.sum("n")).first()[0] or 0)
