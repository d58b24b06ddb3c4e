"""Streams of positions and of forecast cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_means(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and means of (ts, by, value) for each time window; later rows than the watermark don't count."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), by)
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), by, "n", "mean")


def on_each_cycle(cycles: DataFrame, evaluate: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Evaluate again with every batch of forecast rows that arrives; results are added to the Parquet folder `sink` by batch."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            evaluate(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return cycles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
