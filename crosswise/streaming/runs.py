"""Structured Streaming: events as they come become sections' counts per window, and new artifacts recompute only their documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_types(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts of section types per run and tumbling window; rows later than the watermark are dropped by design."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "label", "section_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "label", "section_type", "n"
    )


def recompute_on_arrival(artifacts: DataFrame, recompute: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """For each micro-batch of new ``artifacts(doc_id, ...)``, recompute the documents they touch and write them under the batch's id.

    A batch that is retried overwrites its own folder, so each document's results appear once per batch; ``current`` reads the
    last ones. Which documents a batch touched is written beside the results.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        docs = batch.select("doc_id").distinct()
        recompute(docs).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        docs.write.mode("overwrite").parquet(f"{sink}_touched/batch={batch_id}")

    return artifacts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, sink: str) -> DataFrame:
    """Each document's results from the last batch that touched it; none if that batch found none."""
    last = spark.read.parquet(f"{sink}_touched").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(sink).join(last, ["doc_id", "batch"]).drop("batch")
