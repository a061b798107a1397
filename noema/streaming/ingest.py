"""Incremental ingest and windowed usage with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.operators.merge import merged
from noema.sources.buckets import Buckets

#: Columns of a concept.
CONCEPT = "id string, store string, scope string, type string, title string, description string, body string, resource string, tags array<string>, status string, source_name string, curated boolean, verified boolean, content_hash string, updated_at timestamp"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files as they arrive."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def usage_windows(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Number and value of events by window and type; events later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def ingest(drafts: DataFrame, state: str, checkpoint: str, mirrored: bool = False, buckets: int = 64):
    """Merges a stream of drafts (as for ``merged``) into the concepts under ``state``.

    Concepts lie in ``buckets`` by id, and a batch reads and writes those of its drafts alone. What
    became of the drafts goes to ``state/journal/batch=N``, from the same judgement; a batch that runs
    again after a failure overwrites its own files. Times come from the drafts (the largest
    ``updated_at`` of the batch), so that it makes the same rows.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table = concepts(batch.sparkSession, state, buckets)
        batch = batch.persist()
        now = batch.agg(F.coalesce(F.max("updated_at"), F.to_timestamp(F.lit("1970-01-01"))).cast("string")).first()[0]
        judged = table.merge(number, batch, lambda before, drafts: merged(before, drafts.drop("updated_at"), now, mirrored))
        judged.where("outcome is not null").select("id", "outcome", "held_back", "verification_reset", "content_hash").write.mode("overwrite").parquet(f"{state}/journal/batch={number}")
        batch.unpersist()

    return drafts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def concepts(spark: SparkSession, state: str, buckets: int = 64) -> Buckets:
    """The concepts under ``state``; always with the same number of buckets."""
    return Buckets(spark, f"{state}/concepts", CONCEPT, "id", buckets)


def current(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """Concepts under ``state``, as of the batches ``before`` a number."""
    return concepts(spark, state).read(before)
