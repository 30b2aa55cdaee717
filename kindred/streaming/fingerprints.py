"""Exact groups over a stream of units: counts by fingerprint, merged batch by batch.

State is a Parquet table of (fingerprint, n_members, first_unit), partitioned by batch; a batch only appends its own
aggregate, so a replayed batch overwrites itself and the sum over batches is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "fingerprint string, n_members long, first_unit long"


def merge_batch(state_path: str):
    """A function for ``writeStream.foreachBatch``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("fingerprint").agg(F.count("*").alias("n_members"), F.min("unit_id").alias("first_unit"))
        counts.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return run


def stream_exact_groups(units: DataFrame, state_path: str, checkpoint: str):
    """Start the query; units is a streaming frame with fingerprint and unit_id."""
    return units.select("fingerprint", "unit_id").writeStream.foreachBatch(merge_batch(state_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_groups(spark: SparkSession, state_path: str) -> DataFrame:
    """Groups of more than one, over all batches so far."""
    state = spark.read.schema(STATE + ", batch long").parquet(state_path)
    return state.groupBy("fingerprint").agg(F.sum("n_members").alias("n_members"), F.min("first_unit").alias("first_unit")).where("n_members > 1")
