"""Process only unseen ids, keep one row per id, finish with a full ordered table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

Process = Callable[[DataFrame], DataFrame]


def backlog(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done, one per key."""
    return rows.dropDuplicates([key]).join(done.select(key), key, "left_anti")


def resume(rows: DataFrame, done: DataFrame, key: str, process: Process) -> DataFrame:
    """The finished table after one more run: old rows and the processed backlog."""
    return done.unionByName(process(backlog(rows, done, key)).select(*done.columns))


def ordered_result(template: DataFrame, done: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Every template row in order; '.' where nothing is done yet."""
    filled = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("."))
    return template.select(key, order).join(done.select(key, text), key, "left").select(key, order, filled.alias(text)).orderBy(order)


def run_available(
    spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, key: str, process: Process
) -> int:
    """Drain the files that have come since the last run into ``target``; returns the number of batches.

    Each batch writes its own directory by overwrite, so a batch that runs again after a
    failure replaces itself. Ids of earlier batches are left out by an anti join.
    ``checkpoint`` must be a folder that all executors share.
    """
    batches: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            earlier = spark.read.parquet(target).where(F.col("batch") < batch_id)
            fresh = fresh.join(earlier.select(key), key, "left_anti")
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        process(fresh).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        batches.append(batch_id)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)
