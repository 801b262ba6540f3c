"""A landing folder of JSONL records as a stream without repeats: the streaming form of a done-key set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_landing(spark: SparkSession, path: str, schema: str, keys: list[str], watermark: tuple[str, str] | None, files_per_trigger: int = 1000) -> DataFrame:
    """New records once per key.  ``watermark``: an event-time column and how late a record may come, which bounds the
    keys that the stream remembers.  None must be asked for by name: then every key is remembered for ever, which only
    a folder of bounded size bears."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(path)
    if watermark is None:
        return df.dropDuplicates(keys)
    return df.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)


def run_landing(df: DataFrame, sink: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Apply ``each`` to every micro-batch and append it to a Parquet sink; ends when the folder is read."""

    def put(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
