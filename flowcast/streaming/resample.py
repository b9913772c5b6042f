"""Streaming bucket resampling: readStream -> partial sums and counts of each
micro-batch, written below the shared checkpoint folder -> merged means.

Nothing is kept between batches and there is no watermark, so files may arrive in any
order and late rows count like all others. A batch writes its own folder and overwrites
it when it runs again, so a failed batch is not counted twice. The merged result equals
the batch resample (D1 without gap fill) of the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcast.functions.buckets import time_bucket
from flowcast.session import scratch_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def stream_resample(spark: SparkSession, folder: str, schema: T.StructType, width: str = "5 minutes",
                    key: str = "event_type", value: str = "value", ts: str = "ts",
                    max_files_per_trigger: int = 16, file_glob: str | None = None) -> DataFrame:
    """Run the stream over the files of ``folder`` (optionally only those matching
    ``file_glob``) to completion (``availableNow``) and return the resampled frame
    (ts, sensor_id, value)."""
    out = scratch_path(spark, "stream-resample-out")
    ckpt = scratch_path(spark, "stream-resample-ckpt")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)

    def sink(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(time_bucket(ts, width).alias("ts"), F.col(key).alias("sensor_id")).agg(
            F.sum(value).alias("total"), F.count(value).alias("n"))
        part.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # a batch without rows, so that a folder without files gives an empty frame
    none = T.StructType([T.StructField("ts", schema[ts].dataType), T.StructField("sensor_id", schema[key].dataType),
                         T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    spark.createDataFrame([], none).write.parquet(f"{out}/batch=-1")
    q = (reader.parquet(folder).writeStream.foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    parts = spark.read.schema(T.StructType([*none, T.StructField("batch", T.LongType())])).parquet(out)
    return parts.groupBy("ts", "sensor_id").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("value"))
