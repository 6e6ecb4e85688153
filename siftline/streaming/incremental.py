"""Chunked work that resumes: a file stream, a checkpoint and idempotent batches.

New files become micro-batches; a batch that is repeated after a failure
overwrites its own folder, so results are written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_files(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 64, fmt: str = "parquet") -> StreamingQuery:
    """Run ``step`` over all files not processed before, some at a time, and stop."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", target).parquet(target)


def complete(done: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: whether the results hold exactly the expected keys, once each."""
    a = done.groupBy(key).agg(F.count("*").alias("n"))
    both = a.join(expected.select(key).distinct().withColumn("_e", F.lit(1)), key, "full")
    out = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("foreign"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.withColumn("complete", (F.col("missing") + F.col("foreign") + F.col("repeated")) == 0)


def running_alerts(stream: DataFrame, time: str, value: str, least: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Alerts per window of event time, with late rows up to the watermark."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col(value) >= least).alias("alerts")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "alerts")


def run_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage that is skipped where its output is already there."""
    make_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not make_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(make_path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
