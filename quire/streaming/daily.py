"""Search logs as a stream: daily figures with late rows, and an incremental sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Log files as they arrive in a folder (or the one file named); created_at as an instant, as watermarks need."""
    folder, _, name = path.rpartition("/")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    r = spark.readStream.schema(schema)
    s = r.option("pathGlobFilter", name).parquet(folder) if one else r.parquet(path)
    return s.withColumn("created_at", F.col("created_at").cast("timestamp"))


def daily_counts(logs: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, searches, avg_latency_ms) per day; a row later than the watermark is left out, a log_id counts once within it."""
    w = logs.where("created_at is not null").withWatermark("created_at", late).dropDuplicatesWithinWatermark(["log_id"])
    return w.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count("*").alias("searches"), F.avg("latency_ms").alias("avg_latency_ms")).select(F.to_date("w.start").alias("day"), "searches", "avg_latency_ms")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write it, stop."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
