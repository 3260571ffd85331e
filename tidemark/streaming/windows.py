"""Windowed counts over event streams. A window is emitted once, when the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sketches import distinct_sketch
from tidemark.sources.scratch import new_folder


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def daily_counts(stream: DataFrame, time: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), *keys).agg(F.count("*").alias("n"))


def click_show(stream: DataFrame, time: str, keys: list[str], width: str, delay: str) -> DataFrame:
    """stream has is_click."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.sum("is_click").alias("clicks"), F.sum(1 - F.col("is_click")).alias("shows"))


def daily_sketches(stream: DataFrame, time: str, user: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """A distinct sketch of the users of each day; the state is bounded by the sketch, whatever the number of users."""
    return distinct_sketch(stream.withWatermark(time, delay).withColumn("w", F.window(time, "1 day")), ["w", *keys], user)


def exact_user_days(stream: DataFrame, time: str, user: str, keys: list[str], days: int, delay: str = "1 day") -> DataFrame:
    """Distinct users in sliding windows of some days: each user of a window is kept as state once, so the state grows with the users."""
    in_windows = stream.withWatermark(time, delay).select(F.window(time, f"{days} days", "1 day").alias("w"), *keys, user)
    return in_windows.dropDuplicates(["w", *keys, user]).groupBy("w", *keys).agg(F.count("*").alias("users"))


def drained(counted: DataFrame, name: str) -> DataFrame:
    """Runs the stream over what is there, appends closed windows to a new table and returns it."""
    spark = counted.sparkSession
    path, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    flat = counted.withColumn("window_start", F.col("w.start")).drop("w")
    flat.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(flat.schema).parquet(path)
