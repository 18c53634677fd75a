"""Streaming forms over the events as a stream of files, each run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detect as D
from tidemark.plans.catalog import query
from tidemark.runtime import Scratch, load
from tidemark.streaming import online


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(load(spark, d, "events").schema).option("pathGlobFilter", "events*").parquet(d)


def _ended(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    with Scratch(spark, name) as scratch:
        return scratch.result(online.through(stream, scratch.path()))


@query("stream_threshold", "WITH s AS (SELECT avg(value) m, stddev_pop(value) sd FROM events) SELECT event_id, CAST(abs(value - m) / sd > 2.5 AS INTEGER) AS label FROM events, s")
def stream_threshold(spark: SparkSession, d: str) -> DataFrame:
    """A detector fitted on the table, over the stream."""
    model = D.ZScoreDetector(("value",), 2.5).fit(load(spark, d, "events"))
    return _ended(online.apply(_events(spark, d).select("event_id", "value"), [model]).select("event_id", "label"), "stream")


@query("stream_resample", "WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS t, event_type, arg_max(value, ts) AS value, count(*) AS n FROM events GROUP BY 1, 2) SELECT t, event_type, value, n FROM w WHERE t + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_resample(spark: SparkSession, d: str) -> DataFrame:
    """The intervals that the watermark has closed."""
    stamped = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _ended(online.resample(stamped, "ts", "value", ["event_type"], "6 hours", "1 hour"), "stream")
    return out.withColumn("t", F.col("t").cast("timestamp_ntz"))


@query("stream_rolling_mean", "WITH r AS (SELECT user_id, ts, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT user_id, ts, round(m, 6) AS value_rolling_mean FROM r WHERE n = 5")
def stream_rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    out = _ended(online.rolling_mean(_events(spark, d), "user_id", "ts", "value", 5), "stream")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value_rolling_mean", 6).alias("value_rolling_mean"))
