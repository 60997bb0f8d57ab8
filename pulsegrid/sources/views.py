"""Signal views over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.series import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """`(series_id, t, x)`: the values of each user in time order."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"), "ts", "event_id", F.col("value").alias("x"), *extra
    )
    return number_rows(rows, ["series_id"], ["ts", "event_id"]).select("series_id", "t", "x", *extra)


def line_series(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """`(series_id, t, x)`: the prices of each supplier in shipping order."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), *order, *extra
    )
    return number_rows(rows, ["series_id"], order).select(
        "series_id", "t", F.col("l_extendedprice").alias("x"), *extra
    )


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(recording_id, vec_id, f, mag)`: each vector as one frame; no shuffle."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("recording_id"),
        "vec_id",
        F.expr("transform(embedding, v -> cast(v as double))").alias("f"),
        F.expr("transform(embedding, v -> abs(cast(v as double)))").alias("mag"),
    )


def number_frames(df: DataFrame) -> DataFrame:
    """Add `frame`, the position of a vector in its recording."""
    return number_rows(df, ["recording_id"], ["vec_id"], "frame")


def embedding_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(recording_id, frame, vec_id, f, mag)`."""
    return number_frames(embedding_frames(spark, sf_dir))
