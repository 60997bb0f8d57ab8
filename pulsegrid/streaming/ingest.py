"""Recordings that arrive in a folder, decoded once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.constants import ALLOWED_CONTENT_TYPES
from pulsegrid.sources import ranges
from pulsegrid.sources import recordings as R

ALLOWED = (*ALLOWED_CONTENT_TYPES, R.RAW_TYPE)


def arriving(spark: SparkSession, inbox: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files under `inbox` as (path, length, content_type); their bytes are not read."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(inbox).select("path", "length", F.expr(R.content_type("path")).alias("content_type"))


def write_batch(files: DataFrame, batch: int, lake: str, max_bytes: int | None = None, **options) -> None:
    """File the segments and failures of `files` under the batch's number.

    A batch that runs again replaces what it wrote before, so a recording is there once, whatever failed in between.
    """
    files = files.select("path", "length", "content_type")
    reason = F.expr(R.reject_reason(allowed=ALLOWED, max_bytes=max_bytes, whole=False))
    refused = files.select(F.col("path").alias("recording_id"), F.lit("admission").alias("stage"), reason.alias("error"))
    admitted = files.where(reason.isNull())
    segments = ranges.read_listed(admitted, **options)
    rows = f"{lake.rstrip('/')}/segments/batch={batch}"
    segments.write.mode("overwrite").parquet(rows)
    failed = R.failed(files.sparkSession.read.schema(segments.schema).parquet(rows))
    refused.where("error is not null").unionByName(failed).write.mode("overwrite").parquet(f"{lake.rstrip('/')}/quarantine/batch={batch}")


def ingest(spark: SparkSession, inbox: str, lake: str, checkpoint: str, pattern: str | None = None, files_per_batch: int | None = None, **options) -> StreamingQuery:
    """Take what has arrived since the last call, then end; `options` as of `write_batch`."""
    stream = arriving(spark, inbox, pattern, files_per_batch).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    return stream.foreachBatch(lambda files, batch: write_batch(files, batch, lake, **options)).start()


def recordings(spark: SparkSession, lake: str) -> DataFrame:
    """The segments that were taken in without a failure."""
    return spark.read.parquet(f"{lake.rstrip('/')}/segments").where("error is null").drop("batch", "error")


def quarantine(spark: SparkSession, lake: str) -> DataFrame:
    """(recording_id, stage, error) of the files that were refused or failed."""
    return spark.read.parquet(f"{lake.rstrip('/')}/quarantine").drop("batch")
