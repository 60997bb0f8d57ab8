from pyspark.sql import functions as F

from pulsegrid.operators.onsets import find_onsets
from pulsegrid.sources.views import event_series, table
from pulsegrid.streaming.onsets import stream_onsets


def test_stream_equals_batch_on_out_of_order_files(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    source = tmp_path / "in"
    rows = events.count()
    # Five files in time order, rows shuffled inside each; a last row moves the watermark on.
    for part in range(5):
        chunk = events.where(F.expr(f"event_id * 5 div {rows} = {part}")).orderBy(F.rand(part))
        chunk.coalesce(1).write.mode("append").parquet(str(source))
    end = events.select(
        F.lit(10**9).alias("event_id"),
        F.expr("ts + interval 400 days").alias("ts"),
        F.lit(-1).cast("bigint").alias("user_id"),
        F.lit(1.0).alias("value"),
    ).limit(1)
    end.coalesce(1).write.mode("append").parquet(str(source))

    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    )
    found = stream_onsets(stream, "user_id", "ts", "event_id", "value", delay="2 hours")
    query = (
        found.writeStream.format("memory")
        .queryName("stream_events")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append")
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    streamed = {(r.user_id, r.t, r.x) for r in spark.table("stream_events").collect()}
    batch = {
        (r.series_id, r.t, r.x)
        for r in find_onsets(event_series(spark, sf_dir), ["series_id"], "t", "x").collect()
    }
    assert streamed == batch and len(batch) > 10
