"""Streams: stateful events, routing and ingestion equal to batch; replays leave no second row."""

import json

import numpy as np
import pytest
from pulsegrid.operators.onsets import find_onsets
from pulsegrid.sources import recordings as R
from pulsegrid.sources.views import event_series, table
from pulsegrid.streaming import ingest, onsets_state, routing
from pyspark.sql import functions as F

from test_ranges import wav


def run(df, name, tmp_path, mode="append"):
    """All rows of a stream and the progress of its triggers."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode(mode).start()
    try:
        query.processAllAvailable()
        return df.sparkSession.table(name).collect(), [json.loads(p.json) for p in query.recentProgress]
    finally:
        query.stop()


def in_files(df, folder, parts, by):
    """`parts` files in order of the column `by`, rows shuffled inside each."""
    for part in range(parts):
        df.where(F.expr(f"{by} = {part}")).orderBy(F.rand(part)).coalesce(1).write.mode("append").parquet(str(folder))


def test_state_in_parts_equals_batch(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    rows = events.count()
    in_files(events, tmp_path / "in", 5, f"event_id * 5 div {rows}")
    last = events.limit(1).select(F.lit(10**9).alias("event_id"), F.expr("ts + interval 400 days").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit(1.0).alias("value"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = onsets_state.stream_onsets(stream, "user_id", "ts", "event_id", "value", delay="2 hours", bucket_ms=3_600_000)
    streamed, _ = run(found, "parts", tmp_path)
    batch = find_onsets(event_series(spark, sf_dir), ["series_id"], "t", "x").collect()
    assert {(r.user_id, r.t, r.x) for r in streamed} == {(r.series_id, r.t, r.x) for r in batch} and len(streamed) == len(batch) > 10


def test_a_hot_key_costs_what_is_new(spark, tmp_path):
    """100,000 rows of one key wait; each trigger adds 1,000 and writes state for these alone."""
    schema = "id long, ts timestamp, k int, x double"
    source = str(tmp_path / "in")

    def put(first, n, start):
        rows = spark.range(first, first + n).selectExpr("id", f"timestamp_micros({start} + (id - {first}) * {3_000_000_000 // n}) as ts", "1 as k", "pmod(hash(id), 1000) / 10D as x")
        rows.coalesce(1).write.mode("append").parquet(source)

    day = 1_700_000_000_000_000
    put(0, 100_000, day)
    for step in range(3):  # within the hour that the watermark allows
        put(100_000 + 1000 * step, 1000, day + step * 60_000_000)
    rows = spark.read.schema(schema).parquet(source).selectExpr("id", "ts", "k", "x")
    last = "timestamp_micros({})".format(day + 40 * 3_600_000_000)
    spark.range(1).selectExpr("-1L as id", f"{last} as ts", "2 as k", "0D as x").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = onsets_state.stream_onsets(stream, "k", "ts", "id", "x", delay="1 hour", bucket_ms=600_000)
    streamed, progress = run(found, "hot", tmp_path)
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"] in (1000, 100_000)]
    assert len(written) == 4 and max(written[1:]) <= 40  # buckets, not rows, and none of those that wait
    want = rows.where("k = 1").toPandas().sort_values(["ts", "id"])["x"].to_numpy()
    ordered = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(want)], "k int, t long, x double")
    batch = find_onsets(ordered, ["k"], "t", "x").collect()
    assert {(r.t, r.x) for r in streamed} == {(r.t, r.x) for r in batch} and len(batch) > 100


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "id long, ts timestamp, k int, x double"
    base = 1_700_000_000

    def put(rows):
        spark.createDataFrame(rows, "id long, s long, k int, x double").selectExpr("id", "timestamp_seconds(s) as ts", "k", "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    values = [1.0, 2.0, 1.0, 9.0, 1.0, 1.5, 1.0, 20.0, 1.0, 1.0]
    put([(i, base + i, 1, v) for i, v in enumerate(values)])
    put([(100, base + 10_000, 2, 0.0)])
    put([(101, base + 3, 1, 99.0), (102, base + 20_000, 2, 0.0)])  # far behind the watermark
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed, _ = run(onsets_state.stream_onsets(stream, "k", "ts", "id", "x", delay="1 minute", bucket_ms=5000), "late", tmp_path)
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "k int, t long, x double")
    assert {(r.t, r.x) for r in streamed} == {(r.t, r.x) for r in find_onsets(df, ["k"], "t", "x").collect()} and all(r.x != 99.0 for r in streamed)


def test_routing_equals_the_batch_join(spark, sf_dir, tmp_path):
    from pulsegrid.plans.queries import QUERIES

    routed = QUERIES["event_routing"](spark, sf_dir).toPandas()
    found = {(r.recording_id, r.frame): r.path for r in routed.itertuples()}
    stamp = "timestamp_millis(1700000000000 + frame * 12)"
    onsets = spark.createDataFrame([(int(k), int(f), 0.5 * f) for k, f in found], "recording_id int, frame long, x double").withColumn("ts", F.expr(stamp))
    gate = [(int(k), int(f), p == "chord") for (k, f), p in found.items()] + [(int(k), int(f) + 1, True) for k, f in found if (k, f + 1) not in found]
    gates = spark.createDataFrame(gate, "recording_id int, frame long, gate boolean").withColumn("ts", F.expr(stamp))
    streams = []
    for name, df in (("onsets", onsets), ("gates", gates)):
        in_files(df, tmp_path / name, 3, "frame % 3")
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    rows, _ = run(routing.route_events(*streams, ["recording_id"], "frame", "ts"), "routed", tmp_path)
    assert {(r.recording_id, r.frame): r.path for r in rows} == {(int(k), int(f)): p for (k, f), p in found.items()} and len(rows) == len(found)
    assert rows[0].asDict().keys() == {"recording_id", "frame", "x", "ts", "path"}


@pytest.fixture
def inbox(tmp_path):
    rng = np.random.default_rng(2)
    folder = tmp_path / "inbox"
    folder.mkdir()

    def arrive(*names):
        for name in names:
            (folder / name).write_bytes(wav(rng.uniform(-0.5, 0.5, 60_000)) if name.startswith("good") else b"no recording")

    return folder, arrive


def test_ingestion_takes_each_recording_once(spark, inbox, tmp_path):
    folder, arrive = inbox
    lake, checkpoint = str(tmp_path / "lake"), str(tmp_path / "cp")

    def take():
        ingest.ingest(spark, str(folder), lake, checkpoint, files_per_batch=2, frames=32, range_bytes=50_000).awaitTermination()
        segments = ingest.recordings(spark, lake).select("recording_id", "seg", "samples").collect()
        failures = sorted((r.recording_id.rsplit("/")[-1], r.stage) for r in ingest.quarantine(spark, lake).collect())
        return {(r.recording_id.rsplit("/")[-1], r.seg): r.samples for r in segments}, len(segments), failures

    arrive("good1.wav", "bad1.wav", "note.txt")
    found, n, failures = take()
    assert {k for k, _ in found} == {"good1.wav"} and n == len(found) == 4 and failures == [("bad1.wav", "decode"), ("note.txt", "admission")]
    arrive("good2.wav", "good3.wav", "bad2.wav")
    found, n, failures = take()
    assert {k for k, _ in found} == {"good1.wav", "good2.wav", "good3.wav"} and n == len(found) == 12
    assert failures == [("bad1.wav", "decode"), ("bad2.wav", "decode"), ("note.txt", "admission")]
    again = take()  # nothing new
    assert again == (found, n, failures)
    whole = R.decode(R.scan(spark, str(folder), "good*.wav"), frames=32).collect()
    assert {(r.recording_id.rsplit("/")[-1], r.seg): r.samples for r in whole} == found


def test_a_batch_that_runs_again_replaces_itself(spark, inbox, tmp_path):
    folder, arrive = inbox
    arrive("good1.wav", "bad1.wav", "huge.wav", "note.txt")
    files = R.listing(spark, str(folder))
    lake = str(tmp_path / "lake")
    for _ in range(2):
        ingest.write_batch(files.where("path not like '%good1%'"), 0, lake, max_bytes=1 << 20)
        ingest.write_batch(files.where("path like '%good1%'"), 1, lake, max_bytes=1 << 20)
    assert ingest.recordings(spark, lake).count() == 1
    assert sorted(r.error for r in ingest.quarantine(spark, lake).collect()) == ["Unsupported file type: unknown", "file does not start with RIFF id", "file does not start with RIFF id"]
    ingest.write_batch(files, 2, str(tmp_path / "small"), max_bytes=1000)
    assert {r.error for r in ingest.quarantine(spark, str(tmp_path / "small")).collect()} == {"File too large", "Unsupported file type: unknown", "file does not start with RIFF id"}
    ingest.write_batch(files.limit(0), 3, str(tmp_path / "none"))
    assert ingest.recordings(spark, str(tmp_path / "none")).count() == 0
