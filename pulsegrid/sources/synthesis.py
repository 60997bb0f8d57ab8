"""Recordings made from scores: tables of notes to play, one row an event."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.constants import SAMPLE_RATE
from pulsegrid.sources.recordings import RAW_TYPE

# Weights of the harmonics of a single tone; the tones of a chord are pure.
HARMONICS = (1, 1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 6)
ATTACK, RELEASE = 0.005, 0.02
# Recordings that a task plays and hands on; a few rows of a score are seconds of work.
RECORDINGS_A_TASK = 8


def played(notes: list[int], n: int) -> np.ndarray:
    """`n` samples of a decaying tone, or of a chord of several notes."""
    t = np.arange(n) / SAMPLE_RATE
    hz = [440.0 * 2 ** ((m - 69) / 12) for m in notes]
    if len(hz) == 1:
        y = 0.25 * sum(w * np.sin(2 * np.pi * hz[0] * h * t) for h, w in enumerate(HARMONICS, 1) if hz[0] * h < SAMPLE_RATE / 2)
        y = y * np.exp(-3 * t)
    else:
        y = 0.6 * sum((np.sin(2 * np.pi * f * t) for f in hz), np.zeros(n)) / max(1, len(hz)) * np.exp(-1.5 * t)
    return y * np.minimum(1, t / ATTACK) * np.minimum(1, (n / SAMPLE_RATE - t) / RELEASE)


def recording_pcm(samples: int, lead: int):
    """Arrow UDF: PCM16 of a recording, `lead` samples of silence and its events end to end, from their arrays of notes (none: silence)."""

    def event(notes: list[int | None] | None) -> bytes:
        return np.round(played([m for m in notes or [] if m is not None], samples) * 32767).astype("<i2").tobytes()

    def run(score: pa.Array) -> pa.Array:
        return pa.array((bytes(2 * lead) + b"".join(map(event, row.as_py())) for row in score), pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()  # as in `kernels.kernel_udf`: a test of the length must not play it again


def recordings(score: DataFrame, slots: int, samples: int, lead: int) -> DataFrame:
    """Raw recordings `(path, content, content_type, length)` of a score (recording_id, slot, notes).

    A recording begins with `lead` samples of silence and holds `slots` events of `samples` samples each, whatever the score
    repeats: of rows of one slot the smallest notes are played, and a slot without a row is silent. The score is dealt by
    recording to as many tasks as there is to play, and only the score: no sound is shuffled.
    """
    one = score.where(f"recording_id is not null and slot between 0 and {slots - 1}").groupBy("recording_id", "slot").agg(F.min("notes").alias("notes"))
    scores = one.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "notes"))).alias("_by"))
    count = one.agg(F.approx_count_distinct("recording_id")).first()[0]
    tasks = max(1, -(-count // RECORDINGS_A_TASK), min(count, 2 * one.sparkSession.sparkContext.defaultParallelism))
    events = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.try_element_at("_by", s))
    held = scores.repartition(tasks, "recording_id").select("recording_id", recording_pcm(samples, lead)(events).alias("content"))
    files = held.select(F.col("recording_id").cast("string").alias("path"), "content", F.lit(RAW_TYPE).alias("content_type"))
    return files.withColumn("length", F.octet_length("content").cast("bigint"))
