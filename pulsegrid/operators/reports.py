"""Event records, summaries, documents and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.constants import ANALYSIS_DELAY, FRAME_SIZE, HOP_SIZE, SAMPLE_RATE
from pulsegrid.functions import arrays as A
from pulsegrid.functions import scalars as X

# A document holds the events of this many frames (25 minutes at hop 512), so that a very
# long recording yields several documents instead of one unbounded row.
PART_FRAMES = 1 << 17


def analysis_frame(frame: str = "frame", last: str = "last_frame") -> str:
    """Frame that is analysed for an onset."""
    return f"least({frame} + {ANALYSIS_DELAY}, {last})"


def onset_records(onsets: DataFrame, frame: str = "frame") -> DataFrame:
    return onsets.select(
        "recording_id",
        F.col(frame).alias("frame_index"),
        F.expr(f"round({X.frame_seconds(frame)}, 3)").alias("time_seconds"),
    )


def note_records(picks: DataFrame, frame: str = "frame") -> DataFrame:
    """From `(recording_id, frame, pick STRUCT<note, method, confidence>)`; events without a note go."""
    return picks.where("pick.note is not null").select(
        "recording_id",
        F.col(frame).alias("frame_index"),
        F.expr(f"round({X.frame_seconds(frame)}, 3)").alias("time_seconds"),
        F.col("pick.note").alias("midi_note"),
        F.expr(X.note_name("pick.note")).alias("note_name"),
        F.expr(f"round({X.midi_to_hz('pick.note')}, 2)").alias("frequency_hz"),
        F.col("pick.method").alias("method"),
        F.col("pick.confidence").alias("confidence"),
    )


def chord_records(chords: DataFrame, frame: str = "frame") -> DataFrame:
    return chords.select(
        "recording_id",
        F.col(frame).alias("frame_index"),
        F.expr(f"round({X.frame_seconds(frame)}, 3)").alias("time_seconds"),
        F.lit("chord").alias("type"),
        "label",
        "inversion",
        F.col("chord_score").alias("confidence"),
        "note_score",
    )


def summary(
    recordings: DataFrame, onsets: DataFrame, notes: DataFrame, chords: DataFrame
) -> DataFrame:
    """Counts per recording; a recording without events keeps its row.

    `recordings` has `(recording_id, n_samples)` at the common rate.
    """
    kinds = {"total_onsets": onsets, "total_notes": notes, "total_chords": chords}
    tagged = None
    for name, df in kinds.items():
        part = df.select("recording_id", F.lit(name).alias("kind"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("recording_id").agg(
        *[F.count(F.when(F.col("kind") == name, 1)).alias(name) for name in kinds]
    )
    return recordings.join(counts, "recording_id", "left").select(
        "recording_id",
        *[F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name) for name in kinds],
        F.expr(X.samples_seconds("n_samples")).alias("duration_seconds"),
        F.lit(SAMPLE_RATE).alias("sample_rate"),
    )


def with_detection_rate(summaries: DataFrame) -> DataFrame:
    """Notes per onset in percent; NULL without onsets."""
    return summaries.withColumn(
        "detection_rate", F.expr("round(try_divide(total_notes, total_onsets) * 100, 1)")
    )


def report_rows(recordings: DataFrame, notes: DataFrame) -> DataFrame:
    """Mean confidence and method of the first note, with defaults for recordings without notes."""
    per_key = notes.groupBy("recording_id").agg(
        F.avg("confidence").alias("_confidence"),
        F.min_by("method", "frame_index").alias("_method"),
    )
    return (
        recordings.select("recording_id")
        .join(per_key, "recording_id", "left")
        .select(
            "recording_id",
            F.coalesce("_confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("_method", F.lit("No detection")).alias("method"),
        )
    )


def confidence_text(confidence: str) -> str:
    return f"concat({X.fixed(f'{confidence} * 100', 1, tie_up=True)}, '%')"


def recording_parts(recordings: DataFrame, part_frames: int = PART_FRAMES) -> DataFrame:
    """(recording_id, part, parts): a row for each part of `part_frames` frames of each recording, with events or without.

    `recordings` has `n_samples`, or `duration_seconds`; a recording without a frame has one part.
    """
    n = "n_samples" if "n_samples" in recordings.columns else f"cast(round(duration_seconds * {SAMPLE_RATE}) as bigint)"
    last = f"(greatest(1, ({n} - {FRAME_SIZE}) div {HOP_SIZE} + 1) - 1) div {part_frames}"
    rows = recordings.select("recording_id", F.expr(f"cast({last} as bigint)").alias("_last"))
    return rows.select("recording_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("part"), (F.col("_last") + 1).alias("parts"))


def event_lists(
    recordings: DataFrame, onsets: DataFrame, notes: DataFrame, part_frames: int = PART_FRAMES
) -> DataFrame:
    """Onset times and the joined note names of each part of `part_frames` frames of each recording.

    `n_onsets` counts those of the part, `total_onsets` those of the recording, and `parts` its parts, of which each has a
    row. Over a recording's rows only counts are windowed, one number a part.
    """
    part = F.expr(f"frame_index div {part_frames}").alias("part")
    rows = (
        onsets.select("recording_id", part, "frame_index", "time_seconds")
        .unionByName(
            notes.select("recording_id", part, "frame_index", "note_name"), allowMissingColumns=True
        )
        .unionByName(recording_parts(recordings, part_frames), allowMissingColumns=True)
    )
    times = F.collect_list(F.when(F.col("time_seconds").isNotNull(), F.struct("frame_index", "time_seconds")))
    names = F.collect_list(F.when(F.col("note_name").isNotNull(), F.struct("frame_index", "note_name")))
    whole = W.partitionBy("recording_id")
    return (
        rows.groupBy("recording_id", "part")
        .agg(
            F.count("time_seconds").alias("n_onsets"),
            F.array_sort(times).alias("_times"),
            F.array_sort(names).alias("_names"),
            F.max("parts").alias("parts"),
        )
        .withColumn("total_onsets", F.sum("n_onsets").over(whole))
        .withColumn("parts", F.max("parts").over(whole))
        .select(
            "recording_id",
            "part",
            "parts",
            "n_onsets",
            "total_onsets",
            F.col("_times.time_seconds").alias("onset_times"),
            F.expr(
                "if(size(_names) = 0, 'None detected', array_join(_names.note_name, ', '))"
            ).alias("note_names"),
        )
    )


def result_documents(
    summaries: DataFrame, onsets: DataFrame, notes: DataFrame, chords: DataFrame, part_frames: int = PART_FRAMES
) -> DataFrame:
    """Nested result of each part of `part_frames` frames of each recording: event arrays in frame order, the number of
    parts, and the summary of the whole recording. A part without events has a row with empty arrays."""
    tables = {"onsets": onsets, "notes": notes, "chords": chords}
    part = F.expr(f"frame_index div {part_frames}").cast("bigint").alias("part")
    known = {"n_samples", "duration_seconds"} & set(summaries.columns)
    first = summaries.select("recording_id", F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("parts"))
    rows = recording_parts(summaries, part_frames) if known else first
    for name, df in tables.items():
        fields = ["frame_index", *[c for c in df.columns if c not in ("recording_id", "frame_index")]]
        rows = rows.unionByName(
            df.select("recording_id", part, F.struct(*fields).alias(name)), allowMissingColumns=True
        )
    nested = rows.groupBy("recording_id", "part").agg(
        F.max("parts").alias("parts"), *[F.array_sort(F.collect_list(name)).alias(name) for name in tables]
    )
    fields = [c for c in summaries.columns if c != "recording_id"]
    return nested.join(
        summaries.select("recording_id", F.struct(*fields).alias("analysis_summary")), "recording_id"
    )


def note_line() -> str:
    """Fixed-width line of a note record."""
    seconds = A.bind(X.fixed("time_seconds", 2), "t_", X.right_aligned("t_", 6))
    hz = A.bind(X.fixed("frequency_hz", 1), "h_", X.right_aligned("h_", 6))
    name = X.right_aligned("note_name", 4)
    return f"concat({seconds}, 's: ', {name}, ' (', {hz}, 'Hz) - ', method)"


def note_timing() -> str:
    """Short line of a note record with its confidence in percent."""
    percent = X.fixed("confidence * 100", 0, tie_up=True)
    return f"concat({X.fixed('time_seconds', 2, tie_up=True)}, 's: ', note_name, ' (', {percent}, '%)')"


def export_name(ts: str) -> str:
    """Export file name from a UTC time, to the second."""
    stamp = f"regexp_replace(date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\"), '[:.]', '-')"
    return f"concat('piano_recording_', {stamp}, '.wav')"


def top_candidates(frame_scores: str, n: int = 3) -> str:
    """The `n` best of an array of scores as structs (score, index), best first."""
    order = "array_sort(transform({0}, (v, i) -> named_struct('neg', -round(v, 9), 'i', i)))".format(
        frame_scores
    )
    return f"transform(slice({order}, 1, {n}), d -> named_struct('score', -d.neg, 'index', d.i))"
