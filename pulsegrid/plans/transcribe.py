"""From recording files to onsets, notes, chords, summaries and documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.constants import (
    ALLOWED_CONTENT_TYPES,
    CQT_BINS,
    LOWEST_MIDI,
    PADDED_SIZE,
    SAMPLE_RATE,
)
from pulsegrid.functions import arrays as A
from pulsegrid.functions import kernels as K
from pulsegrid.operators import chords, fusion, gate, periods, pitch, reports
from pulsegrid.operators.onsets import find_onsets
from pulsegrid.operators.series import keep_where
from pulsegrid.session import stage_table
from pulsegrid.sources import ranges
from pulsegrid.sources import recordings as R

KEY = ["recording_id"]
EVENT_COLUMNS = ["chroma", "chord_score", "label", "root_pc", "bass_pc"]
AUTOCORR_LAGS = periods.lag_range(SAMPLE_RATE, 60, 800, PADDED_SIZE - 1)
YIN_LAGS = periods.lag_range(SAMPLE_RATE, 50, 800, PADDED_SIZE // 2)


@dataclass
class Transcription:
    onsets: DataFrame
    notes: DataFrame
    chords: DataFrame
    summary: DataFrame
    file_info: DataFrame
    quarantine: DataFrame
    #: Harmonic sums of all bins at each onset, (recording_id, frame_index, scores).
    candidates: DataFrame

    def documents(self, part_frames: int = reports.PART_FRAMES) -> DataFrame:
        """Nested results, one for each part of `part_frames` frames; take more than the longest recording has for whole ones."""
        nested = reports.result_documents(self.summary, self.onsets, self.notes, self.chords, part_frames)
        return nested.join(self.file_info, "recording_id", "left")

    def report(self) -> DataFrame:
        """Confidence, method and detection rate of each recording."""
        rates = reports.with_detection_rate(self.summary).select("recording_id", "detection_rate")
        return reports.report_rows(self.summary, self.notes).join(rates, "recording_id", "left")

    def event_lists(self, part_frames: int = reports.PART_FRAMES) -> DataFrame:
        return reports.event_lists(self.summary, self.onsets, self.notes, part_frames)

    def top_candidates(self, n: int = 3) -> DataFrame:
        """The `n` best bins of the simple harmonic sum at each onset: (recording_id, frame_index, rank, midi_note, score)."""
        ranked = self.candidates.select(*KEY, "frame_index", F.posexplode(F.expr(reports.top_candidates("scores", n))).alias("rank", "_d"))
        return ranked.select(*KEY, "frame_index", "rank", F.expr(f"cast(_d.index + {LOWEST_MIDI} as int)").alias("midi_note"), F.col("_d.score").alias("score"))

    def note_lines(self) -> DataFrame:
        """Text lines of the notes."""
        return self.notes.select(
            "recording_id", "frame_index", F.expr(reports.note_line()).alias("line"), F.expr(reports.note_timing()).alias("timing")
        )


def frame_features(segments: DataFrame, frames: int = R.SEGMENT_FRAMES, tonal: bool = True) -> DataFrame:
    """One row per frame: flux, constant-Q and chroma (empty if not `tonal`) and, at possible onsets, the analysis frame.

    Narrow: every segment holds the frames that its own frames look at. Recordings without a
    frame and files that failed keep one row with `frame` NULL.
    """
    rows = K.frame_features(frames, tonal)("samples", "seg", "lead", "n_samples")
    kept = ["recording_id", "n_samples", "original_sample_rate", "channels", "error"]
    return (
        segments.select(*kept, "seg", rows.alias("_rows"))
        .select(*kept, "seg", F.posexplode_outer("_rows").alias("_i", "_row"))
        .select(
            *kept,
            F.expr(f"seg * {frames} + _i").alias("frame"),
            F.col("_row.flux").alias("flux"),
            F.col("_row.cqt").alias("cqt"),
            F.col("_row.chroma").alias("chroma"),
            F.col("_row.event").alias("event"),
        )
    )


def gated_features(features: DataFrame) -> DataFrame:
    """Frame features with the gate features and the best chord."""
    return gate.gate_features(
        chords.match_chords(features), "chroma", "chord_score", "cqt"
    ).withColumn("bass_pc", F.expr(chords.bass_class("cqt")))


def chord_events(events: DataFrame) -> DataFrame:
    """Chord records of events that pass the chord gate."""
    passed = keep_where(events, f"{chords.gate_points('chroma', 'chord_score')} >= 1")
    return reports.chord_records(
        passed.withColumn("note_score", F.expr("array_max(chroma)")).withColumn(
            "inversion", F.expr(chords.inversion("bass_pc", "root_pc"))
        )
    )


def pitch_estimates(events: DataFrame) -> DataFrame:
    """Notes of the five estimators on the tapered frames `event`.

    All that reads the frames is one projection, so that they go to one Python worker of a task, once.
    """
    prepared = K.lag_frame(PADDED_SIZE)
    differences = K.lag_differences(YIN_LAGS[1]), K.normalised_differences(*YIN_LAGS)
    spectra = events.select(
        *KEY,
        "frame",
        K.rfft_magnitude("event").alias("mag"),
        K.constant_q(LOWEST_MIDI)("event").alias("cqt"),
        K.in_turn(prepared, K.autocorrelation(AUTOCORR_LAGS[1]))("event").alias("_acf"),
        K.in_turn(prepared, *differences)("event").alias("_curve"),
        K.in_turn(K.constant_q(LOWEST_MIDI), K.hps_notes(CQT_BINS, 1))("event").alias("_hps"),
    )
    lags = spectra.withColumns(
        {
            "_al": F.expr(periods.autocorrelation_lag("_acf", SAMPLE_RATE, *AUTOCORR_LAGS)),
            "_yl": F.expr(periods.yin_lag("_curve", SAMPLE_RATE, *YIN_LAGS)),
            "scores": F.expr(A.bind("array_max(cqt)", "mx", pitch.harmonic_sum_scores("cqt"))),
        }
    ).drop("_acf", "_curve")
    return lags.withColumns(
        {
            "FFT": F.expr(pitch.fft_note("mag")),
            "CQT_Simple": F.expr(pitch.harmonic_sum_note("cqt")),
            "HPS": F.expr("get(_hps, 0)"),
            "Autocorr": F.expr(f"if(_al is null, null, {periods.lag_note('_al', SAMPLE_RATE)})"),
            "YIN": F.expr(f"if(_yl is null, null, {periods.lag_note('_yl', SAMPLE_RATE)})"),
        }
    ).drop("_al", "_yl", "_hps", "cqt")


def pick_notes(estimates: DataFrame, **spectrum) -> DataFrame:
    """Add `pick`: the vote of the estimators, then the cascade."""
    notes = {m: m for m in ["FFT", "CQT_Simple", "HPS", "Autocorr", "YIN"]}
    return (
        estimates.withColumn("_cands", F.expr(fusion.candidates(notes)))
        .withColumn("robust", F.expr(fusion.robust_pick("_cands", "mag", **spectrum)))
        .withColumn("pick", F.expr(fusion.cascade("robust", "CQT_Simple", "HPS", "FFT")))
        .drop("_cands")
    )


def transcribe(
    files: DataFrame,
    highpass: bool = False,
    resample: bool = True,
    chord_path: bool = True,
    allowed=tuple(ALLOWED_CONTENT_TYPES) + (R.RAW_TYPE,),
    raw_rate: int | str = SAMPLE_RATE,
    max_bytes: int | None = None,
) -> Transcription:
    """Analyse admitted files. `chord_path=False` labels every onset as a note; `raw_rate` may name a column;
    `max_bytes` refuses larger files.

    Samples are never shuffled: one narrow pass decodes the files and leaves a stage table of
    frame features, with the analysis frame kept at possible onsets. All later shuffles move
    scalars and small vectors per frame.
    """
    admitted = R.admitted(files, allowed, max_bytes)
    segments = R.decode(admitted, highpass, resample, raw_rate)
    refused = R.quarantine(files.drop("content"), allowed, max_bytes)
    return transcribe_segments(segments, admitted.drop("content"), refused, chord_path)


def transcribe_ranges(spark: SparkSession, path: str, pattern: str | None = None, chord_path: bool = True, max_bytes: int | None = None, **options) -> Transcription:
    """Analyse the files under `path` by byte ranges, whatever their size; `options` as of `sources.ranges`."""
    files = R.listing(spark, path, pattern)
    allowed = tuple(ALLOWED_CONTENT_TYPES) + (R.RAW_TYPE,)
    limits = {"pathGlobFilter": pattern, "maxBytes": max_bytes}
    segments = ranges.scan_segments(spark, path, **{k: v for k, v in limits.items() if v is not None}, **options)
    listed = R.reject_reason(allowed=allowed, max_bytes=max_bytes, whole=False)
    refused = files.select(F.col("path").alias("recording_id"), F.lit("admission").alias("stage"), F.expr(listed).alias("error"))
    return transcribe_segments(segments, files, refused.where("error is not null"), chord_path)


def transcribe_segments(segments: DataFrame, files: DataFrame, refused: DataFrame, chord_path: bool = True) -> Transcription:
    """Analyse segments (as `recordings.decode` gives them) of `files` (path, content_type); `refused` goes to quarantine."""
    marked = frame_features(segments, tonal=chord_path)
    if chord_path:
        marked = gated_features(marked)
    else:  # no event becomes a chord, so nothing of it is computed
        absent = {"chroma": "array<double>", "chord_score": "double", "label": "string", "root_pc": "int", "bass_pc": "int"}
        marked = marked.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()})
    rows = stage_table(marked.drop("cqt"), "frames")
    features = rows.where("frame is not null")

    onsets = find_onsets(
        features.select(*KEY, "frame", "flux", *EVENT_COLUMNS), KEY, "frame", "flux"
    )
    if chord_path:
        flags = features.select(*KEY, "frame", *gate.GATE_FEATURES)
        limits = gate.gate_thresholds(flags, KEY, "frame")
        gated = gate.smooth_gate(gate.gate_vote(flags, limits, KEY, "frame"), KEY, "frame")
        routed = onsets.join(gated.select(*KEY, "frame", "gate"), [*KEY, "frame"])
    else:
        routed = onsets.withColumn("gate", F.lit(False))
    # Notes are estimated where the frames lie, then only the picks are joined to the events.
    picks = pick_notes(pitch_estimates(features.where("event is not null")))
    routed = stage_table(
        routed.join(picks.select(*KEY, "frame", "pick", "scores"), [*KEY, "frame"], "left"), "events"
    )
    notes = reports.note_records(routed.where("not gate"))
    found = chord_events(routed.where("gate"))
    onset_rows = reports.onset_records(routed)
    decoded = rows.where("error is null and coalesce(frame, 0) = 0").select(
        *KEY, "n_samples", "original_sample_rate", "channels"
    )
    return Transcription(
        onsets=onset_rows,
        notes=notes,
        chords=found,
        summary=reports.summary(decoded, onset_rows, notes, found),
        file_info=R.file_info(files, decoded),
        quarantine=refused.unionByName(R.failed(rows)),
        candidates=routed.where("scores is not null").select(*KEY, F.col("frame").alias("frame_index"), "scores"),
    )
