import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as X
from pulsegrid.operators import chords, reports
from pulsegrid.sources import recordings as R


def test_notes_round_trip(spark):
    rows = spark.range(21, 109).select(
        F.col("id").alias("m"),
        F.expr(X.midi_to_hz("id")).alias("hz"),
        F.expr(X.hz_to_midi(X.midi_to_hz("id"))).alias("back"),
        F.expr(X.note_name("id")).alias("name"),
    ).collect()
    assert all(r.m == r.back for r in rows)
    names = {r.m: r.name for r in rows}
    assert (names[60], names[21], names[108], names[69]) == ("C4", "A0", "C8", "A4")


def test_fixed_decimals_are_exact(spark):
    values = [0.615, 2.675, 0.125, 0.375, 622.25, 1318.51, 0.0, 59.95, 1e-9, 99999.994999, 0.05, 12.5, 13.5]
    values += list(np.random.default_rng(5).random(300).round(3) * 200)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for digits in (0, 1, 2):
        got = df.select("x", F.expr(X.fixed("x", digits)).alias("t")).collect()
        assert [r.t for r in got] == [f"{r.x:.{digits}f}" for r in got]
    up = df.select("x", F.expr(X.fixed("x", 1, tie_up=True)).alias("t")).collect()
    assert {r.x: r.t for r in up}[622.25] == "622.3"


def test_clock(spark):
    df = spark.createDataFrame([(0.0,), (5.25,), (65.04,), (119.97,), (3600.0,)], "s double")
    assert [r.t for r in df.select(F.expr(X.clock("s")).alias("t")).collect()] == [
        "0:00.0", "0:05.3", "1:05.0", "1:60.0", "60:00.0",
    ]


def test_extension(spark):
    names = ["a.wav", "d/b.MP3", "x.y/noext", "/p/.hidden", "t.tar.gz"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r.e for r in df.select(F.expr(R.extension("p")).alias("e")).collect()] == [
        ".wav", ".MP3", ".wav", ".wav", ".gz",
    ]


def test_templates(spark):
    rows = chords.chord_templates(spark).collect()
    assert len(rows) == 360 and len({r.tid for r in rows}) == 108
    sets = {}
    for r in rows:
        sets.setdefault(r.tid, set()).add(r.pc)
    assert len({frozenset(s) for s in sets.values()}) == 88
    label = {r.tid: r.label for r in rows}
    assert label[0] == "C:maj" and label[107] == "B:dom7"


def test_chord_labels_move_with_transposition(spark):
    base = np.array([1, 0.1, 0.2, 0.05, 0.9, 0.1, 0.0, 0.8, 0.1, 0.2, 0.0, 0.1])
    df = spark.createDataFrame([(s, np.roll(base, s).tolist()) for s in range(12)], "s int, chroma array<double>")
    got = {r.s: r for r in chords.match_chords(df).collect()}
    assert all(got[s].root_pc == s and got[s].label.endswith(":maj") for s in range(12))


def test_equal_chords_take_the_lowest_template(spark):
    aug = [1.0, 0.0, 0.0, 0.0] * 3
    df = spark.createDataFrame([(v,) for v in (aug, [0.0] * 12)], "chroma array<double>")
    assert [r.label for r in chords.match_chords(df).collect()] == ["C:aug", "C:maj"]


def test_inversions(spark):
    df = spark.createDataFrame([(b, 0) for b in (0, 3, 4, 7, 9, None)], "b int, r int")
    got = [r.i for r in df.select(F.expr(chords.inversion("b", "r")).alias("i")).collect()]
    assert got == ["root", "first", "first", "second", "slash", "root"]


def test_long_recordings_give_several_documents(spark):
    part = reports.PART_FRAMES
    recs = spark.createDataFrame([("r", 10), ("empty", 0)], "recording_id string, n_samples bigint")
    onsets = spark.createDataFrame(
        [("r", f, float(f)) for f in (5, part - 1, part, 3 * part + 2)],
        "recording_id string, frame_index bigint, time_seconds double",
    )
    notes = spark.createDataFrame(
        [("r", part, "C4"), ("r", 5, "D4")], "recording_id string, frame_index bigint, note_name string"
    )
    got = {(r.recording_id, r.part): r for r in reports.event_lists(recs, onsets, notes).collect()}
    assert sum(r.n_onsets for r in got.values()) == 4
    assert got["r", 0].note_names == "D4" and got["r", 1].note_names == "C4"
    assert got["r", 0].onset_times == [5.0, float(part - 1)]
    assert got["empty", 0].note_names == "None detected" and got["empty", 0].n_onsets == 0


def test_pcm_widths():
    values = np.array([-1.0, -0.5, 0.0, 0.25])
    whole = {w: (values * (1 << (8 * w - 1))).astype(int) for w in (2, 3, 4)}
    packed = {w: b"".join(int(v).to_bytes(w, "little", signed=True) for v in v_) for w, v_ in whole.items()}
    packed[1] = bytes(int(v * 128 + 128) for v in values)
    for width, content in packed.items():
        assert list(R.pcm(content, width)) == list(values)
