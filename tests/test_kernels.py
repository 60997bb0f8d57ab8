import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.constants import C1_MIDI, FRAME_SIZE, HOP_SIZE, LOWEST_MIDI, SAMPLE_RATE
from pulsegrid.functions import kernels as K
from pulsegrid.operators import periods, pitch


def arrays(spark, rows):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "i int, f array<double>")


def test_fft_keeps_the_energy_and_null_rows(spark):
    rng = np.random.default_rng(1)
    x = [rng.normal(size=64), rng.normal(size=64), rng.normal(size=30)]
    df = arrays(spark, x).unionByName(spark.createDataFrame([(9, None)], "i int, f array<double>"))
    got = {r.i: r.m for r in df.select("i", K.rfft_magnitude("f").alias("m")).collect()}
    assert got[9] is None
    for i, v in enumerate(x):
        m = np.array(got[i])
        energy = (m[0] ** 2 + m[-1] ** 2 + 2 * (m[1:-1] ** 2).sum()) / len(v)
        assert energy == pytest.approx((v**2).sum())


def test_lag_sums_match_direct_ones(spark):
    x = np.random.default_rng(2).normal(size=40)
    row = arrays(spark, [x]).select(
        K.autocorrelation(39)("f").alias("a"), K.lag_differences(39)("f").alias("d")
    ).first()
    for lag in range(40):
        assert row.a[lag] == pytest.approx((x[: 40 - lag] * x[lag:]).sum(), abs=1e-9)
        assert row.d[lag] == pytest.approx(((x[: 40 - lag] - x[lag:]) ** 2).sum(), abs=1e-9)


@pytest.mark.parametrize("size,target", [(64, 48), (64, 96), (63, 32), (50, 75), (40, 40)])
def test_resampling_keeps_a_slow_tone(size, target):
    tone = lambda n: 1 + np.cos(2 * np.pi * 3 * np.arange(n) / n + 0.4)
    assert np.allclose(K.resample_rows(tone(size)[None, :], target)[0], tone(target))


def test_each_note_is_loudest_in_its_own_bin():
    n = np.arange(FRAME_SIZE)
    for midi in range(60, 109):
        tone = np.sin(2 * np.pi * 440 * 2 ** ((midi - 69) / 12) * n / SAMPLE_RATE)[None, :]
        assert LOWEST_MIDI + K.constant_q_rows(tone, LOWEST_MIDI, (FRAME_SIZE // 2,))[0].argmax() == midi


def test_whole_tones_resolve_all_88_notes():
    n = np.arange(2 * (K.CONTEXT_FRAMES + 4) * HOP_SIZE)
    centre = (K.CONTEXT_FRAMES + 2) * HOP_SIZE
    for bin_ in range(88):
        hz = 440 * 2 ** ((C1_MIDI + bin_ - 69) / 12)
        row = K.constant_q_track(K.halved_signals(np.sin(2 * np.pi * hz * n / SAMPLE_RATE)), centre, 3)[1]
        assert row.argmax() == bin_
        # Amplitude 1 gives half the root of the tone length; far bins stay silent.
        length = SAMPLE_RATE / hz / (2 ** (1 / 12) - 1)
        assert row[bin_] == pytest.approx(np.sqrt(length) / 2, rel=0.02)
        far = np.abs(np.arange(88) - bin_) > 3
        assert row[far].max() < 0.05 * row[bin_]
        if bin_ < 84:
            halved = K.halved_signals(np.sin(2 * np.pi * hz * n / SAMPLE_RATE))
            chroma = K.chroma_track(halved, centre, 1)[0]
            assert chroma.argmax() == bin_ % 12 and np.sort(chroma)[-2] < 0.05


def test_track_equals_direct_tones():
    x = np.random.default_rng(4).normal(size=2 * (K.CONTEXT_FRAMES + 4) * HOP_SIZE)
    centre = (K.CONTEXT_FRAMES + 2) * HOP_SIZE
    got = K.constant_q_track(K.halved_signals(x), centre, 1)[0]
    n = np.arange(len(x)) - centre
    for bin_ in (5, 30, 60, 87):
        hz = 440 * 2 ** ((C1_MIDI + bin_ - 69) / 12)
        length = SAMPLE_RATE / hz / (2 ** (1 / 12) - 1)
        window = np.where(np.abs(n) <= length / 2, 0.5 + 0.5 * np.cos(2 * np.pi * n / length), 0)
        direct = np.abs((x * window * np.exp(-2j * np.pi * hz * n / SAMPLE_RATE)).sum()) * 2 / np.sqrt(length)
        assert got[bin_] == pytest.approx(direct, rel=0.02, abs=0.02)


def test_period_estimators_find_a_harmonic_tone(spark):
    lags_a = periods.lag_range(SAMPLE_RATE, 60, 800, 4095)
    lags_y = periods.lag_range(SAMPLE_RATE, 50, 800, 2048)
    assert lags_a == (55, 735) and lags_y == (55, 882)
    n = np.arange(FRAME_SIZE)
    notes = [57, 60, 64, 69, 74]
    rows = []
    for m in notes:
        hz = 440 * 2 ** ((m - 69) / 12)
        rows.append(sum(np.sin(2 * np.pi * hz * h * n / SAMPLE_RATE) / h for h in range(1, 7)) * np.hanning(FRAME_SIZE))
    df = (
        arrays(spark, rows)
        .withColumn("p", K.lag_frame(4096)("f"))
        .withColumn("acf", K.autocorrelation(lags_a[1])("p"))
        .withColumn("curve", K.normalised_differences(*lags_y)(K.lag_differences(lags_y[1])("p")))
        .withColumn("a", F.expr(periods.autocorrelation_lag("acf", SAMPLE_RATE, *lags_a)))
        .withColumn("y", F.expr(periods.yin_lag("curve", SAMPLE_RATE, *lags_y)))
        .select("i", F.expr(periods.lag_note("a", SAMPLE_RATE)).alias("an"), F.expr(periods.lag_note("y", SAMPLE_RATE)).alias("yn"))
    )
    got = sorted(df.collect())
    assert [r.yn for r in got] == notes
    # Lags under 150 Hz are favoured: three periods of A4 beat one.
    assert [r.an for r in got] == [57, 60, 64, 50, 74]


def test_harmonic_map_is_the_nearest_bin(spark):
    hz = 440 * 2.0 ** ((np.arange(88) + LOWEST_MIDI - 69) / 12)
    for r in pitch.harmonic_map(spark, 88, 5).collect():
        assert r.target == np.abs(hz - hz[r.bin] * r.h).argmin()


def test_silent_spectrum_has_no_note(spark):
    df = arrays(spark, [np.zeros(88)])
    row = df.select(
        F.expr(pitch.hps_note("f")).alias("h"),
        F.expr(pitch.harmonic_sum_note("f")).alias("s"),
        F.expr(pitch.fft_note("f", 88)).alias("f"),
    ).first()
    assert tuple(row) == (None, None, None)


def test_hps_kernel_equals_the_expression(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.exponential(size=88) * rng.choice([0.01, 1.0, 1000.0]) * (rng.uniform(size=88) < 0.3)]) for i in range(300)]
    rows += [(300, [0.0] * 88), (301, None), (302, [1.0] * 88)]
    df = spark.createDataFrame(rows, "i int, c array<double>").repartition(3)
    for voices in (1, 4):
        got = df.select("i", K.hps_notes(88, voices)("c").alias("kernel"), F.expr(pitch.hps_notes("c", 88, voices)).alias("text")).collect()
        assert len(got) == 303 and all((r.kernel or []) == (r.text or []) for r in got)
    assert max(len(r.kernel or []) for r in got) == 4 and min(len(r.kernel or []) for r in got) == 0
    assert df.limit(0).select(K.hps_notes()("c")).collect() == []


def test_kernels_take_blocks_of_a_batch():
    """What a kernel makes on its way does not grow with the batch: it is given blocks, whether rows have one length or several."""
    import pyarrow as pa

    seen = []

    def kernel(x):
        seen.append(x.size)
        return x[:, :3] * 2

    for lengths in ([FRAME_SIZE] * 700, [FRAME_SIZE] * 700 + [5]):
        rows = [np.full(n, i, np.float64) for i, n in enumerate(lengths)]
        seen.clear()
        got = K._by_length(pa.array(rows), kernel).to_pylist()
        assert got == [[2.0 * i] * 3 for i in range(len(rows))] and max(seen) <= K.BLOCK_VALUES and len(seen) > 1


def test_kernels_in_turn_equal_one_after_another():
    import pyarrow as pa

    x = np.random.default_rng(2).normal(size=(300, FRAME_SIZE))
    col = pa.array([*x, None, np.empty(0)])
    first, last = K.lag_frame(2 * FRAME_SIZE), K.autocorrelation(50)
    together = K.in_turn(first, last).func
    for batch in (col, col.slice(290), col.slice(0, 0)):
        want, got = last.func(first.func(batch)).to_pylist(), together(batch).to_pylist()
        assert [r is None for r in got] == [r is None for r in want] and all(a is None or np.allclose(a, b) for a, b in zip(got, want, strict=True))
    notes = K.in_turn(K.constant_q(LOWEST_MIDI), K.hps_notes(88, 1)).func(col.slice(0, 300)).to_pylist()
    assert notes == K.hps_notes(88, 1).func(K.constant_q(LOWEST_MIDI).func(col.slice(0, 300))).to_pylist()
