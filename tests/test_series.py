"""Segmented operators must not depend on where a key is cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import series
from pulsegrid.operators.frames import highpass, sliding_frames
from pulsegrid.operators.gate import smooth_gate
from pulsegrid.operators.onsets import find_onsets
from pulsegrid.operators.spectra import normalize_by_max, spectral_flux


@pytest.fixture(scope="module")
def hot(spark):
    """Key 0 holds most rows; key 2 has one row."""
    rng = np.random.default_rng(7)
    rows = [(k, t, float(v)) for k, n in ((0, 3000), (1, 700), (2, 1)) for t, v in enumerate(rng.gamma(2, 3, n))]
    df = spark.createDataFrame(rows, "k int, t bigint, x double").repartition(6).cache()
    values = {k: np.array([x for kk, _, x in rows if kk == k]) for k in (0, 1, 2)}
    return df, values


def onset_positions(x, window=50, k=1.5):
    out = []
    for t in range(1, len(x) - 1):
        trail = x[max(1, t - window + 1) : t + 1]
        if x[t] > max(x[t - 1], x[t + 1], trail.mean() + k * trail.std()):
            out.append(t)
    return out


@pytest.mark.parametrize("length", [64, 4096])
def test_onsets_match_a_plain_loop(hot, length):
    df, values = hot
    got = find_onsets(df, ["k"], "t", "x", length=length).collect()
    for key, x in values.items():
        assert sorted(r.t for r in got if r.k == key) == onset_positions(x)


def test_onsets_do_not_change_under_scaling(hot):
    df, _ = hot
    plain = {(r.k, r.t) for r in find_onsets(df, ["k"], "t", "x").collect()}
    scaled = df.withColumn("x", F.col("x") * 8)
    assert plain == {(r.k, r.t) for r in find_onsets(scaled, ["k"], "t", "x").collect()}


def test_no_segment_exceeds_its_length(hot):
    df, _ = hot
    sizes = series.with_halo(df, "t", 50, 1, 64).groupBy("k", "_seg").count()
    assert sizes.agg(F.max("count")).first()[0] <= 64 + 51


@pytest.mark.parametrize("size,hop", [(64, 16), (64, 64), (10, 4), (16, 20)])
def test_sliding_frames_count_and_content(hot, size, hop):
    df, values = hot
    got = sliding_frames(df, ["k"], "t", "x", size, hop, segment_hops=24).collect()
    for key, x in values.items():
        frames = {r.frame: r.f for r in got if r.k == key}
        expected = 1 + (len(x) - size) // hop if len(x) >= size else 0
        assert sorted(frames) == list(range(expected))
        for i in (0, expected // 2, expected - 1):
            if expected:
                assert frames[i] == list(x[i * hop : i * hop + size])


def test_frame_pairs_are_neighbouring_frames(hot):
    from pulsegrid.operators.frames import frame_pairs

    df, _ = hot
    frames = {(r.k, r.frame): r.f for r in sliding_frames(df, ["k"], "t", "x", 64, 16, segment_hops=24).collect()}
    pairs = {(r.k, r.frame): (r.f, r.earlier) for r in frame_pairs(df, ["k"], "t", "x", 64, 16, segment_hops=24).collect()}
    assert pairs == {(k, i): (f, frames.get((k, i - 1))) for (k, i), f in frames.items()}


def test_highpass_matches_the_recursion(hot):
    df, values = hot
    long = series.number_rows(
        df.select(F.lit(9).alias("k"), "x", (F.col("k") * 10000 + F.col("t")).alias("o")),
        ["k"], ["o"], rows_per_slice=100,
    )
    x = np.concatenate([values[k] for k in (0, 1, 2)])
    long = long.unionByName(long.withColumn("t", F.col("t") + len(x)))
    x = np.concatenate([x, x])
    y = np.empty_like(x)
    y[0] = x[0]
    for i in range(1, len(x)):
        y[i] = x[i] - x[i - 1] + 0.95 * y[i - 1]
    rows = highpass(long, ["k"], "t", "x").orderBy("t").collect()
    assert np.abs(np.array([r.y for r in rows]) - y).max() < 1e-8


def test_number_rows_is_a_row_number(hot):
    df, values = hot
    shuffled = df.select("k", "x", F.col("t").alias("o"))
    got = series.number_rows(shuffled, ["k"], ["o"], rows_per_slice=300).collect()
    assert all(r.t == r.o for r in got) and len(got) == sum(map(len, values.values()))


@pytest.mark.parametrize("per_slice", [200, 1 << 20])
def test_positions_with_null_keys_crowds_and_outliers(spark, per_slice):
    """NULL keys and orders, nine tenths of the rows at one second, and one row far away."""
    rows = [(None if i % 7 == 0 else "a", 5 if i % 10 else None, i) for i in range(2000)] + [("a", -(10**9), 5000), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "k string, second bigint, id bigint").repartition(5)
    got = {(r.k, r.id): r.t for r in series.number_rows(df, ["k"], ["second", "id"], rows_per_slice=per_slice).collect()}
    wanted = {}
    for key in (None, "a", "b"):
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        wanted.update({(key, x[2]): t for t, x in enumerate(own)})
    assert got == wanted


def test_slices_are_even(spark, monkeypatch):
    seen = []
    staged = series.stage_table
    monkeypatch.setattr(series, "stage_table", lambda df, name: seen.append(staged(df, name)) or seen[-1])
    df = spark.range(4000).selectExpr("1 as k", "if(id = 0, -1000000000, 7) as second", "id")
    series.number_rows(df, ["k"], ["second", "id"], rows_per_slice=250).count()
    assert seen[0].groupBy("k", "_slice").count().agg(F.max("count")).first()[0] <= 1000


def test_null_keys_and_values(spark):
    rows = [(None, 0, 2.0), (None, 1, 4.0), (1, 0, None), (1, 1, None), (2, 0, None), (2, 1, None), (2, 2, 1.0), (2, 3, 2.0), (2, 4, 3.0)]
    df = spark.createDataFrame(rows, "k int, t bigint, x double")
    assert {r.k: r.median for r in series.exact_median(df, ["k"], "x").collect()} == {None: 3.0, 1: None, 2: 2.0}
    totals = series.attach_totals(df, ["k"], "t", [F.max("x").alias("m")], span=2).collect()
    assert len(totals) == 9 and {r.m for r in totals if r.k is None} == {4.0}


@pytest.mark.parametrize("alpha", [0.3, 0.5, 0.95, 0.999])
def test_highpass_for_any_alpha(hot, alpha):
    df, values = hot
    got = {(r.k, r.t): r.y for r in highpass(df, ["k"], "t", "x", alpha=alpha).collect()}
    for key, x in values.items():
        y = x[0]
        for t in range(len(x)):
            y = x[t] if t == 0 else x[t] - x[t - 1] + alpha * y
            assert abs(got[key, t] - y) < 1e-6


def test_whole_series_resampling(hot):
    from pulsegrid.operators.frames import resample_linear, whole_blocks

    df, values = hot
    for up, down in ((147, 160), (3, 2), (1, 1)):
        got = {(r.k, r.j): r.y for r in resample_linear(df, ["k"], "t", "x", up, down).collect()}
        for key, x in values.items():
            wanted = np.interp(np.arange(len(x) * up // down) * down / up, np.arange(len(x)), x)
            assert sorted(j for k, j in got if k == key) == list(range(len(wanted)))
            assert np.allclose([got[key, j] for j in range(len(wanted))], wanted)
    blocks = whole_blocks(df, ["k"], "t", "x", 64, segment_blocks=3).collect()
    for key, x in values.items():
        own = sorted((r.frame, r.f) for r in blocks if r.k == key)
        assert [f for f, _ in own] == list(range(-(-len(x) // 64))) and [v for _, f in own for v in f] == list(x)


def test_totals_reach_every_row(hot):
    df, values = hot
    got = series.attach_totals(df, ["k"], "t", [F.max("x").alias("m")], span=100).collect()
    assert len(got) == sum(map(len, values.values()))
    assert all(r.m == values[r.k].max() for r in got)


@pytest.mark.parametrize("bins", [1, 16384])
def test_exact_median(spark, hot, bins):
    df, values = hot
    many = df.unionByName(spark.range(501).selectExpr("3 as k", "id as t", "cast(id % 3 as double) as x"))
    got = {r.k: r.median for r in series.exact_median(many, ["k"], "x", bins_per_octave=bins).collect()}
    for key, x in {**values, 3: np.arange(501) % 3}.items():
        assert got[key] == pytest.approx(np.median(x), abs=1e-12)


def test_normalize_keeps_a_non_positive_series(spark):
    df = spark.createDataFrame([(1, 0, -2.0), (1, 1, 0.0), (2, 0, 4.0), (2, 1, 1.0)], "k int, t bigint, x double")
    got = {(r.k, r.t): r.v for r in normalize_by_max(df, ["k"], "t", "x", "v").collect()}
    assert got == {(1, 0): -2.0, (1, 1): 0.0, (2, 0): 1.0, (2, 1): 0.25}


def test_flux_across_segments(spark):
    rng = np.random.default_rng(3)
    mags = rng.random((50, 8))
    df = spark.createDataFrame([(1, t, m.tolist()) for t, m in enumerate(mags)], "k int, t bigint, mag array<double>")
    got = [r.flux for r in spectral_flux(df, ["k"], "t", "mag", length=4).orderBy("t").collect()]
    up = np.maximum(np.diff(mags, axis=0), 0)
    assert got[0] == 0 and np.allclose(got[1:], (up**2).sum(axis=1))


def test_gate_smoothing_pads_with_false(spark):
    flags = [1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([(1, t, bool(f)) for t, f in enumerate(flags)], "k int, t bigint, gate_raw boolean")
    got = [r.gate for r in smooth_gate(df, ["k"], "t").orderBy("t").collect()]
    padded = [0, 0, *flags, 0, 0]
    assert got == [sorted(padded[i : i + 5])[2] == 1 for i in range(len(flags))]
