"""Joins by nearness, scans over segments, products and kept statistics against plain loops."""

import bisect
import math
import random

import numpy as np
import pytest
from pulsegrid.functions.kernels import resample_rows
from pulsegrid.functions.registry import FUNCTIONS, register_functions
from pulsegrid.operators import products, scans
from pulsegrid.operators.daily import DailyStatistics
from pulsegrid.operators.gate import gate_thresholds
from pulsegrid.operators.nearest import nearest_join, ratio_anti_join


def plan_of(df):
    return df._jdf.queryExecution().toString()


# nearest join


def plain_nearest(left, right):
    by = {}
    for k, p, v in right:
        if p is not None:
            by.setdefault(k, {}).setdefault(p, []).append(v)
    out = []
    for k, p, i in left:
        at = by.get(k, {})
        if p is None or not at:
            out.append((k, p, i, None, None))
            continue
        places = sorted(at)
        j = bisect.bisect_left(places, p)
        near = min(places[max(0, j - 1) : j + 1], key=lambda q: (abs(q - p), q))
        out.append((k, p, i, near, min(at[near])))
    return sorted(map(str, out))


@pytest.mark.parametrize("rows_per_slice", [1 << 20, 150, 7])
def test_nearest_join(spark, rows_per_slice):
    rng = random.Random(4)
    # Key 1 has most rows, all rows of key 2 crowd at two positions, key 3 has no partner, key 4 has one far away; None is a key.
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, 4, None])
    left = [(k, rng.choice([5, 6]) if k == 2 else rng.randrange(400) * 2, i) for i in range(600) for k in [key()]] + [(1, None, -1)]
    right = [(k, 5 if k == 2 else rng.randrange(300) * 3, rng.randrange(9)) for _ in range(300) for k in [key()] if k not in (3, 4)]
    right += [(4, 10_000, 1), (1, None, 0), (9, 1, 1)]
    lf, rf = spark.createDataFrame(left, "k int, p long, i int"), spark.createDataFrame(right, "k int, p long, v int")
    got = nearest_join(lf.repartition(3), rf, ["k"], "p", ["v"], rows_per_slice)
    assert sorted(str((r.k, r.p, r.i, r.near_p, r.v)) for r in got.collect()) == plain_nearest(left, right)
    assert nearest_join(lf, rf.limit(0), ["k"], "p", ["v"], rows_per_slice).where("v is null").count() == len(left)
    assert nearest_join(lf.limit(0), rf, ["k"], "p", ["v"], rows_per_slice).count() == 0


def test_nearest_join_windows_never_hold_a_key(spark):
    """Windows over rows are by (key, slice); only those over the slices' edges are by key."""
    df = spark.range(3000).selectExpr("id % 2 as k", "id as p", "id as v")
    plan = plan_of(nearest_join(df, df, ["k"], "p", ["v"], 500))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "windowspecdefinition(k" in plan and plan.count("_slice") > 4


# ratio anti join


@pytest.mark.parametrize(("tolerance", "salts"), [(0.1, 1), (0.1, 4), (0.02, 1), (0.9, 1)])
def test_ratio_anti_join(spark, tolerance, salts):
    rng = random.Random(5)
    values = [rng.uniform(20, 4000) for _ in range(400)] + [440.0, 880.0, 1320.0, 0.0, -5.0, 1e-9, 1e12]
    left = [(rng.choice([1, 2, None]), v, i) for i, v in enumerate(values)] + [(1, None, -1)]
    right = [(rng.choice([1, 1, 1, None, 7]), rng.choice([440.0, 55.5, rng.uniform(20, 2000), 0.0, -3.0, None])) for _ in range(60)]
    lf, rf = spark.createDataFrame(left, "k int, f double, i int"), spark.createDataFrame(right, "k int, f double")

    def near(c, e):
        return c is not None and e is not None and c > 0 and e > 0 and any(abs(c / e - h) < tolerance for h in range(2, 7))

    want = sorted(i for k, c, i in left if not any(k == q and near(c, e) for q, e in right))
    got = ratio_anti_join(lf, rf, ["k"], "f", tolerance=tolerance, salts=salts)
    assert got.columns == lf.columns and sorted(r.i for r in got.collect()) == want and 10 < len(want) < len(left) - 10
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# scans


def plain_highpass(x, alpha):
    y = np.empty(len(x))
    y[0] = x[0]
    for i in range(1, len(x)):
        y[i] = x[i] - x[i - 1] + alpha * y[i - 1]
    return y


@pytest.mark.parametrize("alpha", [0.01, 0.5, 0.95, 0.999, 0.99999])
def test_highpass_scan_without_halo(spark, alpha):
    rng = np.random.default_rng(2)
    series = {1: rng.normal(size=3000), 2: rng.normal(size=1), None: rng.normal(size=130) + 50}
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, t long, x double").repartition(5)
    got = {(r.k, r.t): r.y for r in scans.highpass_scan(df, ["k"], "t", "x", alpha=alpha, length=16, fan=3).collect()}
    assert len(got) == len(rows)
    for k, x in series.items():
        want = plain_highpass(x, alpha)
        assert max(abs(got[k, t] - v) for t, v in enumerate(want)) < 1e-9 * max(1, np.abs(x).sum())
    assert scans.highpass_scan(df.limit(0), ["k"], "t", "x", alpha=alpha).count() == 0


def test_lag_sums_of_whole_series(spark):
    rng = np.random.default_rng(3)
    series = {1: rng.normal(size=5000) * 10, 2: rng.normal(size=3), 3: np.array([2.0]), None: rng.normal(size=64)}
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, t long, x double").repartition(4)
    got = {(r.k, r.lag): (r.products, r.differences) for r in scans.lag_sums(df, ["k"], "t", "x", 20, length=64).collect()}
    for k, x in series.items():
        for lag in range(21):
            a, b = x[: max(0, len(x) - lag)], x[lag:]
            want = (float((a * b).sum()), float(((a - b) ** 2).sum())) if lag < len(x) else (0.0, 0.0)
            assert got[k, lag] == pytest.approx(want, abs=1e-7 * (1 + (x * x).sum()))


@pytest.mark.parametrize(("up", "down", "length"), [(147, 160, 700), (3, 2, 200), (1, 4, 600), (5, 1, 64)])
def test_polyphase_series_equal_the_whole_transform(spark, up, down, length):
    """Within 1e-5 of the Fourier method away from the ends, over at least five segments; short series keep their length."""
    n = 3680
    t = np.arange(n)
    x = sum(a * np.sin(2 * np.pi * f * t / n) for a, f in ((1, 40), (0.5, 133), (0.3, min(1500, int(1600 * up / down)) // 2)))
    short = np.array([1.0, 2.0, 4.0])
    rows = [(1, int(i), float(v)) for i, v in enumerate(x)] + [(None, int(i), float(v)) for i, v in enumerate(short)]
    df = spark.createDataFrame(rows, "k int, t long, x double").repartition(4)
    out = scans.resample_polyphase(df, ["k"], "t", "x", up, down, length=length).collect()
    got = {(r.k, r.j): r.y for r in out}
    m = n * up // down
    assert len(got) == len(out) and sorted(j for k, j in got if k == 1) == list(range(m)) and sorted(j for k, j in got if k is None) == list(range(3 * up // down))
    whole = resample_rows(x[None, :], m)[0]
    # Every frequency returns within the series, so only the ends, which are zero here and periodic there, differ.
    inner = range(m // 4, 3 * m // 4)
    assert max(abs(got[1, j] - whole[j]) for j in inner) < 1e-5


def test_affine_maps_carry_over_levels(spark):
    rng = random.Random(1)
    maps = [(k, s, rng.uniform(-1, 1), rng.uniform(-5, 5)) for k in (1, None) for s in range(200)]
    df = spark.createDataFrame(maps, "k int, seg long, a double, b double").repartition(3)
    for fan in (2, 7, 500):
        got = {(r.k, r.seg): r.carry for r in scans.carried(df, ["k"], "seg", 200, fan).collect()}
        for k in (1, None):
            carry = 0.0
            for _, s, a, b in (m for m in maps if m[0] == k):
                assert got[k, s] == pytest.approx(carry, abs=1e-9)
                carry = a * carry + b


# products


@pytest.mark.parametrize("small", [1 << 18, 10])
def test_sparse_product(spark, small, monkeypatch):
    monkeypatch.setattr(products, "SMALL", small)
    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(30, 12)), rng.normal(size=(12, 9)) * (rng.uniform(size=(12, 9)) < 0.4)
    values = spark.createDataFrame([(i, j, float(left[i, j])) for i in range(30) for j in range(12)], "r int, i int, v double")
    weights = spark.createDataFrame([(int(i), int(j), float(right[i, j])) for i, j in zip(*np.nonzero(right))], "i int, c int, w double")
    got = products.product(values, weights, ["r"], "i", ["c"], {"s": "v * w"})
    assert ("BroadcastHashJoin" in plan_of(got)) == (small > 10) or small == 10
    want = left @ right
    for r in got.collect():
        assert r.s == pytest.approx(want[r.r, r.c], abs=1e-9)
    best = {r.r: r.c for r in products.best_of(got, ["r"], "c", "s").collect()}
    held = [c for c in range(9) if right[:, c].any()]
    assert all(best[i] == held[int(np.argmax(np.round(want[i, held], 9)))] for i in range(30))


def test_silent_frames_keep_their_bins(spark):
    df = spark.createDataFrame([(1, [0.0] * 16), (2, [1.0] * 16)], "k int, f array<double>")
    mags = products.magnitudes(df, ["k"], "f", products.fourier_basis(spark, 16)).collect()
    assert len(mags) == 18 and all(r.mag == 0 for r in mags if r.k == 1)


# kept statistics


def gate_rows(day, n, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.gauss(0, 3), 0.0, 1.5, None])
    return [(day, rng.choice(["a", "a", "a", "b", None]), i, value(), value(), value(), value()) for i in range(n)]


def test_daily_thresholds_equal_those_of_all_rows(spark, tmp_path):
    from pulsegrid.constants import GATE_FEATURES, GATE_K

    schema = "day string, rec string, frame long, " + ", ".join(f"{f} double" for f in GATE_FEATURES)
    days = {d: gate_rows(d, n, s) for s, (d, n) in enumerate([("d1", 400), ("d2", 1), ("d3", 700)])}
    held = DailyStatistics(spark, str(tmp_path / "kept"), ["rec"])

    def check(rows):
        want = {}
        for r in gate_thresholds(spark.createDataFrame(rows, schema), ["rec"], "frame").collect():
            want |= {(r.rec, f): r[f"thr_{f}"] for f in GATE_FEATURES}
        got = {(r.rec, r.feature): r.threshold for r in held.thresholds(dict(zip(GATE_FEATURES, GATE_K))).collect()}
        assert set(got) == set(want)
        assert all((got[k] is None and want[k] is None) or math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)

    held.add(spark.createDataFrame(days["d1"] + days["d2"], schema), GATE_FEATURES)
    check(days["d1"] + days["d2"])
    before = sorted(p.name for p in (tmp_path / "kept").rglob("day=d1/*.parquet"))
    held.add(spark.createDataFrame(days["d3"], schema), GATE_FEATURES)
    check(days["d1"] + days["d2"] + days["d3"])
    # An older day is neither read for the new one nor written again; a day that is added again replaces itself.
    assert sorted(p.name for p in (tmp_path / "kept").rglob("day=d1/*.parquet")) == before
    held.add(spark.createDataFrame(days["d3"], schema), GATE_FEATURES)
    check(days["d1"] + days["d2"] + days["d3"])


def test_medians_pass_over_other_octaves(spark, tmp_path):
    held = DailyStatistics(spark, str(tmp_path / "kept"), ["k"])
    rows = spark.range(2000).selectExpr("'x' as day", "1 as k", "pow(1.01, id) as v")
    held.add(rows, ["v"])
    assert held.medians().first()["median"] == pytest.approx((1.01**999 + 1.01**1000) / 2)
    scans_ = [line for line in plan_of(held.medians()).splitlines() if "PushedFilters" in line and "octave" in line]
    assert any("In(octave" in line or "EqualTo(octave" in line for line in scans_)


# SQL functions


def test_sql_functions(spark):
    assert set(register_functions(spark)) == set(FUNCTIONS) == set(register_functions(spark))
    row = spark.sql(
        "select hz_to_midi(440D) a, note_name(60) b, pitch_class(61) c, hz_to_piano(1D) d, clock(75.25D) e, clip_low(-1D, 0D) f,"
        " first_argmax(array(1D, 3D, 3D)) g, bin_to_hz(2) h, frame_seconds(86L) i, fixed_2(0.125D) j, midi_to_hz(cast(null as int)) k"
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == (69, "C4", 1, None, "1:15.3", 0.0, 1)
    assert row.h == pytest.approx(2 * 44100 / 2048) and row.i == pytest.approx(86 * 512 / 44100) and row.j == "0.12" and row.k is None
    plan = plan_of(spark.sql("select hz_to_midi(id) as m from range(10) where hz_to_midi(id) > 3"))
    assert "PythonUDF" not in plan and "LOG2" in plan.upper()
