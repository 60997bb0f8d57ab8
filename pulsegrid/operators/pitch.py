"""Pitch estimators on one spectrum per row, as array expressions (SQL text).

`c` is a constant-Q spectrum of `n` semitone bins from the lowest piano note,
`m` a linear spectrum of `n` bins. All return a note number or NULL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.constants import CQT_BINS, FRAME_SIZE, LOWEST_MIDI, SAMPLE_RATE
from pulsegrid.functions import arrays as A
from pulsegrid.functions import scalars as X
from pulsegrid.functions.kernels import mismatch_errors


def harmonic_step(h: int) -> int:
    """Semitones from a tone to its `h`-th harmonic, to the nearest semitone."""
    return int(round(12 * np.log2(h)))


def harmonic_bin(b: str, h: int, n: int) -> str:
    """Bin nearest to the `h`-th harmonic of bin `b`; the top bin takes what lies beyond."""
    return f"least({b} + {harmonic_step(h)}, {n - 1})"


def harmonic_map(spark: SparkSession, n: int = CQT_BINS, max_h: int = 5) -> DataFrame:
    """Lookup `(bin, h, target)` of `n * max_h` rows."""
    steps = ", ".join(str(harmonic_step(h)) for h in range(1, max_h + 1))
    return (
        spark.range(n)
        .select(F.col("id").cast("int").alias("bin"), F.posexplode(F.expr(f"array({steps})")))
        .select(
            "bin",
            (F.col("pos") + 1).alias("h"),
            F.least(F.col("bin") + F.col("col"), F.lit(n - 1)).alias("target"),
        )
    )


def _hps_scores(res: str, n: int, max_h: int) -> str:
    support = " + ".join(
        f"if({harmonic_bin('b', h, n)} = b, 0D, lg[{harmonic_bin('b', h, n)}] / {h * h}D)"
        for h in range(2, max_h + 1)
    )
    scores = (
        f"transform(sequence(0, {n - 1}), b -> if({res}[b] < 0.05D * mx, -1e6D, "
        f"3 * lg[b] + 0.5D * ({support})))"
    )
    return A.bind(f"transform({res}, v -> ln(v + 1e-8D))", "lg", scores)


def hps_notes(c: str, n: int = CQT_BINS, max_voices: int = 4, max_h: int = 5) -> str:
    """Notes by log harmonic sum; each voice takes 0.9/h of its harmonics out of the rest."""
    taken = " + ".join(
        f"if({harmonic_bin('best', h, n)} = b, {0.9 / h}D, 0D)" for h in range(1, max_h + 1)
    )
    remaining = f"transform(st.res, (v, b) -> greatest(0D, v - {c}[b] * ({taken})))"
    stop = "sc[best] < ln(if(voice = 1, 0.08D, 0.4D) * mx)"
    step = A.bind(
        _hps_scores("st.res", n, max_h),
        "sc",
        A.bind(
            f"cast({A.first_argmax('sc')} as int)",
            "best",
            f"if({stop}, named_struct('res', st.res, 'notes', st.notes, 'open', false), "
            f"named_struct('res', {remaining}, 'notes', array_append(st.notes, {LOWEST_MIDI} + best), "
            f"'open', true))",
        ),
    )
    loop = (
        f"aggregate(sequence(1, {max_voices}), "
        f"named_struct('res', {c}, 'notes', cast(array() as array<int>), 'open', mx > 0D), "
        f"(st, voice) -> if(st.open, {step}, st), st -> array_sort(st.notes))"
    )
    return A.bind(f"array_max({c})", "mx", loop)


def hps_note(c: str, n: int = CQT_BINS, max_h: int = 5) -> str:
    """The single-voice form."""
    return f"get({hps_notes(c, n, 1, max_h)}, 0)"


def harmonic_sum_scores(c: str, n: int = CQT_BINS) -> str:
    """`2 * fundamental + sum of harmonics / h`; weak parts count as 0. Needs `mx`."""
    parts = " + ".join(
        f"if({c}[{harmonic_bin('b', h, n)}] > 0.06D * mx, {c}[{harmonic_bin('b', h, n)}] / {h}D, 0D)"
        for h in range(2, 6)
    )
    return (
        f"transform(sequence(0, {n - 1}), b -> "
        f"2 * if({c}[b] > 0.1D * mx, {c}[b], 0D) + {parts})"
    )


def missing_fundamental(c: str, n: int = CQT_BINS) -> str:
    """The bin an octave under the loudest one if its harmonics speak for it, else NULL. Needs `mx`."""
    support = " + ".join(f"{c}[{harmonic_bin('lower', h, n)}]" for h in (2, 3, 4))
    accepted = A.bind(
        support,
        "backing",
        f"if(backing > 4 * {c}[lower] and backing > 0.7D * mx and {c}[lower] < 0.2D * mx, lower, null)",
    )
    return A.bind(
        f"cast({A.first_argmax(c)} as int) - 12", "lower", f"if(lower < 0, null, {accepted})"
    )


def harmonic_sum_note(c: str, n: int = CQT_BINS, least_max: float = 0.1, correct: bool = True) -> str:
    """Note with the best harmonic sum, an octave lower when its fundamental is missing."""
    best = A.first_argmax(harmonic_sum_scores(c, n))
    note = f"{LOWEST_MIDI} + best"
    if correct:
        note = f"{LOWEST_MIDI} + if({c}[best] < 0.3D * mx, coalesce({missing_fundamental(c, n)}, best), best)"
    pick = A.bind(f"cast({best} as int)", "best", note)
    return A.bind(f"array_max({c})", "mx", f"if(mx < {least_max}D, null, {pick})")


def fft_peak(
    m: str,
    n: int = FRAME_SIZE // 2 + 1,
    rate: float = SAMPLE_RATE,
    size: int = FRAME_SIZE,
    low_hz: float = 40,
    high_hz: float = 600,
) -> str:
    """Peak bin with the best `magnitude + harmonics - louder sub-harmonics` score, NULL if none."""
    first = max(1, int(low_hz * size / rate))
    stop = min(n - 1, int(high_hz * size / rate))
    peaks = (
        f"filter(sequence({first}, {stop - 1}), k -> {m}[k] > {m}[k - 1] and {m}[k] > {m}[k + 1] "
        f"and {m}[k] > 0.1D * top)"
    )
    overtones = " + ".join(
        f"if(k * {h} < {min(size // 2, n)}, {A.nearby_max(m, f'(k * {h})', '2', str(n))} / {h * h}D, 0D)"
        for h in range(2, 6)
    )
    undertones = " + ".join(
        f"if(k * {rate / size}D / {s} >= {low_hz}, "
        + A.bind(
            A.nearby_max(m, f"(k div {s})", "2", str(n)), "u", f"if(u > 0.5D * {m}[k], u * {s}, 0D)"
        )
        + ", 0D)"
        for s in (2, 3, 4)
    )
    ranked = (
        f"transform({peaks}, k -> named_struct('w', round({m}[k] + 0.3D * ({overtones}) "
        f"- 0.5D * ({undertones}), 9), 'after', -k))"
    )
    return A.bind(f"array_max({m})", "top", f"-(array_max({ranked}).after)")


def fft_note(m: str, n: int = FRAME_SIZE // 2 + 1, rate: float = SAMPLE_RATE, size: int = FRAME_SIZE) -> str:
    midi = X.hz_to_midi(f"k * {rate / size}D")
    return A.bind(
        fft_peak(m, n, rate, size),
        "k",
        f"if(k is null, null, {A.bind(midi, 'note', X.piano_note('note'))})",
    )


def harmonic_fit(
    hz: str, m: str, n: int = FRAME_SIZE // 2 + 1, rate: float = SAMPLE_RATE, size: int = FRAME_SIZE
) -> str:
    """How well a fundamental explains a linear spectrum."""

    def nearest(f: str) -> str:
        return f"cast(least({n - 1}, rint({f} / {rate / size}D)) as int)"

    around = A.bind(
        nearest("hz * h"),
        "at_",
        A.nearby_max(m, "at_", "if(hz > 100, 3, 5)", str(n)),
    )
    counted = f"hz * h < {rate / 2}D and w > if(hz < 150, 0.05D, 0.1D) * top"
    harmonics = (
        f"aggregate(sequence(2, if(hz < 150, 8, 5)), named_struct('x', 0D, 'found', 0), (st, h) -> "
        + A.bind(
            around,
            "w",
            f"if({counted}, named_struct('x', st.x + w * if(hz < 100, 1.5D, 1D) / h, "
            f"'found', st.found + 1), st)",
        )
        + ")"
    )
    mix = (
        "case when hz < 150 and hs.found >= 2 then fs * 0.2D + hs.x * 0.8D "
        "when hz < 150 then fs * 0.6D + hs.x * 0.4D "
        "when hs.found > 0 then fs * 0.4D + hs.x * 0.6D else fs end"
    )
    body = A.bind(
        A.nearby_max(m, nearest("hz"), "2", str(n)),
        "fs",
        A.bind(harmonics, "hs", f"({mix}) * if(hs.found >= 3, 1.2D, 1D)"),
    )
    return A.bind(hz, "hz", A.bind(f"array_max({m})", "top", body))


def mismatch_f0(
    df: DataFrame, peaks: str, name: str, low: int = 80, high: int = 800, accept: float = 50.0
) -> DataFrame:
    """Add the fundamental that explains `peaks` best, 0 if the error is not under `accept`.

    Grid search in steps of 2 over [low, high], then in steps of 0.2 from 5 below the best to
    6 above, inside [low, high + 1). The finer grid wins only if it is strictly better.
    """
    coarse = f"transform(sequence(0, {(high - low) // 2}), j -> {low} + 2D * j)"
    start = f"greatest({low}D, _b1.hz - 5)"
    count = f"cast(ceil(round((least({high}D, _b1.hz + 5) + 1 - {start}) / 0.2D, 6)) as int)"
    fine = (
        f"transform(zip_with(array_repeat({start}, {count}), sequence(0, {count} - 1), "
        "(s, j) -> s + 0.2D * j), g -> round(g, 1))"
    )

    def best(rows: DataFrame, grid: str, into: str) -> DataFrame:
        errors = mismatch_errors(F.col(f"{peaks}.freq"), F.col(f"{peaks}.mag"), F.col("_grid"))
        return (
            rows.withColumn("_grid", F.expr(grid))
            .withColumn("_err", errors)
            .withColumn(
                into,
                F.expr(
                    "array_min(zip_with(_err, _grid, "
                    "(e, g) -> named_struct('err', round(e, 9), 'hz', g)))"
                ),
            )
            .drop("_grid", "_err")
        )

    tried = best(best(df, coarse, "_b1"), fine, "_b2")
    return tried.withColumn(
        name,
        F.expr(
            f"case when size({peaks}) = 0 or least(_b1.err, _b2.err) >= {accept}D then 0D "
            "when _b2.err < _b1.err then _b2.hz else _b1.hz end"
        ),
    ).drop("_b1", "_b2")


def suppressed(c: str, note: str, share: float = 0.8, max_h: int = 7) -> str:
    """Spectrum with `share` taken out at the harmonics of `note`; unchanged if it is NULL."""
    steps = ", ".join(str(harmonic_step(h)) for h in range(1, max_h + 1))
    return (
        f"transform({c}, (v, b) -> if({note} is not null and array_contains(array({steps}), "
        f"b - ({note} - {LOWEST_MIDI})), greatest(0D, v - {share}D * v), v))"
    )


def mismatch_notes(c: str, f0: str, max_voices: int = 4) -> str:
    """Polyphonic pick: the note of `f0`, then loud remaining bins that are not its harmonics."""
    ratio = f"pow(2D, (b + {LOWEST_MIDI} - lead) / 12D)"
    harmonic = f"exists(array(2, 3, 4, 5, 6), h -> abs({ratio} - h) < 0.1D)"
    loud = (
        f"filter(sequence(0, size(rest) - 1), b -> rest[b] > 0.8D * array_max(rest) and "
        f"(lead is null or (b + {LOWEST_MIDI} <> lead and not {harmonic})))"
    )
    chosen = (
        f"array_sort(concat(if(lead is null, cast(array() as array<int>), array(lead)), "
        f"transform(slice({loud}, 1, {max_voices} - if(lead is null, 0, 1)), b -> b + {LOWEST_MIDI})))"
    )
    lead = f"if({f0} > 0, {A.bind(X.hz_to_midi(f0), 'note', X.piano_note('note'))}, null)"
    return A.bind(lead, "lead", A.bind(suppressed(c, "lead"), "rest", chosen))
