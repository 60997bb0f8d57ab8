"""Period estimators on lag curves, as array expressions (SQL text)."""

from __future__ import annotations

from pulsegrid.functions import arrays as A
from pulsegrid.functions import scalars as X


def lag_range(rate: float, low_hz: float, high_hz: float, available: int) -> tuple[int, int]:
    """Shortest and longest lag for a frequency range; it must span more than ten lags."""
    shortest, longest = int(rate / high_hz), min(int(rate / low_hz), available)
    if longest <= shortest + 10:
        raise ValueError("the lag range is too short for these frequencies")
    return shortest, longest


def autocorrelation_lag(
    acf: str, rate: float, shortest: int, longest: int, threshold: float = 0.25
) -> str:
    """Lag of the best strict peak of the normalised autocorrelation; low notes count 1.2 times."""
    peaks = (
        f"filter(sequence({shortest + 1}, {longest - 2}), j -> {acf}[j] > {acf}[j - 1] "
        f"and {acf}[j] > {acf}[j + 1] and {acf}[j] / power > {threshold}D)"
    )
    ranked = (
        f"transform({peaks}, j -> named_struct('w', round({acf}[j] / power * "
        f"if({rate}D / j < 150, 1.2D, 1D), 9), 'after', -j))"
    )
    return A.bind(f"if({acf}[0] > 0, {acf}[0], 1D)", "power", f"-(array_max({ranked}).after)")


def yin_lag(
    curve: str, rate: float, shortest: int, longest: int, threshold: float = 0.15
) -> str:
    """Refined lag on a normalised difference curve whose first element is `shortest`.

    First lag under the threshold, moved to a smaller value within three lags; else the
    best strict minimum (low notes favoured), unless it exceeds 0.8. NULL if none.
    """
    last = longest - shortest
    crossing = f"get(filter(sequence(0, {last - 1}), j -> {curve}[j] < {threshold}D), 0)"
    left = "greatest(0, hit - 3)"
    around = f"slice({curve}, {left} + 1, least({last}, hit + 4) - {left})"
    settled = A.bind(
        around,
        "near",
        f"if(array_min(near) < {curve}[hit], "
        f"cast({left} + array_position(near, array_min(near)) - 1 as int), hit)",
    )
    minima = (
        f"filter(sequence(1, {last - 2}), j -> {curve}[j] < {curve}[j - 1] "
        f"and {curve}[j] < {curve}[j + 1])"
    )
    lowest = (
        f"array_min(transform({minima}, j -> named_struct('w', round({curve}[j] * "
        f"if({rate}D / (j + {shortest}) < 200, 0.9D, 1D), 9), 'j', j))).j"
    )
    fallback = A.bind(lowest, "low", f"if({curve}[low] > 0.8D, null, low)")
    chosen = A.bind(crossing, "hit", f"if(hit is null, {fallback}, {settled})")
    l, m, r = f"{curve}[p - 1]", f"{curve}[p]", f"{curve}[p + 1]"
    shift = A.bind(
        f"-(({r} - {l}) / 2) / ({l} - 2 * {m} + {r})", "dx", "if(abs(dx) <= 0.5D, dx, 0D)"
    )
    curved = f"if({l} - 2 * {m} + {r} > 0D, {shift}, 0D)"
    refined = f"if(p > 0 and p < {last - 1}, {curved}, 0D)"
    return A.bind(chosen, "p", f"if(p is null, null, p + {shortest} + {refined})")


def lag_note(lag: str, rate: float) -> str:
    """Note of a period in samples, NULL off the keyboard."""
    return A.bind(X.hz_to_midi(f"{float(rate)}D / {lag}"), "note", X.piano_note("note"))
