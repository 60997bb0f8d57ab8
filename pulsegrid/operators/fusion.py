"""Vote over estimator candidates of one event, as array expressions (SQL text)."""

from __future__ import annotations

from pulsegrid.constants import FRAME_SIZE, METHODS, SAMPLE_RATE
from pulsegrid.functions import arrays as A
from pulsegrid.functions import scalars as X
from pulsegrid.operators.pitch import harmonic_fit


def candidates(notes: dict[str, str]) -> str:
    """Array of (method, ord, note) in voting order, without the estimators that found nothing."""
    listed = ", ".join(
        f"named_struct('method', '{m}', 'ord', {i}, 'note', cast({notes[m]} as int))"
        for i, m in enumerate(METHODS)
        if m in notes
    )
    return f"filter(array({listed}), d -> d.note is not null)"


def winning_class(cands: str) -> str:
    """Candidates of the pitch class with most votes; the class seen first wins a tie."""
    ballots = (
        f"transform({cands}, d -> named_struct("
        f"'votes', size(filter({cands}, e -> e.note % 12 = d.note % 12)), "
        f"'after', -d.ord, 'pc', d.note % 12))"
    )
    return A.bind(
        f"array_max({ballots}).pc", "pc_", f"filter({cands}, d -> d.note % 12 = pc_)"
    )


def method_weight(method: str, hz: str) -> str:
    return (
        f"case when {hz} < 150 then case {method} when 'YIN' then 1.3D when 'Autocorr' then 1.2D "
        f"when 'FFT' then 1.1D else 1D end "
        f"when {hz} < 300 and {method} in ('YIN', 'HPS') then 1.1D else 1D end"
    )


def robust_pick(
    cands: str, m: str, n: int = FRAME_SIZE // 2 + 1, rate: float = SAMPLE_RATE, size: int = FRAME_SIZE
) -> str:
    """Struct (note, method): a lone candidate, else the octave that fits the spectrum best."""
    hz = X.midi_to_hz("d.note")
    scored = (
        "array_max(transform(g, d -> named_struct('w', round("
        f"{harmonic_fit(hz, m, n, rate, size)} * {method_weight('d.method', hz)}, 9), "
        "'after', -d.ord, 'note', d.note, 'method', concat(d.method, ' (octave-corrected)'))))"
    )
    chosen = A.bind(scored, "w_", "named_struct('note', w_.note, 'method', w_.method)")
    alone = "named_struct('note', g[0].note, 'method', g[0].method)"
    picked = A.bind(winning_class(cands), "g", f"if(size(g) = 1, {alone}, {chosen})")
    return f"if(size({cands}) = 0, null, {picked})"


def cascade(robust: str, simple: str, hps: str, fft: str) -> str:
    """Struct (note, method, confidence) from the first estimator of the cascade that found a note."""

    def row(note: str, method: str, confidence: float) -> str:
        return f"named_struct('note', {note}, 'method', {method}, 'confidence', {confidence}D)"

    return (
        f"case when {robust}.note is not null then "
        f"{row(f'{robust}.note', f'''concat('Robust (', {robust}.method, ')')''', 0.9)} "
        f"when {simple} = {hps} then {row(simple, repr('CQT (consensus)'), 0.8)} "
        f"when {simple} is not null then {row(simple, repr('CQT (simple)'), 0.7)} "
        f"when {hps} is not null then {row(hps, repr('CQT (HPS)'), 0.6)} "
        f"when {fft} is not null then {row(fft, repr('FFT'), 0.5)} "
        f"else {row('cast(null as int)', repr('None'), 0.0)} end"
    )


def median_note(cands: str) -> str:
    """Middle note of the candidates, cut to a whole number."""
    s = f"array_sort(transform({cands}, d -> d.note))"
    return A.bind(s, "ns", "cast((ns[(size(ns) - 1) div 2] + ns[size(ns) div 2]) div 2 as int)")
