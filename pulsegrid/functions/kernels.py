"""Arrow-batched transforms: a column of arrays in, a column of arrays out.

Only what has no practical JVM form is here: Fourier transforms, the constant-Q
product and lag sums. All rows of a batch with equal length are stacked.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.constants import (
    ANALYSIS_DELAY,
    C1_MIDI,
    CQT_BINS,
    FRAME_SIZE,
    HOP_SIZE,
    LOWEST_MIDI,
    ONSET_K,
    ONSET_WINDOW,
    SAMPLE_RATE,
)


DOUBLES = T.ArrayType(T.DoubleType())


def kernel_udf(function):
    """Arrow UDF from arrays to arrays.

    Declared non-deterministic only so that the optimizer neither copies it into a
    lambda or a pushed-down filter nor runs it twice.
    """
    return F.arrow_udf(function, DOUBLES).asNondeterministic()


# Values that a kernel is given at once: what it makes on its way does not grow with the batch.
BLOCK_VALUES = 1 << 18


def _in_blocks(kernel, rows: np.ndarray) -> np.ndarray:
    """Apply `kernel` to blocks of stacked rows; only its results are held."""
    step = max(1, BLOCK_VALUES // max(1, rows.shape[1]))
    if len(rows) <= step:
        return kernel(rows)
    out = None
    for at in range(0, len(rows), step):
        part = kernel(rows[at : at + step])
        if out is None:
            out = np.empty((len(rows), *part.shape[1:]), part.dtype)
        out[at : at + step] = part
    return out


def _by_length(col: pa.Array, kernel) -> pa.Array:
    """Apply `kernel` (stacked rows in, stacked rows out) to the rows of each length."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.values.to_numpy(zero_copy_only=False)
    starts = col.offsets.to_numpy()[:-1]
    if len(col) and not col.null_count and sizes[0] and (sizes == sizes[0]).all():
        out = _in_blocks(kernel, flat[starts[0] : starts[0] + sizes.sum()].reshape(len(col), -1).astype(np.float64, copy=False))
        ends = np.arange(len(col) + 1, dtype=np.int32) * np.int32(out.shape[1])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(out).ravel()))
    valid = ~np.asarray(col.is_null())
    rows: list = [None] * len(col)
    for size in np.unique(sizes[valid]) if valid.any() else []:
        where = np.flatnonzero(valid & (sizes == size))
        if size == 0:
            for i in where:
                rows[i] = np.empty(0)
            continue
        step = max(1, BLOCK_VALUES // size)
        for part in (where[at : at + step] for at in range(0, len(where), step)):
            stacked = flat[starts[part][:, None] + np.arange(size)].astype(np.float64, copy=False)
            for i, out in zip(part, kernel(stacked)):
                rows[i] = out
    widths = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
    present = [r for r in rows if r is not None and len(r)]
    values = np.concatenate(present) if present else np.empty(0)
    mask = pa.array(~valid) if (~valid).any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def in_turn(*kernels):
    """One Arrow UDF that applies kernels one after another, to a few rows at a time: of all but the last no batch is held."""
    functions = [k.func for k in kernels]

    def run(col: pa.Array) -> pa.Array:
        rows = max(1, BLOCK_VALUES // FRAME_SIZE)
        parts = []
        for at in range(0, max(1, len(col)), rows):
            part = col.slice(at, rows)
            for function in functions:
                part = function(part)
            parts.append(part)
        return pa.concat_arrays(parts)

    return F.arrow_udf(run, kernels[-1].returnType).asNondeterministic()


@kernel_udf
def rfft_magnitude(frame: pa.Array) -> pa.Array:
    """Magnitudes of the real FFT."""
    return _by_length(frame, lambda x: np.abs(np.fft.rfft(x, axis=1)))


@kernel_udf
def rfft_phase(frame: pa.Array) -> pa.Array:
    """Phases of the real FFT."""
    return _by_length(frame, lambda x: np.angle(np.fft.rfft(x, axis=1)))


def _lag_products(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2, 2 * n, axis=1)[:, :n]


def lag_frame(padded: int):
    """Zero-pad to `padded`, symmetric Hann taper, mean removal: the input of the lag estimators."""

    @kernel_udf
    def prepared(frame: pa.Array) -> pa.Array:
        def kernel(x):
            size = max(padded, x.shape[1])
            full = np.zeros((len(x), size))
            full[:, : x.shape[1]] = x
            full *= np.hanning(size)
            return full - full.mean(axis=1, keepdims=True)

        return _by_length(frame, kernel)

    return prepared


def autocorrelation(max_lag: int):
    """`sum_j x[j] * x[j + lag]` for the lags `0..max_lag`."""

    @kernel_udf
    def sums(frame: pa.Array) -> pa.Array:
        return _by_length(frame, lambda x: _lag_products(x)[:, : max_lag + 1])

    return sums


def lag_differences(max_lag: int):
    """`sum_j (x[j] - x[j + lag])^2` over the overlapping part, for the lags `0..max_lag`."""

    @kernel_udf
    def sums(frame: pa.Array) -> pa.Array:
        def kernel(x):
            lags = np.arange(min(max_lag + 1, x.shape[1]))
            energy = np.cumsum(x * x, axis=1)
            head = energy[:, x.shape[1] - 1 - lags]
            tail = energy[:, -1:] - np.where(lags > 0, energy[:, lags - 1], 0.0)
            return np.maximum(head + tail - 2 * _lag_products(x)[:, lags], 0.0)

        return _by_length(frame, kernel)

    return sums


def hps_notes(n: int = CQT_BINS, max_voices: int = 4, max_h: int = 5):
    """Notes of spectra of `n` semitone bins by log harmonic sum, in order; each voice takes 0.9/h of its harmonics out of the rest.

    As `operators.pitch.hps_notes`, for many rows at once.
    """
    bins = np.arange(n)
    targets = np.minimum(bins[:, None] + [int(round(12 * np.log2(h))) for h in range(1, max_h + 1)], n - 1)
    taken = np.zeros((n, n))
    for h in range(1, max_h + 1):
        np.add.at(taken, (bins, targets[:, h - 1]), 0.9 / h)

    def pick(c: np.ndarray) -> np.ndarray:
        """Bins of the voices of each row, -1 where there is none."""
        top, rest, picks = c.max(axis=1), c.copy(), np.full((len(c), max_voices), -1)
        rows = np.flatnonzero(top > 0)
        for voice in range(max_voices):
            logs = np.log(rest[rows] + 1e-8)
            support = np.zeros_like(logs)
            for h in range(2, max_h + 1):
                at = targets[:, h - 1]
                support += np.where(at == bins, 0.0, logs[:, at] / (h * h))
            scores = np.where(rest[rows] < 0.05 * top[rows, None], -1e6, 3 * logs + 0.5 * support)
            best = np.argmax(np.round(scores, 9), axis=1)
            goes_on = scores[np.arange(len(rows)), best] >= np.log((0.4 if voice else 0.08) * top[rows])
            rows, best = rows[goes_on], best[goes_on]
            picks[rows, voice] = best
            rest[rows] = np.maximum(0.0, rest[rows] - c[rows] * taken[best])
        return picks

    def notes(spectrum: pa.Array) -> pa.Array:
        valid = ~np.asarray(spectrum.is_null())
        held = [np.empty(0, np.int32)] * len(spectrum)
        rows = spectrum.filter(pa.array(valid))
        if len(rows):
            for k, found in zip(np.flatnonzero(valid), pick(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n).astype(np.float64)), strict=True):
                held[k] = np.sort(found[found >= 0] + LOWEST_MIDI).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
        values = np.concatenate(held) if held else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()), mask=pa.array(~valid) if (~valid).any() else None)

    return F.arrow_udf(notes, T.ArrayType(T.IntegerType())).asNondeterministic()


def chroma(size: int, base_class: int = 0):
    """Fold `size` bins to 12 pitch classes and divide by (L2 norm + 1e-6)."""

    @kernel_udf
    def folded(mag: pa.Array) -> pa.Array:
        classes = np.eye(12)[(np.arange(size) + base_class) % 12]

        def kernel(x):
            sums = x @ classes
            return sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-6)

        return _by_length(mag, kernel)

    return folded


def similarities(weights: np.ndarray, best: bool):
    """Products of a vector with the columns of a fixed matrix, to whole billionths.

    With `best` only the largest one and its column number, the first one on ties.
    """

    @kernel_udf
    def products(vector: pa.Array) -> pa.Array:
        def kernel(x):
            scores = np.floor(x @ weights * 1e9 + 0.5)
            if best:
                return np.column_stack([scores.max(axis=1) / 1e9, scores.argmax(axis=1)])
            return scores / 1e9

        return _by_length(vector, kernel)

    return products


@kernel_udf
def mismatch_errors(freq: pa.Array, mag: pa.Array, trial: pa.Array) -> pa.Array:
    """Two-way mismatch of the peaks of a row against each of its trial fundamentals.

    Distance of every harmonic (up to ten, below half the rate) to the nearest peak, plus
    magnitude times distance of every peak to the nearest harmonic, over harmonics + 1.
    """

    def error(f, m, f0):
        """Rows with equally many peaks and trials: `f`, `m` (rows, peaks) and `f0` (rows, trials)."""
        h = np.arange(1, 11)
        harmonic = f0[:, :, None] * h
        audible = harmonic <= SAMPLE_RATE / 2
        # The nearest peak is one of the two that a harmonic falls between.
        order = np.argsort(f, axis=1)
        f, m = np.take_along_axis(f, order, 1), np.take_along_axis(m, order, 1)
        gaps = np.empty_like(harmonic)
        for i, (row, wanted) in enumerate(zip(f, harmonic, strict=True)):
            right = np.searchsorted(row, wanted)
            gaps[i] = np.minimum(
                np.abs(row[np.minimum(right, len(row) - 1)] - wanted), np.abs(row[np.maximum(right - 1, 0)] - wanted)
            )
        nearest = np.rint(f[:, None, :] / f0[:, :, None])
        used = (f[:, None, :] >= 0.8 * f0[:, :, None]) & (nearest >= 1) & (nearest <= 10)
        off = np.where(used, np.abs(f[:, None, :] - f0[:, :, None] * nearest) * m[:, None, :], 0.0)
        return (np.where(audible, gaps, 0.0).sum(axis=2) + off.sum(axis=2)) / (audible.sum(axis=2) + 1)

    peaks, trials = (np.diff(c.offsets.to_numpy()) for c in (freq, trial))
    flat = [c.values.to_numpy(zero_copy_only=False) for c in (freq, mag, trial)]
    starts = [c.offsets.to_numpy()[:-1] for c in (freq, mag, trial)]
    out: list = [np.full(n, 1e6) for n in trials]
    for p, n in np.unique(np.stack([peaks, trials], axis=1), axis=0):
        if not p or not n:
            continue
        same = np.flatnonzero((peaks == p) & (trials == n))
        for part in np.array_split(same, -(-len(same) * p * n // (1 << 20))):
            rows = [x[s[part][:, None] + np.arange(k)] for x, s, k in zip(flat, starts, (p, p, n), strict=True)]
            for i, e in zip(part, error(*rows), strict=True):
                out[i] = e
    offsets = np.concatenate([[0], np.cumsum(trials)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.empty(0)))


def fourier_resample(target: int):
    """Resample arrays to `target` values by cropping or padding their spectrum."""

    @kernel_udf
    def resample(frame: pa.Array) -> pa.Array:
        return _by_length(frame, lambda x: resample_rows(x, target))

    return resample


def fourier_resample_by(up: int, down: int):
    """Resample arrays of any length n to `n * up // down` values."""

    @kernel_udf
    def resample(frame: pa.Array) -> pa.Array:
        return _by_length(frame, lambda x: resample_rows(x, x.shape[1] * up // down))

    return resample


def resample_rows(x: np.ndarray, target: int) -> np.ndarray:
    size = x.shape[1]
    if not target:
        return x[:, :0]
    kept = min(size, target)
    spectrum = np.fft.rfft(x, axis=1)[:, : kept // 2 + 1]
    if kept % 2 == 0 and size != target:
        # The middle coefficient stands for two when cut off, for half when spread out.
        spectrum[:, -1] *= 2.0 if target < size else 0.5
    return np.fft.irfft(spectrum, target, axis=1) * (target / size)


@lru_cache(maxsize=8)
def constant_q_basis(base_midi: int, centres: tuple[int, ...], bins: int = CQT_BINS) -> np.ndarray:
    """Hann-windowed complex tones, one per (centre, bin), cut to one frame.

    Length of bin k: Q * rate / f_k with Q = 1 / (2^(1/12) - 1). Each full tone has
    unit weight sum and is scaled by the root of its length.
    Shape `(FRAME_SIZE, len(centres) * bins * 2)`: real parts, then imaginary parts.
    """
    quality = 1 / (2 ** (1 / 12) - 1)
    hz = 440.0 * 2.0 ** ((base_midi + np.arange(bins) - 69) / 12)
    length = quality * SAMPLE_RATE / hz
    n = np.arange(FRAME_SIZE)
    columns = []
    for centre in centres:
        offset = (n - centre)[:, None]
        window = np.where(
            np.abs(offset) <= length / 2, 0.5 + 0.5 * np.cos(2 * np.pi * offset / length), 0.0
        )
        tone = window * np.exp(-2j * np.pi * hz * offset / SAMPLE_RATE)
        columns.append(tone * np.sqrt(length) / (length / 2))
    basis = np.concatenate(columns, axis=1)
    return np.concatenate([basis.real, basis.imag], axis=1)


def constant_q_rows(frames: np.ndarray, base_midi: int, centres: tuple[int, ...]) -> np.ndarray:
    """Mean constant-Q magnitude of stacked frames over the given centres."""
    product = frames @ constant_q_basis(base_midi, centres)
    half = product.shape[1] // 2
    magnitude = np.hypot(product[:, :half], product[:, half:])
    return magnitude.reshape(len(frames), len(centres), -1).mean(axis=1)


# Frames around a frame that its constant-Q tones reach into, and one halving filter.
CONTEXT_FRAMES = 70
HALVING = np.blackman(31) * np.sinc(0.5 * (np.arange(31) - 15))
HALVING = HALVING / HALVING.sum()


@lru_cache(maxsize=4)
def _octave_tones(base_midi: int, bins: int, per_octave: int) -> list[tuple[int, int, np.ndarray]]:
    """(halvings, reach in samples, tones) for groups of neighbouring bins.

    A bin is taken from the signal halved so often that it lies under a fifth of the rate;
    its tone then has a few hundred samples.
    """
    quality = 1 / (2 ** (1 / per_octave) - 1)
    hz = 440.0 * 2.0 ** ((base_midi - 69) / 12 + np.arange(bins) / per_octave)
    halvings = np.maximum(0, np.floor(np.log2(0.2 * SAMPLE_RATE / (1.1 * hz)))).astype(int)
    groups = []
    for d in sorted(set(halvings), reverse=True):
        own = hz[halvings == d]
        length = quality * SAMPLE_RATE / own / 2**d
        reach = int(np.ceil(length.max() / 2))
        n = np.arange(-reach, reach + 1)[:, None]
        window = np.where(np.abs(n) <= length / 2, 0.5 + 0.5 * np.cos(2 * np.pi * n / length), 0.0)
        tone = window * np.exp(-2j * np.pi * own * n * 2**d / SAMPLE_RATE)
        tone *= 2**d * 2 / np.sqrt(length * 2**d)
        groups.append((int(d), reach, np.concatenate([tone.real, tone.imag], axis=1)))
    return groups


def halved_signals(x: np.ndarray, times: int = 7) -> list[np.ndarray]:
    """The signal at its own rate, at half of it, and so on."""
    out = [x]
    for _ in range(times):
        out.append(np.convolve(out[-1], HALVING, "same")[::2])
    return out


def constant_q_track(
    halved: list[np.ndarray],
    centre: int,
    count: int,
    base_midi: int = C1_MIDI,
    bins: int = CQT_BINS,
    per_octave: int = 12,
) -> np.ndarray:
    """Constant-Q magnitudes of `count` frames whose first centre is at `centre`; whole tones.

    The signal counts as silent outside; it should reach `CONTEXT_FRAMES` frames beyond the
    outer ones where there is more of it.
    """
    columns = []
    for d, reach, tones in _octave_tones(base_midi, bins, per_octave):
        hop, middle = HOP_SIZE >> d, centre >> d
        span = np.pad(halved[d], reach)[middle : middle + (count - 1) * hop + 2 * reach + 1]
        product = np.lib.stride_tricks.sliding_window_view(span, 2 * reach + 1)[::hop] @ tones
        half = product.shape[1] // 2
        columns.append(np.hypot(product[:, :half], product[:, half:]))
    return np.concatenate(columns, axis=1)


def chroma_track(halved: list[np.ndarray], centre: int, count: int) -> np.ndarray:
    """Pitch classes of frames: seven octaves from C1 in thirds of a semitone, each class being
    its own bin and the two beside it; scaled to maximum 1, then by (L2 norm + 1e-6)."""
    fine = constant_q_track(halved, centre, count, C1_MIDI, 7 * 36, 36)
    sums = fine @ np.eye(12)[(np.arange(7 * 36) + 1) // 3 % 12]
    top = sums.max(axis=1, keepdims=True)
    sums = sums / np.where(top > 0, top, 1.0)
    return sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-6)


FRAME_CENTRES = tuple(range(0, FRAME_SIZE + 1, HOP_SIZE))


def constant_q(base_midi: int, centres: tuple[int, ...] = FRAME_CENTRES):
    """Constant-Q magnitudes of frames of `FRAME_SIZE` samples."""

    @kernel_udf
    def cqt(frame: pa.Array) -> pa.Array:
        return _by_length(frame, lambda x: constant_q_rows(x, base_midi, centres))

    return cqt


def normalised_differences(min_lag: int, max_lag: int):
    """Cumulative-mean normalised lag differences for lags `min_lag..max_lag`.

    `d[lag] * lag / sum_{min_lag <= j <= lag} d[j]`, 1 where the sum is 0.
    """

    @kernel_udf
    def curve(differences: pa.Array) -> pa.Array:
        def kernel(d):
            d = d[:, min_lag : max_lag + 1]
            lags = np.arange(min_lag, max_lag + 1)
            running = np.cumsum(d, axis=1)
            return np.where(running > 0, d * lags / np.where(running > 0, running, 1.0), 1.0)

        return _by_length(differences, kernel)

    return curve


def events_between(
    values: np.ndarray,
    first: int,
    start: int,
    window: int = ONSET_WINDOW,
    k: float = ONSET_K,
    slack: float = 0.0,
) -> list[tuple[int, float]]:
    """(position, threshold) of the onset events from position `start` on that have a next value.

    `values[0]` is at position `first`; the values reach back over the trailing window.
    `slack` lowers the threshold by that share.
    """
    values = np.asarray(values, dtype=np.float64)
    i = np.flatnonzero((values[1:-1] > values[:-2]) & (values[1:-1] > values[2:])) + 1
    i = i[first + i >= max(1, start)]
    if not len(i):
        return []
    # Trailing values of each maximum; those before the window, the data or position 1 are left out.
    at = i[:, None] - np.arange(window - 1, -1, -1)
    inside = at >= max(0, 1 - first)
    trail = np.where(inside, values[np.maximum(at, 0)], 0.0)
    n = inside.sum(axis=1)
    mean = trail.sum(axis=1) / n
    spread = np.sqrt((np.where(inside, trail - mean[:, None], 0.0) ** 2).sum(axis=1) / n)
    threshold = mean + k * spread
    over = values[i] > threshold * (1 - slack)
    return list(zip((first + i[over]).tolist(), threshold[over].tolist(), strict=True))


def frame_features(frames_per_segment: int, tonal: bool = True):
    """Features of a segment's own frames, from `(samples, seg, lead, n_samples)`; without `tonal` no constant-Q and chroma.

    Per frame: flux against the frame before, constant-Q magnitudes from C1, chroma, and the
    tapered analysis frame if the flux looks like an onset. That test is the onset rule with a hair of
    slack, so it never misses one; the rule itself is applied later, on the flux column.
    """
    kind = T.ArrayType(
        T.StructType(
            [
                T.StructField("flux", T.DoubleType()),
                T.StructField("cqt", DOUBLES),
                T.StructField("chroma", DOUBLES),
                T.StructField("event", DOUBLES),
            ]
        )
    )
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME_SIZE) / FRAME_SIZE)

    widths_of = (CQT_BINS, 12) if tonal else (0, 0)
    nothing = np.empty(0), np.empty((0, widths_of[0])), np.empty((0, widths_of[1])), []

    def rises(frames: np.ndarray) -> np.ndarray:
        """Flux of each frame but the first against the one before it; only the spectra of a block are held."""
        out, step = [np.empty(0)], BLOCK_VALUES // FRAME_SIZE
        for at in range(0, len(frames), step):
            mags = np.abs(np.fft.rfft(frames[max(0, at - 1) : at + step] * taper, axis=1))
            out.append((np.maximum(np.diff(mags, axis=0), 0.0) ** 2).sum(axis=1))
        return np.concatenate(out)

    def of_segment(x: np.ndarray, seg: int, lead: int, n_samples: int):
        start = seg * frames_per_segment
        last = (n_samples - FRAME_SIZE) // HOP_SIZE
        own = min(frames_per_segment, last + 1 - start)
        if own <= 0:
            return nothing
        back = min(lead, ONSET_WINDOW)
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME_SIZE)[::HOP_SIZE]
        frames = frames[lead - back : lead + own + ANALYSIS_DELAY + 1]
        flux = rises(frames)
        if back == 0:
            flux = np.concatenate([[0.0], flux])
        first = start - back + (1 if back else 0)
        events = [None] * own
        for p, _ in events_between(flux, first, start, slack=1e-9):
            if p < start + own:
                events[p - start] = frames[min(p + ANALYSIS_DELAY, last) - start + back] * taper
        flux = flux[start - first : start - first + own]
        if not tonal:
            return flux, np.empty((own, 0)), np.empty((own, 0)), events
        margin = np.zeros(4 * HOP_SIZE)  # more than the halving filters reach
        halved = halved_signals(np.concatenate([margin, x, margin]))
        centre = len(margin) + lead * HOP_SIZE + FRAME_SIZE // 2
        return flux, constant_q_track(halved, centre, own), chroma_track(halved, centre, own), events

    def lists(rows: np.ndarray) -> pa.ListArray:
        ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    def features(samples: pa.Array, seg: pa.Array, lead: pa.Array, n_samples: pa.Array) -> pa.Array:
        rows = []
        for x, *where in zip(samples, seg.to_pylist(), lead.to_pylist(), n_samples.to_pylist()):
            if x.is_valid:
                rows.append(of_segment(x.values.to_numpy().astype(np.float64), *where))
            else:
                rows.append(nothing)
        flux, cqt, chroma_ = (np.concatenate([r[i] for r in rows]) for i in range(3))
        events = [e for r in rows for e in r[3]]
        widths = np.array([0 if e is None else len(e) for e in events], dtype=np.int64)
        present = [e for e in events if e is not None]
        event = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)),
            pa.array(np.concatenate(present) if present else np.empty(0)),
            mask=pa.array(widths == 0),
        )
        structs = pa.StructArray.from_arrays(
            [pa.array(flux), lists(cqt), lists(chroma_), event],
            names=["flux", "cqt", "chroma", "event"],
        )
        counts = np.cumsum([0, *[len(r[0]) for r in rows]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(counts), structs)

    return F.arrow_udf(features, kind).asNondeterministic()
