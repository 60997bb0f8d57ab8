"""Rational resampling by a bank of short filters: any run of output samples needs only the input around it."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Four-term Blackman-Harris window (fixed values).
WINDOW = (0.35875, 0.48829, 0.14128, 0.01168)
LOBES = 64
# Filters that are kept at once; a bank with more values is built for each block of outputs anew.
KEPT = 1 << 22


def taper(u):
    """The window at `u` in [-1, 1], largest at 0."""
    return sum(a * np.cos(np.pi * k * u) for k, a in enumerate(WINDOW))


class Polyphase:
    """Resamples from `rate` to `target`: output m stands at input position m * rate / target.

    Each output is a sum over the `2 * reach` nearest inputs with the weights of a tapered sinc of `lobes` zero crossings
    on either side, scaled to pass a constant signal unchanged. Beyond the ends the signal is zero.
    """

    def __init__(self, rate: int, target: int, lobes: int = LOBES):
        g = math.gcd(rate, target)
        self.up, self.down, self.lobes = target // g, rate // g, lobes
        self.cut = min(1.0, self.up / self.down)
        self.reach = math.ceil(lobes / self.cut)

    def length(self, n: int) -> int:
        """Outputs of `n` inputs."""
        return n * self.up // self.down

    def inputs(self, first: int, stop: int) -> tuple[int, int]:
        """Inputs that the outputs `first` to `stop` need; may reach over the ends."""
        return first * self.down // self.up - self.reach + 1, max(stop - 1, first) * self.down // self.up + self.reach + 1

    def weights(self, phase: np.ndarray) -> np.ndarray:
        """Filter of each phase (output position behind its input, in parts of `up`)."""
        at = phase[:, None] / self.up - np.arange(1 - self.reach, self.reach + 1)[None, :]
        u = at * self.cut
        w = np.where(np.abs(u) < self.lobes, np.sinc(u) * taper(u / self.lobes), 0.0)
        return w / w.sum(axis=1, keepdims=True)

    @property
    def bank(self) -> np.ndarray | None:
        return _bank(self.up, self.down, self.lobes) if self.up * 2 * self.reach <= KEPT else None

    def outputs(self, x: np.ndarray, begin: int, first: int, stop: int, block: int = 1 << 14) -> np.ndarray:
        """Outputs `first` to `stop` of a signal of which `x` holds the inputs from `begin` on; what `x` lacks is zero."""
        a, b = self.inputs(first, stop)
        x = np.concatenate([np.zeros(max(0, begin - a)), x[max(0, a - begin) :]])
        x = np.concatenate([x, np.zeros(max(0, b - a - len(x)))])
        out, bank = np.empty(max(0, stop - first)), self.bank
        spans = np.lib.stride_tricks.sliding_window_view(x, 2 * self.reach)
        for at in range(first, stop, block):
            m = np.arange(at, min(stop, at + block)) * self.down
            rows = spans[m // self.up - self.reach + 1 - a]
            phase = m % self.up
            out[at - first : at - first + len(m)] = np.einsum("ij,ij->i", rows, self.weights(phase) if bank is None else bank[phase])
        return out


@lru_cache(maxsize=4)
def _bank(up: int, down: int, lobes: int) -> np.ndarray:
    return Polyphase(down, up, lobes).weights(np.arange(up))
