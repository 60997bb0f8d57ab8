"""Array expressions as SQL text. One row holds one frame, so they never shuffle."""

from __future__ import annotations

import math
from functools import lru_cache


def bind(value: str, name: str, body: str) -> str:
    """Evaluate `value` once per row and use it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (acc, v) -> acc + v)"


def first_argmax(a: str, digits: int = 9) -> str:
    """0-based position of the first largest element, compared after rounding."""
    return bind(f"transform({a}, v -> round(v, {digits}))", "r", "array_position(r, array_max(r)) - 1")


def nearby_max(a: str, centre: str, reach: str, size: str) -> str:
    """Largest element within `reach` positions of a 0-based `centre`."""
    first = f"greatest(0, {centre} - {reach})"
    last = f"least({size}, {centre} + {reach} + 1)"
    return f"array_max(slice({a}, cast({first} + 1 as int), cast({last} - {first} as int)))"


def multiply(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (u, v) -> u * v)"


@lru_cache(maxsize=16)
def hann(size: int, periodic: bool) -> str:
    """Hann taper as an array of literals; denominator `size` when periodic, else `size - 1`."""
    step = 2 * math.pi / (size if periodic else max(size - 1, 1))
    return "array(" + ", ".join(f"{0.5 - 0.5 * math.cos(step * i)!r}D" for i in range(size)) + ")"
