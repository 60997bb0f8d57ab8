"""Scalar functions as SQL expression text; wrap in `F.expr` or use in `selectExpr`."""

from __future__ import annotations

from pulsegrid.constants import (
    FRAME_SIZE,
    HIGHEST_MIDI,
    HOP_SIZE,
    LOWEST_MIDI,
    ROOTS,
    SAMPLE_RATE,
)
from pulsegrid.functions import arrays as A

ROOT_ARRAY = "array(" + ", ".join(f"'{name}'" for name in ROOTS) + ")"


def midi_to_hz(m: str) -> str:
    return f"440D * pow(2D, (({m}) - 69) / 12D)"


def hz_to_midi(hz: str) -> str:
    """Nearest note, half to even."""
    return f"cast(rint(69 + 12 * log2(({hz}) / 440D)) as int)"


def piano_note(midi: str) -> str:
    """The note if it is on the keyboard, else NULL."""
    return f"if(({midi}) between {LOWEST_MIDI} and {HIGHEST_MIDI}, {midi}, null)"


def pitch_class(m: str) -> str:
    return f"pmod({m}, 12)"


def note_name(m: str) -> str:
    return f"concat({ROOT_ARRAY}[cast(pmod({m}, 12) as int)], cast(floor(({m}) / 12) - 1 as string))"


def bin_to_hz(k: str, rate: float = SAMPLE_RATE, size: int = FRAME_SIZE) -> str:
    return f"({k}) * {float(rate)}D / {size}"


def frame_seconds(frame: str, hop: int = HOP_SIZE, rate: float = SAMPLE_RATE) -> str:
    return f"({frame}) * {float(hop)}D / {float(rate)}D"


def samples_seconds(n: str, rate: float = SAMPLE_RATE) -> str:
    return f"({n}) / {float(rate)}D"


def fixed(x: str, digits: int, tie_up: bool = False) -> str:
    """A number >= 0 with fixed decimals, rounded by its exact binary value.

    `format_string` rounds the shortest decimal text instead: it makes 0.62 of 0.615, which
    lies below the tie. Exact ties go to the even neighbour, or up with `tie_up`.
    """
    scale = 10**digits
    unit = f"cast({1 << 60} as decimal(19,0))"
    parts = f"cast(cast((x_ - floor(x_)) * {float(1 << 60)}D as bigint) as decimal(19,0)) * {scale}"
    tie = "true" if tie_up else "n_ % 2 = 1"
    over = f"(p_ - (p_ div {unit}) * {unit}) * 2"
    up = f"if({over} > {unit} or ({over} = {unit} and {tie}), 1, 0)"
    number = A.bind(f"cast(floor(x_) as bigint) * {scale} + (p_ div {unit})", "n_", f"n_ + {up}")
    text = (
        f"concat(cast(v_ div {scale} as string), '.', lpad(cast(v_ % {scale} as string), {digits}, '0'))"
        if digits
        else "cast(v_ as string)"
    )
    return A.bind(f"cast({x} as double)", "x_", A.bind(parts, "p_", A.bind(number, "v_", text)))


def right_aligned(text: str, width: int) -> str:
    """Pad on the left; a longer text is kept."""
    return f"lpad({text}, greatest({width}, length({text})), ' ')"


def clock(seconds: str) -> str:
    """Seconds as `m:ss.s`; a remainder that rounds to 60.0 is kept as it is."""
    rest = fixed(f"({seconds}) % 60", 1, tie_up=True)
    return f"concat(cast(floor(({seconds}) / 60) as bigint), ':', lpad({rest}, 4, '0'))"
