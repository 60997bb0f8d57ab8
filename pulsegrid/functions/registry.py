"""The scalar functions as SQL functions of a session: plain expressions that the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pulsegrid.functions import arrays as A
from pulsegrid.functions import scalars as X

#: name -> (parameters, result type, expression)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "midi_to_hz": ("m INT", "DOUBLE", X.midi_to_hz("m")),
    "hz_to_midi": ("hz DOUBLE", "INT", X.hz_to_midi("hz")),
    "hz_to_piano": ("hz DOUBLE", "INT", A.bind(X.hz_to_midi("hz"), "m_", X.piano_note("m_"))),
    "piano_note": ("m INT", "INT", X.piano_note("m")),
    "pitch_class": ("m INT", "INT", X.pitch_class("m")),
    "note_name": ("m INT", "STRING", X.note_name("m")),
    "bin_to_hz": ("k INT", "DOUBLE", X.bin_to_hz("k")),
    "frame_seconds": ("frame BIGINT", "DOUBLE", X.frame_seconds("frame")),
    "samples_seconds": ("n BIGINT", "DOUBLE", X.samples_seconds("n")),
    "clip_low": ("x DOUBLE, low DOUBLE", "DOUBLE", "greatest(low, x)"),
    "clock": ("seconds DOUBLE", "STRING", X.clock("seconds")),
    "fixed_1": ("x DOUBLE", "STRING", X.fixed("x", 1)),
    "fixed_2": ("x DOUBLE", "STRING", X.fixed("x", 2)),
    "first_argmax": ("a ARRAY<DOUBLE>", "INT", f"cast({A.first_argmax('a')} as int)"),
    "array_total": ("a ARRAY<DOUBLE>", "DOUBLE", A.total("a")),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create or replace all functions as temporary SQL functions of this session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
