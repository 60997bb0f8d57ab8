"""Chord templates and chord labelling. Frame-local: no shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.constants import CHORD_INTERVALS, ROOTS
from pulsegrid.functions import arrays as A
from pulsegrid.functions.kernels import similarities
from pulsegrid.functions.scalars import ROOT_ARRAY

QUALITIES = list(CHORD_INTERVALS)
N_TEMPLATES = len(ROOTS) * len(QUALITIES)
_QUALITY_ARRAY = "array(" + ", ".join(f"'{q}'" for q in QUALITIES) + ")"


def template_classes(tid: int) -> list[int]:
    """Pitch classes of a template; templates are numbered root by root."""
    root, quality = divmod(tid, len(QUALITIES))
    return [(root + step) % 12 for step in CHORD_INTERVALS[QUALITIES[quality]]]


def chord_templates(spark: SparkSession) -> DataFrame:
    """Long template table `(tid, label, quality, root_pc, pc, weight)` with unit-norm weights."""
    qualities = F.create_map(
        *[
            x
            for q, steps in CHORD_INTERVALS.items()
            for x in (F.lit(q), F.array(*[F.lit(s) for s in steps]))
        ]
    )
    return (
        spark.range(N_TEMPLATES)
        .select(F.col("id").cast("int").alias("tid"))
        .withColumn("root_pc", F.expr(f"cast(tid div {len(QUALITIES)} as int)"))
        .withColumn("quality", F.expr(f"{_QUALITY_ARRAY}[tid % {len(QUALITIES)}]"))
        .withColumn("steps", qualities[F.col("quality")])
        .select(
            "tid",
            F.expr(f"concat({ROOT_ARRAY}[root_pc], ':', quality)").alias("label"),
            "quality",
            "root_pc",
            F.explode(F.expr("transform(steps, s -> (root_pc + s) % 12)")).alias("pc"),
            (1 / F.sqrt(F.size("steps"))).alias("weight"),
        )
    )


def template_matrix() -> np.ndarray:
    """Unit-norm templates as columns, `(12, 108)`."""
    weights = np.zeros((12, N_TEMPLATES))
    for tid in range(N_TEMPLATES):
        classes = template_classes(tid)
        weights[classes, tid] = len(classes) ** -0.5
    return weights


def template_label(tid: str) -> str:
    return (
        f"concat({ROOT_ARRAY}[{tid} div {len(QUALITIES)}], ':', "
        f"{_QUALITY_ARRAY}[{tid} % {len(QUALITIES)}])"
    )


def match_chords(df: DataFrame, chroma: str = "chroma", scores: str | None = None) -> DataFrame:
    """Add `tid, label, root_pc, chord_score`: the best template, the lowest number on ties.

    `scores` keeps the similarities of all templates under that name.
    """
    weights = template_matrix()
    if scores:
        df = df.withColumn(scores, similarities(weights, best=False)(chroma))
    # Rows without chroma get number 0 and no score.
    return (
        df.withColumn("_best", similarities(weights, best=True)(chroma))
        .withColumn("chord_score", F.expr("get(_best, 0)"))
        .withColumn("tid", F.expr("coalesce(cast(get(_best, 1) as int), 0)"))
        .withColumn("label", F.expr(template_label("tid")))
        .withColumn("root_pc", F.expr(f"cast(tid div {len(QUALITIES)} as int)"))
        .drop("_best")
    )


def root_of_label(label: str) -> str:
    """Pitch class named before the colon."""
    return f"cast(array_position({ROOT_ARRAY}, split_part({label}, ':', 1)) - 1 as int)"


def bass_class(mag: str, base_class: int = 0, floor: float = 0.1) -> str:
    """Pitch class of the lowest bin that reaches `floor` of the frame's maximum."""
    lowest = A.bind(
        f"{floor}D * array_max({mag})",
        "least_",
        f"array_position(transform({mag}, v -> v >= least_), true) - 1",
    )
    return f"cast(({lowest} + {base_class}) % 12 as int)"


def gate_points(chroma: str, chord_score: str) -> str:
    """0..2: a strong second class, and a chord that beats every single note."""
    return A.bind(
        f"sort_array({chroma}, false)",
        "top_",
        f"cast(top_[1] >= 0.5D * top_[0] as int) + cast({chord_score} > round(top_[0], 9) as int)",
    )


def inversion(bass: str, root: str) -> str:
    step = f"pmod({bass} - {root}, 12)"
    return (
        f"case when {bass} is null or {step} = 0 then 'root' when {step} in (3, 4) then 'first' "
        f"when {step} = 7 then 'second' else 'slash' end"
    )
