"""Statistical gate: does an event hold a chord or a single note?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.constants import GATE_FEATURES, GATE_K, GATE_SMOOTH, GATE_VOTES
from pulsegrid.functions import arrays as A
from pulsegrid.operators.series import exact_median, join_by_span, null_safe_join, over_segments
from pulsegrid.operators.spectra import entropy, flatness


def peak_ratio(chroma: str) -> str:
    """Second largest class over the largest."""
    return A.bind(f"sort_array({chroma}, false)", "top_", "top_[1] / (top_[0] + 1e-9D)")


def score_ratio(chroma: str, chord_score: str) -> str:
    """Best chord similarity over best single-note similarity."""
    return f"{chord_score} / (array_max({chroma}) + 1e-9D)"


def gate_features(df: DataFrame, chroma: str, chord_score: str, mag: str) -> DataFrame:
    return df.withColumns(
        {
            "peak_ratio": F.expr(peak_ratio(chroma)),
            "score_ratio": F.expr(score_ratio(chroma, chord_score)),
            "entropy": F.expr(entropy(mag)),
            "flatness": F.expr(flatness(mag)),
        }
    )


def gate_thresholds(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """One row per key: `thr_<feature>` = median + k * population deviation, and `_last` position."""
    long = df.select(
        *keys,
        F.expr(
            f"stack({len(GATE_FEATURES)}, "
            + ", ".join(f"'{f}', {f}" for f in GATE_FEATURES)
            + ") as (feature, value)"
        ),
    )
    medians = exact_median(long, [*keys, "feature"], "value")
    per_key = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"med_{f}") for f in GATE_FEATURES]
    )
    spread = df.groupBy(*keys).agg(
        *[F.stddev_pop(f).alias(f"sd_{f}") for f in GATE_FEATURES], F.max(pos).alias("_last")
    )
    return null_safe_join(per_key, spread, list(keys)).select(
        *keys,
        "_last",
        *[
            (F.col(f"med_{f}") + k * F.col(f"sd_{f}")).alias(f"thr_{f}")
            for f, k in zip(GATE_FEATURES, GATE_K)
        ],
    )


def gate_vote(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Add `votes` and `gate_raw`: enough features strictly above their threshold."""
    votes = sum(
        (F.col(f) > F.col(f"thr_{f}")).cast("int") for f in GATE_FEATURES
    )
    return (
        join_by_span(df, thresholds, keys, pos, "_last")
        .withColumn("votes", votes)
        .withColumn("gate_raw", F.col("votes") >= GATE_VOTES)
        .drop("_last", *[f"thr_{f}" for f in GATE_FEATURES])
    )


def smooth_gate(
    df: DataFrame, keys: Sequence[str], pos: str, flag: str = "gate_raw", name: str = "gate"
) -> DataFrame:
    """Median filter of a boolean over `GATE_SMOOTH` positions; outside counts as false."""
    reach = GATE_SMOOTH // 2

    def compute(rows, w):
        ones = F.sum(F.col(flag).cast("int")).over(w.rowsBetween(-reach, reach))
        return rows.withColumn(name, ones > reach)

    return over_segments(df, keys, pos, reach, reach, compute)
