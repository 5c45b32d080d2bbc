"""Scoring expressions: log counts, min-max scaling, blends, popularity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: blend weights and constants (must match the reference) ---
SIM_WEIGHT, RATIO_WEIGHT, REVIEWS_WEIGHT = 0.6, 0.25, 0.15
POP_REVIEWS_WEIGHT, POP_RATIO_WEIGHT = 0.6, 0.4
SCALE_EPS = 1e-8
BLEND_RATIO_DEFAULT = 0.5      # null / absent ratio in the blend
BLEND_REVIEWS_DEFAULT = 0.5    # absent review-count column in the blend
# --- end fixed values ---


def log_count(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.log1p(F.coalesce(col.cast("double"), F.lit(0.0)))


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    return (x - lo) / (hi - lo + F.lit(SCALE_EPS))


def blend(sim_norm: Column, ratio: Column | None, reviews_norm: Column | None) -> Column:
    """0.6*similarity + 0.25*ratio + 0.15*reviews (both scaled to [0, 1])."""
    r = F.coalesce(ratio.cast("double"), F.lit(BLEND_RATIO_DEFAULT)) if ratio is not None \
        else F.lit(BLEND_RATIO_DEFAULT)
    rc = reviews_norm if reviews_norm is not None else F.lit(BLEND_REVIEWS_DEFAULT)
    return F.lit(SIM_WEIGHT) * sim_norm + F.lit(RATIO_WEIGHT) * r + F.lit(REVIEWS_WEIGHT) * rc


def popularity(review_count: Column | str, positive_ratio: Column | str) -> Column:
    """0.6*log1p(count) + 0.4*ratio with nulls as 0."""
    rc = F.col(review_count) if isinstance(review_count, str) else review_count
    pr = F.col(positive_ratio) if isinstance(positive_ratio, str) else positive_ratio
    return (F.lit(POP_REVIEWS_WEIGHT) * log_count(rc)
            + F.lit(POP_RATIO_WEIGHT) * F.coalesce(pr.cast("double"), F.lit(0.0)))
