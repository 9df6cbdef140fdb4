"""Probability algebra used by accept/refuse decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _col(x)))


def sigmoid(z: Column, bound: float = 50.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(z, -bound, bound)))


def logit(p, eps: float = 1e-12) -> Column:
    p = clip(p, eps, 1.0 - eps)
    return F.ln(p / (1.0 - p))


def below(boundary) -> Column:
    """A value just under the boundary, for scores that must stay refused."""
    return _col(boundary) - 1.2e-16


def shift_to_boundary(p: Column, cut, boundary) -> Column:
    """Move a probability from its own cut to the common boundary scale.

    The result lies on the accepting side exactly when ``p >= cut``.
    """
    z = sigmoid(logit(p) - logit(cut) + logit(boundary))
    return F.when(p >= _col(cut), F.greatest(z, _col(boundary))).otherwise(F.least(z, below(boundary)))


def log_odds_blend(old: Column, new: Column, alpha: float) -> Column:
    z = (1.0 - alpha) * logit(old, 1e-10) + alpha * logit(new, 1e-10)
    return sigmoid(z, 35.0)


def relative_odds(selected: Column, other: Column) -> Column:
    return clip(sigmoid(logit(selected) - logit(other)), 1e-12, 1.0 - 1e-12)


def probability_share(selected: Column, other: Column) -> Column:
    a, b = clip(selected, 1e-12, 1.0 - 1e-12), clip(other, 1e-12, 1.0 - 1e-12)
    return a / (a + b)


def three_class_odds(p_absent: Column, p_match: Column) -> Column:
    """Odds of a true match against an absent one; the middle class is set aside."""
    return p_match / F.greatest(p_absent + p_match, F.lit(1e-15))


def calibrated_odds(p_absent: Column, p_match: Column, temperature: float, bias: float) -> Column:
    l0 = F.ln(clip(p_absent, 1e-12, 1.0))
    l2 = F.ln(clip(p_match, 1e-12, 1.0))
    return 1.0 / (1.0 + F.exp(-((l2 - l0) / temperature - bias)))
