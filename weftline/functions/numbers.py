"""Column functions on numbers: safe ratios, clamps, schedules, preference and policy terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, least: float = 1.0) -> Column:
    return a / F.greatest(b, F.lit(least))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def judge_rescaled(score: Column) -> Column:
    return clamp((score - 3.0) / 2.0)


def cosine_rate(step: Column, total: Column, peak: float) -> Column:
    """Cosine schedule with a floor of a tenth."""
    return F.lit(peak) * (F.lit(0.1) + F.lit(0.45) * (F.lit(1.0) + F.cos(F.lit(math.pi) * step / total)))


def kl_estimate(reference: Column, new: Column) -> Column:
    d = reference - new
    return F.exp(d) - d - 1


def clipped_objective(new: Column, old: Column, advantage: Column, eps: float = 0.2) -> Column:
    r = F.exp(new - old)
    return F.least(r * advantage, F.least(F.greatest(r, F.lit(1 - eps)), F.lit(1 + eps)) * advantage)


def is_clipped(new: Column, old: Column, eps: float = 0.2) -> Column:
    return F.abs(F.exp(new - old) - 1) > eps


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, penalty: float = 0.0) -> Column:
    """-log sigmoid of the scaled log-ratio, in its stable form, with a one-sided penalty for losing the chosen answer."""
    x = F.lit(beta) * ((chosen - rejected) - (ref_chosen - ref_rejected))
    loss = F.when(x >= 0, F.log1p(F.exp(-x))).otherwise(-x + F.log1p(F.exp(x)))
    return loss + F.lit(penalty) * F.greatest(ref_chosen - chosen, F.lit(0.0))


def controller_step(beta: Column, kl: Column, target: float, rate: float = 0.05, low: float = 1e-4, high: float = 2.0) -> Column:
    """Bounded multiplicative controller."""
    if target <= 0:
        raise ValueError("target must be positive")
    e = clamp(kl / target - 1)
    return F.least(F.greatest(beta * F.exp(F.lit(rate) * e), F.lit(low)), F.lit(high))


def position_of(x: Column, y: Column, w: Column, h: Column, width: float = 640.0, height: float = 480.0) -> Column:
    """Where the centre of a box lies: centre, else left or right, else top or bottom."""
    cx, cy = (x + w / 2) / width, (y + h / 2) / height
    mid = cx.between(0.35, 0.65) & cy.between(0.35, 0.65)
    side = F.abs(cy - 0.5) <= F.abs(cx - 0.5)
    return F.when(mid, "center").when(side, F.when(cx < 0.5, "left").otherwise("right")).otherwise(F.when(cy < 0.5, "top").otherwise("bottom"))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of an array of doubles where the mask array is 1; 0 if nowhere."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, v: a + v)
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))
