"""Logits, softmax and Dirichlet summaries as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.fixed import FEATURE_WEIGHTS


def linear_logit(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Sum of weight times feature over the eight features, in their order; missing weights count as 0."""
    w = FEATURE_WEIGHTS if weights is None else weights
    out = F.lit(0.0)
    for name in FEATURE_WEIGHTS:
        out = out + F.lit(float(w.get(name, 0.0))) * F.coalesce(features[name], F.lit(0.0))
    return out


def total(values: Column) -> Column:
    """Sum of an array of doubles, from first to last."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax of an array of doubles, shifted by its maximum; the temperature must be positive and finite."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    scaled = F.transform(logits, lambda x: x / t)
    top = F.array_max(scaled)
    exps = F.transform(scaled, lambda x: F.exp(x - top))
    return F.transform(exps, lambda e: e / total(exps))


def argmax(values: Column) -> Column:
    """Index from 0 of the largest value, the first of equal ones."""
    return -F.array_max(F.transform(values, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))["i"]


def log_loss(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(1e-15)))


def recency(age: Column) -> Column:
    return F.when(age.isNull(), 0.5).otherwise(1.0 / (1.0 + age))


def contradiction_ratio(support: Column, contradict: Column) -> Column:
    both = support + contradict
    return F.when(both == 0, 0.0).otherwise(contradict / both)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def evidential(logits: Column) -> dict[str, Column]:
    """Evidence, alpha, probabilities, belief and ignorance of an array of logits."""
    evidence = F.transform(logits, softplus)
    alpha = F.transform(evidence, lambda e: e + 1.0)
    s = total(alpha)
    return {"evidence": evidence, "alpha": alpha, "probabilities": F.transform(alpha, lambda a: a / s), "belief": F.transform(evidence, lambda e: e / s), "ignorance": F.size(alpha) / s}


def dirichlet_summary(alpha: Column, labels: Column) -> dict[str, Column]:
    """The finding that an array of positive finite alphas (two or more, as many labels) supports."""
    s, k = total(alpha), F.size(alpha)
    p = F.transform(alpha, lambda a: a / s)
    order = F.reverse(F.array_sort(F.transform(p, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))))
    top, second = -order[0]["i"], -order[1]["i"]
    ignorance = F.least(F.lit(1.0), k / s)
    entropy = -total(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(1e-12))))) / F.log(k.cast("double"))
    margin = order[0]["x"] - order[1]["x"]
    extreme = (ignorance >= 0.60) | (entropy >= 0.90) | (margin <= 0.05)
    band = (
        F.when(extreme, "extreme uncertainty")
        .when((ignorance >= 0.35) | (entropy >= 0.75) | (margin <= 0.15), "low confidence")
        .when((ignorance >= 0.15) | (margin <= 0.30), "moderate confidence")
        .otherwise("high confidence")
    )
    return {
        "emitter": F.get(labels, top),
        "probability": order[0]["x"],
        "belief_mass": F.greatest(F.get(alpha, top) - 1.0, F.lit(0.0)) / s,
        "ignorance_mass": ignorance,
        "dirichlet_strength": s,
        "normalized_entropy": entropy,
        "runner_up": F.get(labels, second),
        "probability_margin": margin,
        "confidence_band": band,
        "extreme_uncertainty": extreme,
    }


def lgamma(x: float) -> float:
    return math.lgamma(x)


def digamma(x: float) -> float:
    """Digamma for positive x: recurrence up to 6, then the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
