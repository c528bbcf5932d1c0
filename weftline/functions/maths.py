"""Numeric columns and small numeric helpers without SciPy."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0 or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null where n is 0."""
    p, nn = share(hits, n), n.cast("double")
    mid = F.try_divide(p + z * z / (2 * nn), 1 + z * z / nn)
    half = F.try_divide(F.lit(z) * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)), 1 + z * z / nn)
    return mid - half, mid + half


def ten_point_effect(beta: Column) -> Column:
    """Change in per cent of an outcome in logs when a share grows by ten points."""
    return 100 * F.expm1(0.1 * beta)


def calibrated(raw: Column, tpr: float, fpr: float) -> Column:
    """A share corrected for a classifier's rates, held within 0 and 1."""
    if tpr <= fpr:
        raise ValueError("the true positive rate must exceed the false positive rate")
    return F.least(F.greatest((raw - fpr) / (tpr - fpr), F.lit(0.0)), F.lit(1.0))


def candidate_score(primary: Column, kind: Column, confidence: Column, length: Column, sentence: Column) -> Column:
    """How promising a URL is: primary source, mention type, confidence, length of the text, place in it."""
    return (
        100.0 * primary.cast("int") + 20.0 * (F.coalesce(kind, F.lit(0)) == 1).cast("int") + F.coalesce(confidence, F.lit(0)).cast("double")
        + F.least(F.greatest(F.coalesce(length, F.lit(0)) / 1000.0, F.lit(0.0)), F.lit(20.0))
        + 0.1 * (100 - F.least(F.greatest(F.coalesce(sentence, F.lit(9999)), F.lit(0)), F.lit(100)))
    )


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else math.nan


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees > x)."""
    if not math.isfinite(x) or df < 1:
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for k in range(1, (df + 1) // 2):
        total += term
        term *= half / (k + 0.5)
    return total


def pooled_kappa(agree: float, expected: float) -> float:
    return math.nan if abs(1 - expected) < 1e-12 else (agree - expected) / (1 - expected)
