"""Scores: clamping, the three roundings, weighted radar values, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """floor(x + 0.5), which rounds halves up for negative numbers too."""
    return F.floor(x + F.lit(0.5))


def clamped(x: Column, low: int = 0, high: int = 100) -> Column:
    """Between low and high; null is low."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x, F.lit(low))))


def ten_scale(scores: Sequence[Column]) -> list[Column]:
    """Scores of a scale of ten, if all lie within 0..10, times ten; all clamped to 0..100."""
    small = F.coalesce(F.lit(True), F.lit(True))
    for s in scores:
        small = small & F.coalesce((s >= 0) & (s <= 10), F.lit(False))
    return [clamped(F.when(small, s * 10).otherwise(s)) for s in scores]


def weighted(parts: Sequence[tuple[int, Column]]) -> Column:
    """Weighted mean of scores from 0 to 100 over the parts that are not null, rounded half up; 0 if all are null.

    Scores are clamped before they are weighed; weights are whole numbers, so that halves are exact."""
    weight = sum((F.when(c.isNotNull(), w).otherwise(0) for w, c in parts), F.lit(0))
    total = sum((w * clamped(c) for w, c in parts), F.lit(0))
    return F.when(weight > 0, F.floor(F.try_divide(2 * total + weight, 2 * weight))).otherwise(F.lit(0)).cast("long")


#: Weights of the radar's two compound dimensions, in hundredths.
POTENTIAL = (25, 55, 20)
SKILLS = (30, 70)


def radar(resume: Column, interview: Column, demeanor: Column) -> dict[str, Column]:
    return {
        "resume": clamped(resume), "interview": clamped(interview), "demeanor": clamped(demeanor),
        "potential": weighted(list(zip(POTENTIAL, (resume, interview, demeanor)))), "skills": weighted(list(zip(SKILLS, (resume, interview)))),
    }


def band(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 60, "fair").otherwise("weak")


def three_state(score: Column, high: float = 0.7, low: float = 0.3) -> Column:
    return F.when(score >= high, "supported").when(score >= low, "inferred").otherwise("unsupported")


def aggregated_verdict(verdicts: Column) -> Column:
    """Contradiction before entailment before neutral."""
    has = lambda v: F.exists(verdicts, lambda x: x == v)
    return F.when(has("contradiction"), "contradiction").when(has("entailment"), "entailment").otherwise("neutral")


def thresholded(verdict: Column, confidence: Column, threshold: float) -> Column:
    return F.when(confidence < threshold, "neutral").otherwise(verdict)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
