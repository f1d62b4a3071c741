"""Skill arithmetic. A recovery whose denominator is not positive is NULL, never divided by a small constant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skill(metric: Column, offset: float = 0.0, floor: bool = False) -> Column:
    """metric - offset (R2: 0, AUC: 0.5), floored at 0 on request."""
    s = metric - F.lit(offset)
    return F.greatest(F.lit(0.0), s) if floor else s


def recovery_pct(baseline: Column, model: Column, floor: bool = False) -> Column:
    b = F.greatest(F.lit(0.0), baseline) if floor else baseline
    return F.when(model > 0, F.lit(100.0) * b / model)


def increment(baseline: Column, model: Column) -> Column:
    return model - baseline


def rmse_skill(rmse: Column, reference: Column) -> Column:
    return F.lit(1.0) - F.try_divide(rmse, reference)


def meets_or_beats(baseline: Column, model: Column) -> Column:
    return baseline >= model
