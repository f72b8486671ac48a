"""Ordinal-score column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnscore import schemas as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_ordinal(pred, lo: int = S.SCORE_MIN, hi: int = S.SCORE_MAX) -> Column:
    """Round half to even, clip to [lo, hi], as INT. NaN / null -> null (never correct)."""
    p = _c(pred).cast("double")
    clipped = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.rint(p)))
    return F.when(p.isNull() | F.isnan(p), F.lit(None)).otherwise(clipped).cast("int")


def tolerant(strict, label, tol: int = S.TOLERANCE) -> Column:
    """Flexible prediction: the label when |strict - label| <= tol, else strict."""
    return F.when(F.abs(_c(strict) - _c(label)) <= F.lit(tol), _c(label)).otherwise(_c(strict))


def score_int(score) -> Column:
    """``int(score)``: truncation toward zero of a (possibly NaN) double; NaN -> null."""
    s = _c(score).cast("double")
    return F.when(s.isNull() | F.isnan(s), F.lit(None)).otherwise(s).cast("int")


def nan_to_null(col) -> Column:
    c = _c(col)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
