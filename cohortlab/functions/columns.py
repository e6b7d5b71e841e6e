"""Column expressions (all JVM-side, codegen-friendly; no Python UDFs)."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab import constants as C

# Plain decimal / scientific number, the forms a numeric parse accepts. Spark's own
# cast also accepts suffixes such as '5d' and the words inf / nan, which the
# reference treats as garbage, so text is matched against this first.
NUMERIC_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def strict_double(col: Column, what: str) -> Column:
    """Parse text to DOUBLE; null stays null; anything unparseable fails the job."""
    return (
        F.when(col.isNull(), F.lit(None).cast("double"))
        .when(col.rlike(NUMERIC_RE), F.trim(col).cast("double"))
        .otherwise(F.raise_error(F.concat(F.lit(f"{what} has an unparseable value: "), col)).cast("double"))
    )


def clean_funding_text(col: Column) -> Column:
    """P1 cleaning: trim, '-' means missing, thousands separators dropped."""
    t = F.trim(col)
    return F.when(t == "-", F.lit(None).cast("string")).otherwise(F.regexp_replace(t, ",", ""))


def lenient_double(col: Column) -> Column:
    """Guarded parse that yields null for unparseable text (quarantine variant)."""
    return F.when(col.rlike(NUMERIC_RE), F.trim(col).cast("double"))


def funding_band(usd: Column) -> Column:
    """Right-closed bands (lo, hi]; 0, negative and null have no band."""
    e, lab = C.FUNDING_BIN_EDGES, C.FUNDING_BIN_LABELS
    expr = F.when((usd > e[0]) & (usd <= e[1]), F.lit(lab[0]))
    for i in range(1, len(lab)):
        hi = e[i + 1]
        cond = usd > e[i] if math.isinf(hi) else (usd > e[i]) & (usd <= hi)
        expr = expr.when(cond, F.lit(lab[i]))
    return expr


def funding_band_ord(usd: Column) -> Column:
    e = C.FUNDING_BIN_EDGES
    expr = F.when((usd > e[0]) & (usd <= e[1]), F.lit(0))
    for i in range(1, len(C.FUNDING_BIN_LABELS)):
        hi = e[i + 1]
        cond = usd > e[i] if math.isinf(hi) else (usd > e[i]) & (usd <= hi)
        expr = expr.when(cond, F.lit(i))
    return expr


def age_band(age: Column) -> Column:
    """Left-closed bands [lo, hi)."""
    e, lab = C.AGE_BIN_EDGES, C.AGE_BIN_LABELS
    expr = F.when((age >= e[0]) & (age < e[1]), F.lit(lab[0]))
    for i in range(1, len(lab)):
        hi = e[i + 1]
        cond = age >= e[i] if math.isinf(hi) else (age >= e[i]) & (age < hi)
        expr = expr.when(cond, F.lit(lab[i]))
    return expr


def wilson_bounds(successes: Column, n: Column, confidence: float = 0.90) -> tuple[Column, Column]:
    """Wilson score interval, n = 0 -> (0, 1), clamped to [0, 1]."""
    z = C.WILSON_Z[confidence]
    nd = n.cast("double")
    phat = successes.cast("double") / nd
    denom = F.lit(1.0) + F.lit(z * z) / nd
    center = phat + F.lit(z * z) / (F.lit(2.0) * nd)
    margin = F.lit(z) * F.sqrt(phat * (F.lit(1.0) - phat) / nd + F.lit(z * z) / (F.lit(4.0) * nd * nd))
    lower = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (center - margin) / denom))
    upper = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (center + margin) / denom))
    return lower, upper


def round6(col: Column) -> Column:
    return F.round(col.cast("double"), 6)
