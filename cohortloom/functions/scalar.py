"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of presence and absence that count as 1 and 0.
PRESENT_TOKENS = ("present", "yes", "true", "t", "+")
ABSENT_TOKENS = ("absent", "no", "false", "f", "-")

PROB_FLOOR = 1e-9  # fixed value: probabilities are clipped to [1e-9, 1 - 1e-9]


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double(c) -> Column:
    return as_col(c).cast("double")


def numeric_or_null(c) -> Column:
    """Numeric reading of a cell; NULL (never NaN) when it is not a number."""
    n = F.expr("try_cast(__c AS double)") if c is None else as_col(c).try_cast("double")
    return F.when(~F.isnan(n), n)


def binary_token(c) -> Column:
    """Presence/absence spellings to 1/0, other text to its number or NULL."""
    low = F.lower(F.trim(as_col(c).cast("string")))
    return (
        F.when(low.isin(*PRESENT_TOKENS), F.lit(1.0))
        .when(low.isin(*ABSENT_TOKENS), F.lit(0.0))
        .otherwise(numeric_or_null(low))
    )


def xlogx(c, base: str = "e") -> Column:
    """``x * log(x)`` with 0 at 0."""
    v = double(c)
    log = F.log2(v) if base == "2" else F.log(v)
    return F.when(v > 0, v * log).otherwise(F.lit(0.0))


def binary_entropy_bits(p: Column) -> Column:
    return -(xlogx(p, "2") + xlogx(1 - p, "2"))


def clipped_entropy_bits(p: Column) -> Column:
    q = F.greatest(F.lit(PROB_FLOOR), F.least(F.lit(1 - PROB_FLOOR), p))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def pairs_of(c) -> Column:
    """Number of unordered pairs among ``c`` items, in double to avoid overflow."""
    v = double(c)
    return v * (v - 1) / 2


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)
