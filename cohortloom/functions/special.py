"""Arrow-batched special functions Spark has no built-in for."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()
P_SHIFT = 1e-15  # fixed value added before the normal quantile


def _log_factorial(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=float)
    out = np.zeros_like(v)
    small = v < 32
    if small.any():
        out[small] = [math.lgamma(t + 1) for t in v[small]]
    big = v[~small] + 1.0
    if big.size:  # Stirling series, relative error below 1e-15 from 33 on
        inv = 1.0 / big
        series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680
        out[~small] = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + series
    return out


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact P: total probability of tables no likelier than the observed one.

    Terms further than 40 standard deviations from the mean are below 1e-300,
    so only that window is summed; it is the whole support for ordinary tables.
    """
    r1, c1, n = a + b, a + c, a + b + c + d
    if n == 0 or r1 in (0, n) or c1 in (0, n):
        return 1.0
    mean = r1 * c1 / n
    var = mean * (1 - c1 / n) * (n - r1) / max(n - 1, 1)
    reach = int(40 * math.sqrt(var)) + 64
    lo = max(0, r1 + c1 - n)
    hi = min(r1, c1)
    lo, hi = max(lo, min(a, int(mean) - reach)), min(hi, max(a, int(mean) + reach))
    x = np.arange(lo, hi + 1, dtype=float)
    logp = -(
        _log_factorial(x)
        + _log_factorial(c1 - x)
        + _log_factorial(r1 - x)
        + _log_factorial(n - r1 - c1 + x)
    )
    logp -= logp.max()
    p = np.exp(logp)
    p /= p.sum()
    return float(min(1.0, p[p <= p[int(a - lo)] * (1 + 1e-7)].sum()))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore").astype(float)


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(
        [fisher_two_sided(int(i), int(j), int(k), int(m)) for i, j, k, m in zip(a, b, c, d)],
        dtype=float,
    )


@F.pandas_udf(T.DoubleType())
def abs_quantile_of_half_p(p: pd.Series) -> pd.Series:
    """|normal quantile of P/2|, the display z of an exact test."""

    def one(v: float) -> float:
        q = v / 2 + P_SHIFT
        return abs(_NORMAL.inv_cdf(q)) if 0 < q < 1 else 0.0

    return p.map(one, na_action="ignore").astype(float)
