"""95 % confidence intervals: Wald, link scale, and exact for Poisson counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.96
# Standard normal 97.5 % point, only used to start the exact quantile search.
_Z = 1.959963984540054


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided p value of a standard normal statistic (for coefficient tables)."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore").astype("float64")


def wald(p: Column, n: Column) -> tuple[Column, Column, Column]:
    """Standard error and both bounds of a proportion; bounds are not clipped."""
    se = F.sqrt(F.try_divide(p * (1 - p), n))
    return se, p - Z95 * se, p + Z95 * se


def log_link(fit: Column, se: Column) -> tuple[Column, Column, Column]:
    return F.exp(fit), F.exp(fit - Z95 * se), F.exp(fit + Z95 * se)


def inverse_logit(fit: Column) -> Column:
    return 1 / (1 + F.exp(-fit))


def logit_link(fit: Column, se: Column) -> tuple[Column, Column, Column]:
    return inverse_logit(fit), inverse_logit(fit - Z95 * se), inverse_logit(fit + Z95 * se)


def interval_text(value: Column, low: Column, high: Column) -> Column:
    """``value (low-high)`` with two decimals and an en dash."""
    return F.format_string("%.2f (%.2f–%.2f)", value, low, high)


# from this shape on the expansion is exact to rounding
UNIFORM_FROM = 1e4
MAX_STEPS = 60


def _lower_gamma(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised lower incomplete gamma P(a, x) and its density in x, for x > 0."""
    log_gamma = np.array([math.lgamma(v) for v in a])
    density = np.exp((a - 1) * np.log(x) - x - log_gamma)
    out = np.empty_like(x)

    series = x < a + 1
    if series.any():
        s_a, s_x = a[series], x[series]
        term = 1 / s_a
        total = term.copy()
        step = s_a.copy()
        while True:
            step += 1
            term = term * s_x / step
            total += term
            if (term <= total * 1e-17).all():
                break
        out[series] = total * density[series] * s_x

    tail = ~series
    if tail.any():
        t_a, t_x = a[tail], x[tail]
        tiny = 1e-300
        b = t_x + 1 - t_a
        c = np.full_like(t_x, 1 / tiny)
        d = 1 / b
        h = d.copy()
        i = 0.0
        while True:
            i += 1
            an = -i * (i - t_a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
            if (np.abs(delta - 1) <= 4e-16).all():
                break
        out[tail] = 1 - h * density[tail] * t_x
    return out, density


def _excess(u: np.ndarray) -> np.ndarray:
    """u - log(1 + u) without cancellation for small u."""
    series = sum((-1) ** n * u**n / n for n in range(2, 12))
    return np.where(np.abs(u) < 0.02, series, u - np.log1p(u))


def _uniform_lower_gamma(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for large ``a``, at a cost that does not depend on it: the uniform
    expansion around the normal law with its first two correction terms."""
    u = (x - a) / a
    eta = np.sign(u) * np.sqrt(2 * _excess(u))
    safe = np.where(np.abs(u) < 1e-6, 1e-6, u)
    safe_eta = np.sign(safe) * np.sqrt(2 * _excess(safe))
    first = np.where(np.abs(u) < 1e-3, -1 / 3 + u / 12 - 23 * u**2 / 540, 1 / safe - 1 / safe_eta)
    second = np.where(np.abs(u) < 1e-2, -1 / 540 - u / 288, 1 / safe_eta**3 - 1 / safe**3 - 1 / safe**2 - 1 / (12 * safe))
    normal = np.array([math.erfc(-v) / 2 for v in eta * np.sqrt(a / 2)])
    bell = np.exp(-a * eta**2 / 2) / np.sqrt(2 * math.pi * a)
    return normal - bell * (first + second / a), bell / ((1 + u) * (1 + 1 / (12 * a)))


def _lower_gamma_any(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, density = np.empty_like(x), np.empty_like(x)
    large = a >= UNIFORM_FROM
    for part, rule in ((large, _uniform_lower_gamma), (~large, _lower_gamma)):
        if part.any():
            value[part], density[part] = rule(a[part], x[part])
    return value, density


def gamma_quantile(p: float, shape: np.ndarray) -> np.ndarray:
    """Quantile of the unit-scale gamma: normal-cube start, then damped Newton steps.

    Half of the chi-square quantile with ``2 * shape`` degrees of freedom.
    """
    a = np.asarray(shape, dtype=float)
    z = math.copysign(_Z, p - 0.5)
    x = a * (1 - 1 / (9 * a) + z / (3 * np.sqrt(a))) ** 3
    x = np.maximum(x, 1e-3 * a)
    for _ in range(MAX_STEPS):
        value, density = _lower_gamma_any(a, x)
        new = np.clip(x - (value - p) / density, x / 2, x * 2)
        moved = np.abs(new - x)
        x = new
        # steps square the error: what is left after this one is below rounding
        if (moved <= 1e-9 * x).all():
            return x
    raise ArithmeticError(f"no gamma quantile within {MAX_STEPS} steps")


_LIMITS = T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])


@F.pandas_udf(_LIMITS)
def poisson_limits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Exact 95 % limits of a Poisson mean given a count; one row per stratum."""
    for counts in batches:
        known = counts.notna().to_numpy()
        k = counts[known].to_numpy(dtype=float)
        lower = np.full(len(counts), np.nan)
        upper = np.full(len(counts), np.nan)
        low = np.zeros_like(k)
        if (k > 0).any():
            low[k > 0] = gamma_quantile(0.025, k[k > 0])
        if len(k):
            upper[known] = gamma_quantile(0.975, k + 1)
        lower[known] = low
        yield pd.DataFrame({"lower": lower, "upper": upper})
