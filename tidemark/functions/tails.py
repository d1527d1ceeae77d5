"""Tails of distributions that Spark has no function for, as scalar Python functions and pandas UDFs.

They run on result tables (a row for each feature or pair), never on readings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * f


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution by bisection on erfc."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def shapiro_wilk(x) -> tuple[float, float]:
    """W and p by Royston's approximation (AS R94); p is 0 outside 3 to 5000 values, and 1 where all values are equal."""
    x = np.sort(np.asarray([v for v in x if v is not None and v == v], float))
    n = len(x)
    if n < 3 or n > 5000:
        return float("nan"), 0.0
    if x[-1] - x[0] < 1e-19:
        return 1.0, 1.0
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        ss, u = (m * m).sum(), 1 / math.sqrt(n)
        c = m / math.sqrt(ss)
        poly = lambda k: sum(v * u**i for i, v in enumerate(k))
        an = poly([c[-1], 0.221157, -0.147981, -2.07119, 4.434685, -2.706056])
        a = np.empty(n)
        if n > 5:
            an1 = poly([c[-2], 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
            a[:] = m / math.sqrt(phi)
            a[[-1, 0, -2, 1]] = an, -an, an1, -an1
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * an**2)
            a[:] = m / math.sqrt(phi)
            a[[-1, 0]] = an, -an
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y, mu = -math.log(g - y), 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sd = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


def studentized_range_tail(q: float, k: int, df: float) -> float:
    """P(range of k normals over an independent deviation with df degrees > q), by quadrature."""
    if not q > 0:
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(80)
    z, wz = z * 8, wz * 8
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])

    def range_cdf(w: float) -> float:
        lower = np.array([0.5 * math.erfc(-(v - w) / math.sqrt(2)) for v in z])
        return float(min(1.0, k * (wz * phi * np.maximum(cdf - lower, 0) ** (k - 1)).sum()))

    if df > 5000:
        return max(0.0, 1 - range_cdf(q))
    s, ws = np.polynomial.legendre.leggauss(60)
    spread = 8 / math.sqrt(2 * df)
    a, b = max(1e-6, 1 - spread), 1 + spread
    s, ws = (s + 1) / 2 * (b - a) + a, ws * (b - a) / 2
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return max(0.0, min(1.0, 1 - float(sum(w * math.exp(g) * range_cdf(q * v) for v, w, g in zip(s, ws, log, strict=True)))))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: tables no likelier than the observed one."""
    row, col, n = a + b, a + c, a + b + c + d
    log = lambda k: math.lgamma(col + 1) - math.lgamma(k + 1) - math.lgamma(col - k + 1) + math.lgamma(n - col + 1) - math.lgamma(row - k + 1) - math.lgamma(n - col - row + k + 1) - (math.lgamma(n + 1) - math.lgamma(row + 1) - math.lgamma(n - row + 1))
    ps = [math.exp(log(k)) for k in range(max(0, row + col - n), min(row, col) + 1)]
    seen = math.exp(log(a))
    return min(1.0, sum(p for p in ps if p <= seen * (1 + 1e-7)))


def expected_cell(a: float, b: float, n: float) -> float:
    """Mutual information that a cell with margins a and b of n rows is expected to hold under random labels."""
    a, b, n = int(a), int(b), int(n)
    k = np.arange(max(1, a + b - n), min(a, b) + 1)
    lg = np.vectorize(math.lgamma, otypes=[float])
    fixed = sum(map(math.lgamma, (a + 1, b + 1, n - a + 1, n - b + 1))) - math.lgamma(n + 1)
    p = np.exp(fixed - lg(k + 1) - lg(a - k + 1) - lg(b - k + 1) - lg(n - a - b + k + 1))
    return float((k / n * np.log(n * k / (a * b)) * p).sum())


#: Most values of a rank sum for which its distribution is counted out.
MOST_SUMS = 20_000


def rank_sum_exact(u: float, n1: float, n2: float) -> float:
    """Two-sided p of a rank sum without ties: the share of all arrangements whose U lies as far out."""
    n1, n2 = sorted((int(n1), int(n2)))
    size = n1 * n2 + 1
    ways = np.zeros(size, object)
    ways[0] = 1
    for i in range(1, n1 + 1):  # Gaussian binomial coefficients: times 1 - q^(n2 + i), over 1 - q^i
        step = n2 + i
        if step < size:
            ways[step:] = ways[step:] - ways[: size - step].copy()
        for r in range(min(i, size)):
            ways[r::i] = np.cumsum(ways[r::i])
    far = math.ceil(max(u, n1 * n2 - u) - 1e-9)
    return min(1.0, 2 * float(ways[far:].sum() / ways.sum()))


def _column(f: Callable[..., float]) -> Callable[..., Column]:
    """A scalar function of numbers as a function of columns; a missing argument gives null."""

    @F.pandas_udf(T.DoubleType())
    def call(rows: pd.DataFrame) -> pd.Series:
        found = [None if any(v is None or v != v for v in r) else f(*r) for r in rows.itertuples(index=False, name=None)]
        return pd.Series(found, dtype="Float64")

    return lambda *columns: call(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"a{i}") for i, c in enumerate(columns)]))


f_p, chi2_p, normal_p, fisher_p, tukey_p = (_column(f) for f in (f_tail, chi2_tail, normal_two_sided, fisher_exact, studentized_range_tail))
expected_information, rank_sum_p = _column(expected_cell), _column(rank_sum_exact)


@F.pandas_udf(T.DoubleType())
def shapiro_p(values: pd.Series) -> pd.Series:
    """p of an array of values."""
    return values.map(lambda v: shapiro_wilk(v)[1])
