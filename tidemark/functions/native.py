"""Tails of distributions as Column expressions: series, continued fractions and quadrature inside the JVM, without Python workers.

A missing argument gives null. Each function has a scalar counterpart in ``tails``, by other means, which tests hold it against.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def let(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """``then`` over a struct of values, each of which is computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), F.lit(0))


def ln_gamma(x: Column | str | float) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series at x + 12, less the factors between."""
    x = _c(x)
    z = x + 12.0
    factors = x
    for k in range(1, 12):
        factors = factors * (x + float(k))
    inverse = 1 / (z * z)
    series = F.lit(-691 / 360360)
    for c in (1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12):
        series = series * inverse + c
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series / z - F.ln(factors)


def _erfc_series(degree: int = 27) -> list[float]:
    """Power series in 4 t - 2 of ln(erfc(z) / t) + z^2 with t = 2 / (2 + z): Chebyshev interpolation over all z >= 0."""

    def exact(u: float) -> float:
        t = (u + 1) / 2
        z = 2 / t - 2
        if z < 20:
            return math.log(math.erfc(z) / t) + z * z
        s = sum((-1) ** k * math.prod(range(1, 2 * k, 2)) / (2 * z * z) ** k for k in range(8))
        return math.log(s / (z * math.sqrt(math.pi)) / t)

    nodes = np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
    return np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebfit(nodes, [exact(u) for u in nodes], degree)).tolist()


_ERFC = _erfc_series()


def erfc(x: Column | str) -> Column:
    """Complement of the error function, to some 14 digits of its own size."""
    x = _c(x)
    z = F.abs(x)
    t = 2 / (2 + z)
    u = 2 * t - 1
    power = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        power = power * u + c
    tail = t * F.exp(power - z * z)
    return F.when(x >= 0, tail).when(x < 0, 2 - tail)


def normal_p(z: Column | str) -> Column:
    """Two-sided p of a standard normal value."""
    return erfc(F.abs(_c(z)) / math.sqrt(2))


def gamma_q(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function: a series below a + 1, a continued fraction above."""

    def find(s: Column) -> Column:
        a, x = s["a"], s["x"]
        steps = F.sequence(F.lit(1), (60 + 12 * F.sqrt(a)).cast("int"))
        front = F.exp(-x + a * F.ln(x) - ln_gamma(a))
        start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

        def add(v: Column, n: Column) -> Column:
            term = v["term"] * x / (a + n)
            return F.struct(term.alias("term"), (v["total"] + term).alias("total"))

        low = 1 - front * F.aggregate(steps, start, add, lambda v: v["total"])
        b0 = x + 1 - a
        first = F.struct(F.lit(1e300).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h"))

        def more(v: Column, i: Column) -> Column:
            part, b = -i * (i - a), b0 + 2 * i
            d, c = 1 / (part * v["d"] + b), b + part / v["c"]
            return F.struct(c.alias("c"), d.alias("d"), (v["h"] * c * d).alias("h"))

        high = front * F.aggregate(steps, first, more, lambda v: v["h"])
        return F.when(x <= 0, 1.0).when(x < a + 1, low).when(x >= a + 1, high)

    return let({"a": a.cast("double"), "x": x.cast("double")}, find)


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function: the continued fraction on the side where it is fast."""

    def find(s: Column) -> Column:
        p, r, y = s["p"], s["r"], s["y"]
        front = F.exp(ln_gamma(p + r) - ln_gamma(p) - ln_gamma(r) + p * F.ln(y) + r * F.log1p(-y)) / p
        d0 = 1 / (1 - (p + r) * y / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("f"))

        def step(v: Column, j: Column) -> Column:
            m = F.floor(j / 2).cast("double")
            even = m * (r - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + r + m) * y / ((p + 2 * m) * (p + 2 * m + 1))

            def next_(k: Column) -> Column:
                d, c = 1 / (1 + k["k"] * v["d"]), 1 + k["k"] / v["c"]
                return F.struct(c.alias("c"), d.alias("d"), (v["f"] * c * d).alias("f"))

            return let({"k": F.when(j % 2 == 0, even).otherwise(odd)}, next_)

        sum_ = front * F.aggregate(F.sequence(F.lit(2), (120 + 16 * F.sqrt(p + r)).cast("int")), start, step, lambda v: v["f"])
        return F.when(s["x"] <= 0, 0.0).when(s["x"] >= 1, 1.0).when(s["other"], 1 - sum_).when(~s["other"], sum_)

    a, b, x = (v.cast("double") for v in (a, b, x))
    other = x > (a + 1) / (a + b + 2)
    pick = lambda yes, no: F.when(other, yes).otherwise(no)
    return let({"p": pick(b, a), "r": pick(a, b), "y": pick(1 - x, x), "x": x, "other": other}, find)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of F."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of chi-square."""
    return gamma_q(df / 2, x / 2)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a two by two table: the tables with its margins that are no likelier."""

    def find(s: Column) -> Column:
        a, row, col, n = (s[k] for k in ("a", "row", "col", "n"))
        of = lambda *xs: sum((ln_gamma(x + 1.0) for x in xs), F.lit(0.0))
        log = lambda k: of(row, n - row, col, n - col) - of(n, k, row - k, col - k, n - row - col + k)
        each = F.transform(F.sequence(F.greatest(F.lit(0.0), row + col - n).cast("long"), F.least(row, col).cast("long")), lambda k: F.exp(log(k.cast("double"))))
        return F.least(F.lit(1.0), let({"each": each, "seen": F.exp(log(a))}, lambda t: F.aggregate(F.filter(t["each"], lambda p: p <= t["seen"] * (1 + 1e-7)), F.lit(0.0), lambda x, p: x + p)))

    numbers = [v.cast("double") for v in (a, b, c, d)]
    whole = let({"a": numbers[0], "row": numbers[0] + numbers[1], "col": numbers[0] + numbers[2], "n": sum(numbers[1:], numbers[0])}, find)
    return F.when(sum(numbers[1:], numbers[0]).isNotNull(), whole)


def expected_information(a: Column, b: Column, n: Column) -> Column:
    """Mutual information that a cell with margins a and b of n rows is expected to hold under random labels."""

    def find(s: Column) -> Column:
        a, b, n = s["a"], s["b"], s["n"]
        of = lambda *xs: sum((ln_gamma(x + 1.0) for x in xs), F.lit(0.0))
        term = lambda k: k / n * F.ln(n * k / (a * b)) * F.exp(s["fixed"] - of(k, a - k, b - k, n - a - b + k))
        cells = F.sequence(F.greatest(F.lit(1.0), a + b - n).cast("long"), F.least(a, b).cast("long"))
        return F.aggregate(cells, F.lit(0.0), lambda t, k: t + term(k.cast("double")))

    a, b, n = (v.cast("double") for v in (a, b, n))
    fixed = ln_gamma(a + 1) + ln_gamma(b + 1) + ln_gamma(n - a + 1) + ln_gamma(n - b + 1) - ln_gamma(n + 1)
    return let({"a": a, "b": b, "n": n, "fixed": fixed}, find)


#: Nodes of the two integrals: normals between -8 and 8, and the independent deviation within eight of its own deviations.
NODES, SPREAD_NODES = 64, 32


def legendre(n: int) -> list[tuple[float, float]]:
    """Nodes and weights of Gauss and Legendre on -1 to 1."""
    return list(zip(*(v.tolist() for v in np.polynomial.legendre.leggauss(n)), strict=True))


def tukey_p(q: Column, k: Column, df: Column) -> Column:
    """P(range of k normals over an independent deviation with df degrees > q), by quadrature over both."""
    normal = [(8 * z, 8 * w * math.exp(-32 * z * z) / math.sqrt(2 * math.pi), 0.5 * math.erfc(-8 * z / math.sqrt(2))) for z, w in legendre(NODES)]
    nodes = F.array(*[F.struct(F.lit(z).alias("z"), F.lit(w).alias("w"), F.lit(p).alias("p")) for z, w, p in normal])
    spread = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in legendre(SPREAD_NODES)])

    def range_cdf(width: Column, k: Column) -> Column:
        def add(total: Column, v: Column) -> Column:
            return total + v["w"] * F.pow(F.greatest(v["p"] - erfc((width - v["z"]) / math.sqrt(2)) / 2, F.lit(0.0)), k - 1)

        return F.least(F.lit(1.0), k * F.aggregate(nodes, F.lit(0.0), add))

    def find(s: Column) -> Column:
        q, k, df = s["q"], s["k"], s["df"]
        low = F.greatest(F.lit(1e-6), 1 - 8 / F.sqrt(2 * df))
        high = 1 + 8 / F.sqrt(2 * df)

        def over(t: Column) -> Column:
            def add(total: Column, v: Column) -> Column:
                at = lambda x: x["w"] * F.exp(t["front"] + (df - 1) * F.ln(x["s"]) - df * x["s"] * x["s"] / 2) * range_cdf(q * x["s"], k)
                return total + let({"s": (v["s"] + 1) / 2 * (t["high"] - t["low"]) + t["low"], "w": v["w"] * (t["high"] - t["low"]) / 2}, at)

            return F.aggregate(spread, F.lit(0.0), add)

        front = math.log(2) + df / 2 * F.ln(df / 2) - ln_gamma(df / 2)
        whole = F.when(df > 5000, range_cdf(q, k)).otherwise(let({"front": front, "low": low, "high": high}, over))
        return F.when(q <= 0, 1.0).when(q > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - whole)))

    return let({"q": q.cast("double"), "k": k.cast("double"), "df": df.cast("double")}, find)
