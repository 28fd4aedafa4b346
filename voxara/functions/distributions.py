"""Distribution functions as Columns, accurate in their tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number: the series of Stirling, eight steps up."""
    up = z + 8
    steps = z
    for k in range(1, 8):
        steps = steps * (z + k)
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, 3)) + 1 / (1260 * F.pow(up, 5)) - 1 / (1680 * F.pow(up, 7)) + 1 / (1188 * F.pow(up, 9))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function by Lentz's steps."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    first = 1 / tiny(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half(state: Column, term: Column) -> Column:
        d = 1 / tiny(1 + term * state["d"])
        c = tiny(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _let(half(state, even), lambda s: half(s, odd))

    # Terms needed grow with the root of the larger parameter.
    many = (F.lit(30) + 4 * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), many), start, step, lambda s: s["h"])


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function; small values keep their digits."""

    def lower(v: Column) -> Column:
        front = F.exp(log_gamma(v["a"] + v["b"]) - log_gamma(v["a"]) - log_gamma(v["b"]) + v["a"] * F.log(v["x"]) + v["b"] * F.log1p(-v["x"]))
        return front * _beta_fraction(v["x"], v["a"], v["b"]) / v["a"]

    args = F.struct(x.cast("double").alias("x"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    turned = lambda v: F.struct((1 - v["x"]).alias("x"), v["b"].alias("a"), v["a"].alias("b"))
    return _let(
        args,
        lambda v: F.when(v["x"] <= 0, F.lit(0.0)).when(v["x"] >= 1, F.lit(1.0)).when(v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2), lower(v)).otherwise(1 - _let(turned(v), lower)),
    )


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null without degrees of freedom."""
    square = t.cast("double") * t
    return F.when(df > 0, beta_cdf(df / (df + square), df / 2.0, F.lit(0.5)))


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of the F distribution."""
    return F.when((df1 > 0) & (df2 > 0), beta_cdf(df2 / (df2 + df1 * F.greatest(f, F.lit(0.0))), df2 / 2.0, df1 / 2.0))


def t_quantile(df: Column, alpha: float = 0.05) -> Column:
    """The value that |t| exceeds with probability ``alpha``, by halving."""
    # A bracket for any number of degrees from 1: the t of one degree is the largest.
    top = 1 / math.tan(math.pi * alpha / 2) + 1
    halve = lambda s, _: _let((s["low"] + s["high"]) / 2, lambda m: F.when(t_two_sided(m, df) > alpha, F.struct(m.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high"))))
    return F.when(df > 0, F.aggregate(F.sequence(F.lit(1), F.lit(52)), F.struct(F.lit(0.0).alias("low"), F.lit(top).alias("high")), halve, lambda s: (s["low"] + s["high"]) / 2))
