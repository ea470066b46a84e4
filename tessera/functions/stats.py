"""Paired statistics as Columns: closed forms, and distribution tails by fractions and series of a fixed number of steps."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
#: Discordant pairs below which McNemar's test is exact.
EXACT_BELOW = 25


def mcnemar_chi2(b: Column, c: Column) -> Column:
    return F.when(b + c == 0, F.lit(NAN)).otherwise((F.abs(b - c) - 1) * (F.abs(b - c) - 1) / (b + c).cast("double"))


def mcnemar_exact_p(b: Column, c: Column) -> Column:
    """Two-sided binomial tail at one half, as a fold over the terms C(n, k) / 2**n; n is small where this is used."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    state = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("sum"))
    steps = F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.least(F.lit(1.0), 2 * F.aggregate(steps, state, step, lambda s: s["sum"]))


def mcnemar_interval(b: Column, c: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Confidence interval of the difference in percentage points (final - baseline; c = wrong before, right now)."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    delta = 100 * (c - b) / n.cast("double")
    se = 100 * F.sqrt((b + c).cast("double")) / n.cast("double")
    low, high = (F.when(n <= 0, F.lit(NAN)).when(b + c == 0, delta).otherwise(delta + s * z * se) for s in (-1, 1))
    return low, high


# ---- distribution tails: fractions and series of a fixed number of steps, as folds ------------------------------------

#: Steps of the incomplete beta fraction; enough for degrees of freedom up to LARGE_DF, beyond which t is turned into a normal deviate.
BETA_STEPS, LARGE_DF, ERFC_STEPS, NEWTON_STEPS = 400, 20_000, 80, 8


def _steps(n: int, down: bool = False) -> Column:
    return F.sequence(F.lit(n), F.lit(1), F.lit(-1)) if down else F.sequence(F.lit(1), F.lit(n))


def _let(f, **values: Column) -> Column:
    """``f`` of a struct of values, each worked out once a row however often ``f`` names it."""
    return F.get(F.transform(F.array(F.struct(*(c.cast("double").alias(k) for k, c in values.items()))), f), F.lit(0))


def log_gamma(x: Column) -> Column:
    """ln Gamma of x > 0: Stirling's series at x + 10, less the logarithm of the product between."""
    y = x + 10.0
    between = sum((F.ln(x + float(k)) for k in range(1, 10)), F.ln(x))
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * (691 / 360360)))))) / y
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - between


def _beta_front(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) by its continued fraction, evaluated from its tail; for x below (a + 1) / (a + b + 2)."""

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 + odd / acc)

    inner = F.aggregate(_steps(BETA_STEPS, down=True), F.lit(1.0), lambda acc, m: step(acc, m.cast("double")))
    first = -(a + b) * x / (a + 1)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
    return front / a / (1 + first / inner)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function; the fraction is taken on the side where it converges."""

    def value(v: Column) -> Column:
        a, b, x, y = (v[k] for k in "abxy")
        near = x <= (a + 1) / (a + b + 2)
        return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(near, _beta_front(a, b, x)).otherwise(1 - _beta_front(b, a, y))

    return _let(value, a=a, b=b, x=x, y=1 - x)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a series below 2.5, its continued fraction from there on."""

    def value(v: Column) -> Column:
        x = v["x"]
        scale = F.exp(-x * x) / math.sqrt(math.pi)

        def step(s: Column, k: Column) -> Column:
            t = s["term"] * 2 * x * x / (2 * k + 1)
            return F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))

        series = 1 - scale * F.aggregate(_steps(ERFC_STEPS), F.struct((2 * x).alias("term"), (2 * x).alias("sum")), step, lambda s: s["sum"])
        fraction = scale / F.aggregate(_steps(ERFC_STEPS, down=True), x, lambda acc, k: x + (k.cast("double") / 2) / acc)
        return F.when(x < 2.5, series).otherwise(fraction)

    return _let(value, x=x)


def t_deviate(t: Column, df: Column) -> Column:
    """The normal deviate with the tail of t, by Hill's expansion: for many degrees of freedom."""
    a = df - 0.5
    b = 48 * a * a
    z = F.sqrt(a * F.log1p(t * t / df))
    z2 = z * z
    return z + z * (z2 + 3) / b - z * (((4 * z2 + 33) * z2 + 240) * z2 + 855) / (10 * b * (b + 0.8 * z2 * z2 + 100))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; above LARGE_DF degrees of freedom that of the normal deviate of the same tail."""
    exact = incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))
    large = erfc(t_deviate(t, df) / math.sqrt(2))
    return F.when(F.isnan(t) | (df <= 0), F.lit(NAN)).when(F.abs(t) == float("inf"), F.lit(0.0)).when(df > LARGE_DF, large).otherwise(exact)


def t_critical(p: float, df: Column) -> Column:
    """Upper quantile of Student's t for p > 1/2: closed for one and two degrees of freedom, else Newton steps on the tail.

    They start from the normal quantile's expansion, which lies below the root, where the tail is convex: no step passes it.
    """
    z = NormalDist().inv_cdf(p)
    start = z + (z**3 + z) / (4 * df)
    one, two = math.tan(math.pi * (p - 0.5)), 2 * (p - 0.5) * math.sqrt(2 / (4 * p * (1 - p)))

    def value(v: Column) -> Column:
        df = v["df"]

        def step(t: Column, _: Column) -> Column:
            density = F.exp(v["log_scale"] - (df + 1) / 2 * F.log1p(t * t / df))
            return t + (t_p_value(t, df) / 2 - (1 - p)) / density

        return F.aggregate(_steps(NEWTON_STEPS), v["start"], step)

    scale = log_gamma((df + 1) / 2) - log_gamma(df / 2) - 0.5 * F.ln(df * math.pi)
    newton = _let(value, df=df, start=start, log_scale=scale)
    return F.when(df <= 0, F.lit(NAN)).when(df == 1, F.lit(one)).when(df == 2, F.lit(two)).otherwise(newton)


def chi2_p_value(x: Column) -> Column:
    """Survival function of chi-square with one degree of freedom."""
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(erfc(F.sqrt(x / 2)))


def mcnemar_p(b: Column, c: Column) -> Column:
    return F.when(b + c == 0, F.lit(NAN)).when(b + c < EXACT_BELOW, mcnemar_exact_p(b, c)).otherwise(chi2_p_value(mcnemar_chi2(b, c)))


def cosine_rate(step: Column, total: int, warmup: int, peak: float) -> Column:
    """Linear warm-up, then half a cosine down to zero."""
    rising = step / F.lit(float(max(1, warmup)))
    falling = 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warmup) / F.lit(float(max(1, total - warmup)))))
    return F.lit(peak) * F.when(step < warmup, rising).otherwise(F.greatest(F.lit(0.0), falling))


def optimiser_steps(batches: int, accumulate: int, epochs: int, warmup_ratio: float) -> tuple[int, int]:
    total = math.ceil(batches / accumulate) * epochs
    return total, int(total * warmup_ratio)


def answer_budget(source: Column, short: int = 8, long: int = 32) -> Column:
    """Most answer tokens by source: option letters are short."""
    return F.when(source == "aokvqa", F.lit(short)).otherwise(F.lit(long))
