"""Count distributions as columns. theta null or infinite is the Poisson limit; arguments are columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-300


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression that is used in several places would be evaluated in each."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _poisson(theta: Column) -> Column:
    return theta.isNull() | (theta == float("inf"))


def count_cdf(x: Column, theta: Column, mu: Column) -> Column:
    """P(X <= floor(x)) of the negative binomial or Poisson count, by the recurrence of its log probabilities, so a large mean doesn't underflow."""
    p = theta / (theta + mu)
    start = F.when(_poisson(theta), -mu).otherwise(theta * F.log(p))

    def step(acc: Column, k: Column) -> Column:
        ratio = F.when(_poisson(theta), mu / k).otherwise((k - 1 + theta) / k * (1 - p))
        log = acc["log"] + F.when(ratio > 0, F.log(ratio)).otherwise(float("-inf"))
        return F.struct(log.alias("log"), (acc["cdf"] + F.exp(log)).alias("cdf"))

    to = F.floor(x).cast("int")
    steps = F.when(to >= 1, F.sequence(F.lit(1), to)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(start.cast("double").alias("log"), F.exp(start).cast("double").alias("cdf")), step, lambda acc: acc["cdf"])
    return F.when(x < 0, 0.0).otherwise(F.least(total, F.lit(1.0)))


def zinb_cdf(x: Column, pi: Column, theta: Column, mu: Column) -> Column:
    return pi + (1 - pi) * count_cdf(x, theta, mu)


def zinb_cdf_dt(x: Column, pi: Column, theta: Column, mu: Column, v: Column) -> Column:
    """Distributional transform: between the CDF below x and at x, at share v. Below zero it starts at pi."""
    ends = F.struct(F.when(x <= 0, pi).otherwise(zinb_cdf(x - 1, pi, theta, mu)).alias("low"), zinb_cdf(x, pi, theta, mu).alias("up"))
    return let(ends, lambda e: e["low"] + v * (e["up"] - e["low"]))


def zinb_uniform(x: Column, pi: Column, theta: Column, mu: Column, v: Column) -> Column:
    """Zeros spread over (0, P(0)); others by the transform. The original leaves zeros undefined; v * P(0) is a choice made here."""
    return F.when(x == 0, v * zinb_cdf(F.lit(0), pi, theta, mu)).otherwise(zinb_cdf_dt(x, pi, theta, mu, v))


def nudged_transform(x: Column, pi: Column, theta: Column, mu: Column, v: Column, eps: float = 1e-5) -> Column:
    """The fitting side's transform: from zero at x = 0, moved off 0 and 1 by eps."""
    ends = F.struct(F.when(x <= 0, 0.0).otherwise(zinb_cdf(x - 1, pi, theta, mu)).alias("low"), zinb_cdf(x, pi, theta, mu).alias("up"))
    share = let(ends, lambda e: e["low"] + v * (e["up"] - e["low"]))
    top = let(share, lambda r: F.when(1 - r < eps, r - eps).otherwise(r))
    return let(top, lambda r: F.when(r < eps, r + eps).otherwise(r))


def _log_sum(upto: Column, term) -> Column:
    steps = F.when(upto >= 1, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.log(term(k)))


def log_pmf(x: Column, theta: Column, mu: Column) -> Column:
    k = F.floor(x).cast("int")
    factorial = _log_sum(k, lambda i: i + 1.0)
    rising = _log_sum(k, lambda i: theta + i)
    nb = rising - factorial + theta * F.log(theta / (theta + mu)) + k * F.log(mu / (theta + mu))
    return F.when(mu <= 0, F.when(k == 0, 0.0).otherwise(F.log(F.lit(FLOOR)))).otherwise(F.when(_poisson(theta), k * F.log(mu) - mu - factorial).otherwise(nb))


def zinb_log_pmf(x: Column, pi: Column, theta: Column, mu: Column) -> Column:
    zero = F.log(F.greatest(pi + (1 - pi) * F.exp(log_pmf(F.lit(0), theta, mu)), F.lit(FLOOR)))
    more = F.log(F.greatest(1 - pi, F.lit(FLOOR))) + F.greatest(log_pmf(x, theta, mu), F.log(F.lit(FLOOR)))
    return F.when(x == 0, zero).otherwise(more)


# The rational approximation of the inverse normal distribution function (Acklam).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def qnorm(p: Column) -> Column:
    """Inverse of the normal distribution function; null outside (0, 1)."""
    return let(p, _qnorm)


def _qnorm(p: Column) -> Column:
    q, tail = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    r = q * q
    middle = _horner(r, _A) * q / (_horner(r, _B) * r + 1)
    outer = _horner(tail, _C) / (_horner(tail, _D) * tail + 1)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, outer).when(p > 1 - 0.02425, -outer).otherwise(middle)
