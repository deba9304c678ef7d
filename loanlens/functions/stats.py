"""Distribution functions as column expressions (no SciPy on executors).

Neither Spark SQL nor common SQL engines offer ``erf``; these closed forms keep
p-values inside the JVM and reproducible in any SQL dialect."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["normal_cdf", "two_sided_normal_p", "ks_p_value", "chi2_p_value", "KS_TERMS"]

# Abramowitz & Stegun 26.2.17 coefficients (|error| < 7.5e-8).
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
KS_TERMS = 100


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF by Abramowitz & Stegun 26.2.17."""
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * ax)
    poly = t * (F.lit(AS_B[0]) + t * (F.lit(AS_B[1]) + t * (F.lit(AS_B[2]) + t * (F.lit(AS_B[3]) + t * F.lit(AS_B[4])))))
    upper = F.exp(-ax * ax / F.lit(2.0)) / F.lit((2 * 3.141592653589793) ** 0.5) * poly  # 1 - Phi(|x|)
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def two_sided_normal_p(z: Column) -> Column:
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value.

    ne = n*m/(n+m); lambda = (sqrt(ne) + 0.12 + 0.11/sqrt(ne)) * D;
    p = 2 * sum_{k=1..100} (-1)^(k-1) exp(-2 k^2 lambda^2), clamped to [0, 1];
    1 when D = 0."""
    ne = n.cast("double") * m.cast("double") / (n + m).cast("double")
    lam = (F.sqrt(ne) + F.lit(0.12) + F.lit(0.11) / F.sqrt(ne)) * d
    ks = F.sequence(F.lit(1), F.lit(KS_TERMS))
    series = F.aggregate(
        ks, F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) * series))
    return F.when(d <= 0, F.lit(1.0)).otherwise(p)


def chi2_p_value(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution with integer ``dof``.

    Q = 1 - P(a, h) with a = dof/2, h = x/2 and the lower regularized gamma
    series P = sum_n exp(-h + (a+n) ln h - ln Gamma(a+n+1)), summed in log
    space so that no term overflows.  ln Gamma(a+1) for integer or half-integer
    a is a finite sum of logs (plus ln sqrt(pi)).  Far in the tail (x beyond
    dof + 40 sqrt(2 dof) + 200) the p-value is 0 to double precision."""
    a = dof.cast("double") / F.lit(2.0)
    h = x.cast("double") / F.lit(2.0)
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(a).cast("int") - F.lit(1), F.lit(0)))
    lg_a1 = F.aggregate(steps, F.lit(0.0), lambda acc, j: acc + F.when(a - j > 0, F.log(a - j)).otherwise(F.lit(0.0)))
    lg_a1 = lg_a1 + F.when(F.floor(a) == a, F.lit(0.0)).otherwise(F.lit(0.5 * math.log(math.pi)))
    n_terms = F.ceil(h + F.lit(12.0) * F.sqrt(h) + F.lit(40.0)).cast("int")
    init = F.struct(F.lit(0.0).alias("s"), lg_a1.alias("lg"))

    def step(acc, n):
        lg = F.when(n == 0, acc["lg"]).otherwise(acc["lg"] + F.log(a + n))
        term = F.exp(-h + (a + n) * F.log(h) - lg)
        return F.struct((acc["s"] + term).alias("s"), lg.alias("lg"))

    lower = F.aggregate(F.sequence(F.lit(0), n_terms), init, step)["s"]
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - lower))
    far = x.cast("double") > dof.cast("double") + F.lit(40.0) * F.sqrt(F.lit(2.0) * dof.cast("double")) + F.lit(200.0)
    return (F.when(x.isNull() | dof.isNull(), F.lit(None).cast("double"))
             .when((dof <= 0) | (x <= 0), F.lit(1.0)).when(far, F.lit(0.0)).otherwise(q))
