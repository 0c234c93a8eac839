"""Column expressions shared by the operators.

Everything here is a pure ``Column`` builder: it stays JVM-side, inside
whole-stage codegen, and works the same in batch and streaming plans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 rational approximation of erf
# (|error| <= 1.5e-7).  p, then a1..a5.
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

TWO_POW_32 = 4294967296.0


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def safe_div(num, den, zero=None) -> Column:
    """num / den; ``zero`` (NULL by default) when den is 0 or NULL."""
    q = F.try_divide(col_(num).cast("double"), col_(den).cast("double"))
    return q if zero is None else F.coalesce(q, F.lit(zero).cast("double"))


def is_one(c) -> Column:
    """pandas ``x == 1``: NULL compares as False."""
    return F.coalesce(col_(c) == 1, F.lit(False))


def count_true(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).cast("long")


def md5_uniform(key, salt=42) -> Column:
    """Deterministic U[0,1) from a key: first 8 hex digits of md5(key:salt)/2^32."""
    h = F.md5(F.concat(col_(key).cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def erf(x) -> Column:
    x = col_(x).cast("double")
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * ax)
    # Horner: t*(a1 + t*(a2 + t*(a3 + t*(a4 + t*a5))))
    poly = F.lit(AS_A[4])
    for a in reversed(AS_A[:4]):
        poly = poly * t + F.lit(a)
    poly = poly * t
    y = F.lit(1.0) - poly * F.exp(-ax * ax)
    return F.when(x >= 0, y).otherwise(-y)


def norm_cdf(z) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(col_(z) / F.lit(math.sqrt(2.0))))


def erfc(x) -> Column:
    return F.lit(1.0) - erf(x)


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_(z)))


def ks_pvalue(d, n1, n2, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value.

    lambda = (sqrt(m) + 0.12 + 0.11/sqrt(m)) * D, m = n1*n2/(n1+n2);
    p = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2), clipped to [0, 1],
    and 1 for lambda < 0.2.
    """
    m = col_(n1).cast("double") * col_(n2) / (col_(n1) + col_(n2))
    sm = F.sqrt(m)
    lam = (sm + F.lit(0.12) + F.lit(0.11) / sm) * col_(d)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(p)


def chi2_sf(x, dof) -> Column:
    """Upper tail of the chi-square distribution for integer dof (closed form).

    even k: exp(-x/2) * sum_{i=0}^{k/2-1} (x/2)^i / i!
    odd k:  erfc(sqrt(x/2)) + exp(-x/2) * sum_{i=1}^{(k-1)/2} x^(i-1/2) / (1*3*...*(2i-1)) * sqrt(2/pi)
    Each term is built from its log so that large dof do not overflow.
    """
    x = col_(x).cast("double")
    k = col_(dof).cast("int")
    half = x / 2
    even_terms = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k / 2 - 1, F.lit(0)).cast("int")), F.lit(0.0),
        lambda acc, i: acc + F.exp(-half + i * F.log(F.greatest(half, F.lit(1e-300)))
                                   - F.aggregate(F.sequence(F.lit(0), i), F.lit(0.0),
                                                 lambda a, j: a + F.log(F.greatest(j.cast("double"), F.lit(1.0))))))
    odd_terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest((k - 1) / 2, F.lit(1)).cast("int")), F.lit(0.0),
        lambda acc, i: acc + F.exp(-half + (i - 0.5) * F.log(F.greatest(x, F.lit(1e-300)))
                                   - F.aggregate(F.sequence(F.lit(1), i), F.lit(0.0),
                                                 lambda a, j: a + F.log(F.lit(2.0) * j - 1))))
    odd = erfc(F.sqrt(half)) + F.when(k >= 3, F.lit(math.sqrt(2.0 / math.pi)) * odd_terms).otherwise(F.lit(0.0))
    p = F.when(k % 2 == 0, even_terms).otherwise(odd)
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def poisson1_weight(u) -> Column:
    """Poisson(1) draw from a uniform by inverse CDF (cumulative probabilities <= u)."""
    u = col_(u)
    w = F.lit(0)
    cdf = 0.0
    term = math.exp(-1.0)
    for k in range(0, 12):
        cdf += term
        w = w + F.when(u >= F.lit(cdf), F.lit(1)).otherwise(F.lit(0))
        term = term / (k + 1)
    return w


def box_muller(u1, u2) -> Column:
    """Standard normal from two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.log(F.greatest(col_(u1), F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * col_(u2))


def rnd(c, nd: int = 6) -> Column:
    return F.round(col_(c).cast("double"), nd)
