"""p-values for the chi-square and Kolmogorov-Smirnov tests.

Both tails are JVM-side higher-order-function expressions evaluated on
already-aggregated rows (one row per tested column); the plain-Python
twins are used by the unit tests.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for integer dof
    (regularised Q(dof/2, x/2)), closed form with log-space terms."""
    if dof is None or x is None or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    dof = int(dof)
    if dof <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    y = x / 2.0
    logy = math.log(y)
    total = 0.0
    if dof % 2 == 0:
        # e^-y * sum_{i=0}^{dof/2-1} y^i / i!
        for i in range(dof // 2):
            total += math.exp(-y + i * logy - math.lgamma(i + 1))
        return min(1.0, total)
    # erfc(sqrt(y)) + e^-y * sum_{i=1}^{(dof-1)/2} y^(i-1/2) / Gamma(i+1/2)
    total = math.erfc(math.sqrt(y))
    for i in range(1, (dof - 1) // 2 + 1):
        total += math.exp(-y + (i - 0.5) * logy - math.lgamma(i + 0.5))
    return min(1.0, total)


LARGE = 50_000.0           # shape beyond which the uniform expansion takes over
MOST_STEPS = 2_500         # of the series or the continued fraction


def _log_gamma(s: Column) -> Column:
    """ln Gamma(s) for s > 0: Stirling's series at s + 10 or more, brought
    back by the recurrence for small s."""
    low = s < 10
    x = F.when(low, s + 10).otherwise(s)
    i = 1.0 / x
    stirling = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + i / 12 - i ** 3 / 360 + i ** 5 / 1260 - i ** 7 / 1680
    back = F.aggregate(F.array(*[F.lit(float(k)) for k in range(10)]), F.lit(0.0), lambda acc, k: acc + F.log(s + k))
    return F.when(low, stirling - back).otherwise(stirling)


def _upper_gamma(s: Column, y: Column) -> Column:
    """Q(s, y) for 0 < s <= LARGE, y > 0: 1 minus the lower series below
    s + 1, the continued fraction (modified Lentz) above, where no digits are
    lost however small the tail.  The steps are bounded."""
    front = F.exp(s * F.log(y) - y - _log_gamma(s))
    steps = F.least(F.lit(MOST_STEPS), F.ceil(F.lit(60.0) + 10.0 * F.sqrt(s)).cast("int"))
    one = F.lit(1.0)
    series = F.aggregate(
        F.sequence(F.lit(1), steps), F.struct((one / s).alias("t"), (one / s).alias("sum")),
        lambda a, n: F.struct((a["t"] * y / (s + n)).alias("t"), (a["sum"] + a["t"] * y / (s + n)).alias("sum")), lambda a: a["sum"])
    b0 = y + 1.0 - s
    start = F.struct(b0.alias("b"), F.lit(1e300).alias("c"), (one / b0).alias("d"), (one / b0).alias("h"))

    def lentz(a: Column, n: Column) -> Column:
        an, b = -n * (n - s), a["b"] + 2.0
        d, c = one / (an * a["d"] + b), b + an / a["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (a["h"] * d * c).alias("h"))

    fraction = F.aggregate(F.sequence(F.lit(1), steps), start, lentz, lambda a: a["h"])
    return F.when(y < s + 1.0, 1.0 - front * series).otherwise(front * fraction)


def _upper_gamma_large(s: Column, y: Column) -> Column:
    """Q(s, y) for large s: the uniform expansion about the normal tail."""
    m = y / s - 1.0
    half = F.greatest(m - F.log1p(m), F.lit(0.0))            # eta^2 / 2
    eta = F.signum(m) * F.sqrt(2.0 * half)
    near = F.abs(eta) < 0.01
    c0 = F.when(near, -1 / 3 + eta / 12 - eta ** 2 * (2 / 135) + eta ** 3 / 864).otherwise(F.try_divide(F.lit(1.0), m) - F.try_divide(F.lit(1.0), eta))
    c1 = F.when(near, F.lit(-1 / 540) - eta / 288).otherwise(
        F.try_divide(F.lit(1.0), eta ** 3) - F.try_divide(F.lit(1.0), m ** 3) - F.try_divide(F.lit(1.0), m ** 2) - F.try_divide(F.lit(1 / 12), m))
    z = s * half                                              # erfc(sqrt z) = Q(1/2, z)
    tail = F.when(z > 0, _upper_gamma(F.lit(0.5), z)).otherwise(F.lit(1.0))
    normal = F.when(eta >= 0, 0.5 * tail).otherwise(1.0 - 0.5 * tail)
    return normal + F.exp(-z) / F.sqrt(2 * math.pi * s) * (c0 + c1 / s)


def chi2_p_value(chi2: Column, dof: Column) -> Column:
    """Upper chi-square tail Q(dof/2, chi2/2) as a JVM-side expression (no
    Python worker), in a bounded number of steps for any size."""
    s, y = dof.cast("double") / 2.0, chi2.cast("double") / 2.0
    p = F.when(s > LARGE, _upper_gamma_large(s, y)).otherwise(_upper_gamma(F.least(s, F.lit(LARGE)), y))
    return (F.when(chi2.isNull() | dof.isNull(), F.lit(None).cast("double"))
            .when((dof <= 0) | (chi2 <= 0), F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def kolmogorov_p_value(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p for the two-sample KS statistic:
    Q_KS(lambda), lambda = (sqrt(en) + 0.12 + 0.11/sqrt(en)) * D,
    en = n1*n2/(n1+n2).  Q_KS(l) = 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 l^2);
    below l = 0.2 the tail is 1 to double precision."""
    en = (n1.cast("double") * n2.cast("double")) / (n1 + n2).cast("double")
    s = F.sqrt(en)
    lam = (s + F.lit(0.12) + F.lit(0.11) / s) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0).cast("double"),
        lambda acc, k: acc + F.lit(2.0) * F.pow(F.lit(-1.0), k - 1)
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return (F.when(n1.isNull() | n2.isNull() | (n1 == 0) | (n2 == 0), F.lit(None))
            .when(lam < 0.2, F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))))


#: both samples at most this large: the p-value is counted, not approximated
KS_EXACT_MOST = 10_000


def _ks_exact(d: Column, n1: Column, n2: Column) -> Column:
    """P(D >= d) over all orders of two samples without ties, by counting
    lattice paths: a path takes m steps right and n up, all equally likely,
    and (i, s - i) after s steps lies outside when |i (m + n) - s m| reaches
    d m n.  A fold over s keeps the probabilities of the places inside and
    sums up what leaves at either edge, so small p-values stay accurate."""
    m, n = F.least(n1, n2).cast("bigint"), F.greatest(n1, n2).cast("bigint")
    total, most = m + n, F.round(d * m * n).cast("bigint")
    steps = F.transform(F.sequence(F.lit(1).cast("bigint"), total), lambda s: F.struct(
        s.alias("s"),
        F.greatest(F.lit(0).cast("bigint"), s - n, F.floor((s * m - most) / total) + 1).alias("lo"),
        F.least(m, s, F.ceil((s * m + most) / total) - 1).alias("hi")))

    def fold(a: Column, x: Column) -> Column:
        before = lambda i: F.coalesce(F.get(a["b"], (i - a["lo"]).cast("int")), F.lit(0.0))
        left = (total - x["s"] + 1).cast("double")
        here = lambda i: (before(i) * (n - (x["s"] - 1 - i)) + before(i - 1) * (m - i + 1)) / left
        inside = F.when(x["lo"] <= x["hi"], F.transform(F.sequence(x["lo"], F.greatest(x["lo"], x["hi"])), here)).otherwise(F.array().cast("array<double>"))
        return F.struct(x["lo"].alias("lo"), inside.alias("b"), (a["out"] + here(x["lo"] - 1) + here(x["hi"] + 1)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("lo"), F.array(F.lit(1.0)).alias("b"), F.lit(0.0).alias("out"))
    return F.when(most <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(steps, start, fold, lambda a: a["out"])))


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p-value of the two-sample KS statistic: exact while both
    samples hold at most ``KS_EXACT_MOST`` values, asymptotic beyond and
    where the asymptotic value is below 1e-30."""
    large = kolmogorov_p_value(d, n1, n2)
    exact = (F.greatest(n1, n2) <= KS_EXACT_MOST) & (large > 1e-30)
    return F.when(exact, _ks_exact(d, n1, n2)).otherwise(large)
