"""Phred arithmetic: combined p-values, agreement of two calls, conversion."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
MAX_PV = 3117
MASK_QUAL = 2
#: Logarithm below which the combined p-value counts as 0.
LOG_TINY = -708.396418532264106224

#: Calls up to which the tail's sum is written out as one expression.
UNROLLED = 16

_K = math.log(10) / 10


def to_phred(p: Column) -> Column:
    """Phred value of a probability, rounded half up; MAX_PV for 0 and below; null for null."""
    return F.when(p.isNull(), F.lit(None)).when(p > 0, F.floor(-10 * F.log10(p) + 0.5)).otherwise(MAX_PV).cast("int")


def to_prob(q: Column) -> Column:
    """Error probability of a phred value."""
    return F.pow(F.lit(10.0), q.cast("double") * -0.1)


def fisher_pv(n: Column, phred_sum: Column) -> Column:
    """Phred value of n independent calls with this sum of phreds, by Fisher's method.

    The upper tail of chi-square with 2 n degrees at x = 2 s ln10 / 10 is a finite sum for whole n. Up to UNROLLED calls
    the sum is written out, so that it runs in generated code; beyond it is folded from the last term inwards and kept in logarithms,
    so that no family size or quality overflows. A tail below the least normal number counts as 0 (MAX_PV). n < 1 or a sum
    of 0 gives 0; null for null.
    """
    n, s = n.cast("int"), phred_sum.cast("double")
    x = s * _K
    few, gamma = F.lit(1.0), F.lit(0.0)
    for k in range(UNROLLED - 1, 0, -1):
        few = F.when(n > k, 1.0 + few * x / float(k)).otherwise(F.lit(1.0))
        gamma = F.when(n == k + 1, math.lgamma(k + 1)).otherwise(gamma)
    fold = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("h"), F.lit(0.0).alias("g")),
        lambda a, k: F.struct((1.0 + a["h"] * k / x).alias("h"), (a["g"] + F.log(k.cast("double"))).alias("g")),
    )
    # ln of x**(n-1) / (n-1)! and the sum in units of that term
    lead = F.when(n == 1, -x).otherwise((n - 1) * F.log(x) - fold["g"] - x)
    tail = F.when(n == 1, 0.0).otherwise(F.log(fold["h"]))
    size = n <= UNROLLED
    first = n * F.log(x) - x - F.when(size, gamma).otherwise(fold["g"])
    far = (x >= n) & (x >= 1.0) & (first < LOG_TINY)
    log_tail = F.when(size, F.log(few) - x).otherwise(lead + tail)
    return (
        F.when(n.isNull() | s.isNull(), F.lit(None))
        .when((n < 1) | (s <= 0), 0)
        .when(far, MAX_PV)
        .otherwise(F.greatest(F.lit(0), F.least(F.lit(MAX_PV), F.floor(-log_tail / _K + 0.5))))
        .cast("int")
    )


def agreed_pv(p: Column, q: Column) -> Column:
    """Phred value of two agreeing calls."""
    x = (p + q).cast("double") * _K
    return F.when(x.isNull(), F.lit(None)).when((2 * F.log(x) - x < LOG_TINY) & (x >= 2), MAX_PV).otherwise(F.floor((x - F.log1p(x)) / _K + 0.5)).cast("int")
