"""Return statistics as aggregate expressions."""

from __future__ import annotations

from functools import reduce
from math import e
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def total_return(r: Column) -> Column:
    return F.product(1 + r) - 1


def sharpe(r: Column, periods: int = 12) -> Column:
    """Mean over sample deviation, annualised; 0 with fewer than two periods or no deviation."""
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (sd > 0), F.avg(r) / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0)


def cagr(r: Column, periods: int = 12) -> Column:
    growth = F.product(1 + r)
    return F.when(F.count(r) == 0, 0.0).when(growth <= 0, -1.0).otherwise(F.pow(growth, periods / F.count(r)) - 1)


def sortino(r: Column, periods: int = 12) -> Column:
    """Mean over the sample deviation of the losses, annualised; 0 with fewer than two losses or no deviation of them."""
    losses = F.when(r < 0, r)
    sd = F.stddev_samp(losses)
    return F.when((F.count(losses) >= 2) & (sd > 0), F.avg(r) / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0)


def skewness(r: Column) -> Column:
    """Mean cube of values standardised by the sample deviation; 0 with fewer than three."""
    n = F.count(r)
    return F.when(n < 3, 0.0).when(F.stddev_samp(r) == 0, 0.0).otherwise(F.skewness(r) * F.pow((n - 1) / n, 1.5))


def kurtosis(r: Column) -> Column:
    n = F.count(r)
    return F.when(n < 4, 3.0).when(F.stddev_samp(r) == 0, 3.0).otherwise((F.kurtosis(r) + 3) * F.pow((n - 1) / n, 2))


def equity(returns: DataFrame, by: list[str], order: str, r: str = "ret") -> DataFrame:
    """Compounded index from 1, its peak (1 at least) and drawdown."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("equity", F.product(1 + F.coalesce(r, F.lit(0.0))).over(w))
    return out.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w))).withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))


#: Coefficients of the rational approximation of the normal distribution (Hart 1968), from the highest power.
NORMAL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
EULER = 0.5772156649


def normal_cdf(x: Column) -> Column:
    """The normal distribution function to about 14 places where the argument is within 7, beyond that 0 or 1."""
    a = F.abs(x)
    above, below = (reduce(lambda total, c: total * a + c, cs[1:], F.lit(cs[0])) for cs in (NORMAL_ABOVE, NORMAL_BELOW))
    tail = F.when(a > 7, 0.0).otherwise(F.exp(-a * a / 2) * above / below)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def expected_maximum(n: int) -> float:
    """Expected greatest of ``n`` standard normal values, by the two quantiles usual for deflated Sharpe ratios; 0 for one."""
    if n <= 1:
        return 0.0
    first, second = (NormalDist().inv_cdf(min(max(1 - p, 1e-9), 1 - 1e-9)) for p in (1 / n, 1 / (n * e)))
    return (1 - EULER) * first + EULER * second


def deflated(returns: DataFrame, by: list[str], r: str, trials: int) -> DataFrame:
    """score, probability and expected_max_noise_sharpe of each group's returns, out of ``trials`` tried; all 0 under three returns or without deviation."""
    c = F.col(r)
    each = returns.where(c.isNotNull()).groupBy(*by).agg(F.count(c).alias("n "), F.avg(c).alias("m "), F.stddev_samp(c).alias("s "), skewness(c).alias("k3 "), kurtosis(c).alias("k4 "))
    each = each.withColumn("r ", F.when((F.col("`n `") >= 3) & (F.col("`s `") > 0) & F.lit(trials >= 1), F.col("`m `") / F.col("`s `")))
    ratio = F.col("`r `")
    variance = F.greatest(1 - F.col("`k3 `") * ratio + (F.col("`k4 `") - 1) / 4 * ratio * ratio, F.lit(1e-12))
    each = each.withColumn("d ", F.when(ratio.isNotNull(), F.sqrt(variance / (F.col("`n `") - 1))))
    # columns of their own, so that the long expression below refers to them and doesn't repeat them
    each = each.withColumn("noise ", F.col("`d `") * expected_maximum(trials)).withColumn("x ", (ratio - F.col("`noise `")) / F.col("`d `"))
    found = [ratio - F.col("`noise `"), normal_cdf(F.col("`x `")), F.col("`noise `")]
    names = ["score", "probability", "expected_max_noise_sharpe"]
    return each.select(*by, *[F.coalesce(F.when(ratio.isNotNull(), c), F.lit(0.0)).alias(name) for c, name in zip(found, names, strict=True)])
