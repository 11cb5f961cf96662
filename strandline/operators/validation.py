"""Judging candidates: resampling, overfitting probability, selection and walk-forward."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import stats


def uniform(*cols, seed: int):
    """Two numbers in [0, 1) from a digest of the columns: the same wherever and whenever, and in whatever engine, they are computed."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *cols))
    return tuple(F.conv(F.substring(digest, at, 12), 16, 10).cast("double") / float(1 << 48) for at in (1, 13))


def stationary_bootstrap(returns: DataFrame, by: str, order: str, r: str, resamples: int, block: float, seed: int = 1) -> DataFrame:
    """(by, resample, step, ret): each series resampled in blocks of geometric length, wrapping around.

    A step restarts with probability 1 / block at a random place; otherwise it goes on from the one before. The place
    is the last restart's plus the steps since, so no state is carried. Work is split by series and resample.
    """
    w = Window.partitionBy(by).orderBy(order)
    series = returns.select(by, F.col(r).alias("ret"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    draws = series.select(by, F.col("i").alias("step"), "n").crossJoin(F.broadcast(returns.sparkSession.range(resamples).withColumnRenamed("id", "resample")))
    often, where = uniform(by, "resample", "step", seed=seed)
    restart = (F.col("step") == 0) | (often < 1 / block)
    place = F.when(restart, F.floor(where * F.col("n")) - F.col("step"))
    steps = Window.partitionBy(by, "resample").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    drawn = draws.withColumn("i", F.pmod(F.last(place, ignorenulls=True).over(steps) + F.col("step"), F.col("n")).cast("int"))
    return drawn.drop("n").join(series.drop("n"), [by, "i"]).select(by, "resample", "step", "ret")


def sharpe_interval(returns: DataFrame, by: str, order: str, r: str, resamples: int = 2000, block: float = 6.0) -> DataFrame:
    series = returns.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, r))), lambda x: x[r]).alias("rets"))
    each = bootstrap_sharpes(series, [by], F.col(by), resamples, block, 1)
    return each.groupBy(by).agg(F.percentile("sharpe", 0.025).alias("low"), F.percentile("sharpe", 0.975).alias("high"))


#: Items that a sketch keeps: a rank is then off by 0.3 % of all values, at 99 % confidence.
SKETCH = 1000


def path_sketches(paths: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and sketch: the values of each group as a quantile sketch, a few kilobytes however many there are. Sketches of more paths are added by ``merged_sketches``."""
    return paths.groupBy(*by).agg(F.kll_sketch_agg_double(value, SKETCH).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One sketch for each group of ``by`` from any number of rows, such as those of several runs or of several steps."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """by, n and q, the values at ``quantiles``, of each sketch."""
    return sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, quantiles))).alias("q"))


def path_density(paths: DataFrame, outer: DataFrame, by: list[str], step: str, value: str, bins: int = 72) -> DataFrame:
    """by, step, bin and n: paths in each of ``bins`` equal bins between the least ``low`` and the greatest ``high`` that ``outer`` (by, step, low, high) has of all steps.

    What lies outside counts nowhere; the last bin is closed. Where all quantiles are one value, bins span 1.
    """
    span = outer.groupBy(*by).agg(F.min("low").alias("lo"), F.max("high").alias("hi")).withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi")))
    slot = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))).cast("int")
    inside = paths.join(F.broadcast(span), by).where(F.col(value).between(F.col("lo"), F.col("hi")))
    return inside.groupBy(*by, step, slot.alias("bin")).agg(F.count("*").alias("n"))


def overfitting(returns: DataFrame, slices: int = 10, months: int = 6) -> DataFrame:
    """One row for each way to halve the time slices: the candidate best in sample, its percentile out of sample, and the logit.

    There are ``slices`` equal slices, or else as many as the largest even divisor of the number of months below that, each of ``months``
    months at least. Where no such divisor fits, which the reference leaves without a result, there are the most slices, an even number, that have ``months`` months
    each but for rounding; where not even two fit, there is no row.
    Moments (n, sum, sum of squares) add up over slices, so a half's Sharpe ratio needs no second look at the returns.
    """
    spark: SparkSession = returns.sparkSession
    span = returns.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    whole, allowed = F.col("hi") - F.col("lo") + 1, sorted({slices, *range(2, slices + 1, 2)}, reverse=True)
    fits = F.coalesce(*[F.when(equal & (whole >= k * months), F.lit(k)) for k, equal in [*((k, whole % k == 0) for k in allowed), *((k, F.lit(True)) for k in allowed)]])
    span = span.withColumn("slices", fits).where("slices is not null")
    cut = F.floor((F.col("month") - F.col("lo")) * F.col("slices") / whole).cast("int")
    moments = returns.crossJoin(F.broadcast(span)).groupBy("candidate_id", "slices", cut.alias("slice")).agg(F.count("net").alias("n"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("q"))
    halves = spark.createDataFrame([(n, k, x, x in own) for n in allowed for k, own in enumerate(combinations(range(n), n // 2)) for x in range(n)], "slices int, split int, slice int, inside boolean")
    total = moments.join(F.broadcast(halves), ["slices", "slice"]).groupBy("split", "candidate_id", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    total = total.withColumn("sharpe", F.round(F.when((F.col("n") > 1) & (sd > 0), F.col("s") / F.col("n") / sd).otherwise(0.0), 9))
    both = total.groupBy("split", "candidate_id").agg(F.max(F.when(F.col("inside"), F.col("sharpe"))).alias("inside"), F.max(F.when(~F.col("inside"), F.col("sharpe"))).alias("outside"))
    w = Window.partitionBy("split")
    placed = both.withColumn("place", F.row_number().over(w.orderBy(F.col("inside").desc_nulls_last(), "candidate_id"))).withColumn("above", F.rank().over(w.orderBy(F.col("outside").asc_nulls_first()))).withColumn("all", F.count("*").over(w))
    share = F.col("above") / (F.col("all") + 1)
    return placed.where("place = 1").select("split", "candidate_id", "inside", "outside", share.alias("percentile"), F.ln(share / (1 - share)).alias("logit"))


def walk_forward(returns: DataFrame, folds: DataFrame) -> DataFrame:
    """For each fold (fold_id, train_from, train_to, test_from, test_to): the candidate of best train Sharpe, and its Sharpe and return in the test window."""
    cells = returns.join(F.broadcast(folds), (F.col("month") >= F.col("train_from")) & (F.col("month") <= F.col("test_to")))
    train, test = F.col("month") <= F.col("train_to"), F.col("month") >= F.col("test_from")
    each = cells.groupBy("fold_id", "candidate_id").agg(
        F.round(stats.sharpe(F.when(train, F.col("net"))), 9).alias("train_sharpe"),
        stats.sharpe(F.when(test, F.col("net"))).alias("test_sharpe"),
        (F.product(F.when(test, 1 + F.col("net"))) - 1).alias("test_return"),
    )
    best = F.row_number().over(Window.partitionBy("fold_id").orderBy(F.desc("train_sharpe"), "candidate_id"))
    return each.withColumn("k", best).where("k = 1").drop("k")


def neighbours(grid: DataFrame, axes: list[str]) -> DataFrame:
    """(candidate_id, neighbour_id): points one step away on one axis and equal on the others."""
    steps = grid
    for a in axes:
        steps = steps.withColumn(f"{a} k", F.dense_rank().over(Window.orderBy(a)))
    one, two = steps.alias("x"), steps.alias("y")
    apart = sum((F.abs(F.col(f"x.`{a} k`") - F.col(f"y.`{a} k`")) for a in axes[1:]), F.abs(F.col(f"x.`{axes[0]} k`") - F.col(f"y.`{axes[0]} k`")))
    return one.join(F.broadcast(two), apart == 1).select(F.col("x.candidate_id").alias("candidate_id"), F.col("y.candidate_id").alias("neighbour_id"))


def bootstrap_sharpes(series: DataFrame, by: list[str], key, resamples: int, block: float, seed: int, periods: float = 12.0) -> DataFrame:
    """by, resample and sharpe of each row of ``series``, whose returns are an array ``rets`` in order, resampled as in ``stationary_bootstrap``.

    ``key`` names a series in the digests. A resample is walked within its row, adding up moments, so only series and resamples are rows, and what is shuffled is the series, once.
    Under two returns, or without deviation, the ratio is 0.
    """
    n = F.size("rets")
    digests = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.md5(F.concat_ws(":", F.lit(seed), key, F.col("resample"), i)))
    number = lambda d, at: F.conv(F.substring(d, at, 12), 16, 10).cast("double") / float(1 << 48)

    def step(acc, d):
        place = F.when((acc["place"] < 0) | (number(d, 1) < 1 / block), F.floor(number(d, 13) * n).cast("int")).otherwise(((acc["place"] + 1) % n).cast("int"))
        r = F.get("rets", place)
        return F.struct(place.alias("place"), (acc["s"] + r).alias("s"), (acc["q"] + r * r).alias("q"))

    start = F.struct(F.lit(-1).alias("place"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, each with much to do
    rows = series.where(F.size("rets") > 0).repartition(parts).select(*by, "rets", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    sums = rows.select(*by, "resample", n.alias("n"), F.aggregate(digests, start, step).alias("a"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("a.q") - F.col("a.s") * F.col("a.s") / F.col("n")) / (F.col("n") - 1)))
    sharpe = F.when((F.col("n") > 1) & (sd > 1e-12), F.col("a.s") / F.col("n") / sd * F.sqrt(F.lit(periods))).otherwise(0.0)
    return sums.select(*by, "resample", sharpe.alias("sharpe"))
