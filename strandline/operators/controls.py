"""Negative controls and resampled paths, and the comparison of two tables.

Random orders come from digests of (seed, run, keys), so a lost task computes the same order again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import portfolio
from strandline.storage import saved


def digest(*cols: Column | str) -> Column:
    """A sort key that looks random: the MD5 of the columns joined by colons."""
    return F.md5(F.concat_ws(":", *[F.col(c) if isinstance(c, str) else c for c in cols]))


def contenders(rankable: DataFrame, top_n: int, runs: int, seed: int = 7) -> DataFrame:
    """(run, month, number, score, ret): of the rows of each run and month those that can be among the first ``top_n``, and few others.

    ``score`` is run 0's own; in each other run it is less the higher the first 52 bits of the row's digest are. Rows times runs are only
    added up to the best of parts of the names and held against these (``portfolio.foremost``); they aren't sorted or shuffled.
    """
    rows = rankable.select("month", "number", "score", "ret").crossJoin(F.broadcast(rankable.sparkSession.range(runs + 1).withColumnRenamed("id", "run")))
    drawn = -F.conv(F.substring(digest(F.lit(seed), "run", "month", "number"), 1, 13), 16, 10).cast("double")
    rows = rows.withColumn("score", F.when(F.col("run") == 0, F.col("score")).otherwise(drawn))
    return portfolio.foremost(rows, ["run", "month"], F.lit(top_n), 2 * top_n)


def shuffled_scores(rankable: DataFrame, top_n: int, runs: int, seed: int = 7) -> DataFrame:
    """(run, month, excess): the ``top_n`` names' mean return less that of all rankable names, to twelve digits.

    Run 0 takes the best scores, ties by number; each other run a random order within the month. Null returns or scores don't belong
    in ``rankable``. Only ``contenders`` are ranked, whose number doesn't grow with that of names.
    """
    base = rankable.groupBy("month").agg(F.avg("ret").alias("base"))
    order = [F.col("score").desc_nulls_last(), F.when(F.col("run") > 0, digest(F.lit(seed), "run", "month", "number")).asc(), F.col("number").asc()]
    rank = F.row_number().over(Window.partitionBy("run", "month").orderBy(*order))
    best = contenders(rankable, top_n, runs, seed).withColumn("k", rank).where(F.col("k") <= top_n).join(F.broadcast(base), "month")
    return best.groupBy("run", "month").agg(F.round(F.sum(F.col("ret") - F.col("base")) / top_n, 12).alias("excess"))


def block_shuffles(returns: DataFrame, by: str, order: str, r: str, runs: int, block: int, seed: int = 7) -> DataFrame:
    """(by, run, step, ret): each series with its contiguous blocks of ``block`` periods in a random order; steps from 0."""
    w = Window.partitionBy(by).orderBy(order)
    series = returns.select(by, F.col(r).alias("ret"), (F.row_number().over(w) - 1).alias("i"))
    rows = series.crossJoin(F.broadcast(returns.sparkSession.range(runs).withColumnRenamed("id", "run")))
    of = F.floor(F.col("i") / block).cast("int")
    placed = Window.partitionBy(by, "run").orderBy(digest(F.lit(seed), "run", F.col(by), of), "i")
    return rows.withColumn("step", F.row_number().over(placed) - 1).select(by, "run", "step", "ret")


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """keys and status: ``left_only``, ``right_only``, ``differs`` or ``same``.

    Values differ beyond ``tolerance`` times the larger magnitude (1 at least); two nulls are the same, one isn't. Keys should be unique and not null.
    """
    one = a.select(*keys, F.struct(*values).alias("one"))
    two = b.select(*keys, F.struct(*values).alias("two"))
    apart = F.lit(False)
    for v in values:
        x, y = F.col(f"one.{v}"), F.col(f"two.{v}")
        gap = F.abs(x - y) > tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
        apart = apart | F.when(x.isNull() | y.isNull(), x.isNull() != y.isNull()).otherwise(gap)
    status = F.when(F.col("two").isNull(), "left_only").when(F.col("one").isNull(), "right_only").when(apart, "differs").otherwise("same")
    return one.join(two, keys, "full_outer").select(*keys, status.alias("status"))


def month_arrays(rankable: DataFrame, by: list[str], raw: Column) -> DataFrame:
    """by, month, base (mean return) and names: the rankable rows of a month, best score first, as an array of (number, ret, raw weight); a month's universe bounds it."""
    one = F.struct((-F.col("score")).alias("below"), "number", "ret", raw.cast("double").alias("raw"))
    return rankable.groupBy(*by, "month").agg(F.avg("ret").alias("base"), F.array_sort(F.collect_list(one)).alias("names"))


#: Names that a random order's bound is expected to let through beyond ``top_n``: so many times its root, and so many more.
SPARE_ROOTS, SPARE = 8, 32


def beginnings(rows: DataFrame, months: DataFrame, by: list[str], runs: int, seed: int) -> DataFrame:
    """by, top_n, run, month, digest, below, number, ret and raw: of the rows of each run and month those that can be among the first ``top_n``, and few others.

    Run 0 is in the order of scores; in each other run a row's place is that of its ``digest``, and those below a bound are left, which the month's
    number of names ``n`` sets. Rows times runs are made one by one and held against it; none is sorted or shuffled before. Runs that a bound leaves too few are for the caller to see to.
    """
    sized = [*dict.fromkeys([*by, "top_n", "month"])]
    share = (F.col("top_n") + SPARE_ROOTS * F.sqrt("top_n") + SPARE) / F.col("n")
    bound = F.when(share < 1, F.lpad(F.lower(F.hex(F.floor(share * float(1 << 52)))), 13, "0")).otherwise("g")  # g is above all digits
    able = rows.join(F.broadcast(months.where("is_on and n > 0").select(*sized, bound.alias("bound"))), [*by, "month"])
    own = _placed(portfolio.foremost(able, sized).withColumn("run", F.lit(0)), sized, seed)
    drawn = _placed(able.crossJoin(F.broadcast(rows.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run")))), sized, seed, "bound")
    return own.unionByName(drawn.where("digest < bound").drop("bound"))


def _placed(rows: DataFrame, keys: list[str], seed: int, *more: str) -> DataFrame:
    """What a row's place in its run depends on, and what it returns."""
    random = F.col("run") > 0
    place = [F.when(random, digest(F.lit(seed), "run", "month", "number")).otherwise("").alias("digest"), F.when(random, 0.0).otherwise(-F.col("score")).alias("below")]
    return rows.select(*keys, "run", *place, "number", "ret", "raw", *more)


def _firsts(placed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run and names: (ret, raw) of each run's first ``top_n``, in order."""
    order = F.array_sort(F.collect_list(F.struct("digest", "below", "number", "ret", "raw")))
    first = placed.groupBy(*keys, "run").agg(order.alias("names"))
    return first.select(*keys, "run", F.transform(F.slice("names", F.lit(1), F.col("top_n")), lambda x: F.struct(x["ret"].alias("ret"), x["raw"].alias("raw"))).alias("names"))


def selected(rows: DataFrame, months: DataFrame, by: list[str], runs: int, seed: int) -> DataFrame:
    """by, run, month and excess: what the first ``top_n`` of a month's ``rows`` return by their weights, less the mean return of all; run 0 by score, ties by number, each other in a random order.

    ``rows`` have by, month, number, score, ret and raw (the weight before it is scaled); ``months`` by, month, top_n and is_on: a gated month, or one without rows, returns 0. The orders'
    ``beginnings`` are grouped, so a group is bounded whatever the universe. A run and month that got fewer than it needs is made again from all rows of the month.
    """
    keys = [*by, "month"]
    sized = [*dict.fromkeys([*by, "top_n", "month"])]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ret").alias("base"))
    months = saved(months.select(*sized, "is_on").join(counted, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))), "selection months")
    made = saved(_firsts(beginnings(rows, months, by, runs, seed), sized), "selections")
    every = months.crossJoin(F.broadcast(months.sparkSession.range(runs + 1).select(F.col("id").cast("int").alias("run"))))
    many = F.coalesce(F.size("names"), F.lit(0))
    short = F.broadcast(every.join(made, [*sized, "run"], "left").where(F.col("is_on") & (many < F.least("top_n", "n"))).select(*sized, "run"))
    again = _firsts(_placed(rows.join(short, keys), sized, seed), sized)
    made = made.join(short, [*sized, "run"], "left_anti").unionByName(again)
    total = F.aggregate("names", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["raw"], F.lit(0.0)))
    found = every.join(made, [*sized, "run"], "left").withColumn("total", total)
    part = lambda x: F.when(F.col("total") > 0, F.coalesce(x["raw"], F.lit(0.0)) / F.col("total")).otherwise(1 / F.size("names"))
    gain = F.aggregate("names", F.lit(0.0), lambda acc, x: acc + part(x) * x["ret"]) * F.size("names") / F.col("top_n")
    return found.select(*by, "run", "month", F.coalesce(F.round(gain - F.col("base"), 12), F.lit(0.0)).alias("excess"))


def selections(months: DataFrame, by: list[str], runs: int, seed: int) -> DataFrame:
    """``selected`` of months that have their rows as an array ``names`` (see ``month_arrays``)."""
    names = months.select(*by, "month", F.inline("names")).withColumn("score", -F.col("below")).drop("below")
    return selected(names, months.drop("names"), by, runs, seed)


def block_orders(series: DataFrame, by: list[str], key: Column, runs: int, block: int, seed: int) -> DataFrame:
    """by, run and rets: the array ``rets`` with its blocks of ``block`` periods in a random order (run 0: as it is), within the row."""
    rows = series.select(*by, "rets", F.explode(F.sequence(F.lit(0), F.lit(runs))).alias("run"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("rets") - 1) / block).cast("int")),
        lambda k: F.struct(F.when(F.col("run") > 0, F.md5(F.concat_ws(":", F.lit(seed), F.col("run"), key, k))).otherwise("").alias("digest"), k.alias("k"), F.slice("rets", k * block + 1, F.lit(block)).alias("own")),
    )
    return rows.where(F.size("rets") > 0).select(*by, "run", F.flatten(F.transform(F.array_sort(blocks), lambda b: b["own"])).alias("rets"))


def figures(runs: DataFrame, by: list[str], resamples: int, block: float, seed: int, trials: int) -> DataFrame:
    """by, run, and the Sharpe ratio, the lower bound of its bootstrap interval and the deflated ratio of each run's array ``rets``, to nine digits."""
    from strandline.functions import stats
    from strandline.operators.validation import bootstrap_sharpes

    keys = [*by, "run"]
    low = bootstrap_sharpes(runs, keys, F.concat_ws(":", *keys), resamples, block, seed).groupBy(*keys).agg(F.round(F.percentile("sharpe", 0.025), 9).alias("low"))
    each = runs.select(*keys, F.explode("rets").alias("r"))
    own = each.groupBy(*keys).agg(F.round(stats.sharpe(F.col("r")), 9).alias("sharpe"))
    noise = stats.deflated(each, keys, "r", trials).select(*keys, F.round("score", 9).alias("deflated"))
    return own.join(low, keys).join(noise, keys)


def passed(found: DataFrame, by: list[str]) -> DataFrame:
    """``figures`` with passed: whether a run's three are all at least those of run 0; where run 0 has a figure that isn't known, all pass."""
    names = ("sharpe", "low", "deflated")
    own = found.where("run = 0").select(*by, *[F.col(c).alias(f"own_{c}") for c in names])
    every = found.join(F.broadcast(own), by)
    test, known = F.lit(True), F.lit(True)
    for c in names:
        test, known = test & (F.col(c) >= F.col(f"own_{c}")), known & F.col(f"own_{c}").isNotNull() & ~F.isnan(f"own_{c}")
    return every.withColumn("passed", F.coalesce(test, F.lit(False)) | ~known)
