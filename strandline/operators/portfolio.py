"""Ranking, selection, weights and the monthly backtest of many candidates in one job."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.asof import asof_both
from strandline.operators.universe import CASHOUTS, within_capacity

#: Fixed value: what is left of the last price of a name that stops trading without being paid out.
HAIRCUT = 0.7
#: Fixed value: parts by number whose best scores bound a book's; more than names in a book, or nothing is left out.
PARTS = 32


def anchors(universe: DataFrame) -> DataFrame:
    """number, month and p: total-return closes of the anchor days on which there was a trade."""
    return universe.where((F.col("stale_days") == 0) & (F.col("adj_close") > 0)).select("number", "month", F.col("adj_close").alias("p"))


def _close_before(months: int):
    """The security's total-return close on the anchor exactly so many months before; none if there was no trade then."""
    w = Window.partitionBy("number").orderBy("month").rangeBetween(-months, -months)
    return F.max(F.when((F.col("stale_days") == 0) & (F.col("adj_close") > 0), F.col("adj_close"))).over(w)


def momentum_scores(universe: DataFrame, grid: DataFrame) -> DataFrame:
    """universe with an array ``scores`` of (lookback, skip, score) for each distinct (lookback, skip) of ``grid``; see ``momentum``. One shuffle by security."""
    points = sorted(map(tuple, grid.select("lookback", "skip").distinct().collect()))  # of a parameter table
    back = sorted({s for _, s in points} | {a + s for a, s in points})
    rows = universe.withColumns({f"p{k} ": _close_before(k) for k in back})
    each = [F.struct(F.lit(a).alias("lookback"), F.lit(s).alias("skip"), (F.col(f"`p{s} `") / F.col(f"`p{a + s} `") - 1).alias("score")) for a, s in points]
    return rows.withColumn("scores", F.array(*each)).drop(*[f"p{k} " for k in back])


def momentum(universe: DataFrame, grid: DataFrame) -> DataFrame:
    """universe x distinct (lookback, skip) of ``grid``, with score = P[m - skip] / P[m - skip - lookback] - 1 of total-return closes on anchors; missing or non-positive gives null.

    Looks back by month ordinals, so a missing month is missing and not the one before it.
    """
    return momentum_scores(universe, grid).select("*", F.inline("scores")).drop("scores")


def monthly_returns(universe: DataFrame) -> DataFrame:
    """number, month, ret: the anchor's total-return close over the month before's; none where either is missing."""
    rows = universe.withColumns({"p ": _close_before(0), "was ": _close_before(1)})
    return rows.where("`p ` is not null and `was ` is not null").select("number", "month", (F.col("`p `") / F.col("`was `") - 1).alias("ret"))


def with_volatility(universe: DataFrame, window: int = 12, skip: int = 1) -> DataFrame:
    """Adds volatility: sample deviation of the monthly returns of ``window`` months that end ``skip`` before; those that there are, two at least. One shuffle by security."""
    w = Window.partitionBy("number").orderBy("month").rangeBetween(-(skip + window - 1), -skip)
    rows = universe.withColumns({"p ": _close_before(0), "was ": _close_before(1)}).withColumn("own ", F.col("`p `") / F.col("`was `") - 1)
    return rows.withColumn("volatility", F.stddev_samp("`own `").over(w)).drop("p ", "was ", "own ")


def volatility(universe: DataFrame, window: int = 12, skip: int = 1) -> DataFrame:
    return with_volatility(universe, window, skip).select("number", "month", "volatility")


def holding_returns(universe: DataFrame, daily: DataFrame, actions: DataFrame, parts: int | None = None) -> DataFrame:
    """number, month, ret (at opens) and ret_close (at closes): from the first trade on or after next_execution_date to that of the following month, total return in SEK.

    Without a trade then, to the last close before, if it isn't before the entry: in full if the holder was paid out meanwhile (an action of
    ``CASHOUTS``), else with a haircut. Without that either, the haircut's loss. The security's next month has the exit's prices, so one shuffle
    by security, in ``parts`` partitions if given, serves entry and exit.
    """
    w = Window.partitionBy("number").orderBy("month")
    due = universe.select("number", "month", "next_execution_date", F.col("next_execution_date").alias("date"))
    at = asof_both(due, daily, ["number"], "date", ["adj_open_sek", "adj_close_sek"], parts).drop("date")
    both = at.withColumns({"exit_due": F.lead("next_execution_date").over(w), "out_ahead": F.lead("ahead").over(w), "out_back": F.lead("back").over(w)})
    cashouts = actions.where(F.col("action_type").isin(*CASHOUTS))
    cashouts = cashouts.repartition(parts, "number") if parts else cashouts
    paid = cashouts.groupBy("number").agg(F.collect_set("date").alias("paid_dates"))
    both = both.join(paid, "number", "left").withColumn("paid", F.exists("paid_dates", lambda d: d.between(F.col("next_execution_date"), F.col("exit_due"))))
    entry_date, last = F.col("ahead.right_on"), F.col("out_back.adj_close_sek") * F.when(F.col("paid"), 1.0).otherwise(HAIRCUT)
    fallback = F.when(F.col("out_back.right_on") >= entry_date, last)

    def gain(price: str):
        entry, value = F.col(f"ahead.{price}"), F.coalesce(f"out_ahead.{price}", fallback)
        ret = F.when(F.col("exit_due").isNull() | (entry_date > F.col("exit_due")) | ~(entry > 0), None).otherwise(F.coalesce(F.when(value > 0, value / entry - 1), F.lit(HAIRCUT - 1)))
        return ret

    return both.where("ahead is not null").select("number", "month", gain("adj_open_sek").alias("ret"), gain("adj_close_sek").alias("ret_close"))


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank, from 1: higher scores first, ties by number, missing scores last."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc_nulls_last(), "number")))


RANKABLE = "reason = '' and score is not null and ret is not null"


def weighted(held: DataFrame, by: list[str]) -> DataFrame:
    """Adds weight: equal, by market value (cap) or by one over volatility (inv_vol), summing to the share of ``top_n`` that is held.

    A name without a positive value weighs nothing; where none has one, weights are equal.
    """
    w = Window.partitionBy(*by)
    raw = F.when(F.col("weighting") == "cap", F.when(F.col("market_cap_sek") > 0, F.col("market_cap_sek")))
    raw = raw.when(F.col("weighting") == "inv_vol", F.when(F.col("volatility") > 0, 1 / F.col("volatility"))).otherwise(1.0)
    total, many = F.sum(raw).over(w), F.count("*").over(w)
    part = F.when(F.coalesce(total, F.lit(0.0)) > 0, F.coalesce(raw, F.lit(0.0)) / total).otherwise(1 / many)
    return held.withColumn("weight", many / F.col("top_n") * part)


def foremost(rows: DataFrame, by: list[str], most=None, parts: int = PARTS) -> DataFrame:
    """``rows`` without those that can't be among the first ``most`` (top_n; of columns of ``by``) by score: as many of the best scores of ``parts`` parts by number are at least as high.

    Parts' best scores are found in the tasks, so all rows but a few are dropped before they are shuffled or sorted; equal scores stay.
    """
    best = rows.groupBy(*by, F.pmod("number", F.lit(parts)).alias("part ")).agg(F.max("score").alias("best "))
    order = F.sort_array(F.collect_list("`best `"), asc=False)
    least = best.groupBy(*by).agg(order.alias("order ")).select(*by, F.get("`order `", (F.col("top_n") if most is None else most) - 1).alias("least "))
    return rows.join(F.broadcast(least), by, "left").where("`least ` is null or score >= `least `").drop("least ")


def books(scored: DataFrame, grid: DataFrame, where: str = RANKABLE, by: tuple[str, ...] = ()) -> DataFrame:
    """Full rebalance: the ``top_n`` best rows of ``where`` and within capacity of each (*by, candidate, month), with their weights (see ``weighted``)."""
    sizes = F.broadcast(grid.select("lookback", "skip", "top_n").distinct())
    able = scored.where(where).join(sizes, ["lookback", "skip"]).where(within_capacity(F.col("top_n")))
    keys = [*by, "lookback", "skip", "top_n", "month"]
    best = ranked(foremost(able, keys), keys).where("rank <= top_n")
    held = weighted(best.join(F.broadcast(grid), ["lookback", "skip", "top_n"]), [*by, "candidate_id", "month"])
    return held.select(*by, "candidate_id", "month", "number", "country_code", "currency", "median_value", "close_sek", "top_n", "ret", "score", "weight")


def period_returns(book: DataFrame, cost, facts: DataFrame | None = None, by: tuple[str, ...] = (), months: DataFrame | None = None) -> DataFrame:
    """*by, candidate_id, month, gross, cost, net, entries, exits, held: entries pay on the new weight, exits on the weight of the month before.

    ``cost`` is a fraction, or a column of the ``facts`` (number, month, ...) of the trade's month and of top_n; a trade without one is free. ``months``
    (*by, candidate_id, month) are those that count, also without names, else those of each candidate's book.
    """
    keys = [*by, "candidate_id", "month"]
    now = book.select(*keys, "number", "weight", "ret", "top_n") if facts is not None else book.select(*keys, "number", "weight", "ret")
    before = now.withColumn("month", F.col("month") + 1).drop("ret").withColumnRenamed("weight", "was")
    if facts is not None:
        before = before.withColumnRenamed("top_n", "top_was")
    both = now.join(before, [*keys, "number"], "full_outer")
    if facts is not None:
        traded = now.select("number", "month").unionByName(before.select("number", "month")).distinct()  # as many as books hold, whatever the universe
        facts = facts.join(F.broadcast(traded), ["number", "month"], "left_semi")
        both = both.withColumn("top_n", F.coalesce("top_n", "top_was")).join(F.broadcast(facts), ["number", "month"], "left")
    entered, left = F.col("was").isNull() & F.col("weight").isNotNull(), F.col("weight").isNull() & F.col("was").isNotNull()
    one = F.coalesce(cost if not isinstance(cost, float) else F.lit(cost), F.lit(0.0))
    months = book.select(*keys).distinct() if months is None else months
    nothing = F.lit(0.0)
    return months.join(both, keys, "left").groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("weight") * F.col("ret")), nothing).alias("gross"),
        F.coalesce(F.sum(F.when(entered, F.col("weight") * one).when(left, F.col("was") * one)), nothing).alias("cost"),
        F.count_if(entered).alias("entries"),
        F.count_if(left).alias("exits"),
        F.count("weight").alias("held"),
    ).withColumn("net", F.col("gross") - F.col("cost"))


def path_books(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """Books that depend on the one before: candidate_id, month, number, weight, age.

    A held name that can still be ranked stays while its rank is at most top_n + band, or it was held for under min_hold months; the rest is
    filled by rank. So a name comes in at a rank of top_n at most, and only rows within the band, or of names that were within top_n in the last
    min_hold months, can matter: one group for each candidate, folded month by month, holds these alone.
    """
    best = ranked(scored.where("reason = '' and score is not null and ret is not null"), ["lookback", "skip", "month"])
    longest = grid.agg(F.max("min_hold")).first()[0] or 0  # of a parameter table
    cells = best.join(F.broadcast(grid), ["lookback", "skip"]).select("candidate_id", "month", "number", "rank", "top_n", "band", "min_hold")
    lately = Window.partitionBy("candidate_id", "number").orderBy("month").rangeBetween(-longest, 0)
    entered = F.max(F.when(F.col("rank") <= F.col("top_n"), F.col("month"))).over(lately)
    cells = cells.withColumn("entered", entered).where("rank <= top_n + band or entered >= month - min_hold").drop("entered")

    def fold(rows: pa.Table) -> pa.Table:
        out, ages, last = [], {}, None
        months: dict[int, list] = {}
        for r in rows.to_pylist():
            months.setdefault(r["month"], []).append(r)
        for month in sorted(months):
            names = sorted(months[month], key=lambda r: r["rank"])
            n, band, least = names[0]["top_n"], names[0]["band"], names[0]["min_hold"]
            if last is not None and month != last + 1:
                ages = {}
            stay = [r["number"] for r in names if r["number"] in ages and (r["rank"] <= n + band or ages[r["number"]] < least)][:n]
            fill = [r["number"] for r in names if r["number"] not in stay][: n - len(stay)]
            ages = {x: ages.get(x, 0) + 1 for x in stay + fill}
            last = month
            out += [(names[0]["candidate_id"], month, x, 1.0 / n, a) for x, a in ages.items()]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["candidate_id", "month", "number", "weight", "age"])

    return cells.groupBy("candidate_id").applyInArrow(fold, "candidate_id string, month int, number long, weight double, age int")
