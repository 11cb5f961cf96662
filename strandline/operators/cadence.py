"""Backtests over any schedule of rebalance dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.asof import asof_join
from strandline.operators.portfolio import HAIRCUT, ranked
from strandline.operators.universe import month_ordinal

#: Periods a year of each cadence.
PERIODS = {"month": 12, "quarter": 4, "biweek": 26, "week": 52}
#: Months of the schedules that have offsets.
OFFSETS = {"quarter": 3, "half": 6}


def schedule(days: DataFrame) -> DataFrame:
    """cadence and date: the last day of each month, quarter, second ISO week and ISO week that ``days`` (date, distinct) has."""
    week = {"y": F.extract(F.lit("YEAROFWEEK"), "date"), "k": F.weekofyear("date")}
    weeks = days.withColumns(week).groupBy("y", "k").agg(F.max("date").alias("date"))
    parts = {
        "month": days.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("date")),
        "quarter": days.groupBy(F.trunc("date", "quarter")).agg(F.max("date").alias("date")),
        "biweek": weeks.where((F.col("y") * 53 + F.col("k")) % 2 == 0),
        "week": weeks,
    }
    out = None
    for name, dates in parts.items():
        dates = dates.select(F.lit(name).alias("cadence"), "date")
        out = dates if out is None else out.unionByName(dates)
    return out


def offset_schedule(days: DataFrame) -> DataFrame:
    """cadence and date: the last day in ``days`` (date, distinct) of every third (quarter) and sixth (half) month, at each offset before the calendar's.

    ``quarter-1`` ends in February, May, August and November, ``half-0`` in June and December. A month without a day gives no date.
    """
    ends = days.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("date")).select("date")
    each = [F.struct(F.lit(name).alias("name"), F.lit(length).alias("length")) for name, length in OFFSETS.items()]
    kinds = ends.select("date", F.inline(F.array(*each)))
    # the only offset whose months include this one
    offset = F.pmod(F.col("length") - F.month("date") % F.col("length"), F.col("length"))
    return kinds.select(F.format_string("%s-%d", "name", offset).alias("cadence"), "date")


def periods(days: DataFrame, dates: DataFrame) -> DataFrame:
    """cadence, period (from 0), rebalance_date, entry_date (the next day there is) and exit_date (the following period's entry).

    Periods without either go, above all the last. The tables hold one row for each calendar day at most, whatever the number of securities.
    """
    following = days.select(F.col("date"), F.lead("date").over(Window.orderBy("date")).alias("entry_date"))
    w = Window.partitionBy("cadence").orderBy("date")
    out = dates.join(F.broadcast(following), "date").withColumns({"period": (F.row_number().over(w) - 1).cast("int"), "exit_date": F.lead("entry_date").over(w)})
    return out.where("exit_date > entry_date").select("cadence", "period", F.col("date").alias("rebalance_date"), "entry_date", "exit_date")


def holding_returns(names: DataFrame, spans: DataFrame, daily: DataFrame) -> DataFrame:
    """cadence, period, number, ret: from the open of the entry date to that of the exit date.

    Without an exit open the last close not after it counts, less a haircut; without an entry open there is no return. Opens and closes
    that aren't positive count as missing.
    """
    opens = daily.where("open_sek > 0").select("number", "date", "open_sek")
    entry = opens.select("number", F.col("date").alias("entry_date"), F.col("open_sek").alias("entry_price"))
    due = entry.join(F.broadcast(spans), "entry_date").join(names, "number", "left_semi").withColumn("date", F.col("exit_date"))
    last = asof_join(due, daily.where("close_sek > 0"), ["number"], "date", ["close_sek"]).drop("right_on")
    out = last.join(opens, ["number", "date"], "left")
    return out.select("cadence", "period", "number", (F.coalesce("open_sek", F.col("close_sek") * HAIRCUT) / F.col("entry_price") - 1).alias("ret"))


def momentum(names: DataFrame, spans: DataFrame, daily: DataFrame, lookback: int, skip: int) -> DataFrame:
    """cadence, period, number, month (before the entry's) and score between calendar-shifted dates, closes carried forward."""
    out = names.crossJoin(F.broadcast(spans)).withColumn("month", month_ordinal(F.col("entry_date")) - 1)
    for back, price in ((skip, "p1"), (skip + lookback, "p0")):
        keyed = out.withColumn("date", F.add_months("rebalance_date", -back))
        out = asof_join(keyed, daily.where("close_sek > 0"), ["number"], "date", ["close_sek"]).drop("date", "right_on").withColumnRenamed("close_sek", price)
    return out.select("cadence", "period", "number", "month", (F.col("p1") / F.col("p0") - 1).alias("score"))


def books(scored: DataFrame, sizes: DataFrame) -> DataFrame:
    """candidate_id, cadence, month (the period's number), number, weight and ret of the ``top_n`` best of each period that has them; weight is 1 / top_n."""
    best = ranked(scored.where("score is not null and ret is not null"), ["cadence", "period"])
    held = best.crossJoin(F.broadcast(sizes)).where("rank <= top_n")
    ident = F.format_string("%s_n%d", "cadence", "top_n")
    return held.select(ident.alias("candidate_id"), "cadence", F.col("period").alias("month"), "number", (1 / F.col("top_n")).alias("weight"), "ret")
