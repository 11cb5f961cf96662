"""Event streams: deduplicated daily summaries with a watermark, and rates joined to ticks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.operators.asof import asof_join
from strandline.operators.ledger import LEAST_SHARES, rebalance


def read_ticks(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def daily_summary(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """window, user_id, n, low, high and total of each day; repeated event_ids within the watermark count once, later rows are dropped."""
    once = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return (
        once.groupBy(F.window("ts", "1 day"), "user_id")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))
        .select(F.to_date("window.start").alias("date"), "user_id", "n", "low", "high", "total")
    )


def daily_rates(rates: DataFrame, days_ahead: int = 7) -> DataFrame:
    """A rate for each currency and day from its first one to ``days_ahead`` after its last: that day's, or the latest before."""
    span = rates.groupBy("currency").agg(F.min("date").alias("lo"), F.date_add(F.max("date"), days_ahead).alias("hi"))
    days = span.select("currency", F.explode(F.sequence("lo", "hi")).alias("date"))
    return asof_join(days, rates, ["currency"], "date", ["sek_per_ccy"]).drop("right_on")


def with_rates(ticks: DataFrame, rates: DataFrame) -> DataFrame:
    """Ticks (currency, ts, value) in SEK: a stream-static join to a snapshot of ``daily_rates``, so never to a rate after the tick's day."""
    day = ticks.withColumn("date", F.to_date("ts"))
    return day.join(daily_rates(rates), ["currency", "date"], "left").withColumn("value_sek", F.col("value") * F.when(F.col("currency") == "SEK", 1.0).otherwise(F.col("sek_per_ccy")))


LEDGER = "role string, month int, trade_date date, security_id string, action string, shares double, cash_after double"


def paper_ledger(picks: DataFrame, start: float, cost_bps: float) -> DataFrame:
    """Trades of each role's portfolio as its picks (role, month, trade_date, positions array<struct<security_id, weight, price>>) come in.

    The state is a role's holdings, cash and last month. A month that isn't after the last one is a repetition and changes nothing; of several
    rows of one month the first counts. Positions without a positive price are left alone. A role's positions bound what a task holds.
    """

    def step(key, frames, state):
        holdings, cash, last = state.get if state.exists else ("{}", start, -1)
        holdings, out = json.loads(holdings), []
        rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.month, r.trade_date))
        for r in rows:
            if r.month <= last:
                continue
            last, wanted, prices = int(r.month), {}, {}
            for p in r.positions if r.positions is not None else ():
                if p["price"] is not None and p["price"] > 0:
                    wanted[p["security_id"]], prices[p["security_id"]] = p["weight"], p["price"]
            prices = {k: h[1] for k, h in holdings.items()} | prices
            targets = {k: w for k, w in wanted.items() if w}
            for k, shares, value, cost in rebalance({k: h[0] for k, h in holdings.items()}, cash, targets, prices, cost_bps / 1e4):
                action = "enter" if k not in holdings else "exit" if k not in targets else "adjust"
                holdings[k] = [holdings.get(k, [0.0])[0] + shares, prices[k]]
                cash -= value + cost
                out.append((key[0], last, r.trade_date, k, action, shares, cash))
            holdings = {k: [n, prices[k]] for k, (n, _) in holdings.items() if abs(n) >= LEAST_SHARES}
        state.update((json.dumps(holdings), cash, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])

    return picks.groupBy("role").applyInPandasWithState(step, LEDGER, "holdings string, cash double, last int", "append", "NoTimeout")


def new_periods(picks: DataFrame) -> DataFrame:
    """role and month of the picks (role, month) that are after every month of the role so far; repetitions and old months give nothing."""

    def step(key, frames, state):
        last = state.get[0] if state.exists else -1
        fresh = sorted({int(m) for f in frames for m in f["month"] if m > last})
        state.update((fresh[-1] if fresh else last,))
        yield pd.DataFrame({"role": [key[0]] * len(fresh), "month": fresh})

    return picks.groupBy("role").applyInPandasWithState(step, "role string, month int", "last int", "append", "NoTimeout")


def stale(seen: DataFrame, by: str, date: str, today, most: int = 7) -> DataFrame:
    """The ``by`` whose latest ``date`` is over ``most`` days before ``today``, or unknown, with the days between."""
    age = F.date_diff(F.lit(today), F.max(date))
    return seen.groupBy(by).agg(age.alias("days")).where((F.col("days") > most) | F.col("days").isNull())


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what is there and stops; a later call goes on from the checkpoint."""
    query = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
