"""Streams with typed state and timers: a paper ledger that starts from its history, rates that arrive as a stream, and alarms for silence."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

from strandline.operators.ledger import LEAST_SHARES, LEAST_TRADE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000
EPOCH = dt.date(1970, 1, 1)


def with_state_store(spark: SparkSession) -> None:
    """Keep state in RocksDB, which typed state and timers need, in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


_TYPES = {"string": StringType(), "double": DoubleType(), "date": DateType(), "timestamp": TimestampType(), "int": IntegerType(), "long": LongType()}


def _schema(text: str) -> StructType:
    """A flat schema, read without a session, as there is none where state is declared."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(", "))])


# ---- the paper ledger

#: Columns of the ledger and of the history, as one stream of rows.
LEDGER = "role string, record string, trade_date date, month int, security_id string, action string, trade_value double, price double, shares_delta double, cost_bps double, cost double, value_before double, value_after double, period_return double, cash_after double"
PICKS = "role string, month int, trade_date date, positions array<struct<security_id:string,weight:double,price:double,cost_bps:double,is_pick:boolean>>"
_HOLDING = "shares double, price double, entry_price double, entry_date date, cost_bps double"
_ACCOUNT = "cash double, value double, trade_date date, month int"


def rebalanced(holdings: dict[str, dict], cash: float, targets: dict[str, float], prices: dict[str, float], rates: dict[str, float], worth: float) -> list[tuple[str, float, float, float]]:
    """(security_id, value, shares, cost) of the trades to ``targets`` weights of ``worth``; ``rates`` are costs in basis points.

    Trades below ``LEAST_TRADE`` are left out. If cash would fall below zero, it is done once more with what is worth less the cost of the first try.
    """

    def tried(total: float) -> list[tuple[str, float, float, float]]:
        out = []
        for name in sorted(holdings.keys() | targets.keys()):
            value = total * targets.get(name, 0.0) - holdings.get(name, {"shares": 0.0})["shares"] * prices[name]
            if abs(value) >= LEAST_TRADE:
                out.append((name, value, value / prices[name], abs(value) * rates.get(name, 0.0) / 1e4))
        return out

    trades = tried(worth)
    cost = sum(t[3] for t in trades)
    if cost > 0 and cash - sum(t[1] + t[3] for t in trades) < 0:
        trades = tried(max(0.0, worth - cost))
    return trades


class PaperLedger(StatefulProcessor):
    """A role's account and holdings as typed state; see ``paper_ledger``."""

    def __init__(self, start: float) -> None:
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", _schema(_ACCOUNT))
        self.holdings = handle.getMapState("holdings", _schema("security_id string"), _schema(_HOLDING))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for r in initialState.itertuples(index=False):
            self.account.update((r.cash, r.value, r.trade_date, int(r.month)))
            for h in r.holdings if r.holdings is not None else ():
                self.holdings.updateValue((h["security_id"],), tuple(h[c.split()[0]] for c in _HOLDING.split(", ")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cash, worth, last_date, last_month = self.account.get() if self.account.exists() else (self.start, self.start, None, None)
        held = {k[0]: dict(zip([c.split()[0] for c in _HOLDING.split(", ")], v, strict=True)) for k, v in self.holdings.iterator()}
        had, out = set(held), []
        for r in sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: (r.trade_date, r.month)):
            if last_date is not None and (r.trade_date < last_date or (r.trade_date, r.month) == (last_date, last_month)):
                continue
            own = [p for p in (r.positions if r.positions is not None else ()) if p["price"] is not None and p["price"] > 0]
            picks = [p for p in own if p["is_pick"] is not False]
            prices = {k: h["price"] for k, h in held.items()} | {p["security_id"]: p["price"] for p in own}
            targets = {p["security_id"]: 1.0 / len(picks) if p["weight"] is None else p["weight"] for p in picks}
            rates = {k: h["cost_bps"] for k, h in held.items()} | {p["security_id"]: p["cost_bps"] or 0.0 for p in picks}
            before = cash + sum(h["shares"] * prices[k] for k, h in held.items())
            trades = rebalanced(held, cash, targets, prices, rates, before)
            for name, value, shares, cost in trades:
                cash -= value + cost
                old = held.get(name)
                out.append((key[0], "trade", r.trade_date, int(r.month), name, "buy" if value > 0 else "sell", value, prices[name], shares, rates.get(name, 0.0), cost, None, None, None, cash))
                held[name] = {
                    "shares": (old["shares"] if old else 0.0) + shares, "price": prices[name], "entry_price": old["entry_price"] if old else prices[name],
                    "entry_date": old["entry_date"] if old else r.trade_date, "cost_bps": rates.get(name, 0.0),
                }
            held = {k: h | {"price": prices[k]} for k, h in held.items() if abs(h["shares"]) >= LEAST_SHARES}
            after = cash + sum(h["shares"] * h["price"] for h in held.values())
            paid = sum(t[3] for t in trades)
            out.append((key[0], "history", r.trade_date, int(r.month), None, None, None, None, None, None, paid, before, after, before / worth - 1 if worth else 0.0, cash))
            worth, last_date, last_month = after, r.trade_date, int(r.month)
        if out:
            self.account.update((cash, worth, last_date, last_month))
            for name in had - held.keys():
                self.holdings.removeKey((name,))
            for name, h in held.items():
                self.holdings.updateValue((name,), tuple(h.values()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")]).astype({c: "object" for c in ("security_id", "action", "trade_date")})

    def close(self) -> None:
        pass


def recorded(rows: DataFrame) -> DataFrame:
    """The state that a ledger's written rows (columns ``LEDGER``) end in: role, cash, value, trade_date, month and holdings.

    A name's entry is its first trade since it was last sold out. Prices are those of a name's last trade.
    """
    trades = rows.where("record = 'trade'")
    way = Window.partitionBy("role", "security_id").orderBy("trade_date", "month")
    so_far = F.sum("shares_delta").over(way)
    opened = F.abs(so_far - F.col("shares_delta")) < LEAST_SHARES
    each = trades.withColumns({
        "shares": so_far, "entry_price": F.last(F.when(opened, F.col("price")), ignorenulls=True).over(way), "entry_date": F.last(F.when(opened, F.col("trade_date")), ignorenulls=True).over(way),
    })
    last = each.groupBy("role", "security_id").agg(F.max_by(F.struct("security_id", *[c.split()[0] for c in _HOLDING.split(", ")]), F.struct("trade_date", "month")).alias("h"))
    holdings = last.where(F.abs("h.shares") >= LEAST_SHARES).groupBy("role").agg(F.collect_list("h").alias("holdings"))
    when = F.struct("trade_date", "month")
    account = rows.where("record = 'history'").groupBy("role").agg(F.max_by(F.struct(F.col("cash_after").alias("cash"), F.col("value_after").alias("value"), "trade_date", "month"), when).alias("a"))
    return account.join(holdings, "role", "left").select("role", "a.*", "holdings")


def paper_ledger(picks: DataFrame, start: float, history: DataFrame | None = None) -> DataFrame:
    """Trades and month-end figures (columns ``LEDGER``) of each role's portfolio as its picks (columns ``PICKS``) come in.

    The state is a role's account and its holdings, name by name. It begins with what ``history`` (a batch of rows written before) ends in,
    or with ``start`` in cash. A (trade_date, month) that is recorded, or lies before the last one, changes nothing, so what is sent again does no harm. Positions that aren't picks
    only bring prices; a held name that isn't picked is sold at its price, else at its last one; names without a positive price are left alone. A pick
    without a weight has an equal one. Cash is what all trades leave; a name's cost is the pick's, else that of its last trade.
    """
    first = recorded(history).groupBy("role") if history is not None else None
    return picks.groupBy("role").transformWithStateInPandas(PaperLedger(start), LEDGER, "Append", "None", initialState=first)


# ---- rates that arrive as a stream

RATED = "currency string, tick_id long, ts timestamp, value double, sek_per_ccy double, rate_date date, value_sek double"


class RatesAsOf(StatefulProcessor):
    """Pending ticks and recent rates of a currency; see ``with_streamed_rates``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rates = handle.getMapState("rates", _schema("day int"), _schema("sek_per_ccy double"))
        self.pending = handle.getMapState("pending", _schema("day int, tick_id long"), _schema("ts timestamp, value double"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        days = set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                day = (r.ts.date() - EPOCH).days
                if r.is_rate:
                    self.rates.updateValue((day,), (r.value,))
                else:
                    self.pending.updateValue((day, int(r.tick_id)), (r.ts, r.value))
                    days.add(day)
        for day in days:  # a timer that is set twice fires once
            self.handle.registerTimer((day + 1) * DAY_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        ready = sorted((k, v) for k, v in self.pending.iterator() if k[0] <= day)
        known = sorted((k[0], v[0]) for k, v in self.rates.iterator())
        out = []
        for (own, tick), (ts, value) in ready:
            found = next(((d, rate) for d, rate in reversed(known) if d <= own), (None, None))
            rate = 1.0 if key[0] == "SEK" else found[1]
            when = None if found[0] is None or key[0] == "SEK" else EPOCH + dt.timedelta(days=found[0])
            out.append((key[0], tick, ts, value, rate, when, None if rate is None else value * rate))
            self.pending.removeKey((own, tick))
        # of the rates up to this day only the last can still be asked for
        for d, _ in [k for k in known if k[0] <= day][:-1]:
            self.rates.removeKey((d,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RATED.split(", ")]).astype({"rate_date": "object"})

    def close(self) -> None:
        pass


def with_streamed_rates(ticks: DataFrame, rates: DataFrame, late: str = "2 days", parts: int = 16) -> DataFrame:
    """Ticks (currency, tick_id, ts, value) with the latest rate of ``rates`` (currency, ts, sek_per_ccy) of their day or before, as both come in.

    A tick waits until the watermarks of both streams have passed its day, so a rate that is late by less than ``late`` still counts, and one of a later day never
    does. A tick without any rate so far has null; SEK is 1. A rate sent again for a day replaces that day's. State holds the ticks that wait and, of each
    currency, the rates since the last day that is done. A currency's ticks are dealt over ``parts`` keys and its rates sent to
    each, so one with most of all ticks isn't one task's.
    """
    one = ticks.withWatermark("ts", late).select("currency", F.pmod(F.xxhash64("tick_id"), F.lit(parts)).cast("int").alias("part"), "ts", F.lit(False).alias("is_rate"), F.col("tick_id").cast("long").alias("tick_id"), "value")
    two = rates.withWatermark("ts", late).select("currency", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "ts", F.lit(True).alias("is_rate"), F.lit(None).cast("long").alias("tick_id"), F.col("sek_per_ccy").alias("value"))
    return one.unionByName(two).groupBy("currency", "part").transformWithStateInPandas(RatesAsOf(), RATED, "Append", "EventTime")


# ---- new periods and silence

NOTICES = "role string, notice string, month int, at timestamp"


class Periods(StatefulProcessor):
    """A role's last month and when it was last heard; see ``period_notices``."""

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _schema("month int, at long, raised int"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        month, at, raised = self.seen.get() if self.seen.exists() else (None, None, 0)
        out, before = [], at
        for r in sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: (r.ts, r.month)):
            heard = int(r.ts.tz_localize("UTC").timestamp() * 1000) if r.ts.tzinfo is None else int(r.ts.timestamp() * 1000)
            if at is not None and heard > at:
                if heard - at >= self.silence_ms and not raised:  # it speaks again before its timer came to fire
                    out.append(self._stale(key, month, at))
                raised = 0
            at = heard if at is None else max(at, heard)
            if month is None or r.month > month:
                month = int(r.month)
                out.append((key[0], "new_period", month, r.ts))
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before + self.silence_ms)
            self.handle.registerTimer(at + self.silence_ms)
        self.seen.update((month, at, raised))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NOTICES.split(", ")])

    def _stale(self, key, month: int, at: int) -> tuple:
        return key[0], "stale", month, pd.Timestamp(at + self.silence_ms, unit="ms")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        month, at, raised = self.seen.get()
        out = [] if raised else [self._stale(key, month, at)]
        self.seen.update((month, at, 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NOTICES.split(", ")])

    def close(self) -> None:
        pass


def period_notices(picks: DataFrame, silence_days: int = 7, late: str = "1 day") -> DataFrame:
    """role, notice, month and at of the picks (role, month, ts): ``new_period`` for a month after all of the role's so far, ``stale`` once a role has sent nothing for ``silence_days``.

    Silence is told by an event-time timer, so it is raised by what other roles send, without anything of the silent one; whatever a role sends sets its timer anew.
    A role that speaks again in the batch in which its timer would have fired has been silent all the same, and is told once, however the rows are cut into batches.
    Months sent again or out of order give nothing.
    """
    return picks.withWatermark("ts", late).groupBy("role").transformWithStateInPandas(Periods(silence_days * DAY_MS), NOTICES, "Append", "EventTime")
