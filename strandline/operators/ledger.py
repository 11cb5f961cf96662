"""A paper ledger: holdings and cash of each portfolio, traded to target weights month by month."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

#: Trades under so many SEK are left out, and so few shares are none.
LEAST_TRADE, LEAST_SHARES = 1.0, 1e-6
SCHEMA = "candidate_id string, month int, number long, action string, shares_delta double, price double, trade_value double, cost double, cash_after double"


def rebalance(holdings: dict[int, float], cash: float, targets: dict[int, float], prices: dict[int, float], rate: float) -> list[tuple[int, float, float, float]]:
    """(number, shares, value, cost) of the trades to ``targets`` weights of all the portfolio is worth.

    If cash would go below zero, it is done again with what is worth less the cost of the first try.
    """
    worth = cash + sum(n * prices[k] for k, n in holdings.items())
    budget, trades = worth, []
    for _ in range(2):
        trades = []
        for k in sorted(holdings.keys() | targets.keys()):
            value = targets.get(k, 0.0) * budget - holdings.get(k, 0.0) * prices[k]
            if abs(value) >= LEAST_TRADE:
                trades.append((k, value / prices[k], value, abs(value) * rate))
        cost = sum(t[3] for t in trades)
        if cash - sum(t[2] for t in trades) - cost >= 0:
            break
        budget = worth - cost
    return trades


def ledger(book: DataFrame, prices: DataFrame, start: float, cost_bps: float) -> DataFrame:
    """The trades of each candidate of ``book`` (candidate_id, month, number, weight) at ``prices`` (number, month, price).

    A month without a price takes the name's last one. One group is a candidate's own names over all months, which the book's size bounds.
    Names without any price yet aren't traded.
    """
    held = book.select("candidate_id", "number").distinct()
    quotes = held.join(prices.where("price > 0").select("number", "month", "price"), "number")
    rows = quotes.join(book.select("candidate_id", "month", "number", "weight"), ["candidate_id", "month", "number"], "left")

    def fold(group: pa.Table) -> pa.Table:
        months: dict[int, list] = {}
        for r in group.to_pylist():
            months.setdefault(r["month"], []).append(r)
        out, holdings, last, cash = [], {}, {}, start
        for month in sorted(months):
            last |= {r["number"]: r["price"] for r in months[month]}
            targets = {r["number"]: r["weight"] for r in months[month] if r["weight"] is not None}
            if not targets and not holdings:
                continue
            for k, shares, value, cost in rebalance(holdings, cash, targets, last, cost_bps / 1e4):
                action = "enter" if k not in holdings else "exit" if k not in targets else "adjust"
                holdings[k] = holdings.get(k, 0.0) + shares
                cash -= value + cost
                out.append((group["candidate_id"][0].as_py(), month, k, action, shares, last[k], value, cost, cash))
            holdings = {k: n for k, n in holdings.items() if abs(n) >= LEAST_SHARES}
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string()] + [pa.float64()] * 5
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.groupBy("candidate_id").applyInArrow(fold, SCHEMA)
