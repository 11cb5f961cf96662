"""Streams with typed state: restarts from history, replays, late and missing rates, alarms for silence."""

import collections
import datetime as dt

import pytest

from strandline.streaming import stateful, ticks


def written(spark, folder, batches, schema):
    """Write the batches as one file each and give the stream over them, a file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return ticks.read_ticks(spark, str(folder), spark.createDataFrame([], schema).schema, files_a_batch=1)


@pytest.fixture(autouse=True)
def store(spark):
    stateful.with_state_store(spark)


def position(name, weight, price, bps=10.0, pick=True):
    return (name, weight, price, bps, pick)


MONTHS = [
    ("lead", 5, dt.date(2024, 1, 2), [position("A", 0.5, 10.0), position("B", 0.5, 20.0)]),
    ("other", 5, dt.date(2024, 1, 2), [position("A", None, 10.0, None), position("Z", 0.5, None)]),
    ("lead", 6, dt.date(2024, 2, 1), [position("A", 0.5, 12.0), position("C", None, 5.0, 20.0), position("B", None, 25.0, None, False)]),
    ("lead", 7, dt.date(2024, 3, 1), [position("B", 0.4, 22.0), position("C", 0.6, 6.0)]),
    ("other", 7, dt.date(2024, 3, 1), None),
    ("lead", 7, dt.date(2024, 3, 8), [position("B", 0.5, 23.0), position("C", 0.5, 6.0)]),
]


def plain(rows, start):
    """The ledger by a plain loop: trades (role, date, month, name, value, shares, cost) and history (role, date, month, before, after, return, cost, cash)."""
    trades, history = [], []
    accounts = collections.defaultdict(lambda: {"cash": start, "value": start, "held": {}, "last": None})
    for role, month, date, positions in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        a = accounts[role]
        if a["last"] is not None and (date < a["last"][0] or (date, month) == a["last"]):
            continue
        own = [p for p in positions or [] if p[2]]
        picks = [p for p in own if p[4]]
        for p in own:
            if p[0] in a["held"]:
                a["held"][p[0]]["price"] = p[2]
        price = {k: h["price"] for k, h in a["held"].items()} | {p[0]: p[2] for p in own}
        bps = {k: h["bps"] for k, h in a["held"].items()} | {p[0]: p[3] or 0.0 for p in picks}
        before = a["cash"] + sum(h["n"] * price[k] for k, h in a["held"].items())
        weight = {p[0]: 1 / len(picks) if p[1] is None else p[1] for p in picks}
        total = before
        for attempt in range(2):
            own_trades = []
            for k in sorted(set(a["held"]) | set(weight)):
                value = total * weight.get(k, 0) - a["held"].get(k, {"n": 0.0})["n"] * price[k]
                if abs(value) >= 1:
                    own_trades.append((k, value, value / price[k], abs(value) * bps.get(k, 0) / 1e4))
            cost = sum(t[3] for t in own_trades)
            if attempt or cost == 0 or a["cash"] - sum(t[1] + t[3] for t in own_trades) >= 0:
                break
            total = before - cost
        for k, value, n, c in own_trades:
            a["cash"] -= value + c
            h = a["held"].setdefault(k, {"n": 0.0})
            h |= {"n": h["n"] + n, "price": price[k], "bps": bps.get(k, 0.0)}
            trades.append((role, date, month, k, value, n, c))
        a["held"] = {k: h for k, h in a["held"].items() if abs(h["n"]) >= 1e-6}
        after = a["cash"] + sum(h["n"] * h["price"] for h in a["held"].values())
        history.append((role, date, month, before, after, before / a["value"] - 1, cost, a["cash"]))
        a["value"], a["last"] = after, (date, month)
    return trades, history


def split(rows):
    trades = sorted((r.role, r.trade_date, r.month, r.security_id, r.trade_value, r.shares_delta, r.cost) for r in rows if r.record == "trade")
    history = sorted((r.role, r.trade_date, r.month, r.value_before, r.value_after, r.period_return, r.cost, r.cash_after) for r in rows if r.record == "history")
    return trades, history


def same(got, want):
    assert [g[:4] if isinstance(g[3], str) else g[:3] for g in got] == [w[:4] if isinstance(w[3], str) else w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert [x for x in g if isinstance(x, float)] == pytest.approx([float(x) for x in w[3:] if not isinstance(x, str)], abs=1e-8)


def test_ledger_replays_and_starts_from_history(spark, tmp_path):
    schema = stateful.PICKS
    want = plain(MONTHS, 1000.0)
    # everything is sent again in a later batch, and old months once more
    stream = written(spark, tmp_path / "in", [MONTHS[:2], MONTHS[2:4] + MONTHS[:1], MONTHS, MONTHS[::-1]], schema)
    ticks.run_available(stateful.paper_ledger(stream, 1000.0), str(tmp_path / "whole"), str(tmp_path / "c1"))
    whole = spark.read.parquet(str(tmp_path / "whole")).collect()
    for got, own in zip(split(whole), want, strict=True):
        same(got, sorted(own))
    assert len(whole) == 6 + len(want[0])

    # stopped after the second month, and begun anew, without the checkpoint, from what was written
    first = written(spark, tmp_path / "in1", [MONTHS[:3]], schema)
    ticks.run_available(stateful.paper_ledger(first, 1000.0), str(tmp_path / "early"), str(tmp_path / "c2"))
    history = spark.read.parquet(str(tmp_path / "early"))
    state = {r.role: r for r in stateful.recorded(history).collect()}
    assert state["lead"].month == 6 and sorted(h.security_id for h in state["lead"].holdings) == ["A", "C"]
    assert {h.security_id: (h.entry_price, str(h.entry_date)) for h in state["lead"].holdings} == {"A": (10.0, "2024-01-02"), "C": (5.0, "2024-02-01")}
    later = written(spark, tmp_path / "in2", [MONTHS], schema)
    ticks.run_available(stateful.paper_ledger(later, 1000.0, history), str(tmp_path / "late"), str(tmp_path / "c3"))
    for got, own in zip(split(history.collect() + spark.read.parquet(str(tmp_path / "late")).collect()), want, strict=True):
        same(got, sorted(own))


def at(day, hour=12):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day - 1)


def test_rates_as_a_stream(spark, tmp_path):
    tick, rate = "currency string, tick_id long, ts timestamp, value double", "currency string, ts timestamp, sek_per_ccy double"
    far = [("EUR", 900 + k, at(20 + k), 1.0) for k in range(2)]
    sent = [
        [("EUR", 1, at(2), 10.0), ("EUR", 2, at(3, 1), 10.0), ("DKK", 3, at(3), 5.0), ("SEK", 4, at(3), 7.0)],
        [("EUR", 5, at(5), 10.0), ("EUR", 6, at(1), 10.0)],
        far[:1], far[1:],
    ]
    rates = [
        [("EUR", at(2, 0), 11.0), ("DKK", at(4, 0), 1.5)],  # krone: only after its tick
        [("EUR", at(4, 0), 12.0), ("EUR", at(3, 0), 11.5)],  # the third's comes late, after the fourth's
        [("EUR", at(6, 0), 13.0), ("EUR", at(20, 0), 14.0)],
        [("EUR", at(25, 0), 15.0)],
    ]
    joined = stateful.with_streamed_rates(written(spark, tmp_path / "t", sent, tick), written(spark, tmp_path / "r", rates, rate), parts=3)
    ticks.run_available(joined, str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r.tick_id: (r.sek_per_ccy, r.rate_date and r.rate_date.day, r.value_sek) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {1: (11.0, 2, 110.0), 2: (11.5, 3, 115.0), 3: (None, None, None), 4: (1.0, None, 7.0), 5: (12.0, 4, 120.0), 6: (None, None, None)}
    assert {k: v for k, v in got.items() if k < 900} == want
    # the last ticks' days aren't over yet, and a future rate is never taken
    assert all(v[0] in (14.0,) for k, v in got.items() if k >= 900)


def test_silence_raises_an_alarm(spark, tmp_path):
    schema = "role string, month int, ts timestamp"
    batches = [
        [("lead", 5, at(1)), ("other", 5, at(1)), ("lead", 5, at(2))],
        [("other", 5, at(5)), ("other", 4, at(5))],
        [("other", 6, at(9)), ("other", 6, at(10))],
        [("other", 6, at(15)), ("lead", 6, at(15))],
        [("other", 6, at(17))],
        [("other", 6, at(20)), ("other", 6, at(23))],
        [("other", 6, at(24))],
    ]
    # in batches, so timers fire, and in one, so they are all overtaken but the last
    for name, cut in (("many", batches), ("few", [[r for b in batches for r in b], [("other", 6, at(24))]])):
        ticks.run_available(stateful.period_notices(written(spark, tmp_path / f"{name} in", cut, schema)), str(tmp_path / name), str(tmp_path / f"{name} c"))
        got = sorted((r.role, r.notice, r.month, r["at"]) for r in spark.read.parquet(str(tmp_path / name)).collect())
        assert got == [
            ("lead", "new_period", 5, at(1)), ("lead", "new_period", 6, at(15)), ("lead", "stale", 5, at(9)), ("lead", "stale", 6, at(22)),
            ("other", "new_period", 5, at(1)), ("other", "new_period", 6, at(9)),
        ]
