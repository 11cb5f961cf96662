"""Weights, costs, capacity, eligibility and as-of joins in both directions on small tables, against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from strandline.operators import portfolio, universe
from strandline.operators.asof import asof_both, asof_join


def test_asof_both_agrees_with_each_direction(spark):
    made = random.Random(9)
    left = spark.createDataFrame([(k, made.randrange(4), made.randrange(40)) for k in range(120)], "id int, c int, t int")
    right = spark.createDataFrame([(c, t, 10 * t) for c in range(3) for t in made.sample(range(40), 12)], "c int, t int, v int")
    got = {r.id: (r.ahead and r.ahead.v, r.back and r.back.v) for r in asof_both(left, right, ["c"], "t", ["v"]).collect()}
    ahead = {r.id: r.v for r in asof_join(left, right, ["c"], "t", ["v"], forward=True).collect()}
    back = {r.id: r.v for r in asof_join(left, right, ["c"], "t", ["v"]).collect()}
    assert got == {k: (ahead[k], back[k]) for k in ahead}


def test_weights(spark):
    rows = [("equal", 4, 1, None, None), ("equal", 4, 2, None, None), ("cap", 4, 1, 30.0, None), ("cap", 4, 2, 10.0, None), ("cap", 4, 3, None, None), ("inv_vol", 2, 1, None, 0.1), ("inv_vol", 2, 2, None, 0.3)]
    rows += [("none", 2, 1, None, None), ("none", 2, 2, -1.0, None)]
    df = spark.createDataFrame([(k, "cap" if k == "none" else k, *rest) for k, *rest in rows], "c string, weighting string, top_n int, number int, market_cap_sek double, volatility double")
    got = {(r.c, r.number): round(r.weight, 9) for r in portfolio.weighted(df, ["c"]).collect()}
    assert got == {("equal", 1): 0.25, ("equal", 2): 0.25, ("cap", 1): 0.5625, ("cap", 2): 0.1875, ("cap", 3): 0.0, ("inv_vol", 1): 0.75, ("inv_vol", 2): 0.25, ("none", 1): 0.5, ("none", 2): 0.5}


def test_costs_and_capacity(spark):
    rows = [(5e7, 100.0, "SEK"), (5e7, 49.0, "EUR"), (5e6, 100.0, "SEK"), (4e6, 100.0, "SEK"), (1e6, 100.0, "SEK"), (0.0, 100.0, "SEK"), (None, 100.0, "SEK")]
    df = spark.createDataFrame(rows, "median_value double, close_sek double, currency string")
    cost = [r[0] for r in df.select(universe.tiered_cost_bps(F.lit(10))).collect()]
    # orders of 25,000: brokerage 9; spread 15, 60, 100; taken 0.0005, 0.005, 0.00625, 0.025; times 1.25
    assert cost[:2] == [9 + 15 * 1.25, 9 + 15 * 1.25 + 10 + 25] and cost[2] == 9 + (60 + 10) * 1.25 and cost[3] == 9 + (100 + 20) * 1.25 and cost[4:] == [None] * 3
    high = df.select(universe.tiered_cost_bps(F.lit(10), universe.IMPACT["next_close"], universe.CURRENCY_BPS["high"])).collect()
    assert high[1][0] == 9 + 15 + 10 + 50
    assert [r[0] for r in df.select(universe.within_capacity(F.lit(10))).collect()] == [True, True, True, True, False, False, False]


def test_entries_and_exits_are_charged(spark):
    book = spark.createDataFrame([("a", 1, 7, 0.5, 0.1, 2), ("a", 1, 8, 0.5, 0.0, 2), ("a", 2, 8, 1.0, 0.2, 2), ("a", 4, 8, 1.0, 0.0, 2)], "candidate_id string, month int, number int, weight double, ret double, top_n int")
    facts = spark.createDataFrame([(7, 1, 0.01), (7, 2, 0.03), (8, 1, 0.02), (8, 4, None)], "number int, month int, fee double")
    months = spark.createDataFrame([("a", m) for m in range(1, 5)], "candidate_id string, month int")
    got = {r.month: (round(r.gross, 9), round(r.cost, 9), r.entries, r.exits, r.held) for r in portfolio.period_returns(book, F.col("fee"), facts, months=months).collect()}
    assert got == {1: (0.05, 0.015, 2, 0, 2), 2: (0.2, 0.015, 0, 1, 1), 3: (0.0, 0.0, 0, 1, 0), 4: (0.0, 0.0, 1, 0, 1)}
    flat = {r.month: round(r.cost, 9) for r in portfolio.period_returns(book, 0.01).collect()}
    assert flat == {1: 0.01, 2: 0.005, 4: 0.01}


def _bars(number, issuer, last=23, price=100.0, share_class="ordinary", exchange="ST", delisted=False, shares=1000.0, currency="SEK", odd=()):
    days = [dt.date(2020 + m // 12, m % 12 + 1, d) for m in range(24) for d in (3, 25) if m <= last]
    return [(number, d, *[price * (5 if d in odd else 1)] * 4, 1e5, f"S{number:02d}", exchange, "SE", currency, issuer, shares, share_class, delisted) for d in days]


def test_reasons_in_their_order(spark):
    rows = _bars(1, 1) + _bars(2, 2, share_class="preferred") + _bars(3, 3, exchange="XX") + _bars(4, 4, exchange="CO", price=200.0) + _bars(5, 4, price=90.0) + _bars(6, 6, last=20, delisted=True)
    rows += _bars(7, 7, price=19.0) + _bars(8, 8, odd=(dt.date(2021, 11, 25),)) + _bars(9, 9, shares=None) + [r for r in _bars(10, 10) if r[1] != dt.date(2021, 11, 25)]
    schema = "number long, date date, open_raw double, high_raw double, low_raw double, close_raw double, volume double, security_id string, exchange_group string, country_code string, currency string, issuer_group_id long, shares double, share_class string, is_delisted boolean"
    rates = spark.createDataFrame([("EUR", dt.date(2019, 1, 1), 10.0)], "currency string, date date, sek_per_ccy double")
    actions = spark.createDataFrame([], "number long, date date, action_type string, action_value double, action_ratio double")
    daily = universe.daily_panel(spark.createDataFrame(rows, schema), rates, actions)
    last = 2021 * 12 + 10
    got = {r.number: r for r in universe.universe(daily).where(f"month = {last}").collect()}
    want = {1: "", 2: "non_common_share", 3: "excluded_venue", 4: "", 5: "non_primary_listing", 6: "stale_last_trade", 7: "price_below_min_sek", 8: "bad_outlier_data", 9: "", 10: "stale_last_trade"}
    assert {k: r.reason for k, r in got.items()} == want
    assert got[4].reason_se == "outside_se_only_scope" and got[1].reason_se == "" and got[6].delisted_before_execution
    assert {r.liquid_reason for r in got.values() if r.reason == ""} == {"market_cap_data_unavailable"}  # over 5 % have no value
    early = {r.reason for r in universe.universe(daily).where(f"month = {2021 * 12 + 5} and number = 1").collect()}
    assert early == {"too_short_listing_history"}
    caps = spark.createDataFrame([(n, last, 1e6 * n, "vendor") for n in (1, 4, 9)], "number long, month int, market_cap_sek double, source string")
    valued = {r.number: (r.market_cap_sek, r.status_source) for r in universe.universe(daily, caps).where(f"month = {last}").collect()}
    assert valued[4] == (4e6, "vendor") and valued[2] == (None, "missing_market_cap")
